"""Text functions as Column expressions: tokens, stems, fingerprints, windows, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English words without topical signal.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could", "not", "no",
    "it", "its", "this", "that", "these", "those", "i", "we", "you", "he", "she", "they", "what", "which", "who", "how", "when", "where", "why",
    "as", "if", "than", "then", "so", "also", "just", "more", "into", "about", "up", "out", "after", "before", "between", "through",
]

# Suffix, least length of the word, characters dropped, characters added. The first that fits applies, to words of four letters and more.
SUFFIXES = [
    ("ings", 7, 4, ""), ("ing", 6, 3, ""), ("tions", 4, 5, ""), ("tion", 4, 4, ""), ("ments", 4, 5, ""), ("ment", 4, 4, ""), ("able", 7, 4, ""), ("ible", 7, 4, ""),
    ("ness", 7, 4, ""), ("ers", 6, 3, ""), ("er", 5, 2, ""), ("ed", 5, 2, ""), ("ies", 5, 3, "y"), ("es", 5, 2, ""), ("s", 4, 1, ""),
]

WINDOW, OVERLAP = 800, 150
HEADING = r"^(#{1,4}\s+.+|={3,}|-{3,}|\[Page \d+\])"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression used in many places is otherwise repeated in each."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def stem(word: Column) -> Column:
    """Light suffix stripping; `tion` and `ment` become the empty stem, which is a legal term."""
    found = F.when(F.length(word) <= 3, word)
    for suffix, least, drop, add in SUFFIXES:
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) >= least)
        if suffix == "s":
            fits &= ~F.endswith(word, F.lit("ss"))
        cut = F.left(word, F.length(word) - drop)
        found = found.when(fits, F.concat(cut, F.lit(add)) if add else cut)
    return found.otherwise(word)


def raw_words(text: Column, unicode: bool = False) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+")


def is_term(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(STOPWORDS)


def tokens(text: Column, unicode: bool = False) -> Column:
    """Stemmed tokens in order; stopwords and single characters are dropped before stemming. Null gives null."""
    return F.transform(F.filter(raw_words(text, unicode), is_term), stem)


def token_count(text: Column) -> Column:
    """How many tokens a text has; none of them is stemmed. Null gives 0."""
    return F.coalesce(F.size(F.filter(raw_words(text), is_term)), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def term_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unicode: bool = False) -> DataFrame:
    """A row (id, term) for each token: the exploded form, whose filter and stems stay in generated code."""
    words = docs.select(id_col, F.explode(raw_words(F.col(text_col), unicode)).alias("__w")).where(is_term(F.col("__w")))
    return words.select(id_col, stem(F.col("__w")).alias("term"))


def fingerprint(text: Column) -> Column:
    """What near-equal passages share: lower case, single blanks, 200 characters."""
    return F.substring(strip(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, 200)


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]*>", " "))


def plain_text(text: Column) -> Column:
    """LF line ends, no NUL characters."""
    return F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\x00"), F.lit(""))


def bare_links(text: Column) -> Column:
    """Distinct http(s) URLs in plain text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s<>"')\]]+)"""), F.lit(1)))


def chunks(text: Column, offset: Column, section: Column) -> Column:
    """Windows of WINDOW characters, each OVERLAP before the last one's end: array<struct<text, section, char_offset>>."""
    step = WINDOW - OVERLAP
    last = F.greatest(F.ceil((F.length(text) - WINDOW) / F.lit(float(step))), F.lit(0)).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.substring(text, i * step + 1, F.lit(WINDOW)).alias("text"), section.alias("section"), (offset + i * step).cast("long").alias("char_offset")))
    return F.when(F.length(text) > 0, made).otherwise(F.slice(made, 1, 0))


def windows(text: Column, heading_mode: str = "line") -> Column:
    """Passage windows of a text: array<struct<text, section, char_offset>>.

    Paragraphs (split at blank lines) gather until a heading starts a section. A paragraph that starts with a heading line
    is all heading in mode 'paragraph'; in mode 'line' only its first line is, and the rest begins the section's text.
    """
    kind = "struct<done:array<struct<text:string,section:string,offset:bigint>>,section:string,buffer:string,start:bigint,at:bigint>"
    first = F.struct(F.lit(None), F.lit(None), F.lit(""), F.lit(0), F.lit(0)).cast(kind)

    def flushed(s: Column) -> Column:
        done = F.coalesce(s["done"], F.array().cast("array<struct<text:string,section:string,offset:bigint>>"))
        return F.when(strip(s["buffer"]) != "", F.concat(done, F.array(F.struct(s["buffer"].alias("text"), s["section"].alias("section"), s["start"].alias("offset"))))).otherwise(done)

    def step(s: Column, para: Column) -> Column:
        body = strip(para)
        head, rest = (body, F.lit("")) if heading_mode == "paragraph" else (F.regexp_extract(body, r"^([^\n]*)", 1), strip(F.regexp_replace(body, r"^[^\n]*\n?", "")))
        title = F.regexp_replace(F.regexp_replace(head, r"^#+\s*", ""), r"^\[|\]$", "")
        at = s["at"] + F.length(para) + 2
        opened = F.struct(flushed(s).alias("done"), title.alias("section"), rest.alias("buffer"), s["at"].alias("start"), at.alias("at"))
        longer = F.concat(s["buffer"], F.when(s["buffer"] != "", "\n\n").otherwise(""), body)
        grown = F.struct(s["done"].alias("done"), s["section"].alias("section"), longer.alias("buffer"), s["start"].alias("start"), at.alias("at"))
        return F.when(F.regexp_like(body, F.lit(HEADING)), opened.cast(kind)).otherwise(grown.cast(kind))

    blocks = F.aggregate(F.split(text, r"\n{2,}"), first, step, flushed)
    return F.flatten(F.transform(blocks, lambda b: chunks(b["text"], b["offset"], b["section"])))
