"""BM25 over a corpus (postings) and inside single documents (passages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, term_rows, token_count, tokens, windows

K1, B = 1.5, 0.75
MIN_RELEVANCE, PER_DOCUMENT = 0.05, 8


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """query_id, term, qtf: repeated terms count as often as they stand in the query."""
    return term_rows(queries, id_col, text_col).groupBy(id_col, "term").agg(F.count("*").cast("double").alias("qtf"))


def postings(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, tf. With `terms` only their postings: other tokens are dropped before the exchange."""
    rows = term_rows(docs, id_col, text_col)
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", id_col).agg(F.count("*").cast("double").alias("tf"))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, len: tokens of each document, those without any included. A projection: nothing is exchanged."""
    return docs.select(id_col, token_count(F.col(text_col)).cast("double").alias("len"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score: scores over the corpus as share of each query's best; documents without a hit are left out.

    Only postings of query terms are exchanged. Corpus figures are a one-row aggregate; document lengths are
    joined to the documents that have hits.
    """
    terms = query_terms(queries)
    hits = postings(docs, terms, id_col, text_col)
    lengths = document_lengths(docs, id_col, text_col)
    corpus = lengths.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("mean"))
    frequency = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weights = terms.join(frequency, "term")
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("mean"))
    rows = hits.join(weights, "term").join(lengths, id_col).join(F.broadcast(corpus))  # one row
    raw = rows.groupBy("query_id", id_col).agg(F.sum(part).alias("raw"))
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"))
    return raw.join(best, "query_id").select("query_id", id_col, (F.col("raw") / F.col("best")).alias("score"))


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id")))
    return bm25(docs, queries).withColumn("rank", rank).where(F.col("rank") <= k)


def passage_scores(text: Column, query: Column, heading_mode: str = "line") -> Column:
    """array<struct<window_no, text, section, char_offset, relevance>> of a document's windows, best first.

    Scores are scoped to the document, so all of it is one row's projection: no explosion, no exchange. A matching document's
    best window has relevance 1; windows under MIN_RELEVANCE and beyond PER_DOCUMENT are dropped.
    """

    def scored(counted: Column, asked: Column) -> Column:
        n = F.size(counted).cast("double")
        total = F.aggregate(counted, F.lit(0.0), lambda s, w: s + w["len"])
        mean = total / n
        weights = F.transform(F.sequence(F.lit(0), F.size(asked) - 1), lambda q: idf(n, F.size(F.filter(counted, lambda w: F.get(w["tf"], q) > 0)).cast("double")))

        def score(w: Column, mean: Column, weights: Column) -> Column:
            parts = F.zip_with(w["tf"], weights, lambda tf, weight: F.when(tf > 0, weight * saturation(tf, w["len"], mean)).otherwise(F.lit(0.0)))
            return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

        raw = let(F.struct(mean.alias("mean"), weights.alias("weights")), lambda c: F.transform(counted, lambda w, i: F.struct(i.cast("long").alias("window_no"), w["w"]["text"].alias("text"), w["w"]["section"].alias("section"), w["w"]["char_offset"].alias("char_offset"), score(w, c["mean"], c["weights"]).alias("relevance"))))
        return let(raw, ranked)

    def ranked(raw: Column) -> Column:
        best = F.array_max(F.transform(raw, lambda w: w["relevance"]))
        shares = let(best, lambda top: F.transform(raw, lambda w: w.withField("relevance", F.when(top > 0, w["relevance"] / top).otherwise(F.lit(0.0)))))
        kept = F.filter(shares, lambda w: w["relevance"] >= MIN_RELEVANCE)
        ordered = F.array_sort(kept, lambda a, b: F.when(a["relevance"] > b["relevance"], -1).when(a["relevance"] < b["relevance"], 1).otherwise(F.when(a["window_no"] < b["window_no"], -1).otherwise(1)))
        return F.slice(ordered, 1, PER_DOCUMENT)

    def counts(asked: Column) -> Column:
        return F.transform(windows(text, heading_mode), lambda w: let(tokens(w["text"]), lambda t: F.struct(w.alias("w"), F.size(t).cast("double").alias("len"), F.transform(asked, lambda q: F.size(F.filter(t, lambda x: x == q)).cast("double")).alias("tf"))))

    empty = F.array().cast("array<struct<window_no:bigint,text:string,section:string,char_offset:bigint,relevance:double>>")
    made = let(tokens(query), lambda asked: F.when(F.size(asked) > 0, let(counts(asked), lambda c: F.when(F.size(c) > 0, scored(c, asked)))))
    return F.coalesce(made, empty)


def passages(pairs: DataFrame, text_col: str = "text", query_col: str = "query", heading_mode: str = "line") -> DataFrame:
    """One row per passage of each row of `pairs` (a document with a query), its other columns kept."""
    rest = [c for c in pairs.columns if c not in (text_col, query_col)]
    rows = pairs.select(*rest, F.explode(passage_scores(F.col(text_col), F.col(query_col), heading_mode)).alias("__p"))
    return rows.select(*rest, "__p.window_no", "__p.text", "__p.section", "__p.char_offset", "__p.relevance")


__all__ = ["B", "K1", "bm25", "document_lengths", "passage_scores", "passages", "postings", "query_terms", "top_documents"]
