"""Chat formatting by token-level assembly.

Each turn's role and text are encoded separately, and reserved ids (numbers beyond the vocabulary) are
spliced between the segments, so that no text can produce a control token. The loss mask is a prefix sum
over +1/-1 marks at the borders of assistant texts. The formatted string carries the same structure: its
control strings are broken up inside roles and texts by a backslash, which is reversible. Turns and the text under the
mask are read back from the ids alone.

Template: `<s>`, then for each turn `<|turn|>role<|body|>text</s>`.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

# Control strings of the template and of common chat templates, escaped wherever a text holds them.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|body|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>"]
BEGIN, TURN, BODY, END = "<s>", "<|turn|>", "<|body|>", "</s>"
RESERVED = {BEGIN: 0, TURN: 1, BODY: 2, END: 3}  # added to the vocabulary's size
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)

FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """Break every control string behind its first character, and double every backslash."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:] if m[0] != "\\" else "\\\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted[len(BEGIN) :])]


def assemble(turns: list[tuple[str, str]], encode, base: int):
    """Formatted string, ids, token loss mask and the mask's spans of code points."""
    pieces, ids, marks, spans = [BEGIN], [[base + RESERVED[BEGIN]]], [], []
    at, token = len(BEGIN), 1
    for role, text in turns:
        for string, control in ((TURN, True), (escape(role), False), (BODY, True), (escape(text), False), (END, True)):
            part = [base + RESERVED[string]] if control else encode(string)
            pieces.append(string)
            ids.append(part)
            if role == "assistant" and not control and pieces[-2] == BODY:
                marks += [(token, 1), (token + len(part), -1)]
                spans.append((at, at + len(string)))
            at, token = at + len(string), token + len(part)
    delta = np.zeros(token + 1, np.int64)
    for where, change in marks:
        delta[where] += change
    return "".join(pieces), np.concatenate(ids).astype(np.int32), np.cumsum(delta)[:-1] > 0, spans


def load_vocabulary(data: bytes):
    """A byte-level BPE given as tiktoken ranks, and the first id behind its vocabulary."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def load_encoder(data: bytes):
    """`encode_ordinary` of the vocabulary, and the first id behind it."""
    encoding, base = load_vocabulary(data)
    return encoding.encode_ordinary, base


def read_turns(ids: np.ndarray, decode, base: int) -> list[tuple[str, str]]:
    """Roles and texts of a conversation's ids: what stands between turn and body, and between body and end."""
    turn, body, end = (np.flatnonzero(ids == base + RESERVED[mark]) for mark in (TURN, BODY, END))
    segment = lambda a, b: unescape(decode(ids[a + 1 : b].tolist()).decode())
    return [(segment(a, b), segment(b, c)) for a, b, c in zip(turn, body, end, strict=True)]


def read_loss(ids: np.ndarray, mask: np.ndarray, decode) -> str:
    """The text under the mask, unescaped, one run of the mask after another."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return "".join(unescape(decode(ids[a:b].tolist()).decode()) for a, b in zip(edge[::2], edge[1::2], strict=True))


def _assembled(vocabulary):
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(batches):
        encode, base = load_encoder(vocabulary.value)
        rows, turns, open_, current = [], [], False, None

        def close():
            formatted, ids, mask, spans = assemble(turns, encode, base)
            rows.append({"conv_id": current, "n_turns": len(turns), "formatted": formatted, "ids": ids, "loss_mask": mask, "loss_spans": [{"start": a, "end": b} for a, b in spans]})

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and (conv is None or conv != current):
                    close()
                    turns = []
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows.clear()
                open_, current = True, conv
                turns.append((role or "", text or ""))
        if open_:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def format_conversations(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation (schema FORMATTED) from conv_id, turn, role, text.

    Turns stand in order of turn, then role, then text (nulls first), so that ties and repeated rows, all
    of which are kept, have one order. Null texts and roles are empty. Each row without conv_id is a conversation
    of its own. Other columns are ignored; an empty table gives an empty table. One conversation at a time, its texts
    whole, is held in memory: it is one result row.
    The vocabulary (under 1 MB) is read on the driver and broadcast.
    """
    spark = conversations.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition(partitions(spark), F.coalesce(F.col("conv_id").cast("long"), F.xxhash64("turn", "role", "text")))
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text")
        .mapInArrow(_assembled(shared), FORMATTED)
    )


def _read_back(vocabulary):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        encoding, base = load_vocabulary(vocabulary.value)
        for batch in batches:
            rows = []
            for conv, size, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, mask = np.array(ids, np.int64), np.array(mask, bool)
                turns, loss = read_turns(ids, encoding.decode_bytes, base), read_loss(ids, mask, encoding.decode_bytes)
                seen = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), hashlib.sha256(seen.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)], names=names)

    return run


def read_conversations(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests (schema READ_BACK) of the turns and of the text under the loss mask, decoded from format_conversations' ids."""
    with open(vocabulary, "rb") as f:
        shared = formatted.sparkSession.sparkContext.broadcast(f.read())
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("size"), "ids", "loss_mask").mapInArrow(_read_back(shared), READ_BACK)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)),
     e AS (SELECT *, length(regexp_replace(role, '(\\|<s>|</s>|\[/?INST\]|<\|turn\|>|<\|body\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<</?SYS>>)', '\1x', 'g'))
                     + length(regexp_replace(text, '(\\|<s>|</s>|\[/?INST\]|<\|turn\|>|<\|body\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<</?SYS>>)', '\1x', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n + 8 + 8 + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, lone
"""


def op2_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_conversations(format_conversations(rows))
