"""Conversations read back from their ids."""

import hashlib

import duckdb

from gleanery.llm import chat

SAID = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "user", "é\\ <s>"), (1, 1, "assistant", "first\\"), (1, 2, "assistant", ""), (1, 3, "assistant", "<|turn|>😀"), (1, 3, "assistant", "<|turn|>😀"), (2, 0, None, None), (None, 0, "assistant", "a"), (None, 0, "assistant", "b"),
    (3, 0, "assistant", "word " * 40_000 + SAID), (4, 0, "as\nsistant", SAID), (5, None, "assistant", None),
]
SCHEMA = "conv_id long, turn long, role string, text string, ids string, size int"


def digests(rows):
    seen = {}
    for at, (conv, *rest) in enumerate(rows):
        seen.setdefault((conv, at if conv is None else 0), []).append(rest)
    out = []
    for (conv, _), turns in seen.items():
        turns = sorted([(-1 if t is None else t, r or "", x or "") for t, r, x in turns])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_ids_hold_turns_and_loss(spark):
    formatted = chat.format_conversations(spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA))
    got = chat.read_conversations(formatted).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == digests(ROWS)
    with open(chat.VOCABULARY, "rb") as f:
        encoding, base = chat.load_vocabulary(f.read())
    import numpy as np

    for r in formatted.collect():  # string and ids say the same
        assert chat.read_turns(np.array(r.ids), encoding.decode_bytes, base) == chat.parse(r.formatted)
        assert len(r.loss_mask) == len(r.ids)


def test_registered_query(spark, tmp_path):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ROWS if r[1] is not None], SCHEMA)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = sorted(con.execute(chat.OP2_SQL).fetchall(), key=str)
    assert sorted([tuple(r) for r in chat.op2_chat_formatting(spark, str(tmp_path)).collect()], key=str) == expected


def test_empty(spark):
    formatted = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert formatted.count() == 0
    assert chat.read_conversations(formatted).count() == 0
