"""Subtrees against brute force, and passages that many chunks share."""

import random

import numpy as np
import pytest

from gleanery.llm import substring_dedup as S


@pytest.mark.parametrize("seed", range(6))
def test_subtree_and_deep_nodes(seed):
    rnd = random.Random(seed)
    runs = [[rnd.randrange(1, 3) for _ in range(rnd.randrange(4, 60))] for _ in range(12)]
    words = np.array([w for r in runs for w in r], np.uint64)
    ends = np.repeat(np.cumsum([len(r) for r in runs]), [len(r) for r in runs])
    starts = np.array([i for i in range(len(words)) if ends[i] - i >= 4])
    order, common = S.subtree(words, ends, starts, 16)
    shown = [words[s : min(ends[s], s + 16)].tolist() for s in starts[order]]
    assert [x[:16] for x in shown] == sorted(shown)
    for x, y, n in zip(shown, shown[1:], common, strict=False):
        k = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert n == k
    first, last, lengths = S.deep_nodes(common, 4)
    groups = {}
    for i, x in enumerate(shown):
        groups.setdefault(tuple(x[:4]), []).append(i)
    assert [(a, b) for a, b in zip(first, last, strict=True)] == [(g[0], g[-1]) for g in sorted(groups.values()) if len(g) > 1]
    assert lengths.tolist() == [min(common[a:b]) for a, b in zip(first, last, strict=True)]


def test_leaves_of_a_bounded_group_and_of_a_large_one_agree():
    rnd = np.random.default_rng(2)
    words = rnd.integers(1, 3, 400).astype(np.uint64)
    ends, starts = np.full(400, 400), np.arange(396)
    ids, places = rnd.integers(0, 5, 396), np.arange(396)
    whole = S.later_leaves(words, ends, starts, ids, places, 4, 1 << 20)
    assert (whole == S.later_leaves(words, ends, starts, ids, places, 4, 10)).all()
    seen = {}
    for i in sorted(range(396), key=lambda i: (ids[i], places[i])):
        key = tuple(words[i : i + 4])
        assert whole[i] == (key in seen)
        seen[key] = i


def test_a_passage_in_every_chunk(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'w{i}x{k}' for k in range(30))} {passage} tail{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()}
    assert got == {i: 70 if i else 0 for i in range(200)}
