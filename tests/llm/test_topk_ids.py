"""Ids with several vectors in the top-k search."""

import numpy as np

from gleanery.llm import topk_search


def test_every_vector_of_an_id_takes_part(spark):
    rnd = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rnd.normal(size=6)]) for i in list(range(60)) * 4 + [0, 3, 3, -1, -2, -3]]
    rows += rows[:30]
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v in rows]
    best: dict = {}
    for q, x in good:
        for c, y in good:
            if q % 50 == 0 and q != c:
                best[q, c] = max(best.get((q, c), -1e18), int(x @ y))
    expected = []
    for q in {q for q, _ in best}:
        ranked = sorted((-s, c) for (p, c), s in best.items() if p == q)[:5]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(ranked)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == sorted(expected)


def test_only_survivors_are_resolved(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rnd.normal(size=32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    hits, counts = topk_search.search(df, block=25)
    good = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(np.float64))
    score = good[::50] @ good.T
    for q, row in enumerate(score):
        row[q * 50] = -np.inf
    expected = [(q * 50, r + 1, int(c), int(row[c])) for q, row in enumerate(score) for r, c in enumerate(np.lexsort((np.arange(3000), -row))[:5])]
    assert sorted(tuple(r) for r in hits.collect()) == sorted(expected)
    resolved = {r.query_id: r.resolved for r in counts.collect()}
    assert len(resolved) == 60
    assert all(5 <= n < 1000 for n in resolved.values())


def test_vectors_of_other_lengths_are_not_compared(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [2.0, 5.0]), (50, [3.0]), (3, []), (100, []), (4, [0.5, 0.5]), (4, [9.0])]
    got = sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, score int")).collect())
    one = 256 * 256
    assert got == [(0, 1, 2, 2 * one), (0, 2, 4, one // 2), (50, 1, 4, 27 * one), (50, 2, 1, 3 * one), (100, 1, 3, 0)]
