from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import search

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, v string, list string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "r", "v", "l") for i, v in vectors], SCHEMA)


def brute(vectors, is_query, k):
    out = {}
    for i, v in vectors:
        if is_query(i):
            a = np.array(v)
            found = sorted({(-float(a @ np.array(w) / np.linalg.norm(a) / np.linalg.norm(w)), j) for j, w in vectors if j != i})
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def test_edge_vectors(spark):
    good = [(i, [float(np.cos(i)), float(np.sin(i)), 0.5 + i / 70]) for i in range(12)]
    bad = [(50, None), (51, [0.0, 0.0, 0.0]), (52, [float("nan"), 1.0, 1.0]), (53, [None, 1.0, 1.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1.0, 2.0]), (56, []), (None, [1.0, 1.0, 1.0])]
    same = [(i, [3.0, 1.0, 2.0]) for i in range(20, 45)] + [(20, [3.0, 1.0, 2.0])]
    bad += [(60, [2.0, 1.0]), (65, [1.0, 0.0])]  # another length: compared among themselves
    vectors = good + same[:-1]
    out = search.nearest(frame(spark, good + bad + same), F.col("vec_id") % 5 == 0).collect()
    want = brute(vectors, lambda i: i % 5 == 0, 5)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [j for j, _ in v] for q, v in got.items() if q < 12} == {q: [j for j, _ in v] for q, v in want.items() if q < 12}
    assert [j for j, _ in got[20]] == [21, 22, 23, 24, 25] and [j for j, _ in got[40]] == [20, 21, 22, 23, 24]
    assert got.pop(60) and [j for j, _ in got.pop(65)] == [60, 55] and [j for j, _ in got.pop(55)] == [60, 65]
    assert set(got) == set(want)
    for q, v in want.items():
        assert np.allclose([s for _, s in got[q]], [s for _, s in v], atol=1e-12)


def test_none_and_few(spark):
    assert search.nearest(frame(spark, []), F.lit(True)).count() == 0
    assert search.nearest(frame(spark, [(0, [1.0, 0.0])]), F.lit(True)).count() == 0
    assert search.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1e300, 1e300])]), F.lit(True)).count() == 2


SMALL = search.SearchParams(block_rows=64, query_rows=16)


@pytest.mark.parametrize(("n", "dim"), [(1, 64), (2, 384), (3, 2), (6, 384), (40, 384)])
def test_every_query_has_its_rows(spark, n, dim):
    """min(k, candidates) rows of every query, by the index."""
    rng = np.random.default_rng(n)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, dim)))] + [(0, [1.0] * dim)] * 2
    out = search.nearest(frame(spark, vectors), F.lit(True), SMALL).collect()
    counts = {}
    for r in out:
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
    assert counts == ({i: min(5, n - 1) for i in range(n)} if n > 1 else {})


def test_short_queries_are_looked_up_everywhere(spark):
    """All near rows have the query's own id."""
    rng = np.random.default_rng(3)
    near = [(7, v.tolist()) for v in [1.0, 0.0, 0.0] + 0.01 * rng.standard_normal((60, 3))]
    far = [(100 + i, v.tolist()) for i, v in enumerate([-1.0, 0.0, 0.0] + 0.3 * rng.standard_normal((60, 3)))]
    out = search.nearest(frame(spark, near + far), F.col("vec_id") == 7, SMALL).collect()
    assert sorted(r["rank"] for r in out) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("dim", [64, 384])
def test_recall(spark, dim):
    rng = np.random.default_rng(0)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, dim)))]
    out = search.nearest(frame(spark, vectors), F.col("vec_id") % 50 == 0, search.SearchParams(block_rows=64, query_rows=16)).collect()
    want = brute(vectors, lambda i: i % 50 == 0, 5)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in out)
    assert len(out) == 5 * len(want) and hits / len(out) >= 0.93


def test_small_tables_go_through_the_index(spark, monkeypatch):
    """Every length of more than k + 1 vectors has an index, and what it finds is nearly all."""
    made = []

    class Seen(search.Index):
        def __init__(self, kept, queries, n, p):
            made.append(n)
            super().__init__(kept, queries, n, p)

    monkeypatch.setattr(search, "Index", Seen)
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 32)))]
    out = search.nearest(frame(spark, vectors + [(1000 + i, [1.0 + i, 2.0]) for i in range(6)]), F.col("vec_id") % 10 == 0).collect()
    want = brute(vectors, lambda i: i % 10 == 0, 5)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in out if r.query_id < 1000)
    assert made == [300] and hits / (5 * len(want)) >= 0.93 and sum(r.query_id == 1000 for r in out) == 5


def test_scan_drops_but_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = search.unit(rng.standard_normal((2000, 64)))
    q = search.unit(rng.standard_normal((20, 64)))
    rows, cols = search.scan(q, x, 6, search.SearchParams())
    assert len(rows) < 20 * 2000 / 2
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    kept = set(zip(rows.tolist(), cols.tolist(), strict=True))
    assert np.mean([(i, int(j)) in kept for i in range(20) for j in best[i]]) > 0.95
