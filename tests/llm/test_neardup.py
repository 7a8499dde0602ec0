from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tagweave.llm import graph, neardup
from tests.llm.conftest import make_docs


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def brute(rows, width):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    home = {i: i for i in ids}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    sets = [(r[0], shingles(r[1], width)) for r in rows if r[0] is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                home[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_edge_rows(docs, rows, width):
    want = brute(rows, width)
    out = neardup.classes(docs, neardup.NearDupParams(width=width)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert sorted((r.doc_id or 0, r.n_shingles) for r in out) == sorted((i or 0, len(shingles(t, width))) for i, t, *_ in rows)


def test_chains_and_groups(spark, words):
    """Chains of ever more edits, a large group of near copies, exact copies, and unrelated texts."""
    rng = random.Random(9)
    rows = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(25):
            rows.append((len(rows), " ".join(base), "en", "src0"))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(80)] = rng.choice(words)
    hub = [rng.choice(words) for _ in range(60)]
    for _ in range(80):
        copy = list(hub)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((len(rows), " ".join(copy), "en", "src0"))
    rng.shuffle(rows)
    p = neardup.NearDupParams(width=2, per_salt=7, pair_bucket=3, cell=8, columns=64)
    out = neardup.classes(make_docs(spark, rows), p).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 2)


@pytest.mark.parametrize("p", [neardup.NearDupParams(width=2, cell=100, cell_shingles=3000), neardup.NearDupParams(width=2, broadcast_rows=0)])
def test_large_buckets_of_unrelated_texts(spark, words, p):
    """Texts that share a frequent passage meet in large buckets; few of them are near copies."""
    rng = random.Random(11)
    common = [rng.choice(words) for _ in range(24)]
    rows = []
    for i in range(500):
        own = [rng.choice(words) for _ in range(10)]
        rows.append((i, " ".join(common + own), "en", "src0"))
        if i % 25 == 0:
            rows.append((1000 + i, " ".join([*common, *own[:9], "other"]), "en", "src0"))
    want = brute(rows, 2)
    assert sum(i != c for i, c in want.items()) >= 20
    assert {r.doc_id: r.component_id for r in neardup.classes(make_docs(spark, rows), p).collect()} == want


def test_near_copies_are_sent_to_cells_once(spark, words, monkeypatch):
    """Copies at the edge of the similarity meet in many buckets; whole texts go to one group of cells, and an id of several texts counts whole."""
    rng = random.Random(13)
    hub = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(150):
        copy = list(hub)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(70)] = rng.choice(words)
        rows.append((i if i % 30 else 7, " ".join(copy), "en", "src0"))
    sent, with_texts = [], neardup._with_texts

    def counted(wanted, docs, p):
        if "mb" in wanted.columns:
            sent.append((wanted.count(), wanted.select("node").distinct().count()))
        return with_texts(wanted, docs, p)

    monkeypatch.setattr(neardup, "_with_texts", counted)
    out = neardup.classes(make_docs(spark, rows), neardup.NearDupParams(width=2)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 2)
    (rows_sent, nodes), = sent
    assert nodes > 50 and rows_sent <= 2 * nodes


def test_very_long_texts(spark, words):
    rng = random.Random(12)
    long = [rng.choice(words) + str(rng.randrange(1000)) for _ in range(1_000_000)]
    near = [*long[:500_000], "x", *long[500_001:]]
    far = [*long[:600_000], *(w + "y" for w in long[600_000:])]
    docs = make_docs(spark, [(i, " ".join(w), "en", "src0") for i, w in enumerate((long, near, far))])
    assert {r.doc_id: (r.component_id, r.n_shingles > 900_000) for r in neardup.classes(docs).collect()} == {0: (0, True), 1: (0, True), 2: (2, True)}


def test_deduplicated(docs, rows, no_docs):
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    want = brute(rows, 5)
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {i for i, c in want.items() if i == c}
    assert neardup.classes(no_docs).count() == 0 and neardup.deduplicated(no_docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    p = neardup.NearDupParams()
    x = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    a, b = np.unique(x[:1200]), np.unique(x[300:])
    s = neardup.signatures([a, b], p)
    assert abs((s[0] == s[1]).mean() - 900 / 1500) < 0.13


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    home = {i: i for e in edges for i in e if i is not None}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            home[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in home if find(i) != i}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars, also with repeats, are found to be so without rewriting them all once to see that nothing changes."""
    rounds, large_star = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda e: rounds.append(1) or large_star(e))
    edges = [(i, i % 7) for i in range(7, 400)] * 2
    out = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert sorted((r.u, r.v) for r in out) == [(i, i % 7) for i in range(7, 400)]
    assert not rounds


def test_stars_of_edges():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (50, 30), (300, 290), (300, 2000)):
        u, v = rng.integers(-n, n, m), rng.integers(-n, n, m)
        home = {i: i for i in [*u.tolist(), *v.tolist()]}
        for _ in range(len(home)):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                home[a] = home[b] = min(home[a], home[b])
        got = dict(zip(*(x.tolist() for x in graph.stars(u, v)), strict=True))
        assert got == {i: c for i, c in home.items() if i != c}
