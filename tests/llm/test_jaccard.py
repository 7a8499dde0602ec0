from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import jaccard
from tagweave.plans import storage
from tests.llm.conftest import make_docs
from tests.llm.test_neardup import brute, shingles


def found(docs, p):
    return {r.doc_id: r.component_id for r in jaccard.joined(docs, p).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_edge_rows(docs, rows, width):
    want = brute(rows, width)
    out = jaccard.joined(docs, jaccard.JaccardParams(width=width)).collect()
    assert len(out) == len(rows)
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in out)
    assert sorted((r.doc_id or 0, r.n_shingles) for r in out) == sorted((i or 0, len(shingles(t, width))) for i, t, *_ in rows)


@pytest.mark.parametrize("p", [jaccard.JaccardParams(width=2), jaccard.JaccardParams(width=2, pair_rows=3, block=8, per_salt=7, part_bytes=4000, part_postings=300, gathered=50, broadcast_rows=0)])
def test_chains_and_groups(spark, words, p):
    """Chains of ever more edits, a large group of near copies, exact copies, unrelated texts of one boilerplate."""
    rng = random.Random(9)
    rows = []
    for _ in range(6):
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
    common = [rng.choice(words) for _ in range(70)]
    for _ in range(60):
        rows.append((len(rows), " ".join(common + [rng.choice(words) for _ in range(rng.randint(1, 14))]), "en", "src0"))
    rng.shuffle(rows)
    assert found(make_docs(spark, rows), p) == brute(rows, 2)


def test_many_unrelated_texts_of_one_boilerplate(spark, words):
    """Texts just short of the similarity share all their frequent n-grams; they are not listed pair by pair."""
    rng = random.Random(13)
    common = [rng.choice(words) + str(k) for k in range(60)]
    rows = [(i, " ".join(common + [rng.choice(words) + str(rng.randrange(10**6)) for _ in range(12)]), "en", "src0") for i in range(1500)]
    docs = make_docs(spark, rows)
    p = jaccard.JaccardParams(pair_rows=8, block=64)
    texts = docs.selectExpr("doc_id", "xxhash64(text) AS h", "text")
    nodes = jaccard._sized(texts, p).selectExpr("doc_id", "h", "n", "doc_id AS node")
    prefix = jaccard.prefixes(nodes, texts, p)
    assert prefix.filter("small").count() == 0  # too many n-grams of their own for any link with a text as long
    assert set(found(docs, p).items()) == {(i, i) for i in range(1500)}


def test_one_pair_in_a_large_family(spark, words):
    """Families of several boilerplates of different lengths: few links among many that meet."""
    rng = random.Random(14)
    parts = [[rng.choice(words) + str(k) for k in range(30)] for _ in range(6)]
    rows = []
    for i in range(300):
        text = sum(rng.sample(parts, 3), []) + [rng.choice(words) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(text), "en", "src0"))
    want = brute(rows, 5)
    assert 1 < len(set(want.values())) < 290
    for p in (jaccard.JaccardParams(), jaccard.JaccardParams(pair_rows=2, block=16)):
        assert found(make_docs(spark, rows), p) == want


def test_filters_lose_no_link():
    """On random sets with a common order every pair over the similarity passes at one of its prefix n-grams."""
    rng = np.random.default_rng(3)
    p = jaccard.JaccardParams()
    sets = []
    for _ in range(25):
        base = rng.choice(3000, int(rng.integers(5, 120)), replace=False)
        for _ in range(4):
            keep = base[rng.random(len(base)) < 0.95]
            sets.append(np.unique(np.concatenate([keep, rng.choice(3000, int(rng.integers(0, 8)), replace=False)])))
    df = np.bincount(np.concatenate(sets), minlength=3000)
    shared = [s[df[s] > 1] for s in sets]
    rows = jaccard.prefixes_of(np.repeat(np.arange(100), [len(s) for s in shared]), np.concatenate(shared), df[np.concatenate(shared)], np.arange(100), np.array([len(s) for s in sets]), p)
    facts = jaccard._facts(rows, "", p)
    gram = rows.column("gram").to_numpy()
    i, j = np.nonzero((gram[:, None] == gram[None, :]) & (facts["node"][:, None] < facts["node"][None, :]))
    keep = jaccard.margins(jaccard._side(facts, i), jaccard._side(facts, j), p) >= 0
    passed = set(zip(facts["node"][i[keep]].tolist(), facts["node"][j[keep]].tolist(), strict=True))
    links = {(a, b) for b in range(100) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert links <= passed and links and len(passed) < len(set(zip(facts["node"][i].tolist(), facts["node"][j].tolist(), strict=True)))


def test_very_long_texts_and_empty_table(spark, words, no_docs):
    rng = random.Random(12)
    long = [rng.choice(words) + str(rng.randrange(1000)) for _ in range(300_000)]
    near = [*long[:150_000], "x", *long[150_001:]]
    far = [*long[:180_000], *(w + "y" for w in long[180_000:])]
    docs = make_docs(spark, [(i, " ".join(w), "en", "src0") for i, w in enumerate((long, near, far))])
    assert found(docs, jaccard.JaccardParams()) == {0: 0, 1: 0, 2: 2}
    assert jaccard.joined(no_docs).count() == 0


def test_texts_go_to_tasks_in_small_batches(spark, docs, monkeypatch):
    """Batches are bounded in bytes, not in rows alone; the session's own setting stays."""
    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["bytes"])

    wide = spark.range(5000, numPartitions=1).selectExpr("repeat(cast(id AS string), 500) AS text").mapInArrow(held, "bytes long")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    sizes = [r.bytes for r in jaccard.table(wide, "batches").collect()]
    assert len(sizes) > 1 and max(sizes) <= 5 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    given, table = [], storage.table
    monkeypatch.setattr(storage, "table", lambda df, name, size=None: given.append(size) or table(df, name, size))
    jaccard.joined(docs).count()
    assert given and all(size and size <= 1 << 22 for size in given)
