from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagweave.llm import mixing, quality
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_substrings import brute as passage_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, SF).cache()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored if r.s >= 0.5}

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in good.collect()]
    one = stage["neardup"](spark, good, SF).cache()
    want = near_brute(rows, 5)
    assert {r.doc_id for r in one.collect()} == {i for i, c in want.items() if i == c}

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in one.collect()]
    cut = stage["substrings"](spark, one, SF).cache()
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted((i, t) for i, _, _, t in passage_brute(rows))
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    drawn = stage["mixing"](spark, cut, SF).cache()
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == {r.doc_id: r.n_copies for r in mixing.mix(cut).collect()}

    words = Counter()
    for r in drawn.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    got = Counter()
    for r in stage["packing"](spark, drawn, SF).collect():
        got[r.doc_id] += r.n_tokens
    assert got == +words


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and set(out.columns) == {"doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "offset"}


@pytest.fixture(scope="module")
def labels_dir(spark, docs, tmp_path_factory):
    """Labels of the edge rows, with null labels and a column that clashes."""
    folder = tmp_path_factory.mktemp("labels")
    rows = [(r.doc_id, r.doc_id % 2, None if r.doc_id % 5 == 0 else 0, "t") for r in docs.select("doc_id").distinct().collect() if r.doc_id is not None]
    spark.createDataFrame([*rows, (None, 1, 1, "t"), (1, None, 0, "t")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows(spark, docs, no_docs, labels_dir, name):
    """Null, empty and very long texts, ties, repeated rows, null labels and clashing columns; and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, labels_dir)
    rows = out.collect()
    if name == "packing":
        got = Counter()
        for r in rows:
            got[r.doc_id] += r.n_tokens
        want = Counter()
        for r in docs.collect():
            want[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert got == +want
    else:
        assert out.columns == docs.columns
        assert {(r.score, r._key, r._row, r.n_words) for r in rows} == {("s", "k", "r", "w")}  # clashing columns are carried on
        kept = Counter(r.doc_id for r in rows)
        every = Counter(r.doc_id for r in docs.collect())
        assert kept and set(kept) <= set(every)
        if name in ("quality", "neardup"):
            assert kept <= every
        if name == "substrings":
            assert kept == every and all(r.n_chars == len(r.text) for r in rows)
    none = stage(spark, no_docs, labels_dir)
    assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
