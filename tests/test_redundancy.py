"""Redundancy by vocabulary against the plain version and the Column version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tagweave.functions import tags, vocab
from tagweave.operators import redundancy
from tests import plain

ODD = ["", "?!", "a?!b", "A ?! b", "?!b", "red (x)", "(x", "red (x) y", "café", "Café au lait", "cafe", "b a", "a", "A", "B", "a-b", "a - b", "ſs", "SS x", "K", "k k", "é", "é", "x\\E", "x\\E y", "_", "_ a", "a_b", "1 a 1", "日本", "日本 語", "two  blanks", "$", "a $ b", " $ "]


def removed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = {r.id: r.s for r in redundancy.redundancy_removed(rows, "id", "s").collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def test_contained_pairs(spark):
    """Every ordered pair of odd tags, by the exact test."""
    vocabulary = spark.createDataFrame([(t,) for t in ODD], "tag string")
    pairs = vocabulary.select(F.col("tag").alias("a")).crossJoin(vocabulary.select(F.col("tag").alias("b")))
    want = {(r.a, r.b) for r in pairs.filter(F.expr(tags.word_in_sql("a", "b"))).collect()}
    assert {tuple(r) for r in redundancy.contained(vocabulary).collect()} == {(a, b) for a, b in want if a}
    assert {t for t in ODD if ("", t) in want} == {r.tag for r in redundancy.described(vocabulary).filter("array_contains(inner, '')").collect()}


def test_same_as_the_column(spark):
    rng = random.Random(6)
    words = [w for _, ws, _, _ in vocab.CATEGORIES for w in (ws or ("eyewear",))] + ["two-tone hair", "multicolored hair", "multicolored lips", "mismatched sclera", "Solo", "hairband blue hair", "eyeshadow red eyes"]
    texts = [", ".join(rng.choice(words + ODD) if rng.random() < 0.8 else f"{rng.choice(words)} {rng.choice(words)}" for _ in range(rng.randint(0, 14))) for _ in range(1200)]
    column = spark.createDataFrame(list(enumerate(texts)), "id long, s string").select("id", tags.redundancy_removed("s").alias("r")).collect()
    assert removed(spark, texts) == [r.r for r in sorted(column)]
    plainly = [", ".join(rng.choice(["a", "b", "a b", "c", "red a", "solo", "blue hair", "long hair", "shirt", "white shirt"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    assert removed(spark, plainly) == [plain.without_redundant(t) for t in plainly]


def test_null_empty_and_hot_texts(spark):
    texts = [None, "", "a", None, *["shirt, white shirt"] * 500, ", ".join(f"tag {i}" for i in range(400)) + ", tag"]
    got = removed(spark, texts)
    assert got[:4] == [None, "", "a", None] and set(got[4:-1]) == {"white shirt"} and got[-1].count("tag") == 400
    assert redundancy.redundancy_removed(spark.createDataFrame([], "id long, s string"), "id", "s").count() == 0


def test_no_pattern_is_tested_in_the_rows(spark):
    rows = spark.createDataFrame([(1, "a, b a")], "id long, s string")
    plan = redundancy.redundancy_removed(rows, "id", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan


def test_categories_work_on_each_text_once(spark):
    """Rows are joined to their texts' results: repeated orders stay, and no row has the fold in its own plan."""
    from tagweave.operators import catalog

    out = catalog.CATALOG["tags_redundancy_categories"][0](spark, "/root/testdata/sf0.001")
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()
    again = out.select("k", "raw", "tags", catalog.tags.redundancy_removed("raw").alias("want")).orderBy("k").limit(60).collect()
    assert len(again) == 60 and all(r.tags == r.want for r in again)
    assert out.count() == catalog.read(spark, "/root/testdata/sf0.001", "orders").count()
