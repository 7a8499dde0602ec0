from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions import tags, vocab
from tests import plain


def of(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", column.alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_parse(spark):
    assert of(spark, ["", "a,,b,", "a,  b,   c, d"], tags.parse(F.col("s"))) == [[""], ["a", "", "b", ""], ["a", " b", " c", "d"]]


def test_join(spark):
    assert of(spark, ["b,a,b", "a,b", ""], tags.join(tags.parse(F.col("s")))) == ["ba, b", "a, b", ""]


def test_add_emphasize_remove(spark):
    c = F.array_join(tags.add_emphasize_remove(tags.parse(F.col("s")), ["x", "y"], ["b", "z"], ["c"]), ", ")
    assert of(spark, ["a, B, c, a"], c) == ["x, y, b, a, B"]


def test_replace(spark):
    assert of(spark, ["a, b, a, c"], F.array_join(tags.replace_tags(tags.parse(F.col("s")), ["a", "c"], ["b", "d"]), ", ")) == ["b, d"]
    with pytest.raises(ValueError):
        tags.replace_tags(F.col("s"), ["a"], [])


def test_find_replace(spark):
    assert of(spark, ["a red car, Red carpet, blue", "green red"], tags.find_replace(F.col("s"), ["red"], ["green"])) == ["a green car, green carpet, blue", "green red"]


CASES = {
    "shirt, white shirt": "white shirt", "white shirt, shirt": "white shirt", "a, b, red a, c": "red a, b, c", "dress, smile, red dress, hat": "red dress, smile, hat",
    "dress, red dress, frilled red dress": "frilled red dress", "blue hair, light blue hair": "", "long hair, very long hair, solo": "", "blonde hair, red hair, two-tone hair": "blonde hair, red hair, two-tone hair",
    "blue hair, blue eyes, brown eyes, 1girl": "blue hair, blue eyes, 1girl", "solo, solo focus": "solo focus", "eyewear on head, red eyewear": "eyewear on head",
}


def test_redundancy_cases(spark):
    assert of(spark, list(CASES), tags.redundancy_removed("s")) == list(CASES.values())
    assert [plain.without_redundant(t) for t in CASES] == list(CASES.values())


def test_redundancy_of_all_categories(spark):
    rng = random.Random(5)
    words = [w for _, ws, _, _ in vocab.CATEGORIES for w in (ws or ("eyewear",))] + ["two-tone hair", "multicolored hair", "multicolored lips", "mismatched sclera", "Solo", "a", "b a", "", "?!", "red (x)", "café", "Café au lait", "hairband blue hair", "eyeshadow red eyes"]
    texts = [", ".join(rng.choice(words) if rng.random() < 0.8 else f"{rng.choice(words)} {rng.choice(words)}" for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert of(spark, texts, tags.redundancy_removed("s")) == [plain.without_redundant(t) for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "a b", "c", "red a", "solo", "blue hair", "long hair"]), max_size=8), min_size=1, max_size=20))
def test_redundancy_properties(spark, lists):
    texts = [", ".join(x) for x in lists]
    got = of(spark, texts, tags.redundancy_removed("s"))
    assert got == [plain.without_redundant(t) for t in texts]
    assert not any("solo" in g.split(", ") for g in got)


def test_consolidate(spark):
    cases = {
        "long hair, blue hair, smile": "smile, blue long hair", "blue eyes, red eyes": "blue eyes, red eyes", "smile, hat": "smile, hat", "red ring, old ring": "red ring, old ring",
        "looking at viewer, white shirt, frilled shirt": "looking at viewer, frilled white shirt", "hair hair, long  hair": "long hair",
    }
    assert of(spark, list(cases), tags.consolidated(F.col("s"))) == list(cases.values())


def test_hash_keys(spark):
    want = {"blue": -2005514474, "black": -473495872, "long": 569403132, "very": 961047116, "red": 1360721329, "frilled": 1523359836}
    assert of(spark, list(want), tags.hash_key(F.col("s"))) == list(want.values())


def test_frequency_deletes_line_breaks(spark):
    assert of(spark, ["a, b\nc, a"], tags.counted(F.col("s"))) == [["a", "bc", "a"]]


def test_prompts(spark):
    m = tags.prompt_metadata(F.col("s"))
    (r, bare) = of(spark, ["p1, Negative prompt: n1, Steps: 20, CFG: 7", "p2,  Steps: 5"], m)
    assert tuple(r) == ("p1", "n1", "Steps: 20, CFG: 7") and tuple(bare) == ("p2,", "", "Steps: 5")
    assert of(spark, ["Steps: 20, Seed: 123, Size: 5", "x"], tags.seed_of(F.col("s"))) == ["123", None]
    assert of(spark, ["  a cat </s> ", "x"], tags.stripped_end(F.col("s"))) == ["a cat", "x"]
    assert of(spark, ["a", ""], tags.first_prompt(F.col("s"), F.lit("u"), F.lit("b"))) == ["a", "b"]


def test_outliers(spark):
    assert of(spark, ["a b c d, e f", "x"], tags.outliers(F.col("s"))) == [["a b c d"], []]
