from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _key string, _row string, n_words string"


def make_docs(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "s", "k", "r", "w") for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """Nulls, empties, blanks, a very long text, copies, near copies, repeated rows, shared and null ids."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    edited = base.split()
    edited[50] = "changed"
    out = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, " ".join(edited), "en", "src1"), (4, None, None, None), (5, "", "en", "src0"),
        (6, " \t\n\x0b ", "de", "src2"), (7, "Word", "fr", "src3"), (8, "word", "fr", "src3"), (9, text(30) + " " + passage + " " + text(20), "en", "src0"),
        (10, passage + "\n" + text(40), "es", "src12"), (11, text(20000), "en", "src0"), (12, "Été ÀB x \U0001f600 été", "fr", "weird"), (13, "a " * 100, "en", "src0"),
        (14, text(25), "en", "src0"), (14, text(25), "en", "src0"), (None, text(22), "en", "src4"), (-5, "x\x00y the MIT\nlicense", "en", "src17"),
    ]
    out += [(15, out[13][1], "en", "src0")] * 2
    return out + [(100 + i, text(rng.randint(1, 90)), rng.choice(["en", "de", None]), f"src{rng.randint(0, 19)}") for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make_docs(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])
