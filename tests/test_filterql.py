from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagweave.functions import filterql

ROWS = [(1, "cat, dog"), (2, "Cat"), (3, "dog, bird"), (4, None)]


def ids(spark, query, **kw):
    df = spark.createDataFrame(ROWS, "i int, s string")
    return {r.i for r in df.filter(filterql.selects(F.col("s"), query, **kw)).collect()}


def test_cases(spark):
    for exact in (False, True):
        assert ids(spark, "cat", exact=exact) == {1, 2}
        assert ids(spark, "cat, !dog", exact=exact) == {2}
    assert ids(spark, "!dog") == {2, 4}
    assert ids(spark, "dog AND bird") == {1, 2, 3, 4}
    assert ids(spark, "dog AND bird", compat=False) == {3}
    assert ids(spark, "cat, dog AND bird") == {1, 2, 3}
    assert ids(spark, "") == {1, 2, 3}
    assert ids(spark, "dog AND dog", compat=False) == set()
    assert ids(spark, "do") == set()


def test_parse_and_guard(spark):
    assert filterql.parse_filter("a, !b, cANDd, e!") == filterql.Filter(("a",), ("b", "e"), ("cANDd",))
    with pytest.raises(ValueError):
        filterql.selects(F.col("s"), "a", extension=".png")
