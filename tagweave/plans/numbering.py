"""Numbers in a total order without a window over everything: ranges, counts of each range, offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.plans.storage import table, tasks_for

_BITS = 33  # of a row's place within its partition, in the ids that Spark makes


def numbered(df: DataFrame, order: Sequence[Column], into: str, start: int = 0) -> DataFrame:
    """``df`` with a long column of consecutive numbers by the order, ties in any order.

    Rows are dealt by ranges of the order and written once; what comes to the driver is one count for each range."""
    dealt = df.repartitionByRange(tasks_for(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = table(dealt.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_place", _BITS), F.col("_place").bitwiseAND((1 << _BITS) - 1)
    sizes = sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect()))
    offsets, at = [], start
    for k, n in sizes:
        offsets.append((k, at))
        at += n
    before = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = rows.join(F.broadcast(before), part == F.col("_part"))
    return joined.withColumn(into, F.col("_before") + within).drop("_place", "_part", "_before")
