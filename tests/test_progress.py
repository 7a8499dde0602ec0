"""Counts without a second pass, progress of running stages, and cancelling."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from tagweave.plans import progress


def test_counts_come_with_the_rows(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(touch, "id long")
    stage = progress.Stage(spark, "writing")
    with pytest.raises(RuntimeError):
        stage.counts()
    assert stage.percent() == 0
    stage.run(df, lambda d: d.write.parquet(str(tmp_path / "a")), F.col("id") % 10 == 0)
    assert stage.counts() == {"rows": 1000, "failed": 100} and stage.percent() == 100 and seen.value == 1000
    none = progress.Stage(spark, "none")
    assert none.run(spark.range(0), lambda d: d.collect()) == [] and none.counts() == {"rows": 0, "failed": 0}
    nulls = progress.Stage(spark, "nulls")
    nulls.run(spark.range(4), lambda d: d.collect(), F.when(F.col("id") > 1, F.col("id") > 2))
    assert nulls.counts() == {"rows": 4, "failed": 1}
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_percent_and_cancel(spark, tmp_path):
    df = spark.range(0, 64, 1, 32).mapInArrow(lambda bs: (time.sleep(0.3) or b for b in bs), "id long")
    stage, errors, shares = progress.Stage(spark, "slow"), [], []

    def go():
        try:
            stage.run(df, lambda d: d.write.parquet(str(tmp_path / "b")))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    t = threading.Thread(target=go)
    t.start()
    while t.is_alive() and (not shares or shares[-1] < 40):
        time.sleep(0.1)
        shares.append(stage.percent())
    assert shares == sorted(shares) and 40 <= shares[-1] < 100 and any(0 < s < 40 for s in shares)
    stage.cancel()
    t.join(30)
    assert not t.is_alive() and errors and "cancel" in str(errors[0]).lower()
    assert spark.range(3).count() == 3  # others go on


def test_streams_report_every_batch(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    totals = progress.Totals()
    spark.streams.addListener(totals)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = progress.watched(stream, "ids", F.col("id") % 7 == 0).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 20
        while totals.sums.get("ids", {}).get("rows") != 30 and time.time() < end:
            time.sleep(0.1)
        assert totals.sums == {"ids": {"rows": 30, "failed": 5}} and not totals.errors
    finally:
        spark.streams.removeListener(totals)
