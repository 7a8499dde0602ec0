"""Debounced edits as a stream: of the edits of a file, those that are followed by quiet are saved.

An edit (path, at, seq, text) counts if the next edit of its path comes no earlier than ``quiet`` after it; edits of one time go by ``seq``.
So it is the last of its session, a run of edits with gaps of less than ``quiet``, and comes out when the watermark has reached the
last microsecond of its quiet.  Edits may come in any order and twice, as late as the watermark allows; later ones are passed over.  State is
the open sessions, each with its last edit, and the edits that the watermark has not passed; it lies in RocksDB and is taken up
again from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tagweave.sources.sink import write_files

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def followed(edits: list[tuple[int, int, str | None, bool]], quiet_us: int) -> list[tuple[int, int, str | None, bool]]:
    """Edits (at, seq, text, followed) in order, each once, marked if the next comes too early; those lose their text.  The rule for one path, in plain Python."""
    once = {(e[0], e[1]): e for e in sorted(edits, key=lambda e: (e[0], e[1], e[3], e[2] or ""))}
    order = sorted(once.values(), key=lambda e: e[:2])
    ends = [e[0] for e in order[1:]]
    gone = [e[3] or b - e[0] < quiet_us for e, b in zip(order, ends, strict=False)] + [e[3] for e in order[-1:]]
    return [(e[0], e[1], None if g else e[2], g) for e, g in zip(order, gone, strict=True)]


def debounced(stream: DataFrame, path: Column, at: Column, seq: Column, text: Column, quiet_ms: int = 500, lateness: str = "10 seconds") -> DataFrame:
    """(path, at, text) of a stream of edits that are saved.  See ``started`` for the state store.  Null paths and times are passed over."""
    rows = stream.select(path.cast("string").alias("path"), at.cast("timestamp").alias("at"), seq.cast("long").alias("seq"), text.alias("text"))
    rows = rows.filter("path IS NOT NULL AND at IS NOT NULL").withColumn("seq", F.coalesce("seq", F.lit(0))).withWatermark("at", lateness)
    once = rows.dropDuplicates(["path", "at", "seq", "text"])  # passes over what is older than the watermark, too
    if not quiet_ms:  # every edit counts
        return once.groupBy("path", "at", "seq").agg(F.max("text").alias("text")).select("path", "at", "text")
    last = F.max(F.struct("at", "seq", "text")).alias("last")
    gap = f"{quiet_ms * 1000 - 1} microseconds"  # sessions that touch are merged, and an edit just at the end of the quiet does not follow
    return once.groupBy("path", F.session_window("at", gap)).agg(last).select("path", "last.at", "last.text")


def started(spark: SparkSession, start) -> StreamingQuery:
    """Start a query with a state store on disk; the session's own setting stays."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def saved(edits: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write debounced edits as files of a folder (path is the file's name), the last of a batch for each; all files of a batch or none.

    A batch that is repeated after a failure writes the same files again."""

    def keep(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(F.col("path").alias("name")).agg(F.max_by("text", "at").alias("content"))
        write_files(last, folder)

    writer = edits.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(**trigger or {"processingTime": "1 second"})
    return started(edits.sparkSession, writer.start)


def run_available(spark: SparkSession, edits: DataFrame, base: str) -> DataFrame:
    """Read what is there, and return all edits that have been saved by now; ``base`` holds state and result, and goes on when it is given again."""
    writer = edits.writeStream.outputMode("append").format("parquet").option("path", f"{base}/saved").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    started(spark, writer.start).awaitTermination()
    return spark.read.schema("path string, at timestamp, text string").parquet(f"{base}/saved")
