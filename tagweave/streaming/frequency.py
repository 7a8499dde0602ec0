"""Tag frequencies over a growing folder of tables, by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import tags
from tagweave.plans.storage import shared_dir


def counts(stream: DataFrame, text: str) -> DataFrame:
    """(tag, n) of a stream of texts: a stateful aggregate, complete at every trigger."""
    return stream.select(F.explode(tags.counted(F.col(text))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def run_available(spark: SparkSession, folder: str, schema, text, name: str | None = None) -> DataFrame:
    """Read what is there as a stream, count, and return the last complete table.

    State and result lie in the shared folder.  A query that is given a ``name`` goes on there, after a failure or when
    more files have come; without one it starts afresh."""
    base = f"{shared_dir(spark)}/stream-{name or uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).parquet(folder).select(text.alias("text"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/{number}")

    query = counts(source, "text").writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    # a table of its own for every batch, so that one which breaks off costs nothing; the last complete one counts
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/result").getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(s.getPath().getName()) for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/result"))]
    complete = [n for n in numbers if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/result/{n}/_SUCCESS"))]
    for n in numbers:
        if n < max(complete):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/result/{n}"), True)
    return spark.read.parquet(f"{base}/result/{max(complete)}")
