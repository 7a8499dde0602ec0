"""Where intermediate tables go, and how lineage is cut.

Everything is written below the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors share.  A folder of
our own is made only where that setting is absent, as in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when the write has ended


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared working folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def table(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table.

    Lost executors then cost a reread of files, never a recomputation of the plan above.
    ``batch_bytes`` bounds the Arrow batches that are sent to Python meanwhile, less the last row of each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``table``; their consumers must have been written."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
