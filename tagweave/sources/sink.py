"""Single files as a sink with commit: ``df.write.format("sidefiles").mode("append").save(folder)`` for rows (name, content).

A task writes its files below ``.staged-<job>/<attempt>`` in the folder, so nothing there changes before all tasks have ended.
The commit writes one file that names the attempts that count; from then on the job is going to be in the folder, even if the process
dies: ``published`` carries on with every job that was committed.  A job that fails is removed with all it wrote.

A file of the same name is replaced.  Names are unique within a task (``write_files`` deals rows by name, so within a job); they
are not null or empty, hold no "/" and do not begin with a dot, else the job fails.  Null content is an empty file, text is written as UTF-8.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tagweave.plans.storage import tasks_for
from tagweave.sources.places import located

_STAGED, _COMMIT = ".staged-", "COMMIT"
_THREADS = 16


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    files: int


def _move_attempt(filesystem: fs.FileSystem, base: str, stage: str, attempt: str) -> int:
    """Files of one attempt to their places; those moved before are not there any more."""
    found = filesystem.get_file_info(fs.FileSelector(posixpath.join(base, stage, attempt), allow_not_found=True))
    for info in found:
        filesystem.move(info.path, posixpath.join(base, info.base_name))
    return len(found)


class SinkWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, publish: str):
        self.folder, self.publish = folder, publish
        self.stage = _STAGED + uuid.uuid4().hex
        filesystem, base = located(folder)
        filesystem.create_dir(posixpath.join(base, self.stage), recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        filesystem, base = located(self.folder)
        attempt, seen = uuid.uuid4().hex, set()
        mine = posixpath.join(base, self.stage, attempt)
        filesystem.create_dir(mine, recursive=False)  # fails for a task that outlives its job
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"not a file name: {name!r}")
                if name in seen:
                    raise ValueError(f"two files of one name: {name!r}")
                seen.add(name)
                with filesystem.open_output_stream(posixpath.join(mine, name)) as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")
        return Staged(attempt, len(seen))

    def commit(self, messages: list[Staged | None]) -> None:
        filesystem, base = located(self.folder)
        stage = posixpath.join(base, self.stage)
        attempts = [m.attempt for m in messages if m is not None and m.files]
        with filesystem.open_output_stream(posixpath.join(stage, "commit-being-written")) as f:
            f.write(json.dumps(attempts).encode())
        filesystem.move(posixpath.join(stage, "commit-being-written"), posixpath.join(stage, _COMMIT))
        if self.publish == "now":
            with ThreadPoolExecutor(_THREADS) as pool:
                list(pool.map(lambda a: _move_attempt(filesystem, base, self.stage, a), attempts))
            filesystem.delete_dir(stage)

    def abort(self, messages: list[Staged | None]) -> None:
        filesystem, base = located(self.folder)
        stage = posixpath.join(base, self.stage)
        if filesystem.get_file_info(stage).type == fs.FileType.Directory:
            filesystem.delete_dir(stage)


class SinkSource(DataSource):
    """Options: path; publish = "now" (the commit moves the files) or "later" (``published`` does, by tasks)."""

    @classmethod
    def name(cls) -> str:
        return "sidefiles"

    def writer(self, schema: StructType, overwrite: bool) -> SinkWriter:
        types = {f.name: f.dataType.simpleString() for f in schema.fields}
        if types not in ({"name": "string", "content": "string"}, {"name": "string", "content": "binary"}):
            raise ValueError("columns must be name (string) and content (string or binary)")
        if overwrite:
            raise ValueError("only mode append: files of the same names are replaced, others stay")
        return SinkWriter(self.options["path"], self.options.get("publish", "now"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SinkSource)


def published(spark: SparkSession, folder: str) -> int:
    """Bring every committed job of a folder to its end, one task for each attempt; the number of files moved."""
    filesystem, base = located(folder)
    rows = []
    for info in filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        marker = posixpath.join(base, info.base_name, _COMMIT)
        if info.base_name.startswith(_STAGED) and filesystem.get_file_info(marker).type == fs.FileType.File:
            with filesystem.open_input_stream(marker) as f:
                rows += [(info.base_name, a) for a in json.loads(f.read()) or [None]]

    def run(batches):
        there, path = located(folder)
        for batch in batches:
            moved = [_move_attempt(there, path, s, a) for s, a in zip(*(c.to_pylist() for c in batch.columns), strict=True) if a]
            yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int64())], names=["files"])

    if not rows:
        return 0
    dealt = spark.createDataFrame(rows, "stage string, attempt string").repartition(min(len(rows), 8 * tasks_for(spark)), "attempt")
    files = dealt.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    for stage in {s for s, _ in rows}:
        filesystem.delete_dir(posixpath.join(base, stage))
    return files


def write_files(df: DataFrame, folder: str) -> int:
    """Write rows (name, content: string or binary) as single files of a folder, all of them or none; how many."""
    spark = df.sparkSession
    register(spark)
    rows = df.select("name", "content").repartition(tasks_for(spark), "name")
    rows.write.format("sidefiles").mode("append").option("publish", "later").save(folder)
    return published(spark, folder)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    """A text table of one line a row; what was there stays until the new one is complete."""
    filesystem, target = located(path)
    made, old = (posixpath.join(posixpath.dirname(target.rstrip("/")), f".{kind}-{uuid.uuid4().hex}") for kind in ("made", "old"))
    beside = posixpath.join(posixpath.dirname(path.rstrip("/")), posixpath.basename(made))
    try:
        df.select(F.col(column).alias("value")).write.text(beside)
    except Exception:
        if filesystem.get_file_info(made).type == fs.FileType.Directory:
            filesystem.delete_dir(made)
        raise
    there = filesystem.get_file_info(target.rstrip("/")).type == fs.FileType.Directory
    if there:
        filesystem.move(target.rstrip("/"), old)
    filesystem.move(made, target.rstrip("/"))
    if there:
        filesystem.delete_dir(old)
