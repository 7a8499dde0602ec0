"""Copying, moving, deleting and renaming images together with their side files.

An action is a table of moves (source, target), one row for each image and for each of its possible side files, that tasks
carry out on the file system of the paths.  Every action can be run again after a failure: a target that is there as
it should be counts as done, and a missing side file is passed over.  Plans that change the folder they were read from are
written before the first file goes.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.plans.renames import Keep, pieces, spare
from tagweave.plans.storage import tasks_for
from tagweave.sources.files import renumbered
from tagweave.sources.places import located

SIDES = (".txt", ".caption")
SCHEMA = "source string, target string, outcome string"
_BLOCK = 1 << 20


def with_sides(images: DataFrame, *columns: str) -> DataFrame:
    """A row for each image, and one for each side file that it may have: dir, stem, ext and further columns."""
    exts = F.array(F.col("ext"), *[F.lit(x) for x in SIDES])
    return images.select("dir", "stem", F.explode(exts).alias("ext"), *columns)


def _size(filesystem: fs.FileSystem, path: str) -> int | None:
    info = filesystem.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def _same(filesystem, source: str, other, target: str) -> bool:
    if _size(filesystem, source) != _size(other, target):
        return False
    with filesystem.open_input_stream(source) as a, other.open_input_stream(target) as b:
        while block := a.read(_BLOCK):
            if block != b.read(len(block)):
                return False
    return True


def _copy(filesystem, source: str, other, target: str) -> str:
    if _size(filesystem, source) is None:
        return "missing"
    if _same(filesystem, source, other, target):
        return "present"
    temporary = posixpath.join(posixpath.dirname(target), f".{posixpath.basename(target)}.{uuid.uuid4().hex}")
    with filesystem.open_input_stream(source) as a, other.open_output_stream(temporary) as b:
        while block := a.read(_BLOCK):
            b.write(block)
    other.move(temporary, target)
    return "done"


def _move(filesystem, source: str, other, target: str) -> str:
    """A target that is there is never written over: if it is the same file the source goes, else it is an error."""
    if _size(filesystem, source) is None:
        return "missing" if _size(other, target) is None else "present"
    if _size(other, target) is not None and not _same(filesystem, source, other, target):
        raise FileExistsError(f"{target} is there with other content than {source}")
    if filesystem == other:
        filesystem.move(source, target)
    else:
        _copy(filesystem, source, other, target)
        filesystem.delete_file(source)
    return "done"


def _delete(filesystem, source: str, other, target: str) -> str:
    if _size(filesystem, source) is None:
        return "missing"
    filesystem.delete_file(source)
    return "done"


def _carried_out(plan: DataFrame, action: Callable) -> DataFrame:
    def run(batches):
        for batch in batches:
            outcome = []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (a, x), (b, y) = located(source), located(target or source)
                outcome.append(action(a, x, b, y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcome, pa.string())], names=["source", "target", "outcome"])

    return plan.select("source", "target").mapInArrow(run, SCHEMA)


def _into(images: DataFrame, folder: str) -> DataFrame:
    filesystem, base = located(folder)
    filesystem.create_dir(base, recursive=True)
    name = F.concat("stem", "ext")
    images = images.withColumn("_image", F.col("ext"))
    return with_sides(images, "_image").select(F.concat("dir", name).alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("target"), "_image")


def _settled(plan: DataFrame, keep: Keep, name: str) -> DataFrame:
    """The written plan: each source once, a side file of several images with the one of the least extension; no two sources for one target."""
    plan = keep(plan.groupBy("source").agg(F.min_by("target", F.struct("_image", "target")).alias("target")), name)
    clash = plan.groupBy("target").count().filter("count > 1").first()
    if clash is not None:
        raise FileExistsError(f"{clash['target']} would be the target of several files")
    return plan


def copied(images: DataFrame, folder: str) -> DataFrame:
    """Copy images (dir, stem, ext) and their side files to a folder, over what is there: source, target, outcome."""
    return _carried_out(_into(images, folder).select("source", "target").distinct(), _copy)


def backed_up(images: DataFrame, folder: str) -> DataFrame:
    """Copy the images alone."""
    return _carried_out(_into(images, folder).filter(~F.substring_index("source", "/", -1).rlike(r"\.(txt|caption)$")), _copy)


def moved(images: DataFrame, folder: str, keep: Keep, sides: bool = True) -> DataFrame:
    """Move images and, if asked, their side files.  ``keep(df, name)`` writes and rereads the plan before the first file goes."""
    plan = _into(images, folder)
    plan = plan if sides else plan.filter(~F.col("source").rlike(r"\.(txt|caption)$"))
    return _carried_out(_settled(plan, keep, "moving"), _move)


def sorted_by(images: DataFrame, bucket: Column, folders: dict[str, str], keep: Keep) -> DataFrame:
    """Move images and their side files to the folder of their bucket, such as that of ``size_bucket``; others stay."""
    plan = None
    for name, folder in folders.items():
        part = _into(images.filter(bucket == name), folder)
        plan = part if plan is None else plan.unionByName(part)
    return _carried_out(_settled(plan, keep, "sorting"), _move)


def removed(images: DataFrame, keep: Keep) -> DataFrame:
    """Delete images and their side files."""
    plan = with_sides(images).select(F.concat("dir", "stem", "ext").alias("source"), F.lit(None).cast("string").alias("target"))
    return _carried_out(keep(plan, "removing"), _delete)


def _exists(filesystem: fs.FileSystem, paths: list[str]) -> list[bool]:
    return [i.type == fs.FileType.File for i in filesystem.get_file_info(paths)]


def set_aside(rows: list[dict], exists: Callable, move: Callable) -> Iterator[str]:
    """Sources to their spare names.  No other move has begun, so a spare name that is there is that of this source."""
    for r in rows:
        yield "present" if exists([r["spare"]])[0] else "missing" if not exists([r["source"]])[0] else move(r["source"], r["spare"])


def shifted(rows: list[dict], exists: Callable, move: Callable) -> Iterator[str]:
    """One piece by depth.  The first name of it that is free tells which moves are done: all before it."""
    names = [rows[0]["target"], *(r["source"] for r in rows)]
    there = exists(names)
    if all(there):
        raise FileExistsError(f"{names[0]} is taken by a file that does not move")
    hole = there.index(False)
    for k, r in enumerate(rows):
        yield "present" if k < hole else "missing" if not there[k + 1] else move(r["source"], r["target"])


def put_back(rows: list[dict], exists: Callable, move: Callable) -> Iterator[str]:
    """Spare names to targets, which all pieces have left by now."""
    for r in rows:
        spare, target = exists([r["spare"], r["target"]])
        if spare and target:
            raise FileExistsError(f"{r['target']} is taken by a file that does not move")
        yield move(r["spare"], r["target"]) if spare else "present"


PHASES = (("set-aside", "aside", set_aside), ("shifted", "NOT aside", shifted), ("put-back", "aside", put_back))


def _done(path: str) -> bool:
    filesystem, base = located(f"{path}/_SUCCESS")
    return filesystem.get_file_info(base).type == fs.FileType.File


def _phase(plan: DataFrame, act: Callable, move: Callable) -> DataFrame:
    def whole(batches):
        """Rows of a piece together."""
        piece = []
        for batch in batches:
            for row in batch.to_pylist():
                if piece and (row["piece"] is None or row["piece"] != piece[0]["piece"]):
                    yield piece
                    piece = []
                piece.append(row)
        if piece:
            yield piece

    def run(batches):
        for rows in whole(batches):
            filesystem, _ = located(rows[0]["source"])
            path = {p: located(p)[1] for r in rows for p in (r["source"], r["target"], r["spare"])}

            def moved(a, b, filesystem=filesystem, path=path):
                move(filesystem, path[a], path[b])
                return "done"

            outcome = list(act(rows, lambda names, filesystem=filesystem, path=path: _exists(filesystem, [path[n] for n in names]), moved))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in ("source", "target")] + [pa.array(outcome, pa.string())], names=["source", "target", "outcome"])

    dealt = plan.repartition(8 * tasks_for(plan.sparkSession), F.coalesce("piece", "source")).sortWithinPartitions("piece", "depth")
    return dealt.mapInArrow(run, SCHEMA)


def _there(moves: DataFrame) -> DataFrame:
    """Adds whether source and target are files."""

    def run(batches):
        for batch in batches:
            for name in ("source", "target"):
                paths = batch.column(name).to_pylist()
                found = _exists(located(paths[0])[0], [located(p)[1] for p in paths]) if paths else []
                batch = batch.append_column(f"{name}_there", pa.array(found, pa.bool_()))
            yield batch

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moves.schema.fields)
    return moves.mapInArrow(run, f"{schema}, source_there boolean, target_there boolean")


def _rename_plan(images: DataFrame, order: list[Column], keep: Keep, start: int) -> DataFrame:
    rows = with_sides(renumbered(images, order, start), "new_stem")
    rows = rows.select(F.concat("dir", "stem", "ext").alias("source"), F.concat("dir", "new_stem", "ext").alias("target"), F.col("new_stem").cast("long").alias("number"))
    # a side file of several images goes with the first of them
    rows = rows.groupBy("source").agg(F.min_by("target", "number").alias("target"))
    rows = keep(_there(rows).filter("source_there"), "renaming")
    taken = rows.filter("target_there").join(rows.select(F.col("source").alias("target")), "target", "left_anti")
    first = taken.first()
    if first is not None:
        raise FileExistsError(f"{first['target']} is taken by a file that does not move")
    return pieces(rows, keep)


def renamed(images: DataFrame, order: list[Column], keep: Keep, journal: str, start: int = 1, move: Callable = lambda filesystem, a, b: filesystem.move(a, b)) -> DataFrame:
    """Number the images of each folder in the order given, side files with them: source, target, outcome.

    The plan is written to the folder ``journal`` before the first file moves, and the outcome of every phase when it has ended.  Called
    again with that journal after a failure at any place, it carries on with the plan it finds there, whatever ``images`` holds by
    then; called after the end, it moves nothing.  A journal serves one renaming.  No file is ever written over: a target that a
    file has which does not move is an error, before anything has moved.  Tasks must not run twice at a time (no speculation)."""
    spark = images.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation must be off while files are renamed")
    journal = journal.rstrip("/")
    if not _done(f"{journal}/plan"):
        plan = _rename_plan(images, order, keep, start).withColumn("spare", spare(F.col("source"), "moving"))
        plan.write.mode("overwrite").parquet(f"{journal}/plan")
    plan = spark.read.parquet(f"{journal}/plan")
    out = None
    for name, rows, act in PHASES:
        if not _done(f"{journal}/{name}"):
            _phase(plan.filter(rows), act, move).write.mode("overwrite").parquet(f"{journal}/{name}")
        part = spark.read.schema(SCHEMA).parquet(f"{journal}/{name}")
        if act is not set_aside:
            out = part if out is None else out.unionByName(part)
    return out
