"""A flat image folder as a data source: ``spark.read.format("imagefolder").load(folder)``.

Columns are path, dir, stem, ext, length, width, height, txt and caption.  A schema with fewer of them reads less: headers
are read, by ranges, only for width and height, side texts only for txt and caption, and no image body ever.
The driver lists the folder once for each ``load`` and deals its names, so that a task reads a range of them.  The options ``exts`` and ``stems`` (JSON
lists) filter the listing.  They are options because a frame keeps what a filter once pushed to a Python source: a later query of it without that filter would miss rows.
An image is a file whose extension, lower-cased, is a part of ``pattern`` (so files without one are taken); names that begin with a dot are not listed.
Sizes are null where a header cannot be read, side texts where there is no file; an empty side file is an empty text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tagweave.sources import headers
from tagweave.sources.places import located

# The listing's pattern and the one hidden file.
IMAGES = "*.jpg,*.jpeg,*.png,*.gif,*.webp,*.avif,*.heif"
HIDDEN = "sample_prompt_custom.txt"
SCHEMA = "path string, dir string, stem string, ext string, length long, width int, height int, txt string, caption string"
_TYPES = {"length": pa.int64(), "width": pa.int32(), "height": pa.int32()}
_SIDES = ("txt", "caption")
_BATCH = 512


@dataclass
class Names(InputPartition):
    """Some files of a listing: (name, length, extensions of the side files that are there)."""

    files: list[tuple[str, int, tuple[str, ...]]]


def split_name(name: str) -> tuple[str, str]:
    """Stem and extension, which begins with the last dot or is empty."""
    at = name.rfind(".")
    return (name, "") if at < 0 else (name[:at], name[at:])


def listed(path: str, ext: str, pattern: str) -> bool:
    return ext.lower() in pattern and HIDDEN not in path


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder = options["path"].rstrip("/") + "/"
        self.pattern = options.get("pattern", IMAGES)
        self.per_task = int(options.get("filespertask", "2000"))
        self.columns = schema.fieldNames()
        unknown = set(self.columns) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.allowed = {c: frozenset(json.loads(options[c + "s"])) for c in ("ext", "stem") if options.get(c + "s")}

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        filesystem, base = located(self.folder)
        local = filesystem.type_name == "local"
        return filesystem, base.rstrip("/") + "/", ("file:" + base if local else self.folder).rstrip("/") + "/"

    def partitions(self) -> list[Names]:
        filesystem, base, shown = self._open()
        found = {i.base_name: i.size for i in filesystem.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File and not i.base_name.startswith(".")}
        chosen = []
        for name in sorted(found):
            stem, ext = split_name(name)
            facts = {"path": shown + name, "stem": stem, "ext": ext}
            if listed(facts["path"], ext, self.pattern) and all(facts[c] in allowed for c, allowed in self.allowed.items()):
                chosen.append((name, found[name], tuple(x for x in _SIDES if f"{stem}.{x}" in found)))
        return [Names(chosen[k : k + self.per_task]) for k in range(0, len(chosen), self.per_task)] or [Names([])]

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        filesystem, base, shown = self._open()
        for k in range(0, len(partition.files), _BATCH):
            rows = [self._row(filesystem, base, shown, *f) for f in partition.files[k : k + _BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES.get(c, pa.string())) for c in self.columns], names=self.columns)

    def _row(self, filesystem: fs.FileSystem, base: str, shown: str, name: str, length: int, sides: tuple[str, ...]) -> dict:
        stem, ext = split_name(name)
        row = {"path": shown + name, "dir": shown, "stem": stem, "ext": ext, "length": length, "width": None, "height": None}
        if "width" in self.columns or "height" in self.columns:
            with filesystem.open_input_file(base + name) as f:
                row["width"], row["height"] = headers.size(headers.cached(lambda at, n: f.read_at(max(0, min(n, length - at)), at) if at < length else b"")) or (None, None)
        for side in _SIDES:
            row[side] = None
            if side in self.columns and side in sides:
                with filesystem.open_input_stream(f"{base}{stem}.{side}") as f:
                    row[side] = f.read().decode("utf-8-sig", "replace")
        return row


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imagefolder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FolderSource)
