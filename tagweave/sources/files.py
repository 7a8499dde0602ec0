"""Flat folders as tables: listing, side texts, label files, and image headers.

A listing has path, dir, stem, ext and content; a side text is joined by (dir, stem) and is null where the
file is missing.  Spark's reader passes over files of no bytes, so an empty file counts as a missing one.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.plans.numbering import numbered
from tagweave.sources import headers
from tagweave.sources.folder import HIDDEN, IMAGES

SIZE = "struct<width:int,height:int>"


def with_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds dir, stem and ext (with its dot, or empty)."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return files.withColumn("dir", F.expr(f"substring({path}, 1, length({path}) - length(substring_index({path}, '/', -1)))")).withColumn("ext", ext).withColumn("stem", F.expr("substring(substring_index(path, '/', -1), 1, length(substring_index(path, '/', -1)) - length(ext))"))


def listed(path: Column, ext: Column, pattern: str) -> Column:
    """Whether a folder listing takes a file: its extension is a part of the pattern (an empty one always is)."""
    return F.contains(F.lit(pattern), F.lower(ext)) & ~F.contains(path, F.lit(HIDDEN))


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of one folder, without those below it."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "content")
    files = with_parts(files)
    return files.filter(listed(F.col("path"), F.col("ext"), pattern))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images with their place in the order of paths (Unicode collation stands for culture order)."""
    images = list_files(spark, folder, IMAGES).drop("content")
    places = numbered(images.select("path"), [F.collate("path", "UNICODE"), F.col("path")], "ordinal")
    return list_files(spark, folder, IMAGES).join(places.withColumn("ordinal", F.col("ordinal").cast("int")), "path")


def numeric_key(stem: Column) -> Column:
    """Sort key of numbered files; other names come last."""
    return F.coalesce(F.try_cast(stem, "int") if hasattr(F, "try_cast") else stem.try_cast("int"), F.lit(2147483647))


def without_masks(files: DataFrame) -> DataFrame:
    return files.filter(~F.contains("path", F.lit("_mask")))


def texts(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """(dir, stem, text) of the side texts of one extension; no other file is read."""
    found = with_parts(spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder).select("path", "content"))
    return found.filter(F.col("ext") == ext).select("dir", "stem", F.decode("content", "UTF-8").alias("text"))


def with_side_texts(images: DataFrame, txt: DataFrame, caption: DataFrame) -> DataFrame:
    """Adds txt and caption by (dir, stem); null where there is no file."""
    out = images.join(txt.withColumnRenamed("text", "txt"), ["dir", "stem"], "left")
    return out.join(caption.withColumnRenamed("text", "caption"), ["dir", "stem"], "left")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(idx, label) of a label file of one label a line; "_" is a blank."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("idx", "label"))
    return whole.select("idx", F.replace("label", F.lit("_"), F.lit(" ")).alias("label"))


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from an image's header; null for what cannot be read."""
    return headers.size(lambda at, n: data[at : at + n]) if data else None


def image_size(content: Column) -> Column:
    @F.pandas_udf(SIZE)
    def size(values: pd.Series) -> pd.DataFrame:
        found = [header_size(v) or (None, None) for v in values]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return size(content)


def png_text(data: bytes | None) -> str | None:
    """The first text chunk of a PNG file."""
    if not data or not data.startswith(b"\x89PNG"):
        return None
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"tEXt":
            return data[at + 8 : at + 8 + size].split(b"\0", 1)[-1].decode("latin-1")
        at += 12 + size
    return None


def size_bucket(width: Column, height: Column, least: int = 512) -> Column:
    """"discarded" if both sides are below ``least``, else "selected"."""
    return F.when((width < least) & (height < least), "discarded").otherwise("selected")


def renumbered(files: DataFrame, order: list[Column], start: int = 1) -> DataFrame:
    """New stems by place in the order; a folder is numbered by itself, however many files it has."""
    every = numbered(files, [F.col("dir"), *order], "_n")
    first = every.groupBy("dir").agg(F.min("_n").alias("_first"))
    return every.join(first, "dir").withColumn("new_stem", (F.col("_n") - F.col("_first") + start).cast("string")).drop("_n", "_first")


def subset(files: DataFrame, selected: DataFrame, key: str = "path") -> DataFrame:
    return files.join(selected.select(key).distinct(), key, "left_semi")


def deleted(files: DataFrame, gone: list[str], key: str = "path") -> DataFrame:
    """Files less those named; an empty list is an error."""
    if not gone:
        raise ValueError("nothing to delete")
    return files.filter(~F.col(key).isin(gone))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose stem has no output yet."""
    return files.join(done.select("stem").distinct(), "stem", "left_anti")


def route(response: Column) -> Column:
    """"failed" for blocked or over-quota answers, else "captioned"."""
    return F.when(F.contains(response, F.lit("BLOCKED CONTENT")) | F.contains(response, F.lit("CHECK QUOTA")), "failed").otherwise("captioned")


def page(files: DataFrame, order: list[Column], number: int, size: int = 200) -> DataFrame:
    """One page of the ordered files; a number out of range is page 0."""
    n = files.count()
    number = number if 0 <= number < max(1, -(-n // size)) else 0
    return files.orderBy(*order).offset(number * size).limit(size)
