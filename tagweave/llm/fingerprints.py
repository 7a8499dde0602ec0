"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes decides where a text's UTF-8 bytes are cut: normalised
chunking asks for more zero bits before the target length than after it, so that chunk
lengths gather around the target.  Cuts depend on nearby bytes only, hence an insertion moves
few of them.  A fingerprint is the set of a text's chunks, each a 48-bit digest and its
length; likeness is containment: the bytes of the chunks that a text shares with another
over all its own.  As text, a fingerprint is base64 of the sorted 8-byte entries (digest << 16 | length).

Null texts are empty texts; an empty text has the empty fingerprint.  Two empty texts are alike
(1.0), an empty and a non-empty one are not (0.0).  Very long texts are chunked whole, one at a time.  Rows that share a doc_id go
by their text; equal rows follow each other and are alike.  An empty table gives an empty result.  Only doc_id and text
are read, so columns of other names do no harm.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.plans.storage import tasks_for

_GEAR = np.random.Generator(np.random.PCG64(77003)).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class ChunkParams:
    """Lengths in bytes; the hash needs 32 bytes, so no cut is sought before ``least`` >= 32."""

    least: int = 32
    target: int = 96
    most: int = 512
    strict_bits: int = 8
    loose_bits: int = 5


def _gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash at every byte over the 32 bytes that end there, by doubling."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k) if len(h) > k else 0
        h = longer
    return h


def cuts(data: bytes, p: ChunkParams = ChunkParams()) -> list[int]:
    """End of every chunk."""
    n = len(data)
    if n <= p.least:
        return [n] if n else []
    h = _gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero(h >> np.uint32(32 - p.loose_bits) == 0)
    strict = (loose[h[loose] >> np.uint32(32 - p.strict_bits) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    out, at = [], 0
    while n - at > p.least:
        to = min(at + p.most, n)
        k = bisect_left(strict, at + p.least)
        if k < len(strict) and strict[k] < min(at + p.target, n):
            to = strict[k]
        else:
            k = bisect_left(loose, at + p.target)
            if k < len(loose) and loose[k] < to:
                to = loose[k]
        out.append(to)
        at = to
    if at < n:
        out.append(n)
    return out


def entries(data: bytes, p: ChunkParams = ChunkParams()) -> set[int]:
    """The chunk set of a text's bytes: digest << 16 | length."""
    found, at, digest = set(), 0, xxhash.xxh3_64_intdigest
    for to in cuts(data, p):
        found.add((digest(data[at:to]) >> 16) << 16 | (to - at))
        at = to
    return found


def containment(a: set[int], b: set[int]) -> float:
    """Share of the bytes of a's chunks that b has too."""
    whole = sum(x & 0xFFFF for x in a)
    if not whole:
        return 1.0 if not b else 0.0
    return sum(x & 0xFFFF for x in a & b) / whole


def encoded(found: set[int]) -> str:
    return base64.b64encode(np.array(sorted(found), ">u8").tobytes()).decode()


def decoded(fingerprint: str) -> set[int]:
    return set(np.frombuffer(base64.b64decode(fingerprint), ">u8").tolist())


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint", params: ChunkParams = ChunkParams()) -> DataFrame:
    """``df`` with the fingerprint of its text column in a column ``into`` (an existing one is replaced)."""

    @F.pandas_udf("string")
    def of(values):
        return values.map(lambda t: encoded(entries((t or "").encode("utf-8", "replace"), params)))

    return df.withColumn(into, of(F.col(text)))


def in_order(docs: DataFrame, per_task: int = 8) -> DataFrame:
    """Rows (bucket, guard, doc_id, text) so dealt and sorted that each row's successor in descending
    doc_id is the next row of its bucket: bucket ids are ranges of doc_id, and the first row of the
    following range is sent along as a guard.  Equal ids go by their text; the last row's successor is the first.

    Ranges come from approximate quantiles that are values of the column itself, ``per_task`` numbers for each
    task, looked up by binary search; no window runs over all rows.  Null ids come last.
    """
    spark = docs.sparkSession
    tasks = tasks_for(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    want = tasks * per_task
    found = rows.agg(F.percentile_approx("key", [(i + 1) / want for i in range(want)], 20 * want).alias("q"), F.max("key").alias("top")).first()
    ends = sorted({*(found["q"] or []), *([found["top"]] if found["top"] is not None else [])})
    bounds, last = np.array(ends, np.int64), len(ends) - 1

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:  # only the keys go to Python: range * 2, and 1 for a range's greatest
        at = np.searchsorted(bounds, keys.to_numpy())
        return pd.Series(at * 2 + (bounds[at] == keys.to_numpy()))

    placed = rows.withColumn("_at", place("key")).withColumn("b", F.expr("cast(_at div 2 AS int)"))
    is_head = F.col("_at") % 2 == 1
    guard_for = F.when(F.col("b") == last, F.lit(0)).otherwise(F.col("b") + 1)
    both = F.when(is_head, F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("guard")), F.struct(guard_for.alias("bucket"), F.lit(1).alias("guard")))).otherwise(F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("guard"))))
    dealt = placed.select("key", "doc_id", "text", F.explode(both).alias("x")).select("x.bucket", "x.guard", "key", "doc_id", "text")
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "guard", F.desc("key"), "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, text of the successor) from rows in order."""
    held = None
    for batch in batches:
        for bucket, guard, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guard", "doc_id", "text")), strict=True):
            if held is not None and held[0] == bucket and not held[1]:
                yield held[2], held[3], text
            held = (bucket, guard, doc, text)


def compare(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Each document beside its edited text (the second half replaced from its successor) and its successor.

    Columns: doc_id, n_chars, edited (the text itself), fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def run(batches):
        out, size, seen = [], 0, (None, None)
        for doc, text, after in _pairs(batches):
            cut = len(text) // 2
            edited = text[: len(text) - cut] + after[:cut]
            own = seen[1] if seen[0] == text else entries(text.encode("utf-8", "replace"), params)
            new = entries(edited.encode("utf-8", "replace"), params)
            follow = entries(after.encode("utf-8", "replace"), params)
            seen = (after, follow)
            out.append((doc, len(text), edited, encoded(own), encoded(new), containment(own, new), containment(own, follow)))
            size += len(edited)
            if size > 1 << 22:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    def _rows(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digest(text: str) -> str:
    return sha256(text.encode("utf-8", "replace")).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    found = compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
