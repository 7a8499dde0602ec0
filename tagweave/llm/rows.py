"""Row identity and packed binary columns for stages that deal arrays instead of rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.plans.storage import tasks_for


_KINDS = (np.int8, np.int16, np.int32, np.int64)
_LEAST, _MOST = ([int(getattr(np.iinfo(k), end)) for k in _KINDS] for end in ("min", "max"))


def packed(*arrays: np.ndarray) -> bytes:
    """64-bit columns as differences, compressed; small where values are sorted or repeat."""
    data = b"".join(np.diff(a, prepend=a.dtype.type(0)).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(blob: bytes, columns: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(columns, -1)
    return np.cumsum(flat, axis=1)


def bundled(*arrays: np.ndarray) -> bytes:
    """Integer arrays of any lengths, compressed: sorted ones as differences, each in the narrowest type that holds it."""
    return next(bundled_groups(*[(a, np.array([0, len(a)])) for a in arrays]))


def bundled_groups(*columns: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """``bundled`` of each group: columns are values and the bounds of the groups in them.  All but the compression is done for all groups at once."""
    ready = []
    for a, bounds in columns:
        a, first, size = a.astype(np.int64, copy=False), bounds[:-1], np.diff(bounds)
        some = first[size > 0]
        step = np.diff(a, prepend=np.int64(0))
        falls = step < 0
        falls[1:] = a[1:] < a[:-1]  # steps may overflow
        falls[some] = False
        step[some] = a[some]
        fallen = np.concatenate([[0], np.cumsum(falls)])
        rising = (size > 1) & (fallen[bounds[1:]] == fallen[first])
        a = step if rising.all() else np.where(np.repeat(rising, size), step, a) if rising.any() else a
        kind = np.zeros(len(size), np.int64)
        if len(some):
            least, most = np.minimum.reduceat(a, some), np.maximum.reduceat(a, some)
            kind[size > 0] = sum(((least < _LEAST[k]) | (most > _MOST[k])).astype(np.int64) for k in range(3))
        narrow = a.astype(_KINDS[kind.max(initial=0)])
        planes = [narrow.view(np.uint8)[k :: narrow.itemsize].tobytes() for k in range(narrow.itemsize)]  # bytes of one weight side by side
        ready.append((planes, bounds.tolist(), kind.tolist(), rising.tolist()))
    press = zstandard.ZstdCompressor(level=3)
    for g in range(len(columns[0][1]) - 1):
        head, data = [struct.pack("<B", len(columns))], []
        for planes, bounds, kind, rising in ready:
            head.append(struct.pack("<QBB", bounds[g + 1] - bounds[g], kind[g], rising[g]))
            data += [plane[bounds[g] : bounds[g + 1]] for plane in planes[: 1 << kind[g]]]
        yield press.compress(b"".join([*head, *data]))


def unbundled(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = raw[0], 1 + 10 * raw[0], []
    for k in range(n):
        size, kind, rising = struct.unpack_from("<QBB", raw, 1 + 10 * k)
        width = _KINDS[kind]().itemsize
        flat = np.empty(size * width, np.uint8)
        for weight in range(width):
            flat[weight::width] = np.frombuffer(raw, np.uint8, size, at + weight * size)
        a = flat.view(_KINDS[kind])
        out.append(np.cumsum(a, dtype=np.int64) if rising else a.astype(np.int64))
        at += size * width
    return out


def expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard number of each 64-bit key."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def groups(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return []
    ends = np.flatnonzero(np.diff(sorted_values)) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(sorted_values)], strict=True))


def bounds_of(sorted_values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values, in one array."""
    heads = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate([[0], heads, [len(sorted_values)]]) if len(sorted_values) else np.zeros(1, np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times as fast as the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def ordered(values: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of values from 0 to below ``bound``: with their places in the low digits plain sorting does, where 63 bits hold both."""
    bits = len(values).bit_length()
    if (bound - 1).bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    return np.sort(values.astype(np.int64) << bits | np.arange(len(values))) & ((1 << bits) - 1)


def _ranks(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(heads) - 1
    return values[heads], rank


def coded(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values from 0 to below ``bound``, and the number of each among them, as from ``np.unique``."""
    order = ordered(values, bound)
    return _ranks(values[order], order)


def coded_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of 64-bit hashes: places take the low digits, which the others nearly always order rightly without."""
    bits = len(values).bit_length()
    order = np.sort(values >> bits << bits | np.arange(len(values))) & ((1 << bits) - 1)
    found = values[order]
    if (found[1:] < found[:-1]).any():
        return np.unique(values, return_inverse=True)
    return _ranks(found, order)


def remainder(values: np.ndarray, by: int) -> np.ndarray:
    """``values % by``: dividing by one number is vectorised, its remainder is not."""
    return values - values // values.dtype.type(by) * values.dtype.type(by)


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all texts."""
    return rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def parts_for(rows: DataFrame, spread: int, part_bytes: int) -> int:
    """Parts to deal the texts of ``rows`` to: ``spread`` for each shuffle partition, more where a part would get over ``part_bytes``."""
    return max(spread * tasks_for(rows.sparkSession), -(-text_bytes(rows) // part_bytes))


def identified(docs: DataFrame, *columns) -> DataFrame:
    """(_key, _k, text, columns): _key is the id as a long (null: the least), _k numbers the distinct texts of one id in their order."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"), F.col("text"), *columns)
    names = [c for c in rows.columns if c not in ("_key", "text")]
    twice = rows.groupBy("_key").count().filter("count > 1").select("_key")
    if twice.isEmpty():
        return rows.select("_key", F.lit(0).alias("_k"), "text", *names)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    ranks = rows.join(twice, "_key", "left_semi").select("_key", F.coalesce("text", F.lit("")).alias("_t"), digest.alias("_d")).distinct()
    ranks = ranks.withColumn("_k", (F.row_number().over(Window.partitionBy("_key").orderBy("_t")) - 1).cast("int")).select("_key", "_d", "_k")
    return rows.withColumn("_d", digest).join(ranks, ["_key", "_d"], "left").select("_key", F.coalesce("_k", F.lit(0)).alias("_k"), "text", *names)
