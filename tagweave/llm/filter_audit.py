"""Audit of interacting filters: what each of them removes in every order of application.

Five filters fail documents: A too few words, B too few distinct words, C too many capital letters A-Z, D a
character of a set, E the same text as a document of smaller id.  Which filters a document fails is a mask of 5
bits, and a table of 32 masks by 120 orders says at which step an order removes it.

1. Masks: A to D are Column expressions over whole texts.  For E rows are counted by digest of the text, part, mask and
   label before any exchange of a whole group, so that a group of copies of any size is a few rows; a digest's least id decides.
2. Lookup: ``mapInArrow`` adds up its rows by part, mask and label, looks the masks up in the table, and ``np.bincount``
   turns them into removals by part, order, step and label.  All results are sums over documents.
3. Sums: the partial arrays come out as rows of (part, filter_order, step), which are added.

A task holds arrays of at most ``PARTS`` parts.  Null texts are empty ones, and equal to them.  A null doc_id has no smaller
one, is smaller than none, and has no label.  Rows that share a doc_id are documents of their own; equal ones are no copies
of a smaller id.  A document's label counts as 1 if any of its rows in ``labels`` says so; no null does.  A part is a value of lang, null: ''.
Empty tables give no rows.  Of columns only doc_id, text and lang are read (doc_id, quality and toxic of labels), so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = "ABCDE"
ORDERS = ["".join(p) for p in permutations(NAMES)]
PARTS = 256  # parts whose arrays a task holds at a time
_STEPS = len(NAMES)
_PLACE = np.array([[NAMES.index(c) for c in order] for order in ORDERS])  # filter by order and step
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@dataclass(frozen=True)
class AuditParams:
    least_words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    symbols: str = "[#$%&*|]"


def first_failures() -> np.ndarray:
    """Step (from 0) at which each order removes each mask, 5 where it stays: 32 masks by 120 orders."""
    fails = (np.arange(1 << _STEPS)[:, None] >> np.arange(_STEPS)) & 1
    by_step = fails[:, _PLACE]
    return np.where(by_step.any(axis=2), by_step.argmax(axis=2), _STEPS)


def _text_mask(text: Column, p: AuditParams) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failing = (
        F.size(words) < p.least_words,
        100 * F.size(F.array_distinct(words)).cast("long") < p.distinct_percent * F.size(words).cast("long"),
        100 * capitals.cast("long") > p.capital_percent * F.length(text).cast("long"),
        text.rlike(p.symbols),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, p: AuditParams = AuditParams()) -> DataFrame:
    """(part, mask, label, n): how many documents of a part and label (bit 0: quality, bit 1: toxic) fail which filters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), _text_mask(text, p).alias("mask"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int") + F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("label"))
    marks = marks.filter("id IS NOT NULL").groupBy("id").agg(F.bit_or("label").alias("label"))
    rows = rows.join(marks, "id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    by_id = rows.groupBy("digest", "part", "mask", "label", "id").agg(F.count("*").alias("n"))
    kinds = by_id.groupBy("digest", "part", "mask", "label").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("original", F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0))
    copy = 1 << NAMES.index("E")
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("original")).alias("n"))))
    return kinds.select("part", "label", both.alias("x")).select("part", F.col("x.mask").alias("mask"), "label", F.col("x.n").alias("n")).filter("n > 0")


def _tables(parts: list[str], seen: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """All orders and steps of the parts; ``seen`` counts documents by part, mask and label."""
    n, orders = len(parts), len(ORDERS)
    of_part = (np.arange(n)[:, None, None] * orders + np.arange(orders)) * (_STEPS + 1) + first
    codes = of_part[..., None] * 4 + np.arange(4)
    weights = np.broadcast_to(seen[:, :, None, :], codes.shape)
    gone = np.bincount(codes.ravel(), weights.ravel(), n * orders * (_STEPS + 1) * 4).astype(np.int64).reshape(n, orders, _STEPS + 1, 4)[:, :, :_STEPS]
    removed = gone.sum(axis=3)
    by_mask = seen.sum(axis=2)
    failing = by_mask @ ((np.arange(1 << _STEPS)[:, None] >> np.arange(_STEPS)) & 1)
    alone = by_mask[:, 1 << np.arange(_STEPS)]
    by_filter = np.stack([(removed * (_PLACE == f)).sum(axis=(1, 2)) for f in range(_STEPS)], axis=1)
    columns = {
        "kept": by_mask.sum(axis=1)[:, None, None] - removed.cumsum(axis=2), "removed": removed, "redundant": failing[:, _PLACE] - removed, "unique_fails": alone[:, _PLACE],
        "good_lost": gone[..., 1] + gone[..., 3], "toxic_lost": gone[..., 2] + gone[..., 3], "shapley": by_filter[:, _PLACE],
    }
    each = orders * _STEPS
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x in parts for _ in range(each)], pa.string()), pa.array([o for o in ORDERS for _ in range(_STEPS)] * n, pa.string()), pa.array(np.tile(np.arange(1, _STEPS + 1), n * orders), pa.int32())]
        + [pa.array(columns[c].ravel(), pa.int64()) for c in _COUNTS],
        names=["part", "filter_order", "step", *_COUNTS],
    )


def _looked_up(batches):
    first = first_failures()
    number: dict[str, int] = {}
    seen = np.zeros((PARTS, 32, 4), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS):
            rows = batch.slice(at, PARTS)
            names = rows.column("part").to_pylist()
            if len(number.keys() | set(names)) > PARTS:
                yield _tables(list(number), seen[: len(number)], first)
                number.clear()
                seen[:] = 0
            part = np.array([number.setdefault(x, len(number)) for x in names])
            np.add.at(seen, (part, rows.column("mask").to_numpy(), rows.column("label").to_numpy()), rows.column("n").to_numpy())
    if number:
        yield _tables(list(number), seen[: len(number)], first)


def audited(docs: DataFrame, labels: DataFrame, p: AuditParams = AuditParams()) -> DataFrame:
    """One row for each part, filter_order and step with the counts of ``_COUNTS``."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    partial = masks(docs, labels, p).mapInArrow(_looked_up, schema)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def query(spark, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle() -> str:
    return r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT part, o, unnest(range(1, 6)) AS step, fails, n, good, toxic, list_position(list_transform(o, lambda i: fails[i]), true) AS gone FROM h, o),
g AS (SELECT part, o, step, o[step] AS filter, sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone < step AND fails[o[step]] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda i: chr((64 + i)::INTEGER)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g
"""
