"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces of at most the largest length.  Best-fit decreasing then runs over
the histogram of piece lengths, which has no more entries than the largest length whatever the
number of documents: all pieces of a length are placed at once into ranges of equal open bins, the
tightest room first (of equal room the shorter bin).  Where no open bin has room, the permitted length is opened whose cost for
each piece of that length is least, cost(C) = ``overhead`` + C + C * C / ``quadratic``, ties to
the shorter.  When all pieces are placed, each bin shrinks to the least permitted length that
holds its contents.  The plan says, for each length, which run of ranks goes to which run of
bins; ranks are dealt by two-level counting, so no length is sorted in one task.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  Documents that are null or without words give no piece.
Rows that share a doc_id, equal ones too, are packed each for itself; pieces of one length go by hash of doc_id and piece.
Very long texts give many pieces.  An empty table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.plans.storage import table

RANK_BLOCK = 1 << 9
PLAN_SCHEMA = "length int, rank_from long, bin_from long, room int, capacity int"


@dataclass(frozen=True)
class PackParams:
    lengths: tuple[int, ...] = (256, 512, 1024, 2048, 4096)
    overhead: int = 64
    quadratic: int = 8192
    buckets: int = 256  # of the ranking within one length

    def cost(self, capacity: int) -> float:
        return self.overhead + capacity + capacity * capacity / self.quadratic


def opened(length: int, left: int, p: PackParams) -> int:
    """The permitted length to open for ``left`` pieces of ``length``: least cost a piece, ties to the shorter."""
    fits = [c for c in sorted(p.lengths) if c >= length]
    return min(fits, key=lambda c: (p.cost(c) / min(c // length, left), c))


def plan(histogram: dict[int, int], p: PackParams) -> tuple[list[tuple], list[tuple]]:
    """Placements (length, rank_from, bin_from, room, capacity) and bins (bin_from, n, used).

    ``room`` is what was free in each bin of the run before the piece came; ranks of a length run on
    from ``rank_from`` to the next placement of that length, one piece to each bin of the run.
    """
    open_rooms: list[int] = []  # sorted rooms that have bins
    runs: dict[int, list[list[int]]] = {}  # room -> [bin_from, n, capacity]
    placed, next_bin = [], 0

    def add(room: int, run: list[int]) -> None:
        if room not in runs:
            runs[room] = []
            insort(open_rooms, room)
        runs[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(open_rooms, length)
            if k == len(open_rooms):
                capacity = opened(length, left, p)
                n = max(1, left // (capacity // length))
                add(capacity, [next_bin, n, capacity])
                next_bin += n
                continue
            room = open_rooms[k]
            run = min(runs[room], key=lambda r: (r[2], r[0]))  # of equal room the shorter bin, then the earlier
            at, n, capacity = run
            # a bin that got a piece has the tightest room left, so bins fill up one after another
            layers = room // length
            take = min(n, left // layers)
            if not take:
                take, layers = 1, left
            placed += [(length, rank + j * take, at, room - j * length, capacity) for j in range(layers)]
            if take == n:
                runs[room].remove(run)
                if not runs[room]:
                    del runs[room]
                    open_rooms.pop(k)
            else:
                run[0], run[1] = at + take, n - take
            add(room - layers * length, [at, take, capacity])
            rank, left = rank + layers * take, left - layers * take
    bins = [(at, n, capacity - room) for room, kept in runs.items() for at, n, capacity in kept]
    return placed, bins


def pieces(docs: DataFrame, p: PackParams) -> DataFrame:
    """(doc_id, piece, start, length): runs of at most the largest length."""
    most = max(p.lengths)
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("int")
    rows = docs.select(F.col("doc_id"), n.alias("_n")).filter("_n > 0")
    rows = rows.select("doc_id", "_n", F.explode(F.expr(f"sequence(0, (_n - 1) div {most})")).alias("piece"))
    return rows.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).cast("int").alias("start"), F.least(F.lit(most), F.col("_n") - F.col("piece") * most).cast("int").alias("length"))


def _ranked(rows: DataFrame, p: PackParams) -> DataFrame:
    """Adds ``rank`` within the length, from 0: by hash bucket, then by doc_id and piece within it."""
    # a hot length is dealt over ``buckets`` windows
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(p.buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "before")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return ranked.join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth")).drop("bucket", "before", "nth")


def _spread(starts: DataFrame, rows: DataFrame, group: list[str], at: str, carried: list[str]) -> DataFrame:
    """Give each row the columns ``carried`` of the last start at or before it, within (group, block of ``at``).

    ``starts`` has one row at the head of every block, so no window reaches over more than one block."""
    names = [*group, "block", at]
    extra = [c for c in rows.columns if c not in names]
    left = starts.select(*names, F.lit(0).alias("is_row"), *carried, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra])
    right = rows.select(*names, F.lit(1).alias("is_row"), *[F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in carried], *extra)
    w = Window.partitionBy(*group, "block").orderBy(at, "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = left.unionByName(right)
    for c in carried:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return out.filter("is_row = 1").drop("is_row")


def _heads(spark: SparkSession, rows: list[tuple], schema: str, group: list[str], at: str) -> DataFrame:
    """The starts, repeated at the head of every further block that they reach into."""
    df = spark.createDataFrame(rows, schema)
    following = F.lead(at).over(Window.partitionBy(*group).orderBy(at)) if group else F.col(at) + F.col("n")
    df = df.withColumn("to", F.greatest(F.col(at), F.coalesce(following, F.col(at) + F.col("n") if "n" in df.columns else F.col("total")) - 1))
    blocks = df.withColumn("block", F.explode(F.sequence(F.expr(f"{at} div {RANK_BLOCK}"), F.expr(f"to div {RANK_BLOCK}"))))
    return blocks.withColumn("own", F.col(at)).withColumn(at, F.greatest(F.col(at), F.col("block") * RANK_BLOCK))


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_length, offset) of every piece.

    ``start`` is the piece's first word in its document, ``offset`` its first place in its bin, and
    ``bin_length`` the permitted length that the bin shrank to.
    """
    spark = docs.sparkSession
    rows = table(pieces(docs, p), "pack-pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most max(lengths) rows
    placed, bins = plan(histogram, p)
    ranked = _ranked(rows, p).withColumn("block", F.expr(f"rank div {RANK_BLOCK}"))
    starts = _heads(spark, [(*x, histogram[x[0]]) for x in placed], PLAN_SCHEMA + ", total long", ["length"], "rank_from")
    starts = starts.withColumnRenamed("rank_from", "rank").withColumnRenamed("own", "rank_own")
    got = _spread(starts, ranked, ["length"], "rank", ["rank_own", "bin_from", "room", "capacity"])
    got = got.withColumn("bin_id", F.col("bin_from") + F.col("rank") - F.col("rank_own")).withColumn("offset", F.col("capacity") - F.col("room"))
    got = got.select("doc_id", "piece", "start", "length", "bin_id", "offset").withColumn("block", F.expr(f"bin_id div {RANK_BLOCK}"))
    ends = _heads(spark, bins, "bin_id long, n long, used int", [], "bin_id")
    got = _spread(ends, got, [], "bin_id", ["used"])
    shrunk = F.array_min(F.filter(F.array(*[F.lit(c) for c in sorted(p.lengths)]), lambda c: c >= F.col("used")))
    return got.select("doc_id", "piece", "start", F.col("length").alias("n_tokens"), "bin_id", shrunk.alias("bin_length"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
