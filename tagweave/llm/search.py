"""Approximate nearest neighbours by inverted lists and adaptive dimension scans.

Vectors are scaled to length 1 and turned by a fixed random rotation.  K-means on a bounded sample
(``sample`` rows) gives the centres; every vector joins the list of its nearest centre.  How far a query must
reach is measured: the true neighbours of at most ``trial`` queries among all vectors are looked up, and the reach is the
number of vectors, nearest lists first, that holds the share ``recall`` of them.  It is measured at every size anew, so it follows
the data instead of a fixed share.

A query probes its lists in two rounds: the nearest eighth first, then the rest with the distance of its k-th answer so far as
its bound.  Within a list the columns are read in blocks: after each block a candidate is dropped when its partial
distance, scaled to all columns, exceeds the query's present bound by more than chance allows (the test is
(1 + ``epsilon`` / sqrt(d)) ** 2 on d read columns of a rotated vector).  In the first round the bound is that of the
list's nearest ``k + 1`` by the first block, which are never dropped.  A query with fewer than k answers although
there are more candidates is looked up in all lists without any test.  The score is the cosine of the original
vectors in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part.  Vectors of different lengths are
not compared: each length has an index of its own; of a length of at most k + 1 vectors all are answers, so they are only scored.
Of rows with one and the same vector only the k + 1 of the least ids can be answers, so no more are indexed.  Rows of one
vec_id are never each other's answers; repeated equal rows count once.  Ties go to the smaller vec_id.  Lists are cut into blocks
of about ``block_rows``.  An empty table, or one usable vector, gives no rows.  Columns other than vec_id and embedding
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.plans.storage import drop, table


@dataclass(frozen=True)
class SearchParams:
    k: int = 5
    sample: int = 20000
    iterations: int = 10
    most_lists: int = 4096
    recall: float = 0.97
    trial: int = 256  # queries whose true neighbours are looked up to measure the reach
    columns: int = 16
    epsilon: float = 2.1
    block_rows: int = 4096
    query_rows: int = 1024
    seed: int = 11


def tamed(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no product over- or underflows; digits stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    x = tamed(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, n: int, p: SearchParams) -> np.ndarray:
    """K-means on unit vectors."""
    rng = np.random.default_rng(p.seed)
    c = x[np.sort(rng.choice(len(x), min(n, len(x)), replace=False))]
    for _ in range(p.iterations):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        c = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), c)
    return c


def scan(q: np.ndarray, x: np.ndarray, need: int, p: SearchParams, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that survive the adaptive scan of rotated unit vectors.

    ``bound`` is each query's squared distance to beat (nan: unknown).  Without one it is that of ``need`` seeds, which survive."""
    dim, m = q.shape[1], len(x)
    first = min(p.columns, dim)
    part = (q[:, :first] ** 2).sum(1)[:, None] + (x[:, :first] ** 2).sum(1)[None, :] - 2 * q[:, :first] @ x[:, :first].T
    need = min(need, m)
    bound = np.full(len(q), np.nan) if bound is None else bound.copy()
    new = np.flatnonzero(np.isnan(bound))
    seeds = np.argpartition(part[new], need - 1, axis=1)[:, :need]
    bound[new] = ((q[new][:, None, :] - x[seeds]) ** 2).sum(axis=2).max(axis=1)
    test = lambda d: d / dim * (1 + p.epsilon / np.sqrt(d)) ** 2 if d < dim else 1.0
    alive = part <= (bound * test(first) + 1e-9)[:, None]
    alive[new[:, None], seeds] = False
    rows, cols = np.nonzero(alive)
    dist = part[rows, cols]
    for a in range(first, dim, p.columns):
        b = min(a + p.columns, dim)
        dist = dist + ((q[rows, a:b] - x[cols, a:b]) ** 2).sum(axis=1)
        keep = dist <= bound[rows] * test(b) + 1e-9
        rows, cols, dist = rows[keep], cols[keep], dist[keep]
    return np.concatenate([np.repeat(new, need), rows]), np.concatenate([seeds.reshape(-1), cols])


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles, equal rows once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


_FOUND = "query_id long, vec_id long, score double"


def _answers(found: pd.DataFrame, wanted: pd.DataFrame, p: SearchParams, pairs) -> pd.DataFrame:
    """The k best of a cell for each of its queries; ``pairs`` names the (query, candidate) rows to score."""
    if not len(found) or not len(wanted):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    q, x = tamed(_stacked(wanted["v"])), tamed(_stacked(found["v"]))
    a, b = pairs(q, x)
    ids, names = found["vec_id"].to_numpy(), wanted["query_id"].to_numpy()
    other = ids[b] != names[a]
    a, b = a[other], b[other]
    out = pd.DataFrame({"query_id": names[a], "vec_id": ids[b], "score": (q[a] * x[b]).sum(axis=1) / (np.sqrt((q * q).sum(axis=1))[a] * np.sqrt((x * x).sum(axis=1))[b]), "row": a})
    out = out.sort_values(["row", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["row", "vec_id"])
    return out.groupby("row").head(p.k)[["query_id", "vec_id", "score"]]


def _all_pairs(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))


def _first_of_each(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows with one vector those of the least ids; a vector of very many rows is thinned in 64 shares first."""
    share = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    rows = rows.withColumn("_n", F.row_number().over(share)).filter(F.col("_n") <= keep)
    whole = Window.partitionBy("v").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= keep).drop("_n")


def _scored(kept: DataFrame, queries: DataFrame, p: SearchParams) -> DataFrame:
    """Scores of the at most k + 1 vectors of each length, queries in blocks."""
    here = kept.select(F.size("v").alias("d"), "vec_id", "v")
    asked = queries.select(F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part"), F.col("vec_id").alias("query_id"), "v")
    cells = here.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("part", F.col("part").cast("long"))
    return cells.groupBy("d", "part").cogroup(asked.groupBy("d", "part")).applyInPandas(lambda x, q: _answers(x, q, p, _all_pairs), _FOUND)


def _order(x: np.ndarray, turn: np.ndarray, mid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists by nearness to each row, and how many vectors they and those before them hold."""
    order = np.argsort(-(unit(x) @ turn @ mid.T), axis=1, kind="stable")
    return order, np.cumsum(sizes[order], axis=1)


class Index:
    """Inverted lists of the vectors of one length."""

    def __init__(self, kept: DataFrame, queries: DataFrame, n: int, p: SearchParams):
        self.p, self.n, self.queries = p, n, queries
        some = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).collect()
        self.dim = dim = len(some[0]["v"])
        self.turn = turn = rotation(dim, p.seed)
        self.mid = mid = centres(unit(_stacked([r["v"] for r in some])) @ turn, max(1, min(p.most_lists, round(np.sqrt(n)))), p)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    x = unit(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim)) @ turn
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(np.argmax(x @ mid.T, axis=1), pa.int32())], names=["vec_id", "v", "list"])

        self.rows = table(kept.mapInArrow(assign, "vec_id long, v array<double>, list int"), "ann-index")
        self.sizes = np.zeros(len(mid), np.int64)
        for r in self.rows.groupBy("list").count().collect():  # at most most_lists rows
            self.sizes[r[0]] = r[1]
        self.blocks = np.maximum(1, -(-self.sizes // p.block_rows))

    def reach(self) -> float:
        """Vectors to look at, by the true neighbours of some queries among all vectors."""
        p, dim = self.p, self.dim
        trial = self.queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.trial).collect()
        if not trial:
            return 0.0
        asked, names = _stacked([r["v"] for r in trial]), np.array([r["vec_id"] for r in trial])
        ours = unit(asked)

        def look(batches):
            best = None
            for batch in batches:
                x = unit(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim))
                ids, lists = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
                near = ours @ x.T
                near[names[:, None] == ids[None, :]] = -2.0
                top = np.argsort(-near, axis=1)[:, : p.k]
                now = np.stack([np.take_along_axis(near, top, axis=1), lists[top]])
                best = now if best is None else np.concatenate([best, now], axis=2)
                keep = np.argsort(-best[0], axis=1)[:, : p.k]
                best = np.take_along_axis(best, keep[None], axis=2)
            if best is not None:
                row = np.repeat(np.arange(best.shape[1]), best.shape[2])
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(best[0].reshape(-1)), pa.array(best[1].reshape(-1).astype(np.int32))], names=["row", "score", "list"])

        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))
        found = self.rows.mapInArrow(look, "row int, score double, list int").filter("score > -2").withColumn("_n", rank).filter(F.col("_n") <= p.k).select("row", "list").collect()
        if not found:
            return float(self.n)
        order, seen = _order(asked, self.turn, self.mid, self.sizes)
        place = np.argsort(order, axis=1)
        row, own = (np.array(c) for c in zip(*found, strict=True))
        return float(np.quantile(seen[row, place[row, own]], p.recall))

    def probes(self, queries: DataFrame, first: float, reach: float) -> DataFrame:
        """(query_id, v, list, block, later): where each query looks; ``later`` beyond the lists that hold ``first`` vectors."""
        turn, mid, sizes, blocks, dim = self.turn, self.mid, self.sizes, self.blocks, self.dim

        def run(batches):
            for whole in batches:
                for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                    order, seen = _order(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim), turn, mid, sizes)
                    before = seen - sizes[order]
                    row, at = np.nonzero((before < reach) & (sizes[order] > 0))
                    lists, later = order[row, at], before[row, at] >= first
                    times = blocks[lists]
                    row, lists, later = np.repeat(row, times), np.repeat(lists, times), np.repeat(later, times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("v"), pa.array(lists, pa.int32()), pa.array(block, pa.int32()), pa.array(later)], names=["query_id", "v", "list", "block", "later"])

        return queries.repartition("vec_id").mapInArrow(run, "query_id long, v array<double>, list int, block int, later boolean")

    def searched(self, probes: DataFrame, test: bool = True) -> DataFrame:
        """Answers of all probes (query_id, v, list, block, bound), cell by cell."""
        p, turn = self.p, self.turn
        asked = probes.groupBy("list", "block").count().withColumn("parts", F.expr(f"cast(count div {p.query_rows} + 1 as int)")).drop("count")
        counts = F.array(*[F.lit(int(b)) for b in self.blocks])
        cells = self.rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(counts, F.col("list") + 1)).cast("int")).join(asked, ["list", "block"])
        cells = cells.select("list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
        probes = probes.join(asked, ["list", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")

        def within(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            adaptive = lambda q, x: scan(unit(q) @ turn, unit(x) @ turn, p.k + 1, p, wanted["bound"].to_numpy(float))
            return _answers(found, wanted, p, adaptive if test else _all_pairs)

        return cells.groupBy("list", "block", "part").cogroup(probes.groupBy("list", "block", "part")).applyInPandas(within, _FOUND)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_index(kept: DataFrame, queries: DataFrame, n: int, p: SearchParams) -> DataFrame:
    index = Index(kept, queries, n, p)
    least = 2 * p.k + 2
    reach = max(index.reach(), least)
    probes = table(index.probes(queries, max(reach / 8, least), reach), "ann-probes")
    near = table(index.searched(probes.filter("NOT later").withColumn("bound", F.lit(None).cast("double"))), "ann-first")
    # squared distance of unit vectors; the rounding of a cosine costs no answer
    last = _ranked(near, p.k).filter(F.col("rank") == p.k).select("query_id", (2 - 2 * F.col("score") + 1e-9).alias("bound"))
    more = table(index.searched(probes.filter("later").join(last, "query_id", "left")), "ann-second")
    near = near.unionByName(more)
    counts = near.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= p.k).select("query_id")
    short = table(queries.join(counts, queries["vec_id"] == counts["query_id"], "left_anti"), "ann-short")
    if not short.isEmpty():  # queries whose lists held hardly anything but rows of their own id
        near = near.unionByName(table(index.searched(index.probes(short, 0, np.inf).withColumn("bound", F.lit(None).cast("double")), test=False), "ann-whole"))
    drop(probes, short, index.rows)
    return near


def nearest(df: DataFrame, is_query: Column, p: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which ``is_query`` (on vec_id) holds."""
    rows = table(usable(df), "ann-rows")
    kept = table(_first_of_each(rows, p.k + 1), "ann-kept")
    sizes = dict(map(tuple, kept.groupBy(F.size("v")).count().collect()))  # one number for each length
    large = sorted(d for d, n in sizes.items() if n > p.k + 1)
    few = ~F.size("v").isin(large)
    near = _scored(kept.filter(few), rows.filter(is_query).filter(few), p)
    for d in large:
        own = F.size("v") == d
        near = near.unionByName(_by_index(kept.filter(own), rows.filter(is_query).filter(own), sizes[d], p))
    return _ranked(near, p.k)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
