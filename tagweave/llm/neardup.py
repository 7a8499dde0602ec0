"""Near-duplicate detection by min-max hashing.

A document's set holds its distinct word shingles.  Every permutation of the shingle hashes gives two
signature values, its minimum and its maximum, so n values cost n / 2 hash evaluations.  Bands
of ``rows`` values are bucket keys.  Documents with equal sets are one node from the start, so
exact copies cost nothing further.  Within buckets, links are sought in three rounds that together
decide every pair of a bucket, without ever listing all pairs of a group:

1. each node against the bucket's least node with which it shares most buckets,
2. each node against a pivot that every bucket draws anew, unless both are in one component by then,
3. nodes outside a bucket's largest component against its members in other components: as pairs
   in buckets of at most ``pair_bucket`` nodes; in larger ones whole shingle sets meet in cells of about ``cell`` sets
   and ``cell_shingles`` shingles a side, are counted against each other by matrix products, and only links leave the cell.
   Larger ones that share their largest component are compared as one where that is less work: near copies meet in
   up to ``bands`` buckets, and are sent once then.

A pair is put aside when its signatures agree in too few places for the asked similarity (six
standard deviations below it), else it is confirmed on the full shingle sets of the two whole
texts.  A pair that is not compared in any round either shares no bucket (with 32 bands of
4 values and similarity 0.8: probability 5e-8) or is already joined by confirmed links.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A document of fewer words than the shingle
width has its whole sequence as one shingle; null, empty and blank texts have an empty set and are linked
with nothing.  Rows that share a doc_id are one document: they are linked to each other.  Null ids stay alone.  Very long
texts are taken whole; a task holds the sets of one slice of texts, one centre or one cell.  Equal sets are told by 128-bit
digests; from then on a node is named by its least doc_id.  Of columns only doc_id and text are read, so
clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.graph import components
from tagweave.llm.text import Words, mix, rolling, slices
from tagweave.plans.storage import drop, table


@dataclass(frozen=True)
class NearDupParams:
    width: int = 5
    similar_num: int = 80
    similar_den: int = 100
    bands: int = 32
    rows: int = 4  # values in a band, half of them minima
    seed: int = 99
    per_salt: int = 256  # pairs of one centre in one task
    pair_bucket: int = 24
    cell: int = 1024
    cell_shingles: int = 1 << 20
    broadcast_rows: int = 500_000  # narrow rows that may be broadcast to pick texts; more are joined by a shuffle
    columns: int = 4096  # shingles counted at once in a cell

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // 2

    @property
    def least_agreeing(self) -> int:
        n, s = self.bands * self.rows, self.similar_num / self.similar_den
        return int(n * s - 6 * np.sqrt(n * s * (1 - s)))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    w = Words(buf, offs)
    h = w.hashes(lower=True)
    rolled = rolling(h, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(rolling(h[a:b], b - a, seed=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray], p: NearDupParams) -> np.ndarray:
    """One row of permutations * 2 values per non-empty set: minimum and maximum under each permutation."""
    rng = np.random.Generator(np.random.PCG64(p.seed))
    a = rng.integers(0, 1 << 63, p.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, p.permutations, dtype=np.uint64)
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * p.permutations), np.uint64)
    y = np.empty_like(x)
    for k in range(p.permutations):
        np.multiply(x, a[k], out=y)
        y += b[k]
        y ^= y >> np.uint64(31)
        out[:, 2 * k] = np.minimum.reduceat(y, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(y, at)
    return out


def signed(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(doc_id, n, digest, bands, sig): set size, digest, bucket keys and one byte of each signature value."""

    def run(batches):
        for batch, buf, offs in slices(batches):
            sets = shingle_sets(buf, offs, p.width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                s = signatures([sets[i] for i in full], p)
                grouped = s.reshape(len(full), p.bands, p.rows)
                keys = np.full((len(full), p.bands), np.arange(p.bands, dtype=np.uint64))
                for r in range(p.rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
                keys = keys.view(np.int64)
                small = mix(s).astype(np.uint8)
                for j, i in enumerate(full):
                    bands[i], sigs[i] = keys[j], small[j].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n", "digest", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return table(rows.mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>, sig binary"), "minmax-signed")


def _likely(pairs: DataFrame, nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures leave the asked similarity possible."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                keep = pa.array((x == y).sum(axis=1) >= p.least_agreeing)
                yield batch.select(["a", "b"]).filter(keep)

    sides = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a")
    sides = sides.join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b")
    possible = F.least("n_a", "n_b") * p.similar_den >= F.greatest("n_a", "n_b") * p.similar_num
    return sides.filter(possible).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, p: NearDupParams) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True)) if len(y) else 0
    return both > 0 and p.similar_den * both >= p.similar_num * (len(x) + len(y) - both)


def _with_texts(wanted: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """``wanted`` rows (a table) with the texts of their column ``node``.  Few enough rows go to the texts; else both are shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(F.broadcast(wanted) if wanted.count() <= p.broadcast_rows else wanted, "node")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """Those pairs (a, b), as (u, v), that reach the similarity on the full sets of the whole texts.

    Each centre a is sent once to every group of its partners; groups of a hot centre are split."""
    pairs = table(_likely(pairs, nodes, p), "minmax-likely")
    hot = pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") >= p.per_salt)
    few = pairs.count() <= p.broadcast_rows * p.per_salt
    dealt = pairs.join(F.broadcast(hot) if few else hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.expr(f"coalesce(m, 0) div {p.per_salt} + 1")).cast("int"))
    wanted = dealt.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node")).distinct().unionByName(dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")))
    wanted = table(wanted, "minmax-wanted")
    loaded = _with_texts(wanted, docs, p).select("a", "salt", "role", "node", "text")
    ordered = loaded.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        centre, own = None, []  # a document of several texts has several sets
        for batch, buf, offs in slices(batches):
            sets = shingle_sets(buf, offs, p.width)
            u, v = [], []
            for a, salt, role, node, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "node")), sets, strict=True):
                if role == 0:
                    if centre != (a, salt):
                        centre, own = (a, salt), []
                    own += [s] if len(s) else []
                elif centre == (a, salt) and any(_similar(x, s, p) for x in own):
                    u.append(a)
                    v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    links = table(ordered.mapInArrow(run, "u long, v long"), "minmax-links")
    drop(pairs, wanted)
    return links


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray], width: int) -> np.ndarray:
    """Intersection sizes of every row set with every column set."""
    every = np.concatenate([*rows, *columns])
    values, code, times = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in (*rows, *columns)])
    keep = times[code] > 1
    owner, code = owner[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(code, [at, at + width])
        m = np.zeros((len(rows) + len(columns), width), np.float32)
        m[owner[a:b], code[a:b] - at] = 1
        out += m[: len(rows)] @ m[len(rows) :].T
    return out


def _weights(here: DataFrame, p: NearDupParams, *by: str) -> DataFrame:
    """Of every group: blocks of its outsiders (obs) and of its members (mbs), rows that go to its cells, pairs compared in them."""
    weight = here.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("out_n"), F.count("*").alias("all_c"), F.count_if("out").alias("out_c"))
    blocks = lambda side: F.expr(f"cast(greatest({side}_n div {p.cell_shingles}, {side}_c div {p.cell}) + 1 AS int)")
    weight = weight.withColumn("obs", blocks("out")).withColumn("mbs", blocks("all"))
    return weight.select(*by, "obs", "mbs", F.expr("out_c * mbs + all_c * obs").alias("rows"), F.expr("double(out_c) * all_c").alias("pairs"))


def _grouped(buckets: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, merged, obs, mbs): of every bucket its blocks, or those of all buckets of its largest component where these
    cost fewer rows and no more pairs as one group, each node once in it, than one by one."""
    apart = table(_weights(buckets, p, "largest", "key"), "minmax-weights")
    together = _weights(buckets.drop("key").distinct(), p, "largest")
    costs = apart.groupBy("largest").agg(F.sum("rows").alias("rows_apart"), F.sum("pairs").alias("pairs_apart"))
    one = together.join(costs, "largest").filter("rows < rows_apart AND pairs <= pairs_apart").select("largest", F.col("obs").alias("one_obs"), F.col("mbs").alias("one_mbs"))
    named = apart.join(one, "largest", "left")
    groups = table(named.select("key", F.col("one_obs").isNotNull().alias("merged"), F.coalesce("one_obs", "obs").alias("obs"), F.coalesce("one_mbs", "mbs").alias("mbs")), "minmax-groups")
    drop(apart)
    return groups


def _within_cells(placed: DataFrame, sizes: DataFrame, twice: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """Confirmed links (u, v) between outsiders and members of other components, cell by cell.

    A cell gets about ``cell`` sets and ``cell_shingles`` shingles a side, so its memory is bounded by that or by the longest set.
    Groups are buckets, or all those of one largest component (``_grouped``), which hold every pair of each of them."""
    buckets = placed.join(sizes.select("key", "largest"), "key").join(twice.withColumnRenamed("doc_id", "node"), "node", "left")
    buckets = buckets.withColumn("n", F.coalesce("whole", "n")).withColumn("out", F.col("own") != F.col("largest")).drop("whole")
    buckets = table(buckets, "minmax-buckets")
    groups = _grouped(buckets, p)
    here = buckets.join(groups, "key").withColumn("key", F.struct("merged", F.when(F.col("merged"), F.col("largest")).otherwise(F.col("key")).alias("of")))
    here_rows = here = table(here.select("key", "node", "own", "n", "out", "obs", "mbs").distinct(), "minmax-here")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = here.withColumn("my_ob", mine("obs")).withColumn("my_mb", mine("mbs"))
    # an outsider comes once to each cell of its block; it is a member too where the cell is that of its member block
    outside = here.filter("out").select("key", F.col("my_ob").alias("ob"), every("mbs").alias("mb"), "my_mb", "node", "own")
    outside = outside.select("key", "ob", "mb", F.when(F.col("mb") == F.col("my_mb"), 2).otherwise(0).alias("role"), "node", "own")
    inside = here.select("key", "out", "my_ob", every("obs").alias("ob"), F.col("my_mb").alias("mb"), F.lit(1).alias("role"), "node", "own")
    inside = inside.filter("NOT out OR ob != my_ob").select("key", "ob", "mb", "role", "node", "own")
    wanted = table(outside.unionByName(inside), "minmax-wanted")
    loaded = _with_texts(wanted, docs, p).select("key", "ob", "mb", "role", "node", "own", "text")
    ordered = loaded.repartition("key", "ob", "mb").sortWithinPartitions("key", "ob", "mb", "role")

    def links(cell):
        a, b = ([x for x in cell if x[0] in roles] for roles in ((0, 2), (1, 2)))
        if not a or not b:
            return [], []
        n, m = (np.array([len(x[3]) for x in side], np.float32) for side in (a, b))
        both = shared_counts([x[3] for x in a], [x[3] for x in b], p.columns)
        apart = np.array([x[2] for x in a])[:, None] != np.array([x[2] for x in b])[None, :]
        i, j = np.nonzero(apart & (p.similar_den * both >= p.similar_num * (n[:, None] + m[None, :] - both)))
        return [a[x][1] for x in i], [b[x][1] for x in j]

    def run(batches):
        now, cell = None, []
        for batch, buf, offs in slices(batches):
            sets = shingle_sets(buf, offs, p.width)
            u, v = [], []
            for key, ob, mb, role, node, own, s in zip(*(batch.column(c).to_pylist() for c in ("key", "ob", "mb", "role", "node", "own")), sets, strict=True):
                if now != (key, ob, mb):
                    x, y = links(cell)
                    u, v = u + x, v + y
                    now, cell = (key, ob, mb), []
                if len(s):
                    cell.append((role, node, own, s))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        u, v = links(cell)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    found = table(ordered.mapInArrow(run, "u long, v long").distinct(), "minmax-cells")
    drop(wanted, buckets, groups, here_rows)
    return found


def _with_component(rows: DataFrame, comps: DataFrame, node: str, into: str) -> DataFrame:
    c = comps.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return rows.join(c, F.col(node) == F.col("_u"), "left").withColumn(into, F.coalesce("_v", node)).drop("_u", "_v")


def _unsettled(placed: DataFrame) -> DataFrame:
    """Buckets that hold several components: key, total, largest (component)."""
    sizes = placed.groupBy("key", "own").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "own")).alias("x"), F.sum("m").alias("total"), F.count("*").alias("c"))
    return table(sizes.filter("c > 1").select("key", "total", F.col("x.own").alias("largest")), "minmax-unsettled")


def _pairs_of(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of outsiders and members of other components."""
    outside = placed.join(sizes, "key").filter("own != largest").select("key", F.col("node").alias("x"), F.col("own").alias("x_own"))
    return outside.join(placed, "key").filter("own != x_own").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def classes(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (its least doc_id), kept."""
    rows = signed(docs, p)
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    reps = table(full.groupBy("digest").agg(F.min("doc_id").alias("node")), "minmax-digests")
    nodes = full.join(reps, "digest").filter("doc_id = node").dropDuplicates(["digest"]).select("node", "n", "bands", "sig")
    nodes = table(nodes, "minmax-nodes")
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node"))).alias("drawn")).filter("lo != hi")
    members = table(keyed.join(shared, "key").select("key", "node", "n", F.col("lo").alias("least"), F.col("drawn.node").alias("drawn")), "minmax-members")

    # rows of one doc_id are linked whatever they hold
    twice = table(full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.sum("n").alias("whole")).filter("lo != hi").select("doc_id", "whole"), "minmax-twice")
    links = full.join(twice, "doc_id").join(reps, "digest").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).filter("u != v").distinct()

    best = members.filter("node != least").groupBy("node", "least").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "least")).alias("x"))
    links = links.unionByName(_confirmed(best.select(F.col("x.least").alias("a"), F.col("node").alias("b")), nodes, docs, p))
    comps = components(links)

    placed = _with_component(members, comps, "node", "own")
    stars = placed.select("node", "own", F.explode(F.array("least", "drawn")).alias("pivot")).filter("node != pivot").distinct()
    stars = _with_component(stars, comps, "pivot", "other").filter("own != other").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = comps.unionByName(_confirmed(stars, nodes, docs, p))
    comps = components(links)

    placed = table(_with_component(members.select("key", "node", "n"), comps, "node", "own"), "minmax-placed")
    sizes = _unsettled(placed)
    few, many = sizes.filter(F.col("total") <= p.pair_bucket), sizes.filter(F.col("total") > p.pair_bucket)
    links = comps.unionByName(_confirmed(_pairs_of(placed, few), nodes, docs, p))
    if not many.isEmpty():
        links = links.unionByName(_within_cells(placed, many, twice, docs, p))
    comps = components(links)

    homes = _with_component(reps.select("digest", "node"), comps, "node", "component")
    named = table(homes.select(F.col("digest").alias("_digest"), "component"), "minmax-named")
    drop(reps, nodes, members, twice, placed, sizes, comps)
    out = rows.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """Rows of ``docs`` less all but one document of each class; the one of the least id stays."""
    found = classes(docs, p)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), NearDupParams(width=2))


def oracle() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, list_sort(s) AS s FROM s),
k AS (SELECT min(doc_id) AS rep, any_value(n) AS n, s FROM n WHERE n > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM k),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id, n.doc_id = coalesce(c.component_id, n.doc_id) AS kept
FROM n LEFT JOIN k ON n.s = k.s LEFT JOIN c ON k.rep = c.rep
"""
