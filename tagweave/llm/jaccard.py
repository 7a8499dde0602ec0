"""Jaccard join of documents on n-grams by rare-first prefix filtering.

Two documents link when their sets of distinct word n-grams have ``num`` / ``den`` of their union in common.

1. Sets: documents with equal sets are one node, so exact copies cost nothing further.
2. Frequencies: n-grams are dealt by hash in packed arrays.  What is counted first, by n-gram, is one entry for each slice of texts;
   then the slices' postings meet the frequencies, a part with many postings in several tasks, and those of n-grams of
   two nodes and more go back to their nodes.
3. Prefixes: a node sorts its n-grams by frequency, rarest first, ties by hash.  Those of no other node come first and never join.
   A node with fewer shared n-grams than any link needs is out.  Else the first n - ceil(0.8 n) + 1 are its prefix, and of the
   smaller node of a pair the first n - ceil(0.89 n) + 1 suffice.
4. Join: nodes meet at the n-grams of their prefixes.  Length filter: 0.8 of the larger size.  Positional filter: what comes after the
   n-gram in both orders bounds the overlap.  Suffix filter: parities of what comes after it in ``cells`` ranges of hashes differ in
   no more places than the two suffixes do, which bounds the overlap further.
5. Verification: each pair that is left is decided once, on the full sets of both whole texts.

Pairs are asked for in rounds, so that a group of near copies is never listed pair by pair: every node with the least node of the prefix n-grams it shares most,
then with a drawn one, then with its likeliest partner in another component, as long as that joins any; last all nodes of an
n-gram that are in different components still: those outside its largest component, in blocks, against the others, by arrays of which only pairs that pass the filters come out.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A document of fewer words than the width has its whole sequence as one n-gram; null, empty and blank
texts have an empty set and are linked with nothing.  N-grams are told by 64-bit hashes, equal sets by 128-bit digests.
Rows that share a doc_id are one document: they are linked to each other.  Null ids stay alone.  Very long texts are taken whole; a task holds one slice of texts, one part, one centre or one cell.
Of columns only doc_id and text are read, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.graph import components
from tagweave.llm.neardup import node_of, shingle_sets
from tagweave.llm.rows import bundled, expanded, groups, parts_for, shard_of, unbundled
from tagweave.llm.text import slices
from tagweave.plans import storage
from tagweave.plans.storage import drop, tasks_for

_KEY = 40  # bits of an n-gram within its part
_BATCH_BYTES = 1 << 22  # texts and blobs that go to Python at once; by rows alone a batch may hold tens of MB


@dataclass(frozen=True)
class JaccardParams:
    width: int = 5
    num: int = 80
    den: int = 100
    slice_bytes: int = 1 << 20
    part_bytes: int = 1 << 23  # text of a part, at most about
    part_postings: int = 4_000_000  # postings of a part in one task
    gathered: int = 200_000  # postings that a task handles at once, or those of the longest text
    cells: int = 512  # parity bits of a suffix, a multiple of 64
    pair_rows: int = 24  # nodes of an n-gram that are paired by a join; more are compared in blocks
    block: int = 1024
    per_salt: int = 256  # pairs of one centre in one task
    broadcast_rows: int = 500_000  # narrow rows that may be broadcast to pick texts; more are joined by a shuffle

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        """N-grams of a set of n that any link of it needs."""
        return -(-self.num * n // self.den)

    def least_larger(self, n: np.ndarray) -> np.ndarray:
        """N-grams that a link of a set of n with one as large or larger needs."""
        return -(-2 * self.num * n // (self.num + self.den))


def table(df: DataFrame, name: str) -> DataFrame:
    return storage.table(df, name, _BATCH_BYTES)


def _sized(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """(doc_id, h, n, digest) of every row: hash of the text, size and digest of its set."""

    def run(batches):
        for batch, buf, offs in slices(batches, limit=p.slice_bytes):
            sets = shingle_sets(buf, offs, p.width)
            digests = pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), digests], names=["doc_id", "h", "n", "digest"])

    return table(docs.mapInArrow(run, "doc_id long, h long, n long, digest binary"), "ngram-sized")


def _with_texts(wanted: DataFrame, docs: DataFrame, p: JaccardParams) -> DataFrame:
    """Rows of ``wanted`` (a table) with the texts of their doc_id and h."""
    return docs.join(F.broadcast(wanted) if wanted.count() <= p.broadcast_rows else wanted, ["doc_id", "h"])


def _postings(parts: int, p: JaccardParams):
    def run(batches):
        for batch, buf, offs in slices(batches, limit=p.slice_bytes):
            sets = shingle_sets(buf, offs, p.width)
            grams = np.concatenate(sets)
            owner = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            part = (grams >> np.uint64(_KEY)) % np.uint64(parts)
            order = np.argsort((part << np.uint64(_KEY)) | (grams & np.uint64((1 << _KEY) - 1)), kind="stable")
            part, key, owner = part[order].astype(np.int64), (grams[order] & np.uint64((1 << _KEY) - 1)).astype(np.int64), owner[order]
            rows = []
            for a, b in groups(part):
                keys, counts = np.unique(key[a:b], return_counts=True)
                nodes, at = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(part[a]), int(owner[a]), bundled(keys, counts), bundled(nodes, at)))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "slice", "keys", "owners"])

    return run


def _frequencies(p: JaccardParams):
    """All key blobs of one part to (part, salts, keys): frequencies of two and more, and in how many tasks its postings go."""

    def run(batches):
        part, keys, counts = None, [], []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), strict=True):  # noqa: B007
                k, c = unbundled(blob)
                keys.append(k)
                counts.append(c)
        if part is not None:
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            df = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            again = df > 1
            salts = 1 + int(df.sum()) // p.part_postings
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salts], pa.int32()), pa.array([bundled(known[again], df[again])], pa.binary())], names=["part", "salts", "keys"])

    return run


def _returned(shards: int, p: JaccardParams):
    """Frequencies and then postings of each (part, salt) to (shard, kind, blob): node, n-gram and frequency where that is two and more."""

    def dealt(held):
        node, gram, df = np.concatenate(held, axis=1)
        shard = shard_of(node, shards)
        order = np.lexsort((gram, node, shard))
        node, gram, df, shard = node[order], gram[order], df[order], shard[order]
        bounds = groups(shard)
        blobs = [bundled(node[a:b], gram[a:b], df[a:b]) for a, b in bounds]
        return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in bounds], pa.int32()), pa.array([1] * len(bounds), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "kind", "blob"])

    def run(batches):
        known = df = np.zeros(0, np.int64)
        held, size = [], 0
        for batch in batches:
            for part, kind, keys, owners in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "keys", "owners")), strict=True):
                if not kind:
                    known, df = unbundled(keys)
                    continue
                k, counts = unbundled(keys)
                nodes, at = unbundled(owners)
                place = np.searchsorted(known, k)
                found = np.zeros(len(k), bool)
                found[place < len(known)] = known[place[place < len(known)]] == k[place < len(known)]
                each = np.repeat(found, counts)
                gram = (np.int64(part) << _KEY) | np.repeat(k, counts)[each]
                held.append(np.stack([nodes[at[each]], gram, np.repeat(df[place[found]], counts[found])]))
                size += held[-1].shape[1]
                if size >= p.gathered:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _sizes(shards: int):
    """(node, n) to blobs of kind 0, dealt as the postings are."""

    def run(batches):
        for batch in batches:
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            shard = shard_of(node, shards)
            order = np.lexsort((node, shard))
            bounds = groups(shard[order])
            blobs = [bundled(node[order[a:b]], n[order[a:b]]) for a, b in bounds]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[order[a]]) for a, _ in bounds], pa.int32()), pa.array([0] * len(bounds), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "kind", "blob"])

    return run


_PREFIX = "gram long, node long, n long, rank long, pos long, small boolean, rest binary"


def prefixes_of(node: np.ndarray, gram: np.ndarray, df: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, p: JaccardParams) -> pa.RecordBatch:
    """Prefix rows of all nodes whose shared n-grams are enough for a link; ``nodes`` are sorted."""
    order = np.lexsort((gram, df, node))
    node, gram = node[order], gram[order]
    first = np.array([a for a, _ in groups(node)], np.int64)
    shared = np.diff(np.append(first, len(node)))
    n = sizes[np.searchsorted(nodes, node[first])]
    needed = p.least_overlap(n)
    take = np.where(shared >= needed, n - needed + 1 - (n - shared), 0)  # those of no other node come first
    at = expanded(first, take)
    of = np.repeat(np.arange(len(first)), take)
    rank = at - first[of]
    pos = rank + (n - shared)[of]
    words = p.cells // 64
    mine = np.zeros((len(gram), words), np.uint64)
    mine[np.arange(len(gram)), gram % p.cells // 64] = np.uint64(1) << (gram % 64).astype(np.uint64)
    every = np.bitwise_xor.reduceat(mine, first, axis=0) if len(first) else mine
    before = np.zeros((len(at) + 1, words), np.uint64)
    np.bitwise_xor.accumulate(mine[at], axis=0, out=before[1:])
    begun = (np.cumsum(take) - take)[of]
    rest = every[of] ^ before[1:] ^ before[begun]
    raw, wide = rest.tobytes(), 8 * words
    blobs = pa.array([raw[k * wide : (k + 1) * wide] for k in range(len(at))], pa.binary())
    small = pos < (n - p.least_larger(n) + 1)[of]
    return pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(node[at]), pa.array(n[of]), pa.array(rank), pa.array(pos), pa.array(small), blobs], names=["gram", "node", "n", "rank", "pos", "small", "rest"])


def _prefixes(p: JaccardParams):
    def run(batches):
        sizes, postings = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                (postings if kind else sizes).append(np.stack(unbundled(blob)))
        if postings:
            nodes, n = np.concatenate(sizes, axis=1)
            order = np.argsort(nodes)
            nodes, n = nodes[order], n[order]
            node, gram, df = np.concatenate(postings, axis=1)
            del sizes, postings
            order = np.argsort(node, kind="stable")
            node, gram, df = node[order], gram[order], df[order]
            at = 0
            while at < len(node):  # some nodes at a time
                to = int(np.searchsorted(node, node[min(at + p.gathered, len(node)) - 1], "right"))
                yield prefixes_of(node[at:to], gram[at:to], df[at:to], nodes, n, p)
                at = to

    return run


def prefixes(nodes: DataFrame, docs: DataFrame, p: JaccardParams) -> DataFrame:
    """Prefix n-grams (``_PREFIX``) of the nodes (node, n, doc_id, h) that may have a link."""
    spark = docs.sparkSession
    parts = shards = parts_for(docs, 1, p.part_bytes)
    texts = _with_texts(nodes.select("doc_id", "h", "node"), docs, p).select("node", "text")
    postings = table(texts.mapInArrow(_postings(parts, p), "part int, slice long, keys binary, owners binary"), "ngram-postings")
    counted = postings.select("part", "keys").repartitionById(parts, F.col("part")).mapInArrow(_frequencies(p), "part int, salts int, keys binary")
    counted = table(counted, "ngram-frequencies")
    known = counted.select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "keys", F.lit(None).cast("binary").alias("owners"))
    salts = counted.select("part", "salts")
    placed = postings.join(F.broadcast(salts) if parts <= p.broadcast_rows else salts, "part")
    placed = placed.select("part", F.pmod(F.xxhash64("slice"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "keys", "owners")
    met = known.unionByName(placed).repartition(max(parts, tasks_for(spark)), "part", "salt").sortWithinPartitions("part", "salt", "kind")
    schema = "shard int, kind int, blob binary"
    returned = table(met.mapInArrow(_returned(shards, p), schema), "ngram-returned")
    sizes = nodes.select("node", "n").mapInArrow(_sizes(shards), schema)
    found = returned.unionByName(sizes).repartitionById(shards, F.col("shard")).mapInArrow(_prefixes(p), _PREFIX)
    found = table(found, "ngram-prefixes")
    drop(postings, counted, returned)
    return found


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: JaccardParams) -> DataFrame:
    """Those distinct pairs (a, b) of nodes, as (u, v), that link on the full sets of their whole texts.

    The centre a of a pair is sent once to every group of its partners; groups of a hot centre are split."""
    pairs = table(pairs, "ngram-pairs")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.expr(f"m div {p.per_salt} + 1")).cast("int").alias("salt"))
    wanted = dealt.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node")).distinct().unionByName(dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")))
    wanted = table(wanted.join(nodes.select("node", "doc_id", "h"), "node"), "ngram-wanted")
    loaded = _with_texts(wanted, docs, p).select("a", "salt", "role", "node", "text")
    ordered = loaded.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        centre, own = None, np.zeros(0, np.uint64)
        for batch, buf, offs in slices(batches, limit=p.slice_bytes):
            u, v = [], []
            for a, salt, role, node, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "node")), shingle_sets(buf, offs, p.width), strict=True):
                if role == 0:
                    centre, own = (a, salt), s
                elif centre == (a, salt):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and p.den * both >= p.num * (len(own) + len(s) - both):
                        u.append(a)
                        v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    links = table(ordered.mapInArrow(run, "u long, v long"), "ngram-links")
    drop(pairs, wanted)
    return links


def margins(x: dict[str, np.ndarray], y: dict[str, np.ndarray], p: JaccardParams) -> np.ndarray:
    """By what share of their sizes pairs of prefix rows of one n-gram may exceed the needed overlap; negative where the length, positional or suffix filter drops them."""
    swap = (x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["node"] > y["node"]))
    low, high = np.minimum(x["n"], y["n"]), np.maximum(x["n"], y["n"])
    keep = np.where(swap, y["small"], x["small"]) & (p.den * low >= p.num * high)
    upto = np.minimum(x["rank"], y["rank"]) + 1  # n-grams in common up to this one, at most
    after = np.minimum(x["n"] - x["pos"], y["n"] - y["pos"]) - 1
    keep &= (p.num + p.den) * (upto + after) >= p.num * (low + high)
    left = np.flatnonzero(keep)
    out = np.full(len(keep), -1.0)
    for k in range(0, len(left), 1 << 16):
        i = left[k : k + (1 << 16)]
        apart = np.bitwise_count(x["rest"][x["at"][i]] ^ y["rest"][y["at"][i]]).sum(axis=1, dtype=np.int64)
        after = (x["n"] - x["pos"] + y["n"] - y["pos"])[i] - 2 - apart
        size = (low + high)[i]
        out[i] = ((p.num + p.den) * (2 * upto[i] + after) - 2 * p.num * size) / size
    return out


_FACTS = ("n", "node", "rank", "pos", "small")


def _side(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: columns[c][at] for c in _FACTS} | {"at": at, "rest": columns["rest"]}


def _facts(batch, suffix: str, p: JaccardParams) -> dict[str, np.ndarray]:
    facts = {c: batch.column(c + suffix).to_numpy(zero_copy_only=False) for c in _FACTS}
    facts["rest"] = np.frombuffer(b"".join(batch.column("rest" + suffix).to_pylist()), np.uint64).reshape(-1, p.cells // 64)
    return facts


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _paired(p: JaccardParams):
    def run(batches):
        for batch in batches:
            x, y = (_side(_facts(batch, s, p), np.arange(batch.num_rows)) for s in ("_x", "_y"))
            keep = margins(x, y, p) >= 0
            yield _pairs_batch(x["node"][keep], y["node"][keep])

    return run


def _blocks(p: JaccardParams, best: bool):
    """Rows of one cell (gram, ob, mb) after another: those of role 0 and 2 against those of role 1 and 2 in other components; all that pass, or each one's likeliest."""

    def found(cell: pa.Table):
        facts = _facts(cell.combine_chunks(), "", p)
        role, own = cell.column("role").to_numpy(), cell.column("own").to_numpy()
        a, b = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        for k in range(0, len(a), 128):
            i, j = np.repeat(a[k : k + 128], len(b)), np.tile(b, len(a[k : k + 128]))
            apart = own[i] != own[j]
            i, j = i[apart], j[apart]
            margin = margins(_side(facts, i), _side(facts, j), p)
            keep = np.flatnonzero(margin >= 0)
            if best:
                keep = keep[np.lexsort((facts["node"][j[keep]], -margin[keep], i[keep]))]
                keep = keep[np.unique(i[keep], return_index=True)[1]]
            yield _pairs_batch(facts["node"][i[keep]], facts["node"][j[keep]])

    def run(batches):
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "ob", "mb")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a < b:
                    cell = tuple(keys[:, a].tolist())
                    if cell != now and held:
                        yield from found(pa.Table.from_batches(held))
                        held = []
                    now = cell
                    held.append(batch.slice(a, b - a))
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _with_component(rows: DataFrame, comps: DataFrame, node: str, into: str) -> DataFrame:
    c = comps.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return rows.join(c, F.col(node) == F.col("_u"), "left").withColumn(into, F.coalesce("_v", node)).drop("_u", "_v")


def unsettled(placed: DataFrame) -> DataFrame:
    """N-grams of several components (``own``): gram, total, smalls, largest (component) and inside (its nodes)."""
    sizes = placed.groupBy("gram", "own").agg(F.count("*").alias("m"), F.count_if("small").alias("smalls")).groupBy("gram")
    sizes = sizes.agg(F.max(F.struct("m", "own")).alias("x"), F.sum("m").alias("total"), F.sum("smalls").alias("smalls"), F.count("*").alias("c"))
    return table(sizes.filter("c > 1 AND smalls > 0").select("gram", "total", F.col("x.own").alias("largest"), F.col("x.m").alias("inside")), "ngram-unsettled")


_PLACED = [*_FACTS, "rest", "own"]


def _of_few(placed: DataFrame, few: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs (a, b) that pass the filters at n-grams of few nodes, by a join."""
    here = placed.join(few.select("gram", "largest"), "gram")
    x = here.filter("own != largest").select("gram", *[F.col(c).alias(c + "_x") for c in _PLACED])
    y = here.select("gram", "largest", *[F.col(c).alias(c + "_y") for c in _PLACED])
    pairs = x.join(y, "gram").filter("own_x != own_y AND (own_y = largest OR node_x < node_y)").drop("gram", "largest", "own_x", "own_y")
    return pairs.mapInArrow(_paired(p), "a long, b long")


def _of_many(placed: DataFrame, many: DataFrame, p: JaccardParams, best: bool) -> DataFrame:
    """Pairs (a, b) that pass the filters at n-grams of many nodes, by blocks; or of each node outside the largest component its likeliest in each block."""
    here = placed.join(many, "gram").withColumn("out", F.col("own") != F.col("largest"))
    of = lambda n: F.expr(f"cast({n} div {p.block} + 1 AS int)")
    here = here.withColumn("obs", of("(total - inside)")).withColumn("mbs", of("total"))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = here.withColumn("my_ob", mine("obs")).withColumn("my_mb", mine("mbs"))
    # a node outside comes once to each cell of its block; it is one of the others too where the cell is that of its other block
    outside = here.filter("out").select("gram", F.col("my_ob").alias("ob"), every("mbs").alias("mb"), "my_mb", *_PLACED)
    outside = outside.withColumn("role", F.when(F.col("mb") == F.col("my_mb"), 2).otherwise(0)).drop("my_mb")
    inside = here.select("gram", every("obs").alias("ob"), F.col("my_mb").alias("mb"), "out", "my_ob", *_PLACED).withColumn("role", F.lit(1))
    inside = inside.filter("NOT out OR ob != my_ob").drop("out", "my_ob")
    cells = outside.unionByName(inside).repartition("gram", "ob", "mb").sortWithinPartitions("gram", "ob", "mb")
    return cells.mapInArrow(_blocks(p, best), "a long, b long")


def _settled(met: DataFrame, comps: DataFrame, tried: DataFrame, nodes: DataFrame, texts: DataFrame, p: JaccardParams) -> DataFrame:
    """Components when all nodes that meet and may link have been compared, or are in one component.

    Where many meet, each node outside the largest component first tries its likeliest partner of another one, as long as that joins
    any: what is left to compare pair by pair is then what hardly links."""
    while True:
        placed = table(_with_component(met, comps, "node", "own"), "ngram-placed")
        sizes = unsettled(placed)
        many = sizes.filter(F.col("total") > p.pair_rows)
        if many.isEmpty():
            break
        pairs = table(_of_many(placed, many, p, True).distinct().join(tried, ["a", "b"], "left_anti"), "ngram-candidates")
        links = verified(pairs, nodes, texts, p)
        tried = tried.unionByName(pairs)
        if links.isEmpty():
            break
        drop(placed, sizes)
        comps = components(comps.unionByName(links))
    found = _of_few(placed, sizes.filter(F.col("total") <= p.pair_rows), p)
    if not many.isEmpty():
        found = found.unionByName(_of_many(placed, many, p, False))
    links = verified(found.distinct().join(tried, ["a", "b"], "left_anti"), nodes, texts, p)
    comps = components(comps.unionByName(links))
    drop(placed, sizes)
    return comps


def joined(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = _sized(texts, p)
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    if not full.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "h"])  # rows repeated as they are
    reps = full.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "n")).alias("x"))
    nodes = table(reps.select("digest", "x.doc_id", "x.h", "x.n", F.monotonically_increasing_id().alias("node")), "ngram-nodes")
    prefix = prefixes(nodes, texts, p)

    of_doc = full.join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    homes = of_doc.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("doc_id", "lo")
    links = of_doc.join(homes, "doc_id").select(F.col("node").alias("u"), F.col("lo").alias("v")).filter("u != v")

    drawn = F.min(F.when(F.col("small"), F.struct(F.xxhash64("node", "gram").alias("h"), F.col("node"))))
    pivots = prefix.groupBy("gram").agg(F.min(F.when(F.col("small"), F.col("node"))).alias("least"), drawn.alias("x"), F.count("*").alias("c")).filter("c > 1 AND least IS NOT NULL")
    met = table(prefix.join(pivots.select("gram", "least", F.col("x.node").alias("drawn")), "gram"), "ngram-met")
    best = met.filter("node != least").groupBy("node", "least").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "least")).alias("x"))
    tried = table(best.select(F.col("x.least").alias("a"), F.col("node").alias("b")), "ngram-tried")
    comps = components(links.unionByName(verified(tried, nodes, texts, p)))

    stars = _with_component(met.select("node", "drawn").filter("node != drawn").distinct(), comps, "node", "own")
    stars = _with_component(stars, comps, "drawn", "other").filter("own != other").groupBy("node").agg(F.min_by("drawn", F.xxhash64("node", "drawn")).alias("drawn"))
    known = tried.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    stars = stars.select(F.col("drawn").alias("a"), F.col("node").alias("b"), F.least("drawn", "node").alias("lo"), F.greatest("drawn", "node").alias("hi"))
    stars = table(stars.join(known, ["lo", "hi"], "left_anti").select("a", "b"), "ngram-tried")
    comps = components(comps.unionByName(verified(stars, nodes, texts, p)))

    once = table(tried.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "ngram-tried")
    comps = _settled(met.drop("least", "drawn"), comps, once, nodes, texts, p)

    named = _with_component(nodes.select("digest", "doc_id", "node"), comps, "node", "own")
    least = named.groupBy("own").agg(F.min("doc_id").alias("component"))
    named = table(named.join(least, "own").select(F.col("digest").alias("_digest"), "component"), "ngram-named")
    drop(prefix, nodes, met, tried, stars, once, comps)
    out = rows.join(named, F.col("digest") == F.col("_digest"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, list_sort(s) AS s FROM s),
k AS (SELECT min(doc_id) AS rep, any_value(n) AS n, s FROM n WHERE n > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM k),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN k ON n.s = k.s LEFT JOIN c ON k.rep = c.rep
"""
