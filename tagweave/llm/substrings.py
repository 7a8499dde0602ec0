"""Removal of repeated passages.

A window is ``width`` consecutive words of one document.  Every word that lies in a window whose
word sequence also starts earlier (smaller doc_id, or the same document and an earlier start) goes.

1. Deal: the least hash of a window's three-word runs names its shard, so equal windows meet whatever
   documents they are in.  Neighbouring windows mostly share it and travel as one piece of text.  Every
   window of every document is sent; of pieces with equal bytes in one slice only the earliest, and
   the windows of the others are later places.
2. Confirm and compile: windows of a shard whose hashes recur are compared word by word, and each distinct
   word sequence is compiled into an Aho-Corasick automaton (pyahocorasick, a letter for each distinct run of five words);
   an automaton holds at most ``patterns`` of them.
3. Stream: all pieces of the shard pass through all its automata, equal pieces once for all of them.  Their hits are the occurrences; those
   other than a sequence's earliest go back to their documents, which lose these words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; kept words are joined by one space.  Null texts have no words.
Very long texts are cut into pieces like all others; a task holds one slice, or the longest text, and one part.
An empty table gives an empty result; other columns stay as they are.  Null ids count as the least id.  Rows that share a doc_id are parts of one document in the order of their texts; equal
such rows are judged alike, and none of them is earlier than the other.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.rows import expanded, groups, identified, packed, parts_for, shard_of, unpacked
from tagweave.llm.text import Words, mix, rolling, slices
from tagweave.plans.storage import table

_PART = 40  # bits for the word's place within one row
_RUN = 3  # words of the runs whose least hash names the shard of a window


@dataclass(frozen=True)
class SubstringParams:
    width: int = 20
    slice_bytes: int = 1 << 21
    spread: int = 1  # parts for each shuffle partition, at least
    part_bytes: int = 1 << 23  # text of a part, at most about
    bucket_bytes: int = 1 << 20  # text of a shard that is searched at a time
    held: int = 1 << 18  # later places that a search gathers before it hands them on
    patterns: int = 50_000  # word sequences of one automaton


def _recurring(keys: np.ndarray, places: np.ndarray, shards: int):
    """Rows (1, shard, keys and places) of recurrences."""
    at = shard_of(keys, shards)
    order = np.lexsort((places, keys, at))
    keys, places, at = keys[order], places[order], at[order]
    for a, b in groups(at):
        yield 1, int(at[a]), None, packed(keys[a:b], places[a:b])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, text, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(text, pa.binary()), pa.array(blob, pa.binary())], names=["kind", "part", "text", "blob"])


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values."""
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :])


def _pieces(parts: int, shards: int, p: SubstringParams):
    def run(batches):
        for batch, buf, offs in slices(batches, limit=p.slice_bytes):
            w = Words(buf, offs)
            h = w.hashes(lower=False)
            if len(h) < p.width:
                continue
            run_words = min(_RUN, p.width)
            name = mix(_least(rolling(h, run_words), p.width - run_words + 1))
            doc = np.repeat(np.arange(len(offs) - 1), w.counts)
            i = np.flatnonzero(doc[: len(name)] == doc[p.width - 1 :])
            if not len(i):
                continue
            cut = np.flatnonzero((np.diff(i) > 1) | (doc[i[1:]] != doc[i[:-1]]) | (name[i[1:]] != name[i[:-1]])) + 1
            at = i[np.concatenate([[0], cut])]
            windows = np.diff(np.concatenate([[0], cut, [len(i)]]))
            keys = batch.column("_key").to_numpy()[doc[at]]
            places = (batch.column("_k").to_numpy().astype(np.int64) << _PART)[doc[at]] + at - w.first[doc[at]]
            order = np.lexsort((places, keys))
            at, windows, keys, places = at[order], windows[order], keys[order], places[order]
            raw = buf.tobytes()
            texts = [raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at + windows + p.width - 2].tolist(), strict=True)]
            seen: dict[bytes, int] = {}
            lead = np.array([seen.setdefault(t, n) for n, t in enumerate(texts)])
            # equal rows share keys and places: such a twin is no later place
            later = np.flatnonzero((keys != keys[lead]) | (places != places[lead]))
            rows = list(_recurring(np.repeat(keys[later], windows[later]), expanded(places[later], windows[later]), shards))
            sent = np.flatnonzero(lead == np.arange(len(lead)))
            part = (name[at[sent]] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sent, part = sent[order], part[order]
            tag = (name[at[sent]] >> np.uint64(48)).astype(np.int64)
            for a, b in groups(part):
                mine = sent[a:b]
                text = zstandard.ZstdCompressor(level=1).compress(b"".join([texts[n] for n in mine.tolist()]))
                size = np.array([len(texts[n]) for n in mine.tolist()], np.int64)
                rows.append((0, int(part[a]), text, packed(keys[mine], places[mine], size, tag[a:b])))
            yield _batch(rows)

    return run


def _words(w: Words) -> np.ndarray:
    """Numbers of the words, equal for equal words only: hashes are checked against the bytes."""
    _, first, codes = np.unique(w.hashes(lower=False), return_index=True, return_inverse=True)
    size, rep = w.end - w.start, first[codes]
    same = bool((size == size[rep]).all())
    if same:
        same = bool((w.buf[expanded(w.start, size)] == w.buf[expanded(w.start[rep], size)]).all())
    if not same:
        raw, numbers = w.buf.tobytes(), {}
        codes = np.array([numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)])
    return codes


def _run_words(width: int) -> int:
    """Words of one letter of the automata: the largest divisor of the width up to 5."""
    return max(n for n in range(1, 6) if width % n == 0)


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Number of the run of ``n`` words at every start, equal for equal runs only."""
    h = rolling(mix(codes.astype(np.uint64)), n)
    _, first, out = np.unique(h, return_index=True, return_inverse=True)
    rep = first[out]
    if any((codes[k : len(h) + k] != codes[rep + k]).any() for k in range(n)):
        out = np.unique(np.stack([codes[k : len(h) + k] for k in range(n)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    return out


def _spelled(letters: np.ndarray, base: int) -> str:
    """Every letter as three characters, so that no node of an automaton has more than ``base`` children."""
    digits = np.stack([letters // (base * base), letters // base % base, letters % base], axis=-1)
    return (digits + 1).astype(np.uint8).tobytes().decode("latin-1")


def located(codes: np.ndarray, first: np.ndarray, hashes: np.ndarray, p: SubstringParams, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that an automaton hits, and the number of the word sequence hit.

    ``codes`` are the words of several pieces, piece i at first[i]:first[i + 1], which stands for copies[i] pieces;
    ``hashes`` those of all windows, by which the word sequences to search for are chosen: those of windows whose
    hash recurs.  A letter of an automaton is a run of words; a piece is read once for each offset of such runs."""
    none = np.zeros(0, np.int64)
    count = np.diff(first)
    windows = np.maximum(count - p.width + 1, 0)
    starts = expanded(first[:-1], windows)
    if not len(starts):
        return none, none
    _, lead, back = np.unique(hashes[starts], return_index=True, return_inverse=True)
    times = np.bincount(back, None if copies is None else np.repeat(copies, windows))
    again = np.flatnonzero(times[back] > 1)
    wanted = starts[lead[times > 1]]
    span = np.arange(p.width)
    other = [none]  # windows whose hash is that of other words
    for a in range(0, len(again), 1 << 16):
        n = again[a : a + (1 << 16)]
        mine, rep = starts[n], starts[lead[back[n]]]
        apart = mine != rep
        mine, rep = mine[apart], rep[apart]
        other.append(mine[(codes[mine[:, None] + span] != codes[rep[:, None] + span]).any(axis=1)])
    if sum(map(len, other)):
        wanted = np.concatenate([wanted, *other])
        wanted = wanted[np.unique(codes[wanted[:, None] + span], axis=0, return_index=True)[1]]
    if not len(wanted):
        return none, none
    size = _run_words(p.width)
    runs = _runs(codes, size)
    # the runs of a piece that start at one offset follow each other; a separator comes after them
    offset = np.tile(np.arange(size), len(count))
    length = np.maximum((np.repeat(count, size) - offset) // size, 0)
    head = np.repeat(first[:-1], size) + offset
    begun = np.cumsum(length) - length
    at = np.repeat(head - size * begun, length) + size * np.arange(length.sum())
    place = np.arange(len(at)) + np.repeat(np.arange(len(length)), length)
    inside = np.arange(0, p.width, size)
    found, number = [none], [none]
    for a in range(0, len(wanted), p.patterns):
        rows = runs[wanted[a : a + p.patterns, None] + inside]
        used = np.unique(rows)
        letter = np.zeros(len(codes) + 1, np.int64)  # 0: in no sequence
        letter[used] = np.arange(1, len(used) + 1)
        base = max(2, int(np.ceil((len(used) + 1) ** (1 / 3))))
        machine, wide = ahocorasick.Automaton(), 3 * len(inside)
        joined = _spelled(letter[rows].reshape(-1), base)
        for n in range(len(rows)):
            machine.add_word(joined[n * wide : (n + 1) * wide], a + n)
        machine.make_automaton()
        text = np.zeros(len(at) + len(length), np.int64)
        text[place] = letter[runs[at]]
        hit = np.fromiter(chain.from_iterable(machine.iter(_spelled(text, base))), np.int64).reshape(-1, 2)
        hit = hit[hit[:, 0] % 3 == 2]  # whole letters only
        found.append(at[np.searchsorted(place, hit[:, 0] // 3 - len(inside) + 1)])
        number.append(hit[:, 1])
    return np.concatenate(found), np.concatenate(number)


def _later(keys: np.ndarray, places: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which occurrences are not the earliest of their word sequence."""
    order = np.lexsort((places, keys, number))
    n = number[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[False], n[1:] == n[:-1]]), 0, np.arange(len(n))))
    return order[(keys[order] != keys[order][lead]) | (places[order] != places[order][lead])]


def _loaded(batches, facts: list[np.ndarray], buf: bytearray):
    """Adds the pieces of a part to ``facts`` and ``buf``, row by row and without a second copy; hands on rows of recurrences."""
    for batch in batches:
        for n in range(batch.num_rows):
            kind, part, text, blob = (c[n] for c in batch.columns)
            if kind.as_py():
                yield _batch([(kind.as_py(), part.as_py(), text.as_py(), blob.as_py())])
            else:
                buf += zstandard.ZstdDecompressor().decompress(text.as_buffer())
                facts.append(unpacked(blob.as_buffer(), 4))


def _searched(shards: int, p: SubstringParams):
    def run(batches):
        facts, data = [], bytearray()
        yield from _loaded(batches, facts, data)
        if not facts:
            return
        buf = np.frombuffer(data, np.uint8)
        keys, places, size, tag = np.concatenate(facts, axis=1)
        del facts
        start = np.cumsum(size) - size
        bucket = tag * (1 + len(buf) // p.bucket_bytes) >> 16
        order = np.argsort(bucket, kind="stable")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in groups(bucket[order]):
            mine = order[a:b]
            # equal pieces of several slices are read once; what is found there is found in all of them
            seen: dict[bytes, int] = {}
            same = np.array([seen.setdefault(buf[s:e].tobytes(), len(seen)) for s, e in zip(start[mine].tolist(), (start + size)[mine].tolist(), strict=True)])
            one = np.unique(same, return_index=True)[1]
            copies = np.bincount(same)
            w = Words(np.frombuffer(b"".join(seen), np.uint8), np.concatenate([[0], np.cumsum(size[mine][one])]))
            found, number = located(_words(w), w.first, rolling(w.hashes(lower=False), p.width), p, copies)
            if not len(found):
                continue
            piece = np.searchsorted(w.first, found, "right") - 1
            of = np.argsort(same, kind="stable")
            times = copies[piece]
            owner = mine[of[expanded((np.cumsum(copies) - copies)[piece], times)]]
            k, at = keys[owner], places[owner] + np.repeat(found - w.first[piece], times)
            later = _later(k, at, np.repeat(number, times))
            held.append((k[later], at[later]))
            if sum(len(k) for k, _ in held) >= p.held:
                yield _batch(list(_recurring(*(np.concatenate(x) for x in zip(*held, strict=True)), shards)))
                held = []
        if held:
            yield _batch(list(_recurring(*(np.concatenate(x) for x in zip(*held, strict=True)), shards)))

    return run


def _removed(p: SubstringParams):
    def run(batches):
        known: list[np.ndarray] = []
        keys = places = None
        for whole in batches:
            kinds = whole.column("_kind").to_numpy()
            for blob in whole.filter(pa.array(kinds == 0)).column("_blob").to_pylist():
                known.append(unpacked(blob, 2))
            texts = whole.filter(pa.array(kinds == 1))
            if not texts.num_rows:
                continue
            if keys is None or known:
                pair = np.concatenate([*known, np.zeros((2, 0), np.int64)] + ([np.stack([keys, places])] if keys is not None else []), axis=1)
                known = []
                order = np.lexsort((pair[1], pair[0]))
                keys, places = pair[0][order], pair[1][order]
            for batch, buf, offs in slices([texts], limit=p.slice_bytes):
                w = Words(buf, offs)
                kept, gone = [], []
                raw = buf.tobytes()
                for d, (key, k) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("_k").to_pylist(), strict=True)):
                    i, j = np.searchsorted(keys, [key, key + 1]) if key < (1 << 63) - 1 else (np.searchsorted(keys, key), len(keys))
                    starts = places[i:j]
                    a, b = w.first[d], w.first[d + 1]
                    spans = list(zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True))
                    n = 0
                    if len(starts):
                        hit = np.unique(starts[(starts >> _PART) == k] & ((1 << _PART) - 1))
                        steps = np.zeros(b - a + 1, np.int64)
                        np.add.at(steps, hit, 1)
                        np.add.at(steps, hit + p.width, -1)
                        stay = np.cumsum(steps)[:-1] == 0
                        n = int(b - a - stay.sum())
                        spans = [s for s, keep in zip(spans, stay.tolist(), strict=True) if keep]
                    kept.append(b" ".join([raw[s:e] for s, e in spans]).decode("utf-8"))
                    gone.append(n)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string()), pa.array(w.counts, pa.int64()), pa.array(gone, pa.int64())], names=["_row", "_text", "n_words", "n_removed"])

    return run


def without_repeats(docs: DataFrame, p: SubstringParams = SubstringParams(), counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` with the kept words as text, and two new columns ``counts``: words, and those removed (clashing ones are replaced)."""
    rows = identified(docs, F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"))
    parts = shards = parts_for(docs, p.spread, p.part_bytes)
    schema = "kind int, part int, text binary, blob binary"
    sent = rows.select("_key", "_k", "text").mapInArrow(_pieces(parts, shards, p), schema)
    later = table(sent.repartitionById(parts, F.col("part")).mapInArrow(_searched(shards, p), schema), "repeats")
    row_type = rows.schema["_row"].dataType
    both = rows.select(F.lit(1).alias("_kind"), "_key", "_k", "_row", "text", F.lit(None).cast("binary").alias("_blob"))
    # the same deal as that of the recurrences: the high bits of a multiplicative hash
    both = both.mapInArrow(_with_shard(shards), T.StructType([*both.schema.fields, T.StructField("_part", T.IntegerType())]))
    blobs = later.select(F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_key"), F.lit(None).cast("int").alias("_k"), F.lit(None).cast(row_type).alias("_row"), F.lit(None).cast("string").alias("text"), F.col("blob").alias("_blob"), F.col("part").alias("_part"))
    dealt = both.unionByName(blobs).repartitionById(shards, F.col("_part")).sortWithinPartitions("_kind")
    out = dealt.mapInArrow(_removed(p), f"_row {row_type.simpleString()}, _text string, n_words long, n_removed long")
    keep = [F.col(f"_row.{c}") if c != "text" else F.col("_text").alias("text") for c in docs.columns if c not in counts]
    return out.select(*keep, F.col("n_words").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def _with_shard(shards: int):
    def run(batches):
        for batch in batches:
            part = shard_of(batch.column("_key").to_numpy(), shards)
            yield batch.append_column("_part", pa.array(part, pa.int32()))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def oracle(width: int = 20) -> str:
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {width} + 2)) AS i, w FROM d WHERE len(w) >= {width}),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width} - 1], ' ')) AS h FROM s),
f AS (SELECT doc_id, i, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY h) AS later FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS i FROM f WHERE later),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, list_distinct(coalesce(gone, [])) AS gone FROM d LEFT JOIN g USING (doc_id)),
m AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) k LEFT JOIN c USING (doc_id, i) WHERE c.i IS NULL GROUP BY k.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN m USING (doc_id)
"""
