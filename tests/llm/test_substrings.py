from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest

from tagweave.llm import substrings
from tests.llm.conftest import make_docs


def brute(rows, width=20):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i if i is not None else -(1 << 63), set()).add(t or "")
    part = {(i, t): k for i, ts in texts.items() for k, t in enumerate(sorted(ts))}
    split = [(i if i is not None else -(1 << 63), t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, t, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            place = (i, part[i, t], s)
            first[k] = min(first.get(k, place), place)
    out = []
    for (i, t, w), (doc, *_) in zip(split, rows, strict=True):
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, part[i, t], s):
                gone |= set(range(s, s + width))
        out.append((doc, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def found(docs, p=substrings.SubstringParams()):
    return sorted(((r.doc_id, int(r.n_words), r.n_removed, r.text) for r in substrings.without_repeats(docs, p).collect()), key=str)


def test_edge_rows(docs, rows, no_docs):
    assert found(docs) == brute(rows)
    assert found(docs, substrings.SubstringParams(slice_bytes=300)) == brute(rows)
    assert substrings.without_repeats(no_docs).count() == 0
    assert substrings.without_repeats(docs).columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]


def test_overlapping_passages(spark, words):
    rng = random.Random(8)
    source = [rng.choice(words[:5]) for _ in range(400)]
    rows = []
    for i in range(60):
        a = rng.randrange(380)
        rows.append((i, " ".join(source[a : a + rng.randint(5, 90)] + [rng.choice(words) for _ in range(rng.randint(0, 30))]), "en", "src0"))
    rows.append((70, "b " * 300, "en", "src0"))
    assert found(make_docs(spark, rows)) == brute(rows)


@pytest.mark.parametrize("width", [4, 7, 20])
def test_located_finds_every_occurrence(width):
    """Against a scan of all windows: those that recur, counting copies, and no others."""
    rng = np.random.default_rng(width)
    pieces = [rng.integers(0, 2 if width < 20 else 1, n) for n in (60, 3, 0, 45, width, 31)]
    codes, first = np.concatenate(pieces), np.cumsum([0] + [len(x) for x in pieces])
    copies = np.array([1, 1, 1, 2, 1, 1])
    p = substrings.SubstringParams(width=width, patterns=5)
    hashes = np.array([hash(tuple(codes[i : i + width].tolist())) & 0xFFFF for i in range(len(codes))], np.uint64)
    found, number = substrings.located(codes, first, hashes, p, copies)
    places = {}
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for at in range(a, b - width + 1):
            places.setdefault(tuple(codes[at : at + width].tolist()), []).append((at, copies[i]))
    want = sorted(sorted(at for at, _ in v) for v in places.values() if sum(n for _, n in v) > 1)
    got = {}
    for at, n in zip(found.tolist(), number.tolist(), strict=True):
        got.setdefault(n, []).append(at)
    assert sorted(map(sorted, got.values())) == want


def test_automata_decide(spark, words, monkeypatch):
    """Window hashes that all agree, or automata of few sequences, change nothing: the hits on words decide."""
    rng = random.Random(9)
    passage = [rng.choice(words) for _ in range(70)]
    texts = [[rng.choice(words) for _ in range(30)] + passage[a : a + 45] + [rng.choice(words) for _ in range(30)] for a in (0, 10, 25, 3)]
    codes, first = np.unique(sum(texts, []), return_inverse=True)[1], np.cumsum([0] + [len(t) for t in texts])
    p = substrings.SubstringParams(patterns=7)
    found, number = substrings.located(codes, first, np.zeros(len(codes), np.uint64), p)
    by_number, by_words = {}, {}
    for at, n in zip(found.tolist(), number.tolist(), strict=True):
        by_number.setdefault(n, set()).add(at)
    for a, b in zip(first[:-1], first[1:], strict=True):
        for at in range(a, b - 19):
            by_words.setdefault(tuple(codes[at : at + 20]), set()).add(int(at))
    assert sorted(map(sorted, by_number.values())) == sorted(map(sorted, by_words.values()))
    # removals come from the hits: without them nothing goes but what has equal bytes in one slice
    rows = [(i, " ".join(t), "en", "src0") for i, t in enumerate(texts)]
    assert found_in_shard(rows, p) == {(i, s) for i, s in brute_later(texts)}
    monkeypatch.setattr(substrings, "located", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not found_in_shard(rows, p)


def test_a_part_is_searched_in_little_memory(words):
    """What a task holds beside a part's text is bounded by what is searched at a time; later places are handed on together."""
    import pyarrow as pa

    rng = random.Random(10)
    text = [" ".join(rng.choice(words) + rng.choice(words) for _ in range(700)) for _ in range(400)]
    rows = [(i, t + " " + text[0][:400]) for i, t in enumerate(text)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a : a + 100]]), pa.array([0] * len(rows[a : a + 100]), pa.int32()), pa.array([r[1] for r in rows[a : a + 100]])], names=["_key", "_k", "text"]) for a in range(0, len(rows), 100)]
    p = substrings.SubstringParams()
    sent = pa.Table.from_batches(list(substrings._pieces(1, 1, p)(batches))).filter(pa.compute.field("kind") == 0).to_batches()
    size = sum(substrings.unpacked(blob, 4)[2].sum() for b in sent for blob in b.column("blob").to_pylist())
    assert size > 8 << 20
    tracemalloc.start()
    try:
        found = list(substrings._searched(1, p)(iter(sent)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
    assert len(found) == 1 and found[0].num_rows == 1


def brute_later(texts, width=20):
    seen = set()
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            k = tuple(t[s : s + width])
            if k in seen:
                yield i, s
            seen.add(k)


def found_in_shard(rows, p):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([0], pa.int32()), pa.array([t])], names=["_key", "_k", "text"]) for i, t, *_ in rows]
    out = set()
    for b in substrings._searched(3, p)(substrings._pieces(2, 3, p)(batches)):
        for blob in b.column("blob").to_pylist():
            out |= {(int(k), int(s)) for k, s in zip(*substrings.unpacked(blob, 2), strict=True)}
    return out
