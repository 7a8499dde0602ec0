from __future__ import annotations

import random
from collections import Counter, defaultdict

from tagweave.llm import packing


def sequential(lengths, p):
    """Piece by piece, longest first: tightest open bin, else the permitted length of least cost a piece."""
    bins = []  # [room, capacity, contents]
    lengths = sorted(lengths, reverse=True)
    left = Counter(lengths)
    for n in lengths:
        fits = [b for b in bins if b[0] >= n]
        if not fits:
            c = packing.opened(n, left[n], p)
            bins.append([c, c, []])
            fits = bins[-1:]
        b = min(fits, key=lambda b: b[:2])
        b[0] -= n
        b[2].append(n)
        left[n] -= 1
    return bins


def test_plan_equals_sequential_best_fit():
    p = packing.PackParams(lengths=(8, 16, 32), overhead=4, quadratic=64)
    for seed in range(30):
        rng = random.Random(seed)
        lengths = [rng.choice([rng.randint(1, 32), 5, 9, 32]) for _ in range(rng.randint(0, 300))]
        placed, bins = packing.plan(Counter(lengths), p)
        want = sequential(lengths, p)
        assert sum(n for _, n, _ in bins) == len(want)
        assert Counter(used for _, n, used in bins for _ in range(n)) == Counter(c - room for room, c, _ in want)


def test_whole_table(spark, docs, no_docs, rows):
    p = packing.PackParams()
    out = packing.pack(docs, p).collect()
    sizes = {b: {r.bin_length for r in out if r.bin_id == b} for b in {r.bin_id for r in out}}
    content = defaultdict(list)
    for r in out:
        content[r.bin_id].append((r.offset, r.n_tokens))
    for b, items in content.items():
        items.sort()
        assert items[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(items, items[1:]))  # no gap, no overlap
        used = items[-1][0] + items[-1][1]
        assert sizes[b] == {min(c for c in p.lengths if c >= used)}
    words = Counter()
    for i, t, *_ in rows:
        words[i] += len(packing_words(t))
    got = Counter()
    for r in out:
        got[r.doc_id] += r.n_tokens
    assert got == +words
    placed, bins = packing.plan(Counter(r.n_tokens for r in out), p)
    assert len(content) == sum(n for _, n, _ in bins)
    assert packing.pack(no_docs).count() == 0


def packing_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
