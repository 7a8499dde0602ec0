from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import spelling
from tests.llm.conftest import make_docs


def plain_words(rows):
    seen = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def plain(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def variants(rng, count):
    """Words with edits at every place, doubled letters, long words and hot segments."""
    out = []
    for _ in range(count):
        w = "".join(rng.choice("abcdeéÿ×") for _ in range(rng.choice([7, 7, 8, 9, 12, 25])))
        out.append(w)
        for _ in range(4):
            k = rng.randrange(len(w))
            out.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abz") + w[k + 1 :], w[:k] + w[k] + w[k:]]))
    out += ["aaaaaaa" + "a" * k for k in range(6)] + ["interes" + x for x in ("s", "t", "st", "ts", "", "tt")]
    out += ["prefixed" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 5))) for _ in range(count)]
    return out


@pytest.mark.parametrize("p", [spelling.SpellingParams(), spelling.SpellingParams(rows=4, shard_rows=50, compared=64)])
def test_against_all_pairs(spark, p):
    rng = random.Random(5)
    words = variants(rng, 60)
    rows = []
    for i in range(120):
        picked = [w for w in words for _ in range(int(rng.paretovariate(1.0)) if rng.random() < 0.05 else 0)]
        rng.shuffle(picked)
        rows.append((i, "|".join(w.upper() if rng.random() < 0.2 else w for w in picked), "en", "src0"))
    heavy = words[::9]
    rows.append((500, " ".join(w for w in heavy for _ in range(rng.choice([3, 40, 500]))), "en", "src0"))
    want = plain(plain_words(rows))
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(v[3] > 3 for v in want.values())
    out = spelling.grouped(spelling.vocabulary(make_docs(spark, rows), p, spelling.dropped_letters()), p).collect()
    assert len(out) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want


def test_edge_rows(spark, docs, rows, no_docs):
    out = spelling.grouped(spelling.vocabulary(docs, edit=spelling.dropped_letters())).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == plain(plain_words(rows))
    assert spelling.grouped(spelling.vocabulary(no_docs)).count() == 0


def test_very_long_words_and_a_hot_segment(spark):
    """Words of 50,000 letters, and thousands of words that share one half."""
    rng = random.Random(8)
    long = "".join(rng.choice("abc") for _ in range(50_000))
    words = [long, long[:40_000] + long[40_001:], long[:10] + "z" + long[11:], long[::-1]]
    hot = sorted({"segmented" + "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(3000)})
    hot += [w[:12] + "x" + w[13:] for w in hot[:200]]
    p = spelling.SpellingParams(rows=64)
    df = spark.createDataFrame([(w, 2) for w in dict.fromkeys(words + hot)], "word string, n long")
    sizes = spelling.meetings(df, p).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 64
    found = {frozenset((r.a, r.b)) for r in spelling.near_words(df, p).collect()}
    assert {frozenset(words[:2]), frozenset((words[0], words[2]))} <= found
    by_rest: dict[str, set] = {}
    for w in hot:
        for k in range(9, 18):
            by_rest.setdefault(w[:k] + "?" + w[k + 1 :], set()).add(w)
    want = {frozenset((x, y)) for group in by_rest.values() for x in group for y in group if x < y}
    assert {f for f in found if len(max(f)) < 100} == want and len(want) >= 200


def test_hits_decide():
    """Rows that share a key but not the segment, offset or length are no candidates."""
    rows = [("abcdefgh", True, 8, 4, 8), ("abcdefgx", False, 8, 4, 8), ("xabcdefg", False, 8, 4, 8), ("zzzzefgh", False, 8, 4, 8)]
    shard = pa.Table.from_pylist([{"word": w, "n": 3, "pattern": role, "whole": whole, "lo": lo, "hi": hi, "key": 1} for w, role, whole, lo, hi in rows])
    out = spelling.near_pairs(shard, spelling.SpellingParams()).to_pylist()
    assert [(r["a"], r["b"]) for r in out] == [("abcdefgh", "abcdefgx")]


def test_one_edit():
    chars = lambda s: np.array([[ord(c) for c in s]])
    assert spelling._one_edit(chars("abc"), chars("axc"))[0] and not spelling._one_edit(chars("abc"), chars("abc"))[0]
    assert spelling._one_edit(chars("aab"), chars("ab"))[0] and not spelling._one_edit(chars("abc"), chars("ba"))[0]


def test_no_table_goes_through_the_driver(spark):
    words = spark.createDataFrame([("abcdefgh", 40), ("abcdefgi", 2), ("abcdefg", 3)], "word string, n long")
    plan = spelling.grouped(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
