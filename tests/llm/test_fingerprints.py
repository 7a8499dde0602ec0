from __future__ import annotations

import base64
import random
from hashlib import sha256

import xxhash

from tagweave.llm import fingerprints as fp


def plain_cuts(data, p):
    """Byte after byte: the hash of the 32 bytes before every place, and the first place that may be a cut."""
    out, at = [], 0
    while at < len(data):
        top = min(at + p.most, len(data))
        to = len(data) if len(data) - at <= p.least else top
        for end in range(at + p.least, top):
            h = 0
            for b in data[max(0, end - 32) : end]:
                h = (2 * h + int(fp._GEAR[b])) % 2**32
            if h < 2 ** (32 - (p.strict_bits if end - at < p.target else p.loose_bits)):
                to = end
                break
        out.append(to)
        at = to
    return out


def plain_set(data, p=fp.ChunkParams()):
    """(digest, length) of every chunk."""
    ends = plain_cuts(data, p)
    return {(xxhash.xxh3_64_hexdigest(data[a:b])[:12], b - a) for a, b in zip([0, *ends], ends)}


def plain_text(chunks):
    return base64.b64encode(b"".join(bytes.fromhex(d) + n.to_bytes(2, "big") for d, n in sorted(chunks))).decode()


def plain_likeness(a, b):
    whole = sum(n for _, n in a)
    return sum(n for c, n in a if (c, n) in b) / whole if whole else float(not b)


def test_cuts_byte_by_byte():
    rng = random.Random(4)
    for k in range(60):
        data = bytes(rng.choice(b"abc \n") if k % 2 else rng.randrange(256) for _ in range(rng.choice([0, 1, 31, 32, 33, 95, 96, 97, 511, 512, 513, 1500])))
        for p in (fp.ChunkParams(), fp.ChunkParams(least=32, target=48, most=64, strict_bits=5, loose_bits=2)):
            assert fp.cuts(data, p) == plain_cuts(data, p)
    assert fp.cuts(b"a" * 3000) == plain_cuts(b"a" * 3000, fp.ChunkParams())


def brute(rows):
    order = sorted(((i if i is not None else -(1 << 63)), t or "", i) for i, t, *_ in rows)
    order.sort(key=lambda x: (-x[0], x[1]))
    out = []
    for n, (_, text, doc) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        sets = [plain_set(t.encode()) if len(t) < 20_000 else {(f"{e >> 16:012x}", e & 0xFFFF) for e in fp.entries(t.encode())} for t in (text, edited, after)]
        out.append((doc, len(text), sha256(edited.encode()).hexdigest(), plain_text(sets[0]), plain_text(sets[1]), plain_likeness(sets[0], sets[1]), plain_likeness(sets[0], sets[2])))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_whole_table(spark, docs, rows):
    found = [(r.doc_id, r.n_chars, fp.digest(r.edited), r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.compare(docs).collect()]
    assert sorted(found, key=key) == sorted(brute(rows), key=key)


def test_empty_and_single(spark, no_docs, rows):
    assert fp.compare(no_docs).count() == 0
    from tests.llm.conftest import make_docs

    (r,) = fp.compare(make_docs(spark, rows[:1])).collect()
    assert r.near_next == 1.0


def test_chunks_resist_shifts():
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(2000)).encode()
    moved = b"some new words first " + text
    assert fp.containment(fp.entries(text), fp.entries(moved)) > 0.97
    assert fp.containment(fp.entries(text), fp.entries(text[: len(text) // 2])) == fp.containment(fp.decoded(fp.encoded(fp.entries(text))), fp.entries(text[: len(text) // 2]))
    assert 0.45 < fp.containment(fp.entries(text), fp.entries(text[: len(text) // 2])) < 0.55
    p = fp.ChunkParams()
    ends = fp.cuts(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(text) and max(sizes) <= p.most and all(s > p.least - 1 for s in sizes[:-1])


def test_fingerprint_column(spark, docs):
    out = fp.fingerprints(docs, into="score")
    assert out.columns == docs.columns
    assert {r.score for r in out.filter("doc_id IN (1, 2)").collect()} == {fp.encoded(fp.entries(out.filter("doc_id = 1").first().text.encode()))}
