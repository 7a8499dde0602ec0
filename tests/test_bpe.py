"""The trie splitter and the heap of merges against plain versions and the public library."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tagweave.functions import bpe
from tagweave.operators import catalog


def plain_split(tokens, text):
    """Every live start is tried against every token at every letter."""
    tokens = [t for t in tokens if t]
    out, at, i = [], 0, 0
    while i < len(text):
        ends = [t for t in tokens if i + 1 - len(t) >= at and text[i + 1 - len(t) : i + 1] == t]
        if ends:
            t = next((t for t in ends if len(t) == 1), max(ends, key=len))
            if i + 1 - len(t) > at:
                out.append(text[at : i + 1 - len(t)])
            out.append(t)
            at = i + 1
        i += 1
    return out + ([text[at:]] if at < len(text) else [])


def plain_merged(rank, word):
    parts = list(word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return tuple(parts)


def test_splitter_at_random():
    rng = random.Random(2)
    for _ in range(3000):
        tokens = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 7))]
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
        assert bpe.Splitter(tokens).split(text) == plain_split(tokens, text), (tokens, text)


def test_splitter_is_linear():
    tokens = [f"<loc_{i}>" for i in range(1000)] + ["a" * 500 + "b"]
    text = "word <loc_7><loc_999><loc_x " * 4000 + "a" * 200_000
    s = bpe.Splitter(tokens)
    began = time.process_time()
    parts = s.split(text)
    assert time.process_time() - began < 3 and "".join(parts) == text and parts.count("<loc_999>") == 4000


def test_merges_at_random():
    """Merges of any order, those too whose products come before their parts."""
    rng = random.Random(3)
    for _ in range(1500):
        names = ["a", "b", "c"]
        merges = []
        for _ in range(rng.randint(0, 12)):
            pair = (rng.choice(names), rng.choice(names))
            if pair not in merges and len("".join(pair)) < 9:
                merges.append(pair)
                names.append("".join(pair))
        rng.shuffle(merges)
        e = bpe.Encoder({}, merges)
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert e._merged(word) == plain_merged(e.rank, word), (merges, word)


def test_long_words():
    merges = [("a" * (1 << k), "a" * (1 << k)) for k in range(17)] + [("b", "c")]
    e = bpe.Encoder({}, merges)
    began = time.process_time()
    assert [len(p) for p in e._merged("a" * 100_000)] == [1 << k for k in (16, 15, 10, 9, 7, 5)]
    assert len(e._merged("bcd" * 33_334)) == 66_668
    assert time.process_time() - began < 10


@pytest.mark.skipif(not os.path.exists(catalog.BYTE_TOKENIZER), reason="no vocabulary file")
def test_whole_vocabulary(spark):
    """Ids of the whole public vocabulary are those of the public library."""
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    mine = bpe.Encoder.of_file(catalog.BYTE_TOKENIZER)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("text").isNotNull()).select("text").limit(120).collect()
    for text in [*(r.text for r in rows), "", "  two  blanks \n\n\t x", "l'été <|endoftext|> 日本語 \U0001f600 don't", "x" * 3000, "\x00\x01"]:
        ids = mine.ids(text)
        assert ids == other.encode(text, add_special_tokens=False).ids and mine.decode(ids, 0) == text
    out = catalog.CATALOG["bpe_tokens"][0](spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and out.filter("NOT round_trip").count() == 0


def test_measured_as_encoded():
    rng = random.Random(5)
    encoder = bpe.Encoder.of_file(catalog.BYTE_TOKENIZER)
    texts = ["", "a<|endoftext|>b <|endoftext|>", "\x1c a\x85b  \n x", "été \U0001f600 l'été's", "a" * 100]
    texts += ["".join(rng.choice("aabthe \n\t'sé9.") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        ids = encoder.ids(t)
        assert encoder.measured(t) == (len(ids), encoder.decode(ids, 0) == t)
        assert bpe.pieces(t) == bpe.PIECES.findall(t)
    lossy = bpe.Encoder({"a": 0, "<unk>": 1}, [])
    assert lossy.measured("ab") == (2, False) and lossy.measured("aa") == (2, True)
