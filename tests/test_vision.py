from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions import bpe, detections, geometry, loctokens, pixels, scores
from tagweave.operators import models
from tagweave.plans.settings import Settings


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


def boxes(*rows):
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(r, ("x1", "y1", "x2", "y2", "score"), strict=True)]) for r in rows])


def test_scores(spark):
    r = scores.ranked(F.array(*[F.lit(x).cast("float") for x in (0.9, 0.2, 0.5)]), F.array(*[F.lit(x) for x in ("a_b", "c", "d")]), 0.2)
    assert one(spark, scores.label_list(r)) == ["a b", "d"]
    assert one(spark, scores.weighted(r)) == ["(a b:0.90)", "(d:0.50)"]


def test_suppression(spark):
    kept = one(spark, detections.suppressed(boxes((0, 0, 10, 10, 0.9), (1, 1, 11, 11, 0.8), (20, 20, 30, 30, 0.7))))
    assert [b.x1 for b in kept] == [0, 20]
    assert one(spark, detections.iou(*[boxes((1, 1, 1, 1, 0))[0]] * 2)) is None


def test_canvas_point(spark):
    p = one(spark, detections.canvas_point(F.lit(100), F.lit(50), F.lit(2000), F.lit(1000)))
    assert (round(p.x, 6), round(p.y, 6)) == (51.2, 281.6)


def test_location_tokens(spark):
    b = one(spark, loctokens.boxes(F.lit("car<loc_54><loc_375><loc_906><loc_707>red door<loc_1><loc_2><loc_3><loc_4><loc_5><loc_6><loc_7><loc_8>"), F.lit(1000), F.lit(1000)))
    assert [tuple(x) for x in b] == [("car", 54, 375, 852, 332), ("door", 1, 2, 2, 2), ("door", 5, 6, 2, 2)]
    assert one(spark, loctokens.region(F.lit("<loc_1>"), F.lit(10), F.lit(10))) is None
    assert one(spark, loctokens.labelled_polygons(F.lit("a<poly><loc_1></poly>"), F.lit(10), F.lit(10)))[0].points is None
    assert loctokens.task_query("RegionToOcr", region=(0.1, 0.2, 2.0, -1.0)) == "What text is in the region <loc_100><loc_200><loc_999><loc_0>?"
    with pytest.raises(ValueError):
        loctokens.task_query("Caption", sub_prompt="x")


def test_geometry(spark):
    size = lambda w, h: tuple(one(spark, geometry.aligned_size(F.lit(w), F.lit(h), 512)))
    assert size(1000, 667) == (512, 336) and size(667, 1000) == (336, 512)
    assert [one(spark, geometry.to_multiple(F.lit(v), 16)) for v in (8, 7, 24)] == [16, 0, 32]
    assert one(spark, geometry.tile_starts(F.lit(1000))) == [0, 386, 488]
    for w in (1, 512, 513, 898, 899, 2000):
        starts = one(spark, geometry.tile_starts(F.lit(w)))
        assert set().union(*[range(s, min(w, s + 512)) for s in starts]) == set(range(w))


def test_pixels():
    rng = np.random.default_rng(0)
    mask = (rng.random((9, 11)) > 0.8).astype(np.uint8) * 255
    want = [[mask[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for x in range(11)] for y in range(9)]
    assert (pixels.dilated(mask, 2) == want).all()
    image = rng.integers(0, 256, (700, 600, 3)).astype(np.uint8)
    done = models.inpainted(image, np.zeros((700, 600), np.uint8), None)
    assert np.abs(done[1:-1, 1:-1, :3].astype(int) - image[1:-1, 1:-1]).max() <= 1 and done[0, 0, 3] == 0
    flat = np.full((40, 40, 3), 77, np.uint8)
    assert (pixels.detail_preserving(flat, 7, 7) == 77).all()
    assert pixels.tagger_input(flat).shape == (1, 448, 448, 3) and pixels.detector_input(flat).max() <= 1
    assert pixels.tile_pixels(flat, 0, 0, 64).shape == (64, 64, 3)
    assert pixels.rendered_mask(np.full((256, 256), 9.0), 30, 20).min() == 255
    with pytest.raises(ValueError):
        pixels.combined_masks([mask, mask[:2]])


def test_detail_preserving_against_loops():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 13, 3)).astype(np.uint8)
    got = pixels.detail_preserving(image, 4, 3, 3.0)
    src, patch = image / 255, min(13 / 4, 9 / 3)
    x0, y0 = (13 - 4 * patch) / 2, (9 - 3 * patch) / 2

    def cover(x, y, i, j):
        a = max(0, 1 - max(0, x - i) - max(0, i + 1 - x - patch))
        return a * max(0, 1 - max(0, y - j) - max(0, j + 1 - y - patch))

    def cells(ox, oy):
        return [(cover(ox * patch + x0, oy * patch + y0, i, j), src[j, i]) for j in range(9) for i in range(13)]

    def mean(ox, oy):
        c = cells(min(max(ox, 0), 3), min(max(oy, 0), 2))
        return sum(w * v for w, v in c) / sum(w for w, _ in c)

    for oy in range(3):
        for ox in range(4):
            centre = sum((2 - abs(i)) * (2 - abs(j)) * mean(ox + i, oy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 16
            c = [(w * (((centre - v) ** 2).sum() ** 1.5 if ((centre - v) ** 2).sum() > 1e-9 else 1), v) for w, v in cells(ox, oy) if w > 1e-6]
            want = sum(w * v for w, v in c) / sum(w for w, _ in c)
            assert np.abs(got[oy, ox] - np.floor(want * 255 + 0.5)).max() <= 1


def test_bpe_round_trip():
    rng = random.Random(2)
    letters = list(bpe.byte_letters().values())
    e = bpe.Encoder({n: i + 4 for i, n in enumerate([*letters, "th", "the"])}, [("t", "h"), ("th", "e")], {"<s>": 0, "<unk>": 3, "</s>": 2})
    for text in ("the cat's thé 12  x", "ünï \U0001f600", ""):
        assert e.decode(e.ids(text)) == text
    assert e.tokens("a<s>the") == ["a", "<s>", "the"]
    assert bpe.Splitter(["ab", "b", "abc"]).split("xabcb") == ["xa", "b", "c", "b"]
    assert rng.random() < 1


def test_models_and_settings():
    assert models.greedy(lambda x: np.eye(5)[(len(x) + 2) % 5], most=3) == [2, 3, 4, 0]
    assert models.greedy(lambda x: np.eye(5)[2]) == [2, 2]
    f, m = models.joined_inputs(np.zeros((1, 2, 3)), np.ones((1, 4, 3)), np.array([[1, 1, 0, 0]]))
    assert f.shape == (1, 6, 3) and m.tolist() == [[1, 1, 1, 1, 0, 0]]
    s = Settings.from_json('{"tagger": {"threshold": 7}, "crop": null, "x": 1}')
    assert s.tagger.threshold == 1.0 and s.crop.expansion == 1.1 and Settings.from_json(s.to_json()) == s


def test_stub_tagger_and_caption_tokens(spark):
    """The queries without SQL, against plain versions over the smallest tables."""
    import os

    from tagweave.operators.catalog import CATALOG, TOKENIZER, _Stub
    from tests.plain import without_redundant

    sf = "/root/testdata/sf0.001"
    names = ["red plate", "plate", "solo", "blue hair", "light blue hair", "ring", "old ring", "smile"]
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    got = {r.page_id: r.tags for r in CATALOG["stub_autotag"][0](spark, sf).collect()}
    for k, text in html.items():
        row = _Stub()([text.encode()])[0]
        kept = [names[i] for i in sorted(range(8), key=lambda i: (-row[i], i)) if row[i] > np.float32(0.4)]
        assert got[k] == without_redundant(", ".join(kept)), k
    if os.path.exists(TOKENIZER):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(TOKENIZER)
        texts = {r.k: r.tags for r in CATALOG["tags_parse"][0](spark, sf).join(views_tags(spark, sf), "k").select("k", "tags").limit(200).collect()}
        got = {r.k: (r.n_tokens, r.over) for r in CATALOG["caption_tokens"][0](spark, sf).collect()}
        for k, text in texts.items():
            n = len([i for i in t.encode(text, add_special_tokens=False).ids if i not in (49406, 49407)])
            assert got[k] == (n, n > 75)


def views_tags(spark, sf):
    from tagweave.operators import views

    return views.order_tags(spark, sf)


def test_bpe_against_the_public_library(tmp_path):
    """Files of a vocabulary and merges are read, and give the ids that the tokenizers library gives."""
    import json

    from tokenizers import Tokenizer, decoders, models as kinds, pre_tokenizers

    letters = list(bpe.byte_letters().values())
    merges = [("t", "h"), ("th", "e"), ("i", "n"), ("\u0120", "the"), ("e", "r"), ("o", "n"), ("\u0120", "a"), ("o", "u")]
    vocab = {n: i for i, n in enumerate(["<unk>", *letters, *(a + b for a, b in merges)])}
    (tmp_path / "v.json").write_text(json.dumps(vocab))
    (tmp_path / "m.txt").write_text("#version\n" + "\n".join(" ".join(m) for m in merges) + "\n")
    (tmp_path / "a.json").write_text(json.dumps({"<s>": 900}))
    mine = bpe.Encoder.load(str(tmp_path / "v.json"), str(tmp_path / "m.txt"), str(tmp_path / "a.json"))
    other = Tokenizer(kinds.BPE(vocab, merges, unk_token="<unk>"))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.decoder = decoders.ByteLevel()
    for text in ("the other one's in there", "Th\u00e9  12 the\n\tthin", "\u4f60 a a", " the", ""):
        assert mine.ids(text) == other.encode(text).ids
    assert mine.ids("a<s>the") == [vocab["a"], 900, vocab["the"]]
