"""Tiles as rows against whole images."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tagweave.operators import models, tiling
from tagweave.sources import png

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module


def painter():
    return lambda part, hole: np.where(hole[:, :, None] > 0, 255 - part.astype(float) * 0.5, part)


def image(seed, h, w):
    rng = np.random.default_rng(seed)
    mask = np.zeros((h, w), np.uint8)
    mask[h // 3 : h // 2, w // 4 : w // 2] = 255
    return rng.integers(0, 256, (h, w, 3)).astype(np.uint8), mask


SHAPES = [(300, 260), (64, 64), (65, 200), (30, 20), (129, 64)]


def packed(spark, shapes):
    rows = []
    for k, (h, w) in enumerate(shapes):
        x, mask = image(k, h, w)
        rows.append((f"{k}", bytearray(png.encoded(x)), bytearray(png.encoded(np.repeat(mask[:, :, None], 3, axis=2)))))
    return spark.createDataFrame(rows, "path string, content binary, mask binary")


@pytest.mark.parametrize("lines", [7, 256])
def test_equal_to_the_whole_image(spark, lines):
    blocks = tiling.inpainted(tiling.strips(packed(spark, SHAPES), lines), f"half {lines}", painter, 64, 16).cache()
    for k, (h, w) in enumerate(SHAPES):
        x, mask = image(k, h, w)
        assert (tiling.whole(blocks, f"{k}", w, h) == models.inpainted(x, mask, painter(), 64, 16)).all(), k


def test_strips_are_the_image(spark):
    x, mask = image(1, 50, 40)
    rows = tiling.strips(packed(spark, [(50, 40)]), 8).collect()
    x, mask = image(0, 50, 40)
    rows.sort(key=lambda r: r.top)
    assert [r.top for r in rows] == list(range(0, 50, 8)) and b"".join(r.pixels for r in rows) == x.tobytes() and b"".join(r["mask"] for r in rows) == mask.tobytes()
    other = spark.createDataFrame([("a", bytearray(b"no"), None), ("b", None, None), ("c", bytearray(png.encoded(x)), None)], "path string, content binary, mask binary")
    assert {(r.path, r["mask"]) for r in tiling.strips(other).collect()} == {("c", None)} and tiling.inpainted(tiling.strips(other), "none", painter).count() == 0


def test_one_image_is_dealt_over_many_tasks(spark):
    """Rows of one image are small, and its tiles lie in many tasks."""
    from pyspark.sql import functions as F

    pieces = tiling.strips(packed(spark, [(900, 1000)]), 64)
    blocks = tiling.inpainted(pieces, "many", painter, 128, 32)
    rows = blocks.select(F.spark_partition_id().alias("part"), F.length("pixels").alias("size")).collect()
    assert len(rows) == 10 * 11 and len({r.part for r in rows}) > 20 and max(r["size"] for r in rows) == 96 * 96 * 4
    x, mask = image(0, 900, 1000)
    assert (tiling.whole(blocks, "0", 1000, 900) == models.inpainted(x, mask, painter(), 128, 32)).all()
