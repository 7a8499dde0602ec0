"""Whole-grid decoding against loops over all anchors, and the plan from grids to crops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions import detections, geometry

SCHEMA = "id long, w double, h double, g0 array<float>, g1 array<float>, g2 array<float>"


def images(seed, sizes):
    """Flat grids with few confident anchors, some exactly at the threshold, some turned over."""
    rng = np.random.default_rng(seed)
    out = []
    for i, (w, h) in enumerate(sizes):
        grids = []
        for side, *_ in detections.GRIDS:
            g = rng.normal(0, 1, (side * side * 3, 85)).astype(np.float32)
            g[:, 4] = np.where(rng.random(len(g)) < 0.004, rng.uniform(0.5, 1, len(g)), rng.uniform(0, 0.49, len(g)))
            g[:3, 4] = (0.5, 1.0, 0.5)
            g[:, 5:] = rng.uniform(0, 1, (len(g), 80))
            g[rng.random(len(g)) < 0.5, 5] = 1.0  # class 0, ties with nothing above it
            g[5, :6] = (9, 9, -20, 3, 1, 1)
            grids.append(g)
        out.append((i, float(w), float(h), *[g.reshape(-1).tolist() for g in grids]))
    return out


def plain(w, h, grids, threshold):
    out = {}
    for k, (side, stride, scale, anchors) in enumerate(detections.GRIDS):
        values = np.array(grids[k], np.float32).astype(float).reshape(side, side, 3, 85)
        for row in range(side):
            for col in range(side):
                for a in range(3):
                    dx, dy, dw, dh, conf = values[row, col, a, :5]
                    scores = values[row, col, a, 5:] * conf
                    cx = (1 / (1 + math.exp(-dx)) * scale - 0.5 * (scale - 1) + col) * stride
                    cy = (1 / (1 + math.exp(-dy)) * scale - 0.5 * (scale - 1) + row) * stride
                    bw, bh = math.exp(dw) * anchors[a][0], math.exp(dh) * anchors[a][1]
                    ratio = min(416 / w, 416 / h)
                    px, py = (416 - ratio * w) / 2, (416 - ratio * h) / 2
                    box = (max((cx - bw / 2 - px) / ratio, 0), max((cy - bh / 2 - py) / ratio, 0), min((cx + bw / 2 - px) / ratio, w - 1), min((cy + bh / 2 - py) / ratio, h - 1))
                    if box[0] <= box[2] and box[1] <= box[3] and scores.max() > threshold:
                        out[k, (row * side + col) * 3 + a] = (*box, scores.max(), int(scores.argmax()))
    return out


@pytest.fixture(scope="module")
def rows():
    return images(4, [(800, 600), (416, 416), (300, 1200)])


@pytest.mark.parametrize("threshold", [0.5, 0.3])
def test_all_anchors(spark, rows, threshold):
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select("id", F.explode(detections.grid_boxes([F.col(f"g{k}") for k in range(3)], F.col("w"), F.col("h"), threshold)).alias("b")).select("id", "b.*").collect()
    for i, w, h, *grids in rows:
        want = plain(w, h, grids, threshold)
        mine = {(r.grid, r.anchor): r for r in got if r.id == i}
        assert set(mine) == set(want) and len(want) > 5
        for at, (*box, score, kind) in want.items():
            r = mine[at]
            assert np.allclose((r.x1, r.y1, r.x2, r.y2, r.score), (*box, score), atol=1e-6) and r["class"] == kind


def test_from_grids_to_crops_in_one_plan(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = df.select("id", "w", "h", detections.found([F.col(f"g{k}") for k in range(3)], F.col("w"), F.col("h"), overlap=0.35).alias("boxes"))
    crops = found.select("id", "boxes", F.transform("boxes", lambda b: geometry.crop_window(b, F.col("w").cast("int"), F.col("h").cast("int"), 1.1, 512)).alias("crops")).collect()
    for r in crops:
        _, w, h, *grids = rows[r.id]
        people = sorted((b for b in plain(w, h, grids, 0.5).values() if b[5] == 0), key=lambda b: -b[4])
        kept = []
        for b in people:
            area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
            both = [max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1])) for k in kept]
            if not any(o > 0.35 * (area(b) + area(k) - o) for o, k in zip(both, kept, strict=True)):
                kept.append(b)
        assert np.allclose([(b.x1, b.y1, b.x2, b.y2, b.score) for b in r.boxes], [b[:5] for b in kept], atol=1e-6) and len(kept) > 1
        assert len(r.crops) == len(kept) and all(c is not None for b, c in zip(r.boxes, r.crops, strict=True) if min(b.x2 - b.x1, b.y2 - b.y1) >= 4)
        assert all(0 <= c.x < w and 0 <= c.y < h and c.w > 0 and c.h > 0 for c in r.crops if c)


def test_confidence_is_looked_at_first(spark):
    """Anchors without confidence are passed over whatever their classes hold; three grids are needed."""
    empty = [(0, 416.0, 416.0, *[[0.0] * (s * s * 3 * 85) for s, *_ in detections.GRIDS])]
    df = spark.createDataFrame(empty, SCHEMA)
    assert df.select(F.size(detections.grid_boxes([F.col(f"g{k}") for k in range(3)], F.col("w"), F.col("h"))).alias("n")).first().n == 0
    with pytest.raises(ValueError, match="three"):
        detections.grid_boxes([F.col("g0")], F.col("w"), F.col("h"))


def test_grids_of_functions(spark):
    """Values that are computed where they are looked at give the boxes of whole arrays."""
    from tagweave.functions import detections as d

    value = lambda i, k: ((i.cast("long") * 85 + k) * 7919 % 1009) / F.lit(1009.0)
    arrays = [F.transform(F.sequence(F.lit(0), F.lit(g[0] * g[0] * 3 * 85 - 1)), lambda j: (j.cast("long") * 7919 % 1009) / F.lit(1009.0)) for g in d.GRIDS]
    whole = spark.range(1).select(*[a.alias(f"g{k}") for k, a in enumerate(arrays)]).cache()
    one = whole.select(d.grid_boxes([F.col(f"g{k}") for k in range(3)], F.lit(800.0), F.lit(480.0), 0.9).alias("b")).first().b
    two = spark.range(1).select(d.grid_boxes([value] * 3, F.lit(800.0), F.lit(480.0), 0.9).alias("b")).first().b
    assert one == two and len(one) > 10
