"""Detections: grid decoding, class filter, overlap, greedy suppression, mask choice, canvas points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.tags import let

# Fixed values of the detector: per grid (cells a side, stride, xy scale, anchors).
GRIDS = (
    (52, 8, 1.2, ((12.0, 16.0), (19.0, 36.0), (40.0, 28.0))),
    (26, 16, 1.1, ((36.0, 75.0), (76.0, 55.0), (72.0, 146.0))),
    (13, 32, 1.05, ((142.0, 110.0), (192.0, 243.0), (459.0, 401.0))),
)
INPUT_SIZE = 416
BOX = "struct<x1:double,y1:double,x2:double,y2:double,score:double>"


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, without a pixel added; null when the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = w * h
    return F.try_divide(both, area(a) + area(b) - both)


def suppressed(boxes: Column, threshold: float = 0.35) -> Column:
    """Greedy suppression over boxes sorted by score: each kept box drops later ones that overlap it by more than the threshold."""
    none = F.filter(boxes, lambda b: F.lit(False))

    def step(kept: Column, box: Column) -> Column:
        hit = F.exists(kept, lambda k: F.coalesce(iou(k, box) > threshold, F.lit(False)))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(box)))

    return F.aggregate(boxes, none, step)


def by_score(boxes: Column) -> Column:
    """Best score first; ties keep their order."""
    placed = F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("minus"), i.alias("i"), b.alias("box")))
    return F.transform(F.array_sort(placed), lambda x: x["box"])


def decoded(cell: Column, width: Column, height: Column, threshold: float = 0.5) -> Column:
    """Box of one anchor: ``cell`` has grid (0-2), row, col, anchor, dx, dy, dw, dh, conf and classes (array).

    Null if its best class score times confidence is not above the threshold, or the box is turned over.
    """
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), cell["grid"] + 1)
    stride, scale = pick([g[1] for g in GRIDS]), pick([g[2] for g in GRIDS])
    flat = cell["grid"] * 3 + cell["anchor"] + 1
    anchor_w = F.element_at(F.array(*[F.lit(a[0]) for g in GRIDS for a in g[3]]), flat)
    anchor_h = F.element_at(F.array(*[F.lit(a[1]) for g in GRIDS for a in g[3]]), flat)
    sig = lambda x: 1.0 / (1.0 + F.exp(-x))
    cx = (sig(cell["dx"]) * scale - 0.5 * (scale - 1.0) + cell["col"]) * stride
    cy = (sig(cell["dy"]) * scale - 0.5 * (scale - 1.0) + cell["row"]) * stride
    w, h = F.exp(cell["dw"]) * anchor_w, F.exp(cell["dh"]) * anchor_h
    ratio = F.least(F.lit(float(INPUT_SIZE)) / width, F.lit(float(INPUT_SIZE)) / height)
    pad_x, pad_y = (INPUT_SIZE - width * ratio) / 2, (INPUT_SIZE - height * ratio) / 2
    x1 = F.greatest((cx - w / 2 - pad_x) / ratio, F.lit(0.0))
    y1 = F.greatest((cy - h / 2 - pad_y) / ratio, F.lit(0.0))
    x2 = F.least((cx + w / 2 - pad_x) / ratio, width - 1.0)
    y2 = F.least((cy + h / 2 - pad_y) / ratio, height - 1.0)
    score = F.array_max(cell["classes"]) * cell["conf"]
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), score.alias("score"), (F.array_position(cell["classes"], F.array_max(cell["classes"])) - 1).cast("int").alias("class"))
    return F.when((score > threshold) & (x1 <= x2) & (y1 <= y2), box)


Values = Callable[[Column, int], Column]
PER_ANCHOR = 85  # four of the box, the confidence, 80 classes


def _grid_boxes(grid: int, values: Column | Values, width: Column, height: Column, threshold: float, most: float) -> Column:
    side = GRIDS[grid][0]
    if isinstance(values, Column):
        at = lambda i, k: F.element_at(values, i * PER_ANCHOR + (k + 1)).cast("double")
        classes = lambda i: F.transform(F.slice(values, i * PER_ANCHOR + 6, PER_ANCHOR - 5), lambda x: x.cast("double"))
    else:
        at = values
        classes = lambda i: F.array(*[values(i, k) for k in range(5, PER_ANCHOR)])

    def box(i: Column) -> Column:
        cell = F.struct(
            F.lit(grid).alias("grid"), F.floor(i / (3 * side)).alias("row"), (F.floor(i / 3) % side).alias("col"), (i % 3).alias("anchor"), *[at(i, k).alias(n) for k, n in enumerate(("dx", "dy", "dw", "dh", "conf"))],
            classes(i).alias("classes"),
        )
        return let(cell, lambda c: let(decoded(c, width, height, threshold), lambda b: F.when(b.isNotNull(), F.struct(c["grid"].alias("grid"), i.alias("anchor"), *[b[n].alias(n) for n in ("x1", "y1", "x2", "y2", "score", "class")]))))

    hopeful = F.filter(F.sequence(F.lit(0), F.lit(side * side * 3 - 1)), lambda i: at(i, 4) * most > threshold)
    return F.filter(F.transform(hopeful, box), lambda b: b.isNotNull())


def grid_boxes(grids: Sequence[Column | Values], width: Column, height: Column, threshold: float = 0.5, most: float = 1.0) -> Column:
    """Boxes of all anchors of the three flat grids (cells by rows, 3 anchors each, 85 values): grid, anchor (its place in the grid), x1, y1, x2, y2, score, class.

    No class is scored above ``most``, so an anchor whose confidence is too low for that is passed over by one look; only others are decoded.
    A grid is an array, or a function that gives the value of an anchor's place and a number from 0 to 84; then only values that are looked at are computed."""
    if len(grids) != len(GRIDS):
        raise ValueError("three grids are needed")
    return F.concat(*[_grid_boxes(k, g, width, height, threshold, most) for k, g in enumerate(grids)])


def found(grids: Sequence[Column], width: Column, height: Column, kind: int = 0, threshold: float = 0.5, overlap: float = 0.35) -> Column:
    """Boxes of one class after greedy suppression, best first."""
    return suppressed(by_score(F.filter(grid_boxes(grids, width, height, threshold), lambda b: b["class"] == kind)), overlap)


def first_best(values: Column) -> Column:
    """Place (from 0) of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def canvas_point(x: Column, y: Column, width: Column, height: Column, side: int = 1024) -> Column:
    """A point of an image on the letterboxed square canvas; new sizes round half to even, padding is whole pixels."""
    ratio = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    new_w, new_h = F.rint(width * ratio), F.rint(height * ratio)
    pad_x, pad_y = F.floor((side - new_w) / 2), F.floor((side - new_h) / 2)
    return F.struct((x * ratio + pad_x).alias("x"), (y * ratio + pad_y).alias("y"))


def prompt_points(points: Column, box: Column) -> Column:
    """Labelled prompt points: 1 for points, 2 and 3 for a box's corners."""
    own = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1).alias("label")))
    corners = F.array(F.struct(box["x1"].alias("x"), box["y1"].alias("y"), F.lit(2).alias("label")), F.struct(box["x2"].alias("x"), box["y2"].alias("y"), F.lit(3).alias("label")))
    return F.concat(own, F.when(box.isNull(), F.filter(corners, lambda c: F.lit(False))).otherwise(corners))


def mask_needed(values: Column) -> Column:
    """Whether any mask value is above 0."""
    return F.exists(values, lambda v: v > 0)
