"""Image geometry as Column functions: aligned sizes, crop windows, tile grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_multiple(value: Column, multiple: int) -> Column:
    """Nearest multiple; a remainder of half or more goes up."""
    if multiple == 0:
        return value
    r = value % multiple
    return F.when(r >= multiple // 2, value + multiple - r).otherwise(value - r).cast("int")


def aligned_size(width: Column, height: Column, target: int) -> Column:
    """The longer side becomes the target; both sides are multiples of 16, at least 16."""
    ratio = width.cast("double") / height
    w = F.when(width >= height, F.lit(target)).otherwise(F.rint(target * ratio).cast("int"))
    h = F.when(width >= height, F.rint(target / ratio).cast("int")).otherwise(F.lit(target))
    side = lambda v: F.greatest(F.lit(16), to_multiple(v, 16))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def _half(v: Column) -> Column:
    return (v / 2).cast("int")


def crop_window(box: Column, width: Column, height: Column, expansion: float, target: int) -> Column:
    """Window around a detection, in its own aspect, and the size that it is resized to; null for a box of less than a pixel a side."""
    if expansion < 1:
        raise ValueError("the expansion must be at least 1")
    cx, cy = ((box["x1"] + box["x2"]) / 2).cast("int"), ((box["y1"] + box["y2"]) / 2).cast("int")
    w, h = (box["x2"] - box["x1"]).cast("int"), (box["y2"] - box["y1"]).cast("int")
    sw, sh = (w * expansion).cast("int"), (h * expansion).cast("int")
    cw = F.least(width, cx + _half(sw)) - F.greatest(F.lit(0), cx - _half(sw))
    ch = F.least(height, cy + _half(sh)) - F.greatest(F.lit(0), cy - _half(sh))
    aspect = F.try_divide(w.cast("double"), h)
    new_h = F.when(aspect < 1.0, F.try_divide(cw, aspect).cast("int")).otherwise(ch)
    new_w = F.when(aspect < 1.0, cw).otherwise((ch * aspect).cast("int"))
    x, y = F.greatest(F.lit(0), cx - _half(new_w)), F.greatest(F.lit(0), cy - _half(new_h))
    fw, fh = F.least(new_w, width - x), F.least(new_h, height - y)
    factor = F.least(F.try_divide(F.lit(float(target)), fw), F.try_divide(F.lit(float(target)), fh))
    return F.when((w > 0) & (h > 0) & (fw > 0) & (fh > 0), F.struct(x.alias("x"), y.alias("y"), fw.alias("w"), fh.alias("h"), (fw * factor).cast("int").alias("out_w"), (fh * factor).cast("int").alias("out_h")))


def manual_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Rectangle between two points, held within the image."""
    x, y = F.least(x1, x2), F.least(y1, y2)
    within = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return F.struct(within(x, width).alias("x"), within(y, height).alias("y"), within(F.abs(x1 - x2), width - x).alias("w"), within(F.abs(y1 - y2), height - y).alias("h"))


def tile_starts(size: Column, tile: int = 512, overlap: int = 126) -> Column:
    """Starts of the tiles along one side; the last one ends at the border."""
    step = tile - overlap
    n = F.when(size <= tile, 1).otherwise(F.ceil((size - tile) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i == n - 1) & (size > tile), size - tile).otherwise(i * step).cast("int"))


def tiles(width: Column, height: Column, tile: int = 512, overlap: int = 126) -> Column:
    """(row, col, x, y, w, h) of every tile."""
    xs, ys = tile_starts(width, tile, overlap), tile_starts(height, tile, overlap)
    return F.flatten(F.transform(ys, lambda y, r: F.transform(xs, lambda x, c: F.struct(
        r.alias("row"), c.alias("col"), x.alias("x"), y.alias("y"), F.least(F.lit(tile), width - x).alias("w"), F.least(F.lit(tile), height - y).alias("h")))))
