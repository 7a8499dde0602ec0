"""Inpainting of images of any size by tiles that are rows.

An image comes as strips: rows of (path, width, height, top, pixels, mask), pixels and mask being the bytes of some of its lines, 3
and 1 for each point.  Each strip is cut where tiles lie, so a tile's pieces meet in one task; tiles are dealt over all
tasks, one at a time in memory.  A painted tile gives each block of the result its share of a weighted sum, and the shares of a block, of
which there are at most nine, are added in the order of their tiles, as a whole image is blended.  What comes out are
blocks (path, x, y, width, height, pixels: 4 bytes a point).  No task holds more than a strip, a tile or a block.

Tiles without a mask pass through.  An image whose strips have no mask at all (null) is not blended: its strips are its result.
Points past the border mirror the image, as ``pixels.tile_pixels`` has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import pixels
from tagweave.operators.captions import once
from tagweave.plans.storage import tasks_for
from tagweave.sources import png

STRIP = "path string, width int, height int, top int, pixels binary, mask binary"
BLOCK = "path string, x int, y int, width int, height int, pixels binary"
_PIECE = "path string, width int, height int, tile_x int, tile_y int, top int, pixels binary, mask binary"
_SHARE = "path string, block_x int, block_y int, width int, height int, tile_x int, tile_y int, sums binary"


def starts(size: int, tile: int, overlap: int) -> list[int]:
    """Where tiles begin along one side; the last ends at the border."""
    n = 1 if size <= tile else -(-(size - tile) // (tile - overlap)) + 1
    return [size - tile if i == n - 1 and size > tile else i * (tile - overlap) for i in range(n)]


def strips(images: DataFrame, lines: int = 256) -> DataFrame:
    """Strips (``STRIP``) of PNG images (path, content, mask: a PNG or null), each read line by line; null for what is no plain 8-bit PNG."""

    def run(batches):
        for batch in batches:
            for path, content, mask in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "mask")), strict=True):
                masks = png.strips(mask, lines) if mask is not None else None
                for top, part, w, h in png.strips(content, lines):
                    hole = next(masks)[1][:, :, 0].tobytes() if masks is not None else None
                    yield pa.RecordBatch.from_pylist([{"path": path, "width": w, "height": h, "top": top, "pixels": part[:, :, :3].tobytes(), "mask": hole}], schema=_schema(STRIP))

    return images.select("path", "content", "mask").mapInArrow(run, STRIP)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _pieces(tile: int, overlap: int):
    """Parts of strips that lie in a tile."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for s in batch.to_pylist():
                w, h, top = s["width"], s["height"], s["top"]
                image = np.frombuffer(s["pixels"], np.uint8).reshape(-1, w, 3)
                hole = np.frombuffer(s["mask"], np.uint8).reshape(-1, w)
                rows = []
                for y in starts(h, tile, overlap):
                    a, b = max(y, top) - top, min(y + tile, top + len(image)) - top
                    if a < b:
                        for x in starts(w, tile, overlap):
                            rows.append({"path": s["path"], "width": w, "height": h, "tile_x": x, "tile_y": y, "top": top + a, "pixels": image[a:b, x : x + tile].tobytes(), "mask": hole[a:b, x : x + tile].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(_PIECE))

    return run


def _tiles(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]):
    """Rows of one key after another; a batch may end within a key."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in key):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _painted(name: str, factory: Callable, tile: int, overlap: int):
    """Pieces of a tile, in order, to its shares of the blocks that it lies in."""
    step = tile - overlap

    def run(batches):
        paint, weight = once(name, factory), pixels.feather(tile, overlap)
        for rows in _tiles(batches, ("path", "tile_x", "tile_y")):
            w, h, x, y = (rows[0][c] for c in ("width", "height", "tile_x", "tile_y"))
            wide = min(tile, w - x)
            image = np.concatenate([np.frombuffer(r["pixels"], np.uint8).reshape(-1, wide, 3) for r in rows])
            hole = np.concatenate([np.frombuffer(r["mask"], np.uint8).reshape(-1, wide) for r in rows])
            part, mask = pixels.tile_pair(image, hole, 0, 0, tile)
            done = paint(part, mask) if (mask > 0).any() else part
            high = len(image)
            sums = np.concatenate([done[:high, :wide, :3] * weight[:high, :wide, None], weight[:high, :wide, None]], axis=2)
            out = []
            for by in range(y // step, (y + high - 1) // step + 1):
                for bx in range(x // step, (x + wide - 1) // step + 1):
                    a, b, c, d = max(by * step, y) - y, min((by + 1) * step, y + high) - y, max(bx * step, x) - x, min((bx + 1) * step, x + wide) - x
                    out.append({"path": rows[0]["path"], "block_x": bx * step, "block_y": by * step, "width": w, "height": h, "tile_x": x, "tile_y": y, "sums": sums[a:b, c:d].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_schema(_SHARE))

    return run


def _added(tile: int, overlap: int):
    """Shares of a block, in the order of tiles, to its points."""
    step = tile - overlap

    def run(batches):
        for rows in _tiles(batches, ("path", "block_x", "block_y")):
            x, y, w, h = (rows[0][c] for c in ("block_x", "block_y", "width", "height"))
            high, wide = min(step, h - y), min(step, w - x)
            total = np.zeros((high, wide, 4))
            for r in rows:
                a, b = max(r["tile_y"], y) - y, min(r["tile_y"] + tile, y + high) - y
                c, d = max(r["tile_x"], x) - x, min(r["tile_x"] + tile, x + wide) - x
                total[a:b, c:d] += np.frombuffer(r["sums"], np.float64).reshape(b - a, d - c, 4)
            out, full = np.zeros((high, wide, 4), np.uint8), total[:, :, 3] > 0
            out[full, :3] = np.clip(total[full][:, :3] / total[full][:, 3:], 0, 255).astype(np.uint8)
            out[full, 3] = 255
            yield pa.RecordBatch.from_pylist([{"path": rows[0]["path"], "x": x, "y": y, "width": wide, "height": high, "pixels": out.tobytes()}], schema=_schema(BLOCK))

    return run


def inpainted(strips: DataFrame, name: str, factory: Callable, tile: int = 512, overlap: int = 126) -> DataFrame:
    """Blocks (``BLOCK``) of images whose masked tiles ``factory()(tile, mask)`` has painted; ``strips`` that have a mask are taken."""
    tasks = 8 * tasks_for(strips.sparkSession)
    pieces = strips.filter("mask IS NOT NULL").mapInArrow(_pieces(tile, overlap), _PIECE)
    dealt = pieces.repartition(tasks, "path", "tile_x", "tile_y").sortWithinPartitions("path", "tile_x", "tile_y", "top")
    shares = dealt.mapInArrow(_painted(name, factory, tile, overlap), _SHARE)
    dealt = shares.repartition(tasks, "path", "block_x", "block_y").sortWithinPartitions("path", "block_x", "block_y", "tile_y", "tile_x")
    return dealt.mapInArrow(_added(tile, overlap), BLOCK)


def whole(blocks: DataFrame, path: str, width: int, height: int) -> np.ndarray:
    """One small image on the driver, for looking at it."""
    out = np.zeros((height, width, 4), np.uint8)
    for r in blocks.filter(F.col("path") == path).toLocalIterator():
        out[r.y : r.y + r.height, r.x : r.x + r.width] = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 4)
    return out
