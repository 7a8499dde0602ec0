"""File actions, and model stages over files with stand-ins."""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagweave.functions import bpe, pixels
from tagweave.operators import models
from tagweave.plans.storage import table
from tagweave.sources import actions, files, png


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module


def image(seed, h=20, w=30, channels=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, channels)).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("2", "1", "b"):
        (src / f"{name}.png").write_bytes(png.encoded(image(len(name))))
    (src / "1.txt").write_text("one")
    (src / "1.caption").write_text("the first")
    (src / "b.txt").write_text("bee")
    (src / "keep.md").write_text("x")
    return src


def images(spark, folder):
    return files.list_files(spark, str(folder), "*.png").select("path", "dir", "stem", "ext", "content")


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def test_png_round_trip():
    for channels in (1, 3, 4):
        x = image(channels, 7, 5, channels)
        got = png.decoded(png.encoded(x))
        assert (got[:, :, : max(channels, 1)] == (x if channels > 1 else x)).all() if channels > 1 else (got == x).all()
    assert png.decoded(b"no") is None and png.decoded(None) is None and png.decoded(png.SIGNATURE) is None


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    x = image(9, 6, 5).reshape(6, -1).astype(int)
    rows = []
    for y in range(6):
        up = x[y - 1] if y else np.zeros(15, int)
        left, corner = np.concatenate([[0] * 3, x[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        paeth = [min((a, b, c), key=lambda n, p=a + b - c: abs(p - n)) for a, b, c in zip(left, up, corner, strict=True)]
        guess = (0, left, up, (left + up) // 2, np.array(paeth))[kind]
        rows.append(bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes())
    data = png.encoded(x.reshape(6, 5, 3))
    plain = zlib.compress(b"".join(rows))
    at = data.index(b"IDAT") - 4
    old = int.from_bytes(data[at : at + 4], "big")
    data = data[:at] + len(plain).to_bytes(4, "big") + b"IDAT" + plain + b"\0\0\0\0" + data[at + 12 + old :]
    assert (png.decoded(data) == x.reshape(6, 5, 3)).all()


def test_copies_moves_and_deletes(spark, folder, tmp_path):
    out = tmp_path / "out"
    found = images(spark, folder)
    some = found.filter("stem IN ('1', 'b')")
    assert sorted(r.outcome for r in actions.copied(some, f"file://{out}").collect()) == ["done"] * 5 + ["missing"]
    assert names(out) == ["1.caption", "1.png", "1.txt", "b.png", "b.txt"]
    assert sorted(r.outcome for r in actions.copied(some, f"file://{out}").collect()) == ["missing"] + ["present"] * 5
    assert {r.outcome for r in actions.backed_up(found, str(tmp_path / "saved")).collect()} == {"done"} and names(tmp_path / "saved") == ["1.png", "2.png", "b.png"]
    bucket = F.when(F.col("stem") == "2", "selected").when(F.col("stem") == "1", "discarded")
    actions.sorted_by(found, bucket, {"selected": str(tmp_path / "s"), "discarded": str(tmp_path / "d")}, table).collect()
    assert names(tmp_path / "s") == ["2.png"] and names(tmp_path / "d") == ["1.caption", "1.png", "1.txt"] and names(folder) == ["b.png", "b.txt", "keep.md"]
    assert sorted(r.outcome for r in actions.removed(images(spark, folder), table).collect()) == ["done", "done", "missing"]
    assert names(folder) == ["keep.md"]


def test_resizing_cropping_upscaling(spark, folder):
    found = images(spark, folder)
    for sampler in models.SAMPLERS:
        made = {png.decoded(r.content).shape for r in models.resized_files(found, 64, sampler).collect()}
        assert len(made) == 1 and max(made.pop()) == 64
    with pytest.raises(ValueError):
        models.resized_files(found, 64, "none")
    box = F.struct(F.lit(5).alias("x"), F.lit(4).alias("y"), F.lit(100).alias("w"), F.lit(3).alias("h"))
    cut = models.cropped_files(found, F.when(F.col("stem") == "1", box)).collect()
    got = {r.path.rsplit("/", 1)[1]: png.decoded(r.content) for r in cut}
    assert (got["1.png"] == image(1)[4:7, 5:]).all() and (got["2.png"] == image(1)).all()
    double = lambda: lambda x: x.repeat(2, axis=2).repeat(2, axis=3)
    up = models.upscaled_files(found, "double", double).collect()
    assert all((png.decoded(r.content) == image(1).repeat(2, 0).repeat(2, 1)).all() for r in up)
    broken = spark.createDataFrame([("x", bytearray(b"no"))], "path string, content binary")
    assert models.upscaled_files(broken, "double", double).first().content is None


def test_segmenting_and_inpainting(spark):
    x = image(3, 40, 50)
    mask = np.zeros((40, 50), np.uint8)
    mask[10:20, 10:20] = 255
    rows = [("a", png.encoded(x), png.encoded(mask), [[1.0, 2.0, 3.0, 4.0]]), ("b", png.encoded(x), None, None)]
    df = spark.createDataFrame([(p, bytearray(c), m and bytearray(m), b) for p, c, m, b in rows], "path string, content binary, mask binary, boxes array<array<double>>")
    black = lambda: lambda part, hole: np.where(hole[:, :, None] > 0, 0, part)
    got = {r.path: png.decoded(r.content) for r in models.inpainted_files(df, "mask", "black", black).collect()}
    assert (got["a"][11:19, 11:19, :3] == 0).all() and (got["a"][25:, 25:45, :3].astype(int) - x[25:, 25:45] <= 1)[:-2].all() and (got["b"] == x).all()
    found = {r.path: r.content for r in models.segmented_files(df, "boxes", lambda t: t, lambda f, b: (np.full((1, 256, 256), 9.0), np.array([1.0]))).collect()}
    assert png.decoded(found["a"]).shape == (40, 50, 3) and (png.decoded(found["a"]) == 255).all() and found["b"] is None


class Reader:
    """Stands in for a captioning model: spells a fixed answer and ends."""

    def __init__(self, words, text):
        self.ids, self.size = words.ids(text) + [2], max(words.names) + 1

    def start(self, tensor, ids):
        assert tensor.shape == (1, 3, 768, 768) and ids
        return lambda so_far: np.eye(self.size)[self.ids[len(so_far) - 1]]


def encoder():
    letters = list(bpe.byte_letters().values())
    special = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3} | {f"<loc_{i}>": 300 + i for i in range(1000)}
    return bpe.Encoder({n: i + 4 for i, n in enumerate(letters)}, [], special)


def test_vision_tasks(spark):
    df = spark.createDataFrame([("a", bytearray(png.encoded(image(1, 100, 200)))), ("b", bytearray(b"no"))], "path string, content binary")
    got = {r.path: r for r in models.vision(df, "Caption", encoder, "v1", lambda: Reader(encoder(), "a red cat ")).collect()}
    assert got["a"].answer == "a red cat" and got["a"].parsed.text == "a red cat" and got["b"].answer is None
    located = models.vision(df, "Detection" if any(t[0] == "Detection" for t in models.loctokens.TASKS) else "ObjectDetection", encoder, "v2", lambda: Reader(encoder(), "cat"))
    assert {r.path: r.answer for r in located.collect()}["a"] == "cat"


def test_registry():
    r = models.Registry()
    r.add("t", "tagger", {"model": "/m.onnx"}, classes=5)
    assert r.names("tagger") == ["t"] and r.of("t")["classes"] == 5 and not r.names("upscaler")
    with pytest.raises(KeyError):
        r.of("t", "upscaler")
    with pytest.raises(ValueError):
        r.add("t", "tagger", {})


def test_kernels_agree_with_the_plain_sum():
    x = image(4, 6, 9).astype(float)
    assert np.allclose(pixels.resized(x, 9, 6), x, atol=1e-9)
