from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tagweave.sources import files, sink


def png(w, h, text=b"Comment\0p, Negative prompt: n, Steps: 1"):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"tEXt", text)


def test_folder(spark, tmp_path):
    (tmp_path / "2.png").write_bytes(png(20, 30))
    (tmp_path / "10.PNG").write_bytes(png(5, 6))
    (tmp_path / "x_mask.png").write_bytes(b"broken")
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / "2.txt").write_text("a, b")
    (tmp_path / "2.caption").write_text("a caption")
    (tmp_path / "labels.csv").write_text("red_hair\nsmile\n")
    images = files.list_images(spark, str(tmp_path)).cache()
    assert {r.stem + r.ext for r in images.collect()} == {"2.png", "10.PNG", "x_mask.png", "noext"}
    sized = images.select("stem", files.image_size(F.col("content")).alias("s")).collect()
    assert {r.stem: r.s and (r.s.width, r.s.height) for r in sized}["2"] == (20, 30)
    joined = files.with_side_texts(images, files.texts(spark, str(tmp_path), ".txt"), files.texts(spark, str(tmp_path), ".caption"))
    assert {r.stem: (r.txt, r.caption) for r in joined.collect()} == {"2": ("a, b", "a caption"), "10": (None, None), "x_mask": (None, None), "noext": (None, None)}
    assert [r.stem for r in files.without_masks(images).orderBy(files.numeric_key(F.col("stem")), "ordinal").collect()] == ["2", "10", "noext"]
    assert [tuple(r) for r in files.labels(spark, str(tmp_path / "labels.csv")).collect()] == [(0, "red hair"), (1, "smile")]
    assert files.png_text(png(1, 1)) == "p, Negative prompt: n, Steps: 1"
    out = f"file://{tmp_path}/out"
    n = sink.write_files(joined.select(F.concat("stem", F.lit(".txt")).alias("name"), F.coalesce("txt", F.lit("none")).alias("content")), out)
    assert n == 4 and (tmp_path / "out" / "2.txt").read_text() == "a, b" and (tmp_path / "out" / "10.txt").read_text() == "none"


def test_sets(spark):
    df = spark.createDataFrame([(f"/d/{i}", "/d/", str(i)) for i in range(450)], "path string, dir string, stem string")
    order = [files.numeric_key(F.col("stem"))]
    assert [r.stem for r in files.page(df, order, 2).collect()] == [str(i) for i in range(400, 450)]
    assert files.page(df, order, 9).first().stem == "0"
    assert files.pending(df, df.limit(100)).count() == 350 and files.deleted(df, ["/d/1"]).count() == 449
    assert {r.new_stem for r in files.renumbered(df, order, 7).filter("stem = '0'").collect()} == {"7"}
    with pytest.raises(ValueError):
        files.deleted(df, [])
    assert spark.range(1).select(files.size_bucket(F.lit(511), F.lit(512))).first()[0] == "selected"


def test_header_of_jpeg_gif_webp():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01" + b"\0" * 10
    assert files.header_size(jpeg) == (32, 16) and files.header_size(b"GIF89a\x05\0\x06\0") == (5, 6)
    assert files.header_size(b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")) == (10, 5)
    assert files.header_size(b"nothing") is None and files.header_size(None) is None
