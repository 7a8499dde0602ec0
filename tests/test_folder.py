"""The image folder as a data source, and headers of all formats."""

from __future__ import annotations

import random
import struct

import pytest

from tagweave.sources import folder, headers
from tests.test_files import png


def box(kind, data, large=False):
    return struct.pack(">I4sQ", 1, kind, 16 + len(data)) + data if large else struct.pack(">I4s", 8 + len(data), kind) + data


def heif(w, h, brand=b"avif", wide=False, version=0, before=b"", large=False, item=7):
    """A primary item with its extent among those of a thumbnail and other properties."""
    ispe = lambda a, b: box(b"ispe", struct.pack(">III", 0, a, b))
    ipco = box(b"ipco", ispe(160, 120) + box(b"pixi", b"\0\0\0\0\x03\x08\x08\x08") + ispe(w, h) + box(b"irot", b"\1"), large)
    ids = ">H" if version < 1 else ">I"
    kinds = "H" if wide else "B"
    entry = lambda i, *ns: struct.pack(ids, i) + struct.pack(f">B{len(ns)}{kinds}", len(ns), *ns)
    essential = 0x8000 if wide else 0x80
    ipma = box(b"ipma", struct.pack(">BBHI", version, 0, int(wide), 2) + entry(3, 1) + entry(item, 2 | essential, 3, 4))
    pitm = box(b"pitm", struct.pack(">IH", 0, item) if version < 1 else struct.pack(">BBHI", 1, 0, 0, item))
    meta = box(b"meta", b"\0\0\0\0" + box(b"hdlr", b"\0" * 24) + box(b"iprp", ipco + ipma) + pitm)
    return box(b"ftyp", b"isom\0\0\0\0" + brand + b"miaf" if brand != b"avif" else b"avif\0\0\0\0mif1") + before + meta


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\0" * 20


def size(data):
    return headers.size(headers.cached(lambda at, n: data[at : at + n], 64))


def test_sizes():
    exif = b"\xff\xe1" + struct.pack(">H", 65535) + b"\xff" * 65533
    assert size(png(20, 30)) == (20, 30) and size(b"GIF89a\x05\0\x06\0") == (5, 6)
    assert size(jpeg(640, 480)) == (640, 480) and size(jpeg(640, 480, exif * 3)) == (640, 480) and size(b"\xff\xd8\xff\xda\0\x02") is None
    assert size(b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 7, -9)) == (7, 9) and size(b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 7, 9)) == (7, 9)
    assert size(b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 33, 44)) == (33, 44)
    assert size(b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + struct.pack("<I", 9 | 4 << 14)) == (10, 5)
    assert size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")) == (10, 5)


@pytest.mark.parametrize("brand", [b"avif", b"heic", b"mif1"])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("version", [0, 1])
def test_box_trees(brand, wide, version):
    assert size(heif(4032, 3024, brand, wide, version)) == (4032, 3024)
    assert size(heif(5, 6, brand, wide, version, before=box(b"mdat", b"x" * 5000), large=True)) == (5, 6)


def test_broken_headers():
    rng = random.Random(2)
    whole = [png(1, 2), jpeg(3, 4), heif(5, 6), heif(5, 6, b"heic", True, 1, large=True), b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 14]
    for data in whole:
        for k in range(0, len(data), 3):
            size(data[:k])
        for _ in range(300):
            bad = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            size(bytes(bad))
    assert size(b"") is None and size(b"nothing at all") is None and size(box(b"ftyp", b"isom\0\0\0\0mp41")) is None


@pytest.fixture
def images(tmp_path):
    (tmp_path / "2.png").write_bytes(png(20, 30))
    (tmp_path / "10.PNG").write_bytes(png(5, 6))
    (tmp_path / "a b#.avif").write_bytes(heif(64, 32))
    (tmp_path / "c.heif").write_bytes(heif(7, 8, b"heic"))
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / "e.jpg").write_bytes(b"")
    (tmp_path / "2.txt").write_text("a, b")
    (tmp_path / "2.caption").write_text("")
    (tmp_path / "noext.txt").write_text("﻿marked", encoding="utf-8")
    (tmp_path / "sample_prompt_custom.txt").write_text("hidden")
    (tmp_path / ".hidden.png").write_bytes(png(1, 1))
    (tmp_path / "below.png").mkdir()
    return tmp_path


def test_columns(spark, images):
    folder.register(spark)
    rows = {r.stem + r.ext: r for r in spark.read.format("imagefolder").load(str(images)).collect()}
    assert {n: (r.width, r.height, r.txt, r.caption) for n, r in rows.items()} == {
        "2.png": (20, 30, "a, b", ""), "10.PNG": (5, 6, None, None), "a b#.avif": (64, 32, None, None), "c.heif": (7, 8, None, None), "noext": (None, None, "marked", None), "e.jpg": (None, None, None, None),
    }
    assert rows["2.png"].path == f"file:{images}/2.png" and rows["2.png"].dir == f"file:{images}/" and rows["e.jpg"].length == 0
    texts = spark.read.format("imagefolder").option("pattern", "*.txt").load(f"file://{images}").collect()
    assert sorted(r.stem for r in texts) == ["2", "noext", "noext"]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("imagefolder").schema("path string, pixels string").load(str(images)).collect()


def test_tasks_and_filters(spark, images):
    folder.register(spark)
    read = spark.read.format("imagefolder").option("filesPerTask", "2").load(str(images))
    assert read.rdd.getNumPartitions() == 3
    assert {r.stem for r in read.filter("ext = '.png'").collect()} == {"2"} and {r.stem for r in read.filter("ext IN ('.heif', '.avif') AND width > 10").collect()} == {"a b#"}
    assert read.count() == 6  # a filter on a frame does not stay for its next query
    some = spark.read.format("imagefolder").option("exts", '[".heif", ".avif", ".PNG"]')
    assert {r.stem for r in some.load(str(images)).collect()} == {"a b#", "c", "10"} and {r.stem for r in some.option("stems", '["c", "2"]').load(str(images)).collect()} == {"c"}
    reader = folder.FolderReader({"path": str(images), "exts": '[".heif"]'}, spark.createDataFrame([], "path string").schema)
    assert [n for p in reader.partitions() for n, *_ in p.files] == ["c.heif"]  # the listing is filtered, not the rows
    assert spark.read.format("imagefolder").load(str(images / "below.png")).count() == 0


def test_no_body_is_read(spark, tmp_path):
    """Sparse files of a terabyte: only ranges of their headers can have been read."""
    folder.register(spark)
    for k, data in enumerate((png(640, 480), heif(64, 32), jpeg(3, 4, b"\xff\xe1" + struct.pack(">H", 65535) + b"\xff" * 65533))):
        with (tmp_path / f"{k}.png").open("wb") as f:
            f.write(data)
            f.truncate(1 << 40)
    late = heif(9, 8, before=box(b"free", b""))
    with (tmp_path / "3.avif").open("wb") as f:  # the boxes of the header come after the image
        f.write(late[: late.index(b"free") - 4] + struct.pack(">I4sQ", 1, b"mdat", 1 << 39))
        f.seek(late.index(b"free") - 4 + (1 << 39))
        f.write(late[late.index(b"free") + 4 :])
    rows = spark.read.format("imagefolder").schema("stem string, length long, width int, height int").load(str(tmp_path)).collect()
    assert {r.stem: (r.width, r.height) for r in rows} == {"0": (640, 480), "1": (64, 32), "2": (3, 4), "3": (9, 8)} and min(r.length for r in rows) > 1 << 38
