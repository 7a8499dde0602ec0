from __future__ import annotations

import hashlib
import random

import zstandard

from tagweave.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "s") for i, u, h in rows], "page_id long, url string, html string, digest string, size string")


def table(tmp_path, spark, rows, p=warc.WarcParams()):
    to = f"file://{tmp_path}/a"
    index = warc.write(pages(spark, rows), to, p)
    return to, index, warc.read(index, to).collect()


def rows_of_all_kinds():
    rng = random.Random(1)
    big = "".join(chr(rng.randrange(97, 123)) for _ in range(1000))
    out = [(1, "http://a/", big), (2, None, big), (9, "http://b/ x\r\nEvil: 1", big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "ü", "é" * 500), (8, "ü", "é" * 500), (None, "n", "y" * 2000), (10, "t", "\r\n\r\nWARC/1.1\r\n\r\n")]
    return out + [(20 + i, "u", str(rng.random()) * rng.randint(1, 3000)) for i in range(60)] + [(9, "http://b/", big)]


def test_round_trip(spark, tmp_path):
    rows = rows_of_all_kinds()
    to, index, out = table(tmp_path, spark, rows, warc.WarcParams(frame_bytes=5000, archive_bytes=20000))
    data = {(i, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in rows}
    top = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    assert len(out) == len(rows)
    for r in out:
        payload = data[r.page_id, r.payload_digest]
        first = top.get(payload.decode())
        want = ("response", None) if first is None or first == r.page_id else ("revisit", first)
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(payload), *want)
    for r in index.collect():  # one record at a time, by the index
        reader = warc.BundleReader(f"{to}/{r.archive}")
        head, body = reader.record(r.frame, r.offset, r.length)
        assert warc._from_urn(head["WARC-Record-ID"]) == r.page_id
        if head["WARC-Type"] == "response":
            assert warc.http_parts(body)[1] in [(h or "").encode() for i, _, h in rows if i == r.page_id]


def test_frames_are_plain_zstandard(spark, tmp_path):
    to, index, _ = table(tmp_path, spark, rows_of_all_kinds()[:12])
    name = index.first().archive
    data = (tmp_path / "a" / name).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    reader = warc.BundleReader(f"{to}/{name}")
    assert whole == b"".join(reader.frame(k) for k in range(len(reader.frames)))


def test_no_pages(spark, tmp_path):
    assert table(tmp_path, spark, [])[2] == []
