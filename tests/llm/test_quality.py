from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tagweave.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    assert out[out.quality == 1].predicted.mean() > 0.97


def test_edges(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (11, 1, 0), (13, 0, 0), (13, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    assert len({r.s for r in out if r.doc_id in (4, 5)}) == 1  # null and empty texts alike
    assert quality.filter_good(docs, model).columns == docs.columns
    assert quality.filter_good(no_docs, model).count() == 0


def test_one_class_or_none(spark, docs, no_docs):
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.filter_good(docs, quality.fit(docs, one)).count() == docs.count()
    none = quality.fit(docs, one.limit(0))
    assert {round(r.s, 6) for r in docs.select(quality.score(F.col("text"), none).alias("s")).collect()} == {0.5}


def plain_features(text, good, bad, p):
    """Three features and a constant, by one plain compression of each block."""
    data, total = (text or "").encode(), [0, 0]
    if not data:
        return [0.0] * 4
    for k, dictionary in enumerate((good, bad)):
        c = zstandard.ZstdCompressor(level=p.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        total[k] = sum(len(c.compress(data[i : i + p.block_bytes])) for i in range(0, len(data), p.block_bytes))
    share = math.log(sum(total) / 2 / len(data))
    return [x * len(data) / (len(data) + p.half_bytes) for x in ((total[1] - total[0]) / sum(total), share, share**2, 1.0)]


def test_query_against_plain_steps(spark):
    """Sample, dictionaries, curve and scores of the whole query, each by a plain version."""
    sf, p = "/root/testdata/sf0.001", quality.QualityParams()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    known = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    picked = {q: sorted((i for i, k in known if k == q), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[: p.rows_per_class] for q in (0, 1)}
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), train=~quality.held_out())
    ordered = {q: [texts[i] or "" for i in sorted(picked[q])] for q in (0, 1)}
    assert model.good == quality._dictionary(ordered[1], p) and model.bad == quality._dictionary(ordered[0], p)
    n = {q: sum(k == q for _, k in known) for q in (0, 1)}
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)
    assert math.isclose(model.prior, math.log(share / (1 - share)))
    # the fitted curve is where the weighted loss over both halves is flat
    gradient, count = np.zeros(4), sum(len(t) for t in ordered.values())
    halves = [{q: t[k::2] for q, t in ordered.items()} for k in (0, 1)]
    rows = []
    for own, other in (halves, halves[::-1]):
        dictionaries = quality._dictionary(other[1], p), quality._dictionary(other[0], p)
        rows += [(np.array(plain_features(t, *dictionaries, p)), q) for q in (0, 1) for t in own[q]]
    scale = np.array([x for x, _ in rows]).std(axis=0) + 1e-9
    for x, q in rows:
        weight = (share if q else 1 - share) / len(ordered[q]) * count
        gradient += weight * (1 / (1 + math.exp(-(x @ model.weights + model.prior))) - q) * x / scale
    assert np.abs(gradient + 1e-2 * np.array(model.weights) * scale).max() < 1e-5
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = 1 / (1 + math.exp(-(np.dot(plain_features(text, model.good, model.bad, p), model.weights) + model.prior)))
        assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].predicted == (want >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_sample_is_bounded_by_bytes(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)] + [(11, 1, 0)], "doc_id long, quality int, toxic int")
    size = lambda n: [(r[0], len((r[1] or "").encode())) for r in quality.sample(docs, labels, quality.QualityParams(class_bytes=n), F.lit(True)).select("_quality", "_text").collect()]
    assert len(size(1 << 30)) == 41
    some = size(2000)
    assert len(some) >= 2 and all(sum(s for q, s in some if q == k) <= max(2000, max(s for q, s in some if q == k)) for k in (0, 1))
