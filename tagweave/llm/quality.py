"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts.  A text is
cut into blocks and every block is compressed with either dictionary.  The difference of the two
total sizes over their sum, beside the compressed size a byte (which tells endless repetition and
noise from prose), is turned into a probability by a logistic curve fitted to the same labelled rows.  The whole text counts.  A text of n bytes weighs its evidence by
n / (n + ``half_bytes``), so that a few bytes leave the share of good labels standing; empty and
null texts score that share.

Learning uses a bounded sample: at most ``rows_per_class`` labelled rows of each class, those of
the smallest md5 of their id, as long as their whole texts together hold at most ``class_bytes`` (the first is taken in any
case), so the sample is the same wherever it is drawn.  The curve is fitted on two halves of it, each compressed with
the dictionaries of the other half, so that no text is weighed by its own words.  Everything
else covers all rows.  Without rows of both classes the score is the share of good rows (0.5 when
there are none).  Repeated label rows count as often as they occur; null labels are passed over.  Very long texts are
scored whole, block by block; rows that share a doc_id are scored each for itself, equal texts alike; an empty table
gives an empty result; columns that are neither doc_id nor text are kept by the filter and not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class QualityParams:
    rows_per_class: int = 2000
    class_bytes: int = 16 << 20
    dictionary_bytes: int = 96 << 10
    block_bytes: int = 2048
    level: int = 3
    half_bytes: int = 100


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    params: QualityParams


class _Sizes:
    """Compressed sizes under one dictionary."""

    def __init__(self, dictionary: bytes, level: int):
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=level)
        self.run = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def of(self, blocks: list[bytes]) -> int:
        return sum(len(self.run(b)) for b in blocks)


def _blocks(text: str | None, size: int) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i : i + size] for i in range(0, len(data), size)]


def features(texts, model: QualityModel) -> np.ndarray:
    """For each text: the normalised difference, the log of its compressed share and that squared, and 1,
    all times the weight of its length."""
    good, bad = _Sizes(model.good, model.params.level), _Sizes(model.bad, model.params.level)
    out = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        if blocks := _blocks(text, model.params.block_bytes):
            a, b, n = good.of(blocks), bad.of(blocks), sum(map(len, blocks))
            share = np.log((a + b) / (2 * n))
            out[i] = np.array([(b - a) / (a + b), share, share * share, 1.0]) * (n / (n + model.params.half_bytes))
    return out


def _dictionary(texts: list[str], p: QualityParams) -> bytes:
    blocks = [b for t in texts for b in _blocks(t, p.block_bytes)]
    try:
        return zstandard.train_dictionary(p.dictionary_bytes, blocks, level=p.level).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: their bytes are the dictionary
        return b"".join(blocks)[-p.dictionary_bytes :] or b" " * 8


def _calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, ...]:
    """Logistic regression of y on x beside a fixed prior, by Newton's method.

    Each class weighs as its share of all labels says; a light ridge keeps it finite."""
    share = 1 / (1 + np.exp(-prior))
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    scale = x.std(axis=0) + 1e-9
    a, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w + prior, -35, 35)))
        g = a.T @ (weight * (p - y)) + 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def sample(docs: DataFrame, labels: DataFrame, p: QualityParams, train: Column) -> DataFrame:
    """The bounded sample of labelled texts: (quality, text)."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).filter(train)
    key = F.md5(F.col("_id").cast("string"))
    picked = None
    for q in (0, 1):
        part = known.filter(F.col("_quality") == q).orderBy(key, "_id").limit(p.rows_per_class)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    # at most 2 * rows_per_class narrow rows are broadcast
    joined = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_doc", "_quality", "_text")
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    sizes = joined.groupBy("_doc", "_quality").agg(F.sum(size).alias("n")).select("_doc", "_quality", "n", F.md5(F.col("_doc").cast("string")).alias("key")).collect()
    keep, held = [], {0: 0, 1: 0}
    for doc, q, n, _ in sorted(sizes, key=lambda r: (r[3], r[0], r[1])):
        if not held[q] or held[q] + n <= p.class_bytes:
            held[q] += max(n, 1)
            keep.append((doc, q))
    if len(keep) == len(sizes):
        return joined
    kept = docs.sparkSession.createDataFrame(keep, "_doc long, _quality int")
    return joined.join(F.broadcast(kept), ["_doc", "_quality"], "left_semi").select("_doc", "_quality", "_text")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, params: QualityParams = QualityParams()) -> QualityModel:
    """Learn from the labelled rows for which ``train`` (a condition on ``_id``) holds."""
    train = F.lit(True) if train is None else train
    rows = sorted(map(tuple, sample(docs, labels, params, train).collect()), key=lambda r: (r[0], r[1], r[2] or ""))
    n = dict(map(tuple, labels.select(F.col("doc_id").alias("_id"), "quality").filter(train & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()))
    share = (n.get(1, 0) + 0.5) / (n.get(1, 0) + n.get(0, 0) + 1)
    prior = float(np.log(share / (1 - share)))
    texts = {q: [t or "" for _, k, t in rows if k == q] for q in (0, 1)}
    if not any(texts[0]) or not any(texts[1]):
        return QualityModel(b" " * 8, b" " * 8, (0.0, 0.0, 0.0, 0.0), prior, params)
    halves = [{q: t[k::2] for q, t in texts.items()} for k in (0, 1)]
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        if not any(other[0]) or not any(other[1]):
            other = texts
        model = QualityModel(_dictionary(other[1], params), _dictionary(other[0], params), (0.0,) * 4, prior, params)
        for q in (0, 1):
            x.append(features(own[q], model))
            y += [float(q)] * len(own[q])
    return QualityModel(_dictionary(texts[1], params), _dictionary(texts[0], params), _calibrated(np.concatenate(x), np.array(y), prior), prior, params)


def score(text: Column, model: QualityModel) -> Column:
    """Calibrated probability (0 to 1) that a text is good."""

    @F.pandas_udf(T.DoubleType())
    def probability(values: pd.Series) -> pd.Series:
        z = features(values.tolist(), model) @ np.array(model.weights) + model.prior
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return probability(text)


def held_out() -> Column:
    """Whether crc32 of the id as text leaves a remainder of 1 by 3."""
    return F.coalesce(F.crc32(F.col("_id").cast("string")) % 3 == 1, F.lit(False))


def filter_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """Rows of at least that score, with the columns that they had."""
    return docs.filter(score(F.col("text"), model) >= least)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, train=~held_out())
    scored = docs.select(F.col("doc_id").alias("_id"), score(F.col("text"), model).alias("score"))
    return scored.select(F.col("_id").alias("doc_id"), held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
