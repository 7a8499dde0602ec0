"""Scores of taggers: sigmoid, threshold and rank, weighted captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Single precision, as the taggers' outputs."""
    return (1.0 / (1.0 + F.exp(-x.cast("double")).cast("float"))).cast("float")


def ranked(scores: Column, labels: Column, threshold: float = 0.2) -> Column:
    """(label, score) of the scores above the threshold (0 to 1), best first, ties by place; "_" in labels is a blank."""
    threshold = min(max(threshold, 0.0), 1.0)
    rows = F.zip_with(scores, labels, lambda s, n: F.struct(s.alias("score"), F.replace(n, F.lit("_"), F.lit(" ")).alias("label")))
    placed = F.transform(rows, lambda r, i: F.struct((-r["score"]).alias("minus"), i.alias("i"), r["label"].alias("label"), r["score"].alias("score")))
    kept = F.filter(placed, lambda r: r["score"] > F.lit(threshold).cast("float"))
    return F.transform(F.array_sort(kept), lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score")))


def label_list(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["label"])


def weighted(rows: Column) -> Column:
    """"(label:0.87)" with two decimals, halves rounded up."""
    return F.transform(rows, lambda r: F.format_string("(%s:%.2f)", r["label"], F.round(r["score"].cast("double"), 2)))
