"""Corpus pipeline: quality filter, near-duplicate removal, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
reread as the next one's ``docs``.  All but the last keep the columns of ``documents``, further ones too, whatever their names.
Empty tables pass through all stages; rows that share a doc_id, equal ones too, are treated as each operator's docstring says.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import mixing, neardup, packing, quality, substrings
from tagweave.plans.storage import drop, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted to the labels, does not reject.

    Null and empty texts score the share of good labels; whole texts count, however long."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8): that of the least id.

    Null and empty texts, and null ids, are linked with nothing and stay."""
    return neardup.deduplicated(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the words of passages that occur earlier; n_chars follows the new text.

    Null texts become empty; a text that loses all its words stays as an empty one."""
    out = substrings.without_repeats(docs, counts=(f"_words_{uuid4().hex}", f"_removed_{uuid4().hex}"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of domains, languages and sources, each as often as it was drawn.

    Null labels count as the label ''; documents without words cost nothing and go by their place in the epoch."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of several permitted lengths; null and wordless texts give none."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("neardup", one_of_each),
    ("substrings", without_passages),
    ("mixing", mixed),
    ("packing", packed),
]

# The classifier and the packing cannot be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            drop(docs)  # its consumer has been written
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
