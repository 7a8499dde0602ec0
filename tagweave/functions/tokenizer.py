"""Token counts with a public tokenizer file, whose path is a parameter."""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Ids of the start and end marks of the caption tokenizer, and the limit of its text encoder.
START, END, LIMIT = 49406, 49407, 75


@lru_cache(4)
def _loaded(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def caption_tokens(spark: SparkSession, text: Column, path: str) -> Column:
    """Number of tokens of a caption, without one start and one end mark; 0 for empty and null texts.

    The file is sent to the executors once; it need not lie on them."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        found = _loaded(SparkFiles.get(name)).encode_batch(values.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e.ids) - (START in e.ids) - (END in e.ids) for e in found], dtype="int32")

    return count(text)
