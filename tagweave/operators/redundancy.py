"""Redundancy removal by vocabulary: what is redundant with what is found once for each pair of distinct tags.

Every distinct tag is described once: its categories, and the tags that stand in it between word boundaries.  Those are found by an
inverted index.  A tag within another has all its words among the other's, so it is looked up by its rarest word only,
and what that gives is checked once by the exact test.  A tag without words can only stand between two words, so it is
looked up among the gaps of others; the empty tag stands in whatever has a word.  A tag holds few others, so
descriptions are small.  The fold over a text's tags then compares strings and tests no pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import tags
from tagweave.plans.storage import table

_FOLDED = "lower(upper({}))"  # equal for letters that match in any case


def _words(tag: str) -> str:
    return rf"transform(regexp_extract_all({tag}, '(?U)(\\w+)'), w -> {_FOLDED.format('w')})"


def _gaps(tag: str) -> str:
    return rf"transform(regexp_extract_all({tag}, '(?U)(?<=\\w)(\\W+)(?=\\w)'), g -> concat(chr(0), {_FOLDED.format('g')}))"


def contained(vocabulary: DataFrame) -> DataFrame:
    """(inner, outer) of distinct tags (tag): inner stands in outer between word boundaries, in any case.  The empty tag is left out."""
    tokens = vocabulary.select("tag", F.expr(f"explode(array_distinct(concat({_words('tag')}, {_gaps('tag')})))").alias("token"))
    sizes = tokens.groupBy("token").agg(F.count("*").alias("n"))
    keys = vocabulary.filter("tag != ''").select("tag", F.expr(f"explode(CASE WHEN size({_words('tag')}) > 0 THEN {_words('tag')} ELSE array(concat(chr(0), {_FOLDED.format('tag')})) END)").alias("token"))
    rarest = keys.join(sizes, "token").groupBy("tag").agg(F.min(F.struct("n", "token")).alias("x"))
    met = rarest.select(F.col("tag").alias("inner"), F.col("x.token").alias("token")).join(tokens.withColumnRenamed("tag", "outer"), "token")
    return met.filter(F.expr(tags.word_in_sql("inner", "outer"))).select("inner", "outer")


def described(vocabulary: DataFrame) -> DataFrame:
    """(tag, c, inner) of distinct tags: tests of its categories, and the tags that stand in it."""
    inner = contained(vocabulary).groupBy("outer").agg(F.collect_list("inner").alias("_inner"))
    with_empty = F.expr(f"IF(size({_words('tag')}) > 0, array(''), cast(array() AS array<string>))")
    rows = vocabulary.join(inner, vocabulary["tag"] == inner["outer"], "left")
    return rows.select("tag", F.expr(tags.category_sql("tag")).alias("c"), F.concat(F.coalesce("_inner", F.array().cast("array<string>")), with_empty).alias("inner"))


def redundancy_removed(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): tag texts after redundancy removal, as ``tags.redundancy_removed`` gives them; ``key`` names one row each.

    The texts are read twice, once for their distinct tags.  Null texts stay null.  A tag in a third of all rows meets its one description by a join that is split or broadcast."""
    parsed = texts.select(key, F.posexplode_outer(tags.parse(F.col(column))).alias("_pos", "tag"))
    vocabulary = table(parsed.select("tag").filter("tag IS NOT NULL").distinct(), "tags")
    facts = table(described(vocabulary), "tag-facts")
    rows = parsed.join(facts, "tag", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.col("tag").alias("t"), "c", "inner"))).alias("_x"))
    related = "transform(_x, x -> named_struct('t', x.t, 'c', x.c, 'r', transform(filter(_x, y -> array_contains(x.inner, y.t) OR array_contains(y.inner, x.t)), y -> y.t)))"
    kept = tags.join(F.expr(f"transform(array({related}), rows -> {tags.fold_sql('rows')})[0]"))
    return rows.select(key, F.when(F.col("_x")[0]["t"].isNotNull(), kept).alias(column))
