"""Derived inputs of the queries, in Spark and in SQL: tag texts, image sizes, boxes, token strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.plans.storage import tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_tags(spark: SparkSession, d: str) -> DataFrame:
    """(k, tags): a tag text per order, from its parts' names."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = read(spark, d, "part").select("p_partkey", "p_name")
    tag = F.when(F.col("l_partkey") % 2 == 0, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), 2))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "p_name", tag.alias("tag")).alias("x"))
    # dealt once, by the grouping key, into a fixed number of tasks: what follows is heavy on small rows
    dealt = rows.repartition(tasks_for(spark), "l_orderkey")
    return dealt.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tag"]), ", ").alias("tags"))


ORDER_TAGS = """ot AS (SELECT l_orderkey AS k, string_agg(CASE WHEN l_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) END, ', ' ORDER BY l_linenumber, l_partkey, p_name) AS tags
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
pt AS (SELECT k, tags, string_split(replace(replace(tags, ', ', ','), '  ', ' '), ',') AS t FROM ot)"""


def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(id, w, h)."""
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (256 + F.col("p_size") * 37).alias("w"), (256 + (F.col("p_partkey") * 53) % 1900).cast("int").alias("h"))


IMAGE_SIZES = "im AS (SELECT p_partkey AS id, 256 + p_size * 37 AS w, (256 + (p_partkey * 53) % 1900)::INTEGER AS h FROM part)"


def order_boxes(spark: SparkSession, d: str) -> DataFrame:
    """(k, boxes): detections per order, best score first."""
    line = read(spark, d, "lineitem")
    x1, y1 = F.col("l_quantity"), F.col("l_linenumber") * 5.0
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 20 + 10 * F.col("l_tax")).alias("x2"), (y1 + 30).alias("y2"), F.col("l_discount").alias("score"))
    rows = line.select(F.col("l_orderkey").alias("k"), F.struct((-F.col("l_discount")).alias("minus"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), x1.alias("q"), F.col("l_tax").alias("t"), box.alias("box")).alias("x"))
    return rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["box"]).alias("boxes"))


ORDER_BOXES = """bx AS (SELECT l_orderkey AS k, l_quantity AS x1, l_linenumber * 5.0::DOUBLE AS y1, l_quantity + 20 + 10 * l_tax AS x2, l_linenumber * 5.0::DOUBLE + 30 AS y2, l_discount AS score,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_quantity, l_tax) AS rn FROM lineitem)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, dir, stem, ext, ordinal): a made-up folder listing from documents."""
    docs = read(spark, d, "documents")
    exts = F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".tx", "", ".webp", ".md")])
    ext = F.element_at(exts, (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("img"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    stem = F.when(F.col("doc_id") % 7 == 0, F.concat(name, F.lit("_mask"))).otherwise(name)
    return docs.select(F.concat(F.lit("/data/"), stem, ext).alias("path"), F.lit("/data/").alias("dir"), stem.alias("stem"), ext.alias("ext"), F.col("doc_id").alias("ordinal"))


FILES = """fl AS (SELECT '/data/' || s || e AS path, s AS stem, e AS ext, doc_id AS ordinal FROM (SELECT doc_id, (CASE WHEN doc_id % 11 = 0 THEN 'img' ELSE '' END) || doc_id || (CASE WHEN doc_id % 7 = 0 THEN '_mask' ELSE '' END) AS s,
(['.jpg', '.PNG', '.tx', '', '.webp', '.md'])[(doc_id % 6 + 1)::INTEGER] AS e FROM documents))"""


def token_text(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): labels with location tokens."""
    n = F.col("p_partkey")
    loc = lambda *cs: F.concat(*[F.concat(F.lit("<loc_"), (c % 1000).cast("string"), F.lit(">")) for c in cs])
    return read(spark, d, "part").select(n.alias("id"), F.concat(F.col("p_name"), loc(n, n * 3, n * 5, n * 7), F.when(n % 3 == 0, loc(n * 11, n * 13, n * 17, n * 19)).otherwise(""), F.element_at(F.split("p_name", " "), 1), loc(n * 2, n * 4, n * 6, n * 8)).alias("text"))


TOKEN_TEXT = """tt AS (SELECT p_partkey AS id, p_name || '<loc_' || p_partkey % 1000 || '><loc_' || p_partkey * 3 % 1000 || '><loc_' || p_partkey * 5 % 1000 || '><loc_' || p_partkey * 7 % 1000 || '>' ||
CASE WHEN p_partkey % 3 = 0 THEN '<loc_' || p_partkey * 11 % 1000 || '><loc_' || p_partkey * 13 % 1000 || '><loc_' || p_partkey * 17 % 1000 || '><loc_' || p_partkey * 19 % 1000 || '>' ELSE '' END ||
split_part(p_name, ' ', 1) || '<loc_' || p_partkey * 2 % 1000 || '><loc_' || p_partkey * 4 % 1000 || '><loc_' || p_partkey * 6 % 1000 || '><loc_' || p_partkey * 8 % 1000 || '>' AS text FROM part)"""


def prompt_raw(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, role, raw): generation records from conversations."""
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.concat("text", F.lit(", Negative prompt: "), "role", F.lit(", Steps: 20, Seed: "), F.col("conv_id").cast("string"), F.lit(", Size: 5")).alias("raw"))


PROMPT_RAW = "pr AS (SELECT conv_id, turn, role, text || ', Negative prompt: ' || role || ', Steps: 20, Seed: ' || conv_id || ', Size: 5' AS raw FROM conversations)"
