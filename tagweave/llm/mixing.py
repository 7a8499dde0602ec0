"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source).  A token budget flows down the tree by integer weights.  A
child never gets more than its capacity (the tokens below it times ``epochs``); what it cannot
take goes to its siblings by their weights, and only what a whole family cannot take is missed by
the parent, which settled its own share with its siblings on the same capacities.  Each leaf
then takes documents from seeded epochs: complete passes first, then the longest prefix of the
next epoch's order that fits, where an epoch orders documents by md5(seed:epoch:doc_id).

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  Null domain, lang or source count as the label ''.
Documents without words take part with 0 tokens.  Rows of one leaf that share a doc_id are chosen
together; equal rows are taken alike.  Budgets are whole tokens, rounded down at each node.  Weights that are not named are
``default_weight``.  A node of weight 0 gets nothing, and what lies below it adds to no ancestor's capacity, so its
share goes to others; without any positive weight nothing is chosen.  Very long texts count with all their tokens; an
empty table gives an empty result; further columns of ``docs``, whatever their names, are neither read nor lost.

Only built-in functions are used.  The table of leaves is small beside the rows; the hot leaf is
never sorted whole: its prefix is found over 4096 slices of the order first, then inside one slice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.plans.storage import table

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixParams:
    seed: int = 7
    epochs: int = 2
    share_num: int = 9  # the budget is this share of all tokens
    share_den: int = 10
    default_weight: int = 1
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {
        "domain": {"web": 5, "books": 3, "code": 2},
        "lang": {"en": 6, "de": 2, "fr": 1, "es": 1},
        "source": {"src0": 4, "src1": 2},
    })


def domain_of(source: Column) -> Column:
    """Domain of a source by its number: 0-9 web, 10-14 books, the rest code; others web."""
    n = F.expr("try_cast(substr(_source, 4) AS INT)")
    return F.when(source.startswith("src") & n.between(10, 14), "books").when(source.startswith("src") & (n >= 15), "code").otherwise("web")


def _weight(level: str, p: MixParams) -> Column:
    out = None
    for name, w in p.weights.get(level, {}).items():
        cond = F.col(level) == name
        out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return (F.lit(p.default_weight) if out is None else out.otherwise(p.default_weight)).cast("long")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def labelled(docs: DataFrame) -> DataFrame:
    """(_id, domain, lang, source, n_tokens) of every row."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("lang"), tokens(F.col("text")).alias("n_tokens"))
    return rows.select("_id", domain_of(F.col("_source")).alias("domain"), "lang", F.col("_source").alias("source"), "n_tokens")


def _shared_out(nodes: DataFrame, parent: list[str], level: str, p: MixParams) -> DataFrame:
    """nodes: parent columns, ``level``, cap, budget (the parent's).  Adds ``share``: water-filling among siblings."""
    n = nodes.withColumn("w", _weight(level, p))
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # decimals keep the comparison of cap / w exact at any size
    before = family.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("decimal(38,12)") / F.col("w")).otherwise(0), level).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("w_all", F.sum("w").over(family))
    d = lambda c: F.col(c).cast("decimal(19,0)")
    n = n.withColumn("full", d("cap") * (d("w_all") - d("w_before")) <= d("w") * (d("budget") - d("cap_before")))
    n = n.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(family))
    part = F.expr("(CAST(w AS decimal(19,0)) * CAST(left AS decimal(19,0))) div greatest(open, 1)")
    return n.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("w", "cap_before", "w_before", "w_all", "full", "left", "open")


def budgets(rows: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Leaf table: domain, lang, source, leaf_tokens, budget."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
    open_path = F.least(*[_weight(level, p) for level in LEVELS]) > 0
    leaves = table(leaves.withColumn("cap", F.when(open_path, F.col("leaf_tokens") * p.epochs).otherwise(0)), "mix-capacities")
    nodes = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("leaf_tokens").alias("t"))
    nodes = nodes.withColumn("budget", F.expr(f"sum(t) OVER () * {p.share_num} div {p.share_den}"))
    shares = _shared_out(nodes, [], "domain", p).select("domain", F.col("share").alias("budget"))
    for k in (1, 2):
        up, here = list(LEVELS[:k]), list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap")).join(shares, up)
        shares = _shared_out(nodes, up, LEVELS[k], p).select(*here, F.col("share").alias("budget"))
    return leaves.drop("cap").join(shares, list(LEVELS))


def order_key(epoch: Column, p: MixParams) -> Column:
    return F.md5(F.concat(F.lit(f"{p.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))


def cutoffs(rows: DataFrame, leaves: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Leaf table with ``whole`` (complete epochs) and the key of the last document of the begun one."""
    leaves = table(leaves, "mix-budgets").withColumn("whole", F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens"))
    keyed = rows.join(leaves, list(LEVELS)).withColumn("key", order_key(F.col("whole"), p)).withColumn("slice", F.substring("key", 1, 3))
    by_slice = keyed.groupBy(*LEVELS, "slice", "rest").agg(F.sum("n_tokens").alias("t"))
    running = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_slice = by_slice.withColumn("upto", F.sum("t").over(running))
    first = by_slice.filter(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("slice", (F.col("upto") - F.col("t")).alias("before"))).alias("x")).select(*LEVELS, F.col("x.slice").alias("cut_slice"), F.col("x.before").alias("before"))
    inside = keyed.join(first, list(LEVELS)).filter(F.col("slice") == F.col("cut_slice")).groupBy(*LEVELS, "key", "_id", "rest", "before").agg(F.sum("n_tokens").alias("t"))
    running = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.col("before") + F.sum("t").over(running)).filter(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    out = leaves.join(first, list(LEVELS), "left").join(last, list(LEVELS), "left")
    # no slice is cut: the whole epoch fits (only documents without tokens); nothing of the cut slice fits: end before it
    return out.select(*LEVELS, "leaf_tokens", "budget", "whole", F.when(F.col("cut_slice").isNull(), F.lit("g")).otherwise(F.coalesce("last_key", "cut_slice")).alias("last_key"))


def choose(rows: DataFrame, cut: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``rows`` (with _id and the leaf columns) times the copies that the mixture takes: column n_copies."""
    joined = rows.join(cut, list(LEVELS))
    return joined.withColumn("n_copies", (F.col("whole") + F.when(order_key(F.col("whole"), p) <= F.col("last_key"), 1).otherwise(0)).cast("int")).filter(F.col("n_copies") > 0)


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Chosen documents: doc_id, domain, lang, source, n_tokens, leaf_tokens, budget, n_copies."""
    rows = table(labelled(docs), "mix-rows")
    cut = table(cutoffs(rows, budgets(rows, p), p), "mix-leaves")
    return choose(rows, cut, p).select(F.col("_id").alias("doc_id"), *LEVELS, "n_tokens", "leaf_tokens", "budget", "n_copies")


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The chosen rows of ``docs`` with their own columns, each as often as it was taken."""
    rows = table(labelled(docs), "mix-rows")
    cut = table(cutoffs(rows, budgets(rows, p), p), "mix-leaves")
    own = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", F.col("_row.doc_id").alias("_id"), F.coalesce("_row.source", F.lit("")).alias("_source"), F.coalesce("_row.lang", F.lit("")).alias("lang"))
    own = own.select("_row", "_id", domain_of(F.col("_source")).alias("domain"), "lang", F.col("_source").alias("source"))
    taken = choose(own, cut, p).select("_row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("_copy"))
    return taken.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(p: MixParams = MixParams()) -> str:
    def weight(level):
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in p.weights[level].items()) + f" ELSE {p.default_weight} END::BIGINT"

    def level(name, source, parent, col):
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        keep = ", ".join([*parent, col])
        return f"""
{name}_a AS (SELECT *, {weight(col)} AS w FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER x, 0)::HUGEINT AS cb, coalesce(sum(w) OVER x, 0)::HUGEINT AS wb, sum(w) OVER ({over})::HUGEINT AS wall
  FROM {name}_a WINDOW x AS ({over} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 0 END, {col} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_c AS (SELECT *, cap * (wall - wb) <= w * (budget - cb) AS full_ FROM {name}_b),
{name} AS (SELECT {keep}, CASE WHEN full_ THEN cap ELSE w * (budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({over}), 0)::HUGEINT) // greatest(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({over}), 1)::HUGEINT END::BIGINT AS budget FROM {name}_c)"""

    e = p.epochs
    return f"""
WITH rows0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
    CASE WHEN source LIKE 'src%' THEN try_cast(substr(source, 4) AS INTEGER) END AS n FROM documents),
rows1 AS (SELECT doc_id, CASE WHEN n BETWEEN 10 AND 14 THEN 'books' WHEN n >= 15 THEN 'code' ELSE 'web' END AS domain, lang, source, n_tokens FROM rows0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens, (CASE WHEN least({', '.join(map(weight, LEVELS))}) > 0 THEN sum(n_tokens) * {e} ELSE 0 END)::BIGINT AS cap FROM rows1 GROUP BY domain, lang, source),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, (sum(sum(leaf_tokens)) OVER () * {p.share_num} // {p.share_den})::BIGINT AS budget FROM leaves GROUP BY domain),
{level("s1", "n1", [], "domain")},
n2 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, s.budget FROM leaves l JOIN s1 s USING (domain) GROUP BY l.domain, l.lang, s.budget),
{level("s2", "n2", ["domain"], "lang")},
n3 AS (SELECT l.domain, l.lang, l.source, l.cap, s.budget FROM leaves l JOIN s2 s USING (domain, lang)),
{level("s3", "n3", ["domain", "lang"], "source")},
cut AS (SELECT l.domain, l.lang, l.source, l.leaf_tokens, s.budget, CASE WHEN l.leaf_tokens > 0 THEN s.budget // l.leaf_tokens ELSE 0 END AS whole FROM leaves l JOIN s3 s USING (domain, lang, source)),
keyed AS (SELECT r.*, c.leaf_tokens, c.budget, c.whole, md5('{p.seed}:' || c.whole || ':' || coalesce(r.doc_id::VARCHAR, '')) AS key FROM rows1 r JOIN cut c USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
taken AS (SELECT *, (whole + CASE WHEN upto <= budget - whole * leaf_tokens THEN 1 ELSE 0 END)::INTEGER AS n_copies FROM run)
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, budget, n_copies FROM taken WHERE n_copies > 0
"""
