"""License scan by diagonal voting.

All rolling word trigrams of every text are joined by hash with the trigrams of license templates, and compared word for word;
a match is a vote for a diagonal (place in the text - place in the template).  A diagonal that holds
all trigrams of a phrase is an exact occurrence of it.  For the longer notices, diagonals that lie within ``gap`` of
each other are merged, which bridges inserted, repeated and left-out words.  A merged span is verified on its alignment:

* the longest chain of votes that rises in the text and in the template covers at least ``cover_num / cover_den`` of
  the template's trigrams, so words out of order or words repeated in between neither help nor hurt;
* from every template of another label that shares a trigram with it, some word that this other one lacks is met;
* of overlapping spans of different labels the one best covered stays (ties: all of them).

Lower-casing concerns A-Z only; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A null or empty text has no words, no labels and
score 0.0.  Very long texts are scanned whole, in rows of one trigram each.  Repeated rows are scanned each for itself, an empty
table gives an empty result, and columns other than doc_id and text are not read.
``score`` is the best coverage of any template (1.0 for an exact phrase, 0.0 without votes).

Built-in functions only.  Votes are joined against the templates, a fixed table of some hundred
rows, so the big side is never shuffled; what is grouped afterwards are votes, keyed by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3

# Phrases that must be found word for word, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Opening words of well-known license notices, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LicenseParams:
    gap: int = 3
    cover_num: int = 3  # of a notice's trigrams, cover_num / cover_den must be met in order
    cover_den: int = 5


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, exact, n_grams, place, w0, w1, w2) of every trigram."""
    out = []
    for t, (text, label) in enumerate([*phrases, *notices]):
        words = text.split()
        for i in range(len(words) - K + 1):
            out.append((t, label, t < len(phrases), len(words) - K + 1, i, *words[i : i + K]))
    return out


def apart(phrases=PHRASES, notices=NOTICES) -> dict[int, list[list[int]]]:
    """For each notice and each related notice of another label that lacks some of its words: the trigrams that hold such a word."""
    all_words = {t: (text.split(), label) for t, (text, label) in enumerate([*phrases, *notices]) if t >= len(phrases)}
    grams = {t: {tuple(w[i : i + K]) for i in range(len(w) - K + 1)} for t, (w, _) in all_words.items()}
    out = {}
    for t, (words, label) in all_words.items():
        out[t] = []
        for o, (other, other_label) in all_words.items():
            own = {i for i, w in enumerate(words) if w not in other}
            if label != other_label and grams[t] & grams[o] and own:
                out[t].append([i for i in range(len(words) - K + 1) if own & set(range(i, i + K))])
    return out


def grams(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, n_words, pos, w0, w1, w2): every trigram of every text, and one row of nulls at pos -1 per text."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), words.alias("_w"))
    n = F.size("_w")
    shifted = [F.expr(f"slice(_w, {k + 1}, greatest(size(_w) - {K - 1}, 0))") for k in range(K)]
    triples = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    one = F.array(F.struct(*[F.lit("").alias(f"w{k}") for k in range(K)]))
    zipped = F.concat(one, triples)
    return rows.select("_row", "doc_id", n.cast("long").alias("n_words"), F.posexplode(zipped).alias("pos", "g")).select("_row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "g.w0", "g.w1", "g.w2")


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """The trigram table, with a marker row for the null trigram that stands for a text itself."""
    needs = apart(phrases, notices)
    rows = [(-1, "", True, 1, [], 0, "", "", ""), *((t, label, exact, n, needs.get(t, []), *rest) for t, label, exact, n, *rest in templates(phrases, notices))]
    t = spark.createDataFrame(rows, "template int, label string, exact boolean, n_grams int, needs array<array<int>>, place int, t0 string, t1 string, t2 string")
    return t.withColumn("t_hash", F.xxhash64("t0", "t1", "t2"))


_KEYS = ["_row", "doc_id", "n_words", "template", "label", "exact", "n_grams", "needs"]


def diagonals(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Votes by diagonal: (_row, doc_id, n_words, template, label, exact, n_grams, needs, diagonal, places); template -1 stands for the text."""
    votes = grams(docs).withColumn("hash", F.xxhash64("w0", "w1", "w2"))
    # the template table has a fixed size of a few hundred rows
    t = F.broadcast(template_table(docs.sparkSession, phrases, notices))
    met = votes.join(t, (F.col("hash") == F.col("t_hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")))
    return met.groupBy(*_KEYS, (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))


# longest chain: after each vote, in order of the text, the best length that ends at its place of the template
_CHAIN = """aggregate(
  array_sort(flatten(transform(votes, d -> transform(d.places, p -> struct(d.diagonal + p AS pos, -p AS down))))),
  array_repeat(0, n_grams),
  (best, v) -> transform(best, (b, i) -> if(i = -v.down, greatest(b, 1 + coalesce(array_max(slice(best, 1, i)), 0)), b)),
  best -> array_max(best))"""


def spans(diag: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """Spans of merged neighbouring diagonals: _row, doc_id, n_words, template, label, exact, n_grams, first, last, chain, verified."""
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    away = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > p.gap)
    marked = diag.withColumn("away", F.when(F.coalesce(away, F.lit(True)), 1).otherwise(0))
    grouped = marked.withColumn("run", F.sum("away").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = grouped.select(*_KEYS, "run", "diagonal", "places", (F.col("diagonal") + F.array_min("places")).alias("a"), (F.col("diagonal") + F.array_max("places") + K - 1).alias("b"))
    out = ends.groupBy(*_KEYS, "run").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.collect_list(F.struct("diagonal", "places")).alias("votes"))
    out = out.withColumn("chain", F.when(F.col("exact"), F.size(F.col("votes")[0]["places"])).otherwise(F.expr(_CHAIN)))
    met = F.flatten(F.transform("votes", lambda d: d["places"]))
    enough = (F.col("chain") * p.cover_den >= F.col("n_grams") * p.cover_num) & F.forall("needs", lambda n: F.arrays_overlap(n, met))
    return out.withColumn("verified", F.when(F.col("exact"), F.col("chain") == F.col("n_grams")).otherwise(enough)).drop("votes", "needs")


def settled(s: DataFrame) -> DataFrame:
    """Labels of the verified notices that no overlapping one of another label beats: _row, own (array of labels)."""
    real = s.filter("verified AND NOT exact").select("_row", "first", "last", "label", "chain", "n_grams")
    order = Window.partitionBy("_row").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = real.withColumn("away", F.when(F.coalesce(F.col("first") > reach, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("away").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    island = marked.groupBy("_row", "island").agg(F.collect_list(F.struct("first", "last", "label", "chain", "n_grams")).alias("all"))
    best = F.expr("""transform(filter(all, x -> NOT exists(all, y -> y.label != x.label AND y.first <= x.last AND x.first <= y.last
        AND y.chain * x.n_grams > x.chain * y.n_grams)), x -> x.label)""")
    return island.select("_row", best.alias("own")).groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))


def scan(docs: DataFrame, p: LicenseParams = LicenseParams(), phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    s = spans(diagonals(docs, phrases, notices), p)
    real = F.col("template") >= 0
    base = real & F.col("exact") & F.col("verified")
    cover = F.when(real & (~F.col("exact") | F.col("verified")), F.col("chain") / F.col("n_grams")).otherwise(0.0)
    found = s.groupBy("_row", "doc_id", "n_words").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("of_base"), F.max(cover).alias("score"))
    found = found.join(settled(s), "_row", "left")
    every = F.array_sort(F.array_union("of_base", F.coalesce("own", F.array().cast("array<string>"))))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("of_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(p: LicenseParams = LicenseParams()) -> str:
    rows = ", ".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {i}, '{a}', '{b}', '{c}')" for t, label, exact, n, i, a, b, c in templates())
    needs = ", ".join(f"({t}, {n}::INTEGER[])" for t, ns in apart().items() for n in ns)
    return f"""
WITH t(template, label, exact, n_grams, place, t0, t1, t2) AS (VALUES {rows}),
needs(template, any_of) AS (VALUES {needs}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT r, unnest(w[1:len(w)-2]) AS w0, unnest(w[2:len(w)-1]) AS w1, unnest(w[3:len(w)]) AS w2, unnest(range(greatest(len(w) - 2, 0))) AS pos FROM d WHERE len(w) >= 3),
v AS (SELECT DISTINCT r, template, label, exact, n_grams, place, pos, pos - place AS diagonal FROM g JOIN t ON w0 = t0 AND w1 = t1 AND w2 = t2),
dg AS (SELECT DISTINCT r, template, exact, diagonal FROM v),
mark AS (SELECT *, CASE WHEN exact OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {p.gap} THEN 1 ELSE 0 END AS away FROM dg WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
runs AS (SELECT *, sum(away) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM mark),
s AS (SELECT r, template, label, v.exact, n_grams, run, min(pos) AS first_, max(pos) + {K - 1} AS last_, list(DISTINCT place::INTEGER) AS met, list([place::INTEGER] ORDER BY pos, place DESC) AS votes FROM v JOIN runs USING (r, template, diagonal) GROUP BY ALL),
c AS (SELECT *, CASE WHEN exact THEN len(met) ELSE list_max(list_reduce(votes, lambda best, x: list_transform(best, lambda b, i: CASE WHEN i = x[1] + 1 THEN greatest(b, 1 + coalesce(list_max(best[1:x[1]]), 0)) ELSE b END), list_transform(range(n_grams), lambda i: 0::INTEGER))) END AS chain FROM s),
ok AS (SELECT *, CASE WHEN exact THEN chain = n_grams ELSE chain * {p.cover_den} >= n_grams * {p.cover_num} AND NOT EXISTS (SELECT 1 FROM needs n WHERE n.template = c.template AND NOT list_has_any(n.any_of, c.met)) END AS verified FROM c),
own AS (SELECT r, label FROM ok x WHERE verified AND NOT exact AND NOT EXISTS (SELECT 1 FROM ok y WHERE y.r = x.r AND y.verified AND NOT y.exact AND y.label <> x.label AND y.first_ <= x.last_ AND x.first_ <= y.last_ AND y.chain * x.n_grams > x.chain * y.n_grams)
  UNION SELECT r, label FROM ok WHERE verified AND exact),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM own GROUP BY r)
SELECT any_value(d.doc_id) AS doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (WHERE exact AND verified)::BIGINT AS n_base,
  min(first_) FILTER (WHERE exact AND verified)::BIGINT AS first_word, max(first_) FILTER (WHERE exact AND verified)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact AND verified), '') AS base_labels,
  coalesce(any_value(l.labels), '') AS labels,
  coalesce(max(chain / n_grams) FILTER (WHERE NOT exact OR verified), 0.0)::DOUBLE AS score
FROM d LEFT JOIN ok ON d.r = ok.r LEFT JOIN l ON d.r = l.r GROUP BY d.r
"""
