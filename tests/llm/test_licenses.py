from __future__ import annotations

import random
import re

import duckdb

from tagweave.llm import licenses
from tests.llm.conftest import make_docs


def test_against_sql(spark, docs, rows):
    extra = make_docs(spark, [
        (900, "Released under the MIT License. And under the mit  license, v2 (under the MIT-license)", "en", "s"), (901, "CC BY-NC; cc_by_nc; CC BY 4 NC", "en", "s"),
        (902, "Licensed under the Apache License, Version 2.0 (the License); you may surely not use this file except in compliance with the License.", "en", "s"),
        (903, "PERMISSION IS HEREBY GRANTED, free of charge, to any one person obtaining copies of this software and associated documentation files", "en", "s"), (904, "by nc", "en", "s"), (905, "cc by nc", "en", "s")])
    every = docs.filter("doc_id NOT IN (14, 15)").unionByName(extra)
    con = duckdb.connect()
    con.register("documents", every.select("doc_id", "text").toPandas())
    want = con.sql(licenses.oracle()).df().sort_values("doc_id")
    got = licenses.scan(every).toPandas().sort_values("doc_id")
    cols = sorted(want.columns)
    assert got[cols].fillna(-1).values.tolist() == want[cols].fillna(-1).values.tolist()
    by = got.set_index("doc_id")
    assert by.loc[900, "n_base"] == 3 and by.loc[900, "base_labels"] == "mit" and by.loc[900, "first_word"] == 1
    assert by.loc[901, "base_labels"] == "cc-by-nc" and by.loc[901, "n_base"] == 2
    assert by.loc[902, "labels"] == "apache-2" and by.loc[903, "base_labels"] == "" and by.loc[903, "labels"] == "mit"
    assert by.loc[904, "n_base"] == 0 and by.loc[905, "score"] == 1.0


NOTICE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
CASES = {
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution NonCommercial International License.": "cc-by-nc",
    "foo bar " * 9 + NOTICE.replace("you may", "the License you " * 8 + "may"): "apache-2",
    NOTICE + " This work is licensed under a Creative Commons Attribution 4.0 International License. " + NOTICE: "apache-2,cc-by",
    " ".join(reversed(NOTICE.split())): "",
    "this work is under license": "",
    "under the MIT licen\u017fe, wor\u212a": "",
}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, p=licenses.LicenseParams()):
    """The scan by loops over words: (n_words, n_base, first, last, base labels, labels, score)."""
    w, k = words_of(text), licenses.K
    places, labels, kept, score = [], set(), [], 0.0
    for phrase, label in licenses.PHRASES:
        x = phrase.split()
        at = [i for i in range(len(w) - len(x) + 1) if w[i : i + len(x)] == x]
        places += at
        labels |= {label} if at else set()
        score = max(score, float(bool(at)))
    base = sorted(labels)
    needs = licenses.apart()
    for t, (notice, label) in enumerate(licenses.NOTICES, len(licenses.PHRASES)):
        x = notice.split()
        n = len(x) - k + 1
        votes = [(i, j) for i in range(len(w) - k + 1) for j in range(n) if w[i : i + k] == x[j : j + k]]
        runs, last = [], None
        for d in sorted({i - j for i, j in votes}):
            runs = runs + [{d}] if last is None or d - last > p.gap else [*runs[:-1], runs[-1] | {d}]
            last = d
        for run in runs:
            mine = sorted((i, -j) for i, j in votes if i - j in run)
            best = []
            for at, (i, j) in enumerate(mine):
                best.append(1 + max([best[b] for b in range(at) if mine[b][0] < i and -mine[b][1] < -j], default=0))
            chain = max(best)
            score = max(score, chain / n)
            met = {-j for _, j in mine}
            if chain * p.cover_den >= n * p.cover_num and all(met & set(x) for x in needs[t]):
                kept.append((mine[0][0], mine[-1][0] + k - 1, label, chain / n))
    labels |= {a[2] for a in kept if not any(b[2] != a[2] and b[0] <= a[1] and a[0] <= b[1] and b[3] > a[3] + 1e-12 for b in kept)}
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), score


def test_against_a_plain_scan(spark, docs, rows):
    rng = random.Random(5)
    texts = list(CASES)
    for _ in range(60):  # notices with words left out, doubled, moved and put in
        x = " ".join(n for n, _ in rng.choices(licenses.NOTICES, k=rng.randint(1, 3))).split()
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice([[], [x[i], x[i]], [x[i], "foo"], x[max(0, i - 3) : i + 1]])
        texts.append(" ".join(x))
    every = docs.unionByName(make_docs(spark, [(1000 + i, t, "en", "s") for i, t in enumerate(texts)]))
    want = sorted(((i, *plain(t)) for i, t in [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in enumerate(texts)]), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(every).collect()), key=str)
    assert got == want
    by = {g[0]: g[6] for g in got}
    assert [by[1000 + i] for i in range(len(CASES))] == list(CASES.values())


def test_rows_and_counts(docs, rows, no_docs):
    out = licenses.scan(docs).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    assert sorted((r.doc_id or 0, r.n_words) for r in out) == sorted((i or 0, len(split(t))) for i, t, *_ in rows)
    assert licenses.scan(no_docs).count() == 0
