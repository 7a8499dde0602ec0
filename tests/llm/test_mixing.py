from __future__ import annotations

import duckdb
import pytest

from tagweave.llm import mixing


NO_WEIGHT = {"domain": {"web": 5, "books": 0, "code": 2}, "lang": {"en": 6, "de": 0, "fr": 1}, "source": {"src0": 4, "src1": 0}}


@pytest.mark.parametrize("p", [mixing.MixParams(), mixing.MixParams(weights=NO_WEIGHT, epochs=3), mixing.MixParams(weights={"domain": {"web": 0, "books": 0, "code": 0}})])
def test_against_sql(spark, docs, p):
    """All rows: null ids, ids that rows share, weights of 0."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    full = mixing.MixParams(p.seed, p.epochs, weights={level: p.weights.get(level, {"none": 1}) for level in mixing.LEVELS})
    want = con.sql(mixing.oracle(full))
    found = mixing.mix(docs, p)
    cols = sorted(want.columns)
    assert sorted((str(tuple(r[c] for c in cols)) for r in found.collect())) == sorted(str(r) for r in want.select(", ".join(cols)).fetchall())


def test_budgets_respect_capacity_and_whole(spark, docs):
    p = mixing.MixParams()
    rows = mixing.labelled(docs)
    leaves = mixing.budgets(rows, p).toPandas()
    total = leaves.leaf_tokens.sum() * p.share_num // p.share_den
    assert (leaves.budget <= leaves.leaf_tokens * p.epochs).all() and (leaves.budget >= 0).all()
    assert total - 3 * len(leaves) <= leaves.budget.sum() <= total


def test_shortage_goes_to_siblings_first(spark):
    from tests.llm.conftest import make_docs

    w = lambda n: "w " * n
    docs = make_docs(spark, [(1, w(10), "en", "src0"), (2, w(100), "en", "src1"), (3, w(100), "de", "src2"), (4, w(100), "de", "src10")])
    p = mixing.MixParams(epochs=1, share_num=1, share_den=2, weights={"domain": {"web": 1, "books": 1}, "lang": {"en": 1, "de": 1}, "source": {"src0": 3, "src1": 1}})
    got = {(r.lang, r.source): r.budget for r in mixing.budgets(mixing.labelled(docs), p).collect()}
    # of 155 tokens web gets 77, en 38 of them: src0 has only 10, its sibling takes the 28
    assert got == {("en", "src0"): 10, ("en", "src1"): 28, ("de", "src2"): 38, ("de", "src10"): 77}


def test_documents_are_repeated_whole(spark, docs, no_docs):
    n = {}
    for r in mixing.mix(docs.filter("doc_id < 14 OR doc_id > 15")).collect():
        n[r.doc_id] = r.n_copies
    out = mixing.mixed_documents(docs.filter("doc_id < 14 OR doc_id > 15"))
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == n
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mix(docs).filter("doc_id = 15").count() in (0, 2)
