from __future__ import annotations

import re
from itertools import permutations

import pytest

from tagweave.llm import filter_audit
from tests.llm.conftest import make_docs


def failing(rows):
    least: dict[str, int] = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, yes in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and least[text] < doc_id), strict=True) if yes}
        yield doc_id, lang or "", fails


def plain(rows, good, toxic):
    """Every order applied to every document, filter by filter."""
    out, gone_by = {}, {}
    docs = list(failing(rows))
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left, before = mine, []
            for step, c in enumerate(order, 1):
                now = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                out[part, order, step] = [len(left), len(now), sum(c in f for _, f in before), sum(f == {c} for _, f in mine), sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                gone_by[part, c] = gone_by.get((part, c), 0) + len(now)
                before += now
    return {k: (*v, gone_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int, part string, mask string"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (7, 0, 0), (14, 1, 0), (100, 1, 1), (101, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame([(*r, "p", "m") for r in rows], LABELS)


def test_every_order(spark, docs, rows, labels):
    more = [(200 + i, t, "fr", "s") for i, t in enumerate(["LOUD WORDS " * 60, "a # b", "", None, "same same " * 80, " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k}" for k in range(120))])]
    more += [(200, "LOUD WORDS " * 60, "fr", "s"), (None, "a # b", None, None), (-9, "word", "de", "s")]
    both = docs.unionByName(make_docs(spark, more))
    want = plain([*rows, *more], {1, 2, 4, 14, 100, 101}, {2, 3, 100})
    assert found(filter_audit.audited(both, labels)) == want
    assert any(v[2] and v[3] for v in want.values())


def test_copies_in_several_parts(spark, labels):
    """One text in a third of all rows, over more parts than a task holds at a time."""
    rows = [(i, "copied # text" if i % 3 == 0 else f"text {i}", f"l{i % 400}", "s") for i in range(1200)]
    got = found(filter_audit.audited(make_docs(spark, rows), labels))
    assert len(got) == 400 * 600
    assert sum(v[1] for (_, order, step), v in got.items() if order == "EABCD" and step == 1) == 399
    mine = [r for r in rows if r[2] == "l3"]
    twins = [(0, "copied # text", "other", "s")]
    want = plain(mine + twins, {1, 2, 4, 14, 100, 101}, {2, 3, 100})
    assert {k: v for k, v in got.items() if k[0] == "l3"} == {k: v for k, v in want.items() if k[0] == "l3"}


def test_empty_tables(spark, docs, no_docs, labels):
    assert filter_audit.audited(no_docs, labels).count() == 0
    assert sum(r.good_lost for r in filter_audit.audited(docs, labels.limit(0)).collect()) == 0


def test_table():
    first = filter_audit.first_failures()
    assert first.shape == (32, 120) and (first[0] == 5).all() and (first[31] == 0).all()
    order = filter_audit.ORDERS.index("DACBE")
    assert first[0b10001, order] == 1 and first[0b10000, order] == 4
