"""Captioning under one limit, with errors that cost a row."""

from __future__ import annotations

import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagweave.operators import captions
from tagweave.plans.storage import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module


def rows(spark, prompts, parts=4):
    return spark.createDataFrame([(f"/x/{i}", bytearray(f"image {i}".encode()), p) for i, p in enumerate(prompts)], "path string, content binary, prompt string").repartition(parts)


def service(folder=None, slow=0.0):
    """Answers by the prompt; notes when it was asked."""

    def make():
        def ask(contents, prompts, system):
            out = []
            for c, p in zip(contents, prompts, strict=True):
                if folder:
                    open(os.path.join(folder, f"{time.time():.6f}-{os.getpid()}-{c.decode().replace(' ', '')}"), "w").close()
                time.sleep(slow * (1 + len(c) % 3))
                if p.startswith("raise "):
                    raise RuntimeError(p.removeprefix("raise "))
                out.append(f"{p} of {c.decode()} by {system} \n")
            return out

        return ask

    return make


def asked_at(folder):
    return sorted(float(n.split("-")[0]) for n in os.listdir(folder))


def got(df):
    return {r.path: (r.response, r.route) for r in df.collect()}


PROMPTS = ["p", "raise 429 too many", "q", "raise no such thing", "CHECK QUOTA", "r"]
WANT = {"/x/0": ("p of image 0 by s \n", "captioned"), "/x/1": ("CHECK QUOTA", "failed"), "/x/2": ("q of image 2 by s \n", "captioned"), "/x/3": ("BLOCKED CONTENT", "failed"), "/x/5": ("r of image 5 by s \n", "captioned")}


@pytest.mark.parametrize("limit", [None, 60])
def test_errors_cost_a_row(spark, limit):
    out = captions.captioned(rows(spark, PROMPTS, 2), F.col("prompt"), f"errors {limit}", service(), "s", limit, 6.0, 2)
    assert out.columns == ["path", "content", "prompt", "response", "route"]
    found = got(out)
    assert {k: v for k, v in found.items() if k != "/x/4"} == WANT and found["/x/4"][1] == "failed"


@pytest.mark.parametrize("callers, slow", [(1, 0.0), (4, 0.0), (4, 0.2)])
def test_never_over_the_limit(spark, tmp_path, callers, slow):
    """However many tasks ask, and however long answers take, no period holds more requests than the limit."""
    limit, period, n = 8, 1.6, 40
    out = captions.captioned(rows(spark, ["p"] * n, 7), F.col("prompt"), f"limit {callers} {slow}", service(str(tmp_path), slow), "s", limit, period, callers)
    assert len([r for r in got(out).values() if r[1] == "captioned"]) == n
    at = asked_at(tmp_path)
    assert len(at) == n and all(b - a >= period for a, b in zip(at, at[limit:], strict=False))
    if not slow:
        assert at[-1] - at[0] < 3 * n * period / limit  # and not much below it either


def test_rows_of_one_task_only(spark, tmp_path):
    """Empty partitions take part in every round and end with the others."""
    out = captions.captioned(rows(spark, ["p"] * 3, 1), F.col("prompt"), "few", service(str(tmp_path)), "s", 50, 1.0, 4)
    assert len(got(out)) == 3 and captions.captioned(rows(spark, ["p"], 1).limit(0), F.col("prompt"), "none", service(), "s", 50, 1.0, 3).count() == 0


def test_an_invalid_key_stops_all_tasks(spark, tmp_path):
    out = captions.captioned(rows(spark, ["raise API_KEY_INVALID"] * 300, 4), F.col("prompt"), "key", service(str(tmp_path)), "s", 20, 1.0, 4)
    found = got(out)
    assert len(found) == 300 and {r[1] for r in found.values()} == {"unasked"} and len(asked_at(tmp_path)) <= 8


def test_slots_are_dealt_once():
    counts = [3, 0, 1, 5]
    every = [captions.slots(counts, r) for r in range(4)]
    assert sorted(sum(every, [])) == list(range(9)) and [len(s) for s in every] == counts and all(s == sorted(s) for s in every)


def fill(folder):
    folder.mkdir()
    for name, tags in (("a", "red, blue"), ("b", None), ("c", ""), ("d", "raise 429"), ("e e#", "x"), ("f", "raise other")):
        (folder / f"{name}.png").write_bytes(name.encode())
        if tags is not None:
            (folder / f"{name}.txt").write_text(tags)


def content(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if not p.name.startswith(".")}


@pytest.mark.parametrize("limit", [None, 100])
def test_folder(spark, tmp_path, limit):
    fill(tmp_path / "in")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "e e#.webp").write_text("done before")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "bad"), "the user's", f"folder {limit}", service(), table, "s", limit, 2.0, 2)
    found = {r.path.rsplit("/", 1)[1]: r.route for r in captions.caption_folder(*args).collect()}
    assert found == {"a.png": "captioned", "b.png": "captioned", "c.png": "captioned", "d.png": "failed", "f.png": "failed"}
    assert content(tmp_path / "out") == {"a.png": "a", "a.txt": "red, blue of a by s", "b.png": "b", "b.txt": "the user's of b by s", "c.png": "c", "c.txt": f"{captions.BASE_PROMPT} of c by s", "e e#.webp": "done before"}
    assert content(tmp_path / "bad") == {"d.png": "d", "f.png": "f"}
    assert sorted(content(tmp_path / "in")) == ["a.txt", "c.txt", "d.txt", "e e#.png", "e e#.txt", "f.txt"]
    assert captions.caption_folder(*args).count() == 0


def test_folder_with_an_invalid_key(spark, tmp_path):
    fill(tmp_path / "in")
    (tmp_path / "in" / "f.txt").write_text("raise API_KEY_INVALID")
    with pytest.raises(captions.InvalidKey):
        captions.caption_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "bad"), "u", "folder key", service(), table, "s")
    assert "f.png" in content(tmp_path / "in") and "a.txt" in content(tmp_path / "out") and content(tmp_path / "bad") == {"d.png": "d"}
