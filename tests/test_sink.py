"""The side-file sink: all files of a job or none."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tagweave.sources import sink


def names(folder):
    return sorted(os.listdir(folder))


def rows(spark, pairs, parts=4):
    return spark.createDataFrame(pairs, "name string, content string").repartition(parts)


def broken(name):
    def made(n):
        if n == "17.txt":
            raise RuntimeError("this row cannot be made")
        return n

    return F.udf(made, "string")(name)


def test_files(spark, tmp_path):
    (tmp_path / "3.txt").write_text("old")
    (tmp_path / "kept.txt").write_text("kept")
    assert sink.write_files(rows(spark, [(f"{i} é.txt" if i == 5 else f"{i}.txt", None if i == 4 else f"text {i} é") for i in range(50)]), str(tmp_path)) == 50
    assert len(names(tmp_path)) == 51 and (tmp_path / "3.txt").read_text() == "text 3 é" and (tmp_path / "4.txt").read_bytes() == b"" and (tmp_path / "kept.txt").read_text() == "kept"
    sink.register(spark)
    data = spark.createDataFrame([("a.bin", bytearray(b"\0\xff"))], "name string, content binary")
    data.write.format("sidefiles").mode("append").save(f"file://{tmp_path}")
    assert (tmp_path / "a.bin").read_bytes() == b"\0\xff" and not [n for n in names(tmp_path) if n.startswith(".")]
    assert sink.write_files(rows(spark, []), str(tmp_path)) == 0 and sink.write_files(rows(spark, [("x", "y")]), str(tmp_path / "new" / "er")) == 1


def test_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "3.txt").write_text("old")
    bad = rows(spark, [(f"{i}.txt", "new") for i in range(40)]).withColumn("content", broken("name"))
    with pytest.raises(Exception, match="cannot be made"):
        sink.write_files(bad, str(tmp_path))
    assert names(tmp_path) == ["3.txt"] and (tmp_path / "3.txt").read_text() == "old"


@pytest.mark.parametrize("pairs", [[("a", "1"), ("a", "2")], [("", "1")], [(None, "1")], [("../a", "1")], [(".a", "1")]])
def test_refused_names(spark, tmp_path, pairs):
    with pytest.raises(Exception, match="name"):
        sink.write_files(rows(spark, [*pairs, ("good", "x")]), str(tmp_path))
    assert names(tmp_path) == []


def test_refused_tables(spark, tmp_path):
    sink.register(spark)
    with pytest.raises(Exception, match="columns must be"):
        spark.range(1).write.format("sidefiles").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="append"):
        rows(spark, [("a", "b")]).write.format("sidefiles").mode("overwrite").save(str(tmp_path))


def test_commit_survives_a_crash(spark, tmp_path):
    """A committed job ends after a crash at any place; one that was not committed never shows."""
    writer = sink.SinkWriter(str(tmp_path), "later")
    import pyarrow as pa

    batch = lambda k: iter([pa.RecordBatch.from_pylist([{"name": f"{k}-{i}", "content": "x"} for i in range(5)])])
    messages = [writer.write(batch(k)) for k in range(3)] + [None]
    lost = writer.write(batch(9))  # an attempt whose message never came
    other = sink.SinkWriter(str(tmp_path), "later")
    other.write(batch(7))
    assert sink.published(spark, str(tmp_path)) == 0
    writer.commit(messages)
    staged = tmp_path / writer.stage
    assert json.loads((staged / "COMMIT").read_text()) == [m.attempt for m in messages[:3]] and lost.attempt not in (staged / "COMMIT").read_text()
    for n in names(staged / messages[1].attempt)[:2]:  # moved before the crash
        (staged / messages[1].attempt / n).rename(tmp_path / n)
    assert sink.published(spark, str(tmp_path)) == 13 and sink.published(spark, str(tmp_path)) == 0
    assert [n for n in names(tmp_path) if not n.startswith(".")] == [f"{k}-{i}" for k in range(3) for i in range(5)] and not staged.exists()
    other.abort([])
    assert not [n for n in names(tmp_path) if n.startswith(".")]


def test_lines(spark, tmp_path):
    path = str(tmp_path / "prompts")
    for wanted in (["a", "b", "c"], ["d"]):
        sink.write_lines(spark.createDataFrame([(x,) for x in wanted], "p string"), path, "p")
        assert sorted(r.value for r in spark.read.text(path).collect()) == wanted
    with pytest.raises(Exception, match="cannot be made"):
        sink.write_lines(rows(spark, [("17.txt", ""), ("2", "")]).select(broken("name").alias("p")), path, "p")
    assert [r.value for r in spark.read.text(path).collect()] == ["d"] and names(tmp_path) == ["prompts"]
