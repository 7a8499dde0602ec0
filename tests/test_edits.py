"""The debounced stream of edits against a plain version over all edits."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagweave.streaming import edits

START = datetime(2024, 5, 1)
SCHEMA = "name string, at timestamp, seq long, text string"


def plain(rows, quiet_ms, lateness_ms):
    """Saved edits when the last of the rows has been seen."""
    out, end = set(), max(at for _, at, *_ in rows) - timedelta(milliseconds=lateness_ms)
    for name in {n for n, *_ in rows if n is not None}:
        mine = sorted({(at, seq, text) for n, at, seq, text in rows if n == name})
        for (at, _, text), after in zip(mine, [*mine[1:], None], strict=True):
            over = at + timedelta(milliseconds=quiet_ms)
            if over <= end and (after is None or after[0] >= over):
                out.add((name, at, text))
    return out


def write(spark, folder, rows, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")


def stream(spark, folder, lateness="2 seconds"):
    found = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return edits.debounced(found, F.col("name"), F.col("at"), F.col("seq"), F.col("text"), 500, lateness)


def got(df):
    rows = [(r.path, r["at"], r.text) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_late_repeated_and_out_of_order(spark, tmp_path):
    """Edits within the allowed lateness in any order over several batches, and a restart between each two of them."""
    rng = random.Random(3)
    rows, at = [], 0
    for k in range(260):
        at += rng.choice([20, 100, 300, 499, 500, 501, 900])
        rows.append((rng.choice(["a.txt", "b.txt", "c.txt"]), START + timedelta(milliseconds=at), k, None if k % 50 == 7 else f"text {k}"))
    rows += [(rows[5][0], rows[5][1], 1000, "same time, later"), (None, rows[9][1], 1001, "of nothing")]
    arrival = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rng.uniform(0, 0.9))
    seen, base = [], str(tmp_path / "state")
    for k in range(0, len(arrival), 60):
        batch = arrival[k : k + 60]
        write(spark, tmp_path, batch + batch[:5] + (seen[-3:] if k else []), k)  # some come twice
        seen += batch
        out = edits.run_available(spark, stream(spark, tmp_path), base)
        assert got(out) == plain([r for r in seen], 500, 2000)
    assert len(got(out)) > 40 and any(t is None for *_, t in got(out))


def test_too_late_edits_change_nothing(spark, tmp_path):
    s = lambda x: START + timedelta(seconds=x)
    base = str(tmp_path / "state")
    write(spark, tmp_path, [("a", s(0), 1, "first"), ("a", s(10), 2, "second"), ("b", s(20), 3, "b")], 1)
    assert got(edits.run_available(spark, stream(spark, tmp_path), base)) == {("a", s(0), "first"), ("a", s(10), "second")}
    write(spark, tmp_path, [("a", s(0.2), 4, "too late"), ("c", s(40), 5, "c")], 2)
    assert got(edits.run_available(spark, stream(spark, tmp_path), base)) == {("a", s(0), "first"), ("a", s(10), "second"), ("b", s(20), "b")}


def test_many_paths_and_times(spark, tmp_path):
    """Work is done for sessions and not by a call for every edit and timer: 4000 edits of 200 paths in one batch."""
    rng = random.Random(8)
    rows = [(f"{rng.randrange(200)}.txt", START + timedelta(milliseconds=rng.randrange(20_000)), k, f"{k}") for k in range(4000)]
    write(spark, tmp_path, rows, 1)
    out = edits.run_available(spark, stream(spark, tmp_path), str(tmp_path / "state"))
    assert got(out) == plain(rows, 500, 2000)
    assert "TransformWithState" not in stream(spark, tmp_path)._jdf.queryExecution().analyzed().toString()


def test_no_quiet(spark, tmp_path):
    rows = [("a", START + timedelta(seconds=x), x, str(x)) for x in (1, 1, 2, 9)]
    write(spark, tmp_path, rows, 1)
    found = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = edits.debounced(found, F.col("name"), F.col("at"), F.col("seq"), F.col("text"), 0, "2 seconds")
    assert got(edits.run_available(spark, out, str(tmp_path / "state"))) == {("a", rows[0][1], "1"), ("a", rows[2][1], "2")}


def test_superseded_edits_still_supersede():
    """One that is followed goes on counting for those before it, though they come later."""
    first = edits.followed([(600, 1, "x", False), (1000, 2, "y", False)], 500)
    assert first == [(600, 1, None, True), (1000, 2, "y", False)]
    assert edits.followed([*first, (200, 3, "z", False)], 500) == [(200, 3, None, True), (600, 1, None, True), (1000, 2, "y", False)]
    assert edits.followed([(0, 1, "a", False), (500, 2, "b", False), (500, 3, "c", False)], 500) == [(0, 1, "a", False), (500, 2, None, True), (500, 3, "c", False)]


def test_saved_as_files(spark, tmp_path):
    s = lambda x: START + timedelta(seconds=x)
    write(spark, tmp_path, [("1.txt", s(0), 1, "draft"), ("1.txt", s(0.3), 2, "kept"), ("1.txt", s(3), 3, "final"), ("2.txt", s(1), 4, ""), ("9.txt", s(60), 5, "not decided")], 1)
    out = tmp_path / "texts"
    edits.saved(stream(spark, tmp_path), str(out), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert {p.name: p.read_text() for p in out.iterdir() if not p.name.startswith(".")} == {"1.txt": "final", "2.txt": ""}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("quiet", [0, 500])
def test_empty(spark, tmp_path, quiet):
    write(spark, tmp_path, [], 1)
    assert edits.run_available(spark, stream(spark, tmp_path), str(tmp_path / "state")).count() == 0
