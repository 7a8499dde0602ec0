"""Renaming without loss: plans of chains and cycles, and crashes after every single move."""

from __future__ import annotations

import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagweave.plans import renames
from tagweave.plans.storage import table
from tagweave.sources import actions, files, folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module


def plan_of(spark, moves, spread):
    df = spark.createDataFrame(list(moves.items()), "source string, target string")
    return [r.asDict() for r in renames.pieces(df, table, spread).withColumn("spare", renames.spare(F.col("source"), "x")).collect()]


class Folder:
    """Names and contents; dies after some moves."""

    def __init__(self, names):
        self.files = {n: n for n in names}
        self.left = None

    def exists(self, names):
        return [n in self.files for n in names]

    def move(self, a, b):
        if self.left is not None:
            if not self.left:
                raise ConnectionError("killed")
            self.left -= 1
        assert b not in self.files, "written over"
        self.files[b] = self.files.pop(a)
        return "done"


def carry_out(plan, there, ended, rng):
    """The phases that have not ended, pieces in any order."""
    for name, rows, act in actions.PHASES:
        if name in ended:
            continue
        aside = rows == "aside"
        mine = [r for r in plan if r["aside"] == aside]
        pieces = [[r] for r in mine] if aside else [sorted((r for r in mine if r["piece"] == p), key=lambda r: r["depth"]) for p in sorted({r["piece"] for r in mine})]
        rng.shuffle(pieces)
        for piece in pieces:
            list(act(piece, there.exists, there.move))
        ended.add(name)


def graphs():
    rng = random.Random(7)
    chain = {f"d/{i}": f"d/{i + 1}" for i in range(300)}
    cycles = {f"d/{c}-{i}": f"d/{c}-{(i + 1) % n}" for c, n in enumerate((2, 3, 5, 40)) for i in range(n)}
    names = [f"d/{i}" for i in range(120)]
    mixed = dict(zip(rng.sample(names, 80), rng.sample(names, 80), strict=True))
    return [chain, cycles, mixed, {"d/a": "d/b", "d/c": "d/c"}, {}]


@pytest.mark.parametrize("spread", [1, 4, 10**9])
@pytest.mark.parametrize("which", range(5))
def test_killed_after_every_move(spark, which, spread):
    moves = graphs()[which]
    plan = plan_of(spark, moves, spread)
    real = {s: t for s, t in moves.items() if s != t}
    assert {r["source"]: r["target"] for r in plan} == real and len(plan) == len(real)
    if spread == 10**9 and which < 2:  # one spare name for each cycle, none for a chain
        assert sum(r["aside"] for r in plan) == (0, 4)[which]
    want = {moves.get(n, n): n for n in moves}
    rng = random.Random(spread)
    steps = len(plan) + sum(r["aside"] for r in plan)
    for kill in range(steps + 1):
        there, ended = Folder(moves), set()
        there.left = kill
        try:
            carry_out(plan, there, ended, rng)
            assert kill == steps
        except ConnectionError:
            if kill % 3 == 0:  # and again soon after
                there.left = 1
                with pytest.raises(ConnectionError) if kill + 1 < steps else pytest.MonkeyPatch.context():
                    carry_out(plan, there, ended, rng)
        there.left = None
        carry_out(plan, there, ended, rng)
        assert there.files == want, kill
        carry_out(plan, there, set(ended), rng)
        assert there.files == want


def test_long_chains_are_short_pieces(spark):
    plan = plan_of(spark, {f"d/{i}": f"d/{i + 1}" for i in range(5000)}, 64)
    longest = max(r["depth"] for r in plan)
    assert longest < 1000 and 40 < sum(r["aside"] for r in plan) < 130


def killed_after(counter, moves):
    """A move that fails for good when so many have been made."""

    def move(filesystem, a, b):
        if len(os.listdir(counter)) >= moves:
            raise ConnectionError("killed")
        assert not os.path.exists(b)
        filesystem.move(a, b)
        open(os.path.join(counter, f"{os.getpid()}-{len(os.listdir(counter))}-{os.path.basename(b)}"), "w").close()

    return move


def content(path):
    return {p.name: p.read_text() for p in path.iterdir() if not p.name.startswith(".")}


def images(spark, path):
    folder.register(spark)
    return spark.read.format("imagefolder").schema("path string, dir string, stem string, ext string").load(str(path))


def order():
    return [files.numeric_key(F.col("stem")), F.col("stem"), F.col("ext")]


def fill(path):
    """Numbers one too high, two that change places by name, shared stems, empty and missing side files."""
    path.mkdir()
    for i in [*range(3, 17), "z z#", "y"]:
        (path / f"{i}.png").write_text(f"image {i}")
        if i != 7:
            (path / f"{i}.txt").write_text("" if i == 9 else f"text {i}")
    (path / "5.gif").write_text("image 5 gif")
    (path / "y.caption").write_text("caption y")


WANT = [3, 4, "5 gif", *range(5, 17), "y", "z z#"]


def expected():
    out = {}
    for n, name in enumerate(WANT, 1):
        out[f"{n}.gif" if name == "5 gif" else f"{n}.png"] = f"image {name}"
        if name not in (7, 5):  # 5.gif sorts before 5.png, so it is the first of the shared stem and takes the side file
            out[f"{n}.txt"] = "" if name == 9 else f"text {name}".removesuffix(" gif")
    out[f"{WANT.index('y') + 1}.caption"] = "caption y"
    return out


def test_the_expected_names():
    assert expected()["3.gif"] == "image 5 gif" and expected()["4.png"] == "image 5" and expected()["3.txt"] == "text 5" and "4.txt" not in expected()


@pytest.mark.parametrize("kill", [0, 1, 9, 20, 32, 10**6])
def test_folder_survives(spark, tmp_path, kill):
    fill(tmp_path / "in")
    before = content(tmp_path / "in")
    counter, journal = tmp_path / "moves", str(tmp_path / "journal")
    counter.mkdir()
    args = (order(), table, journal)
    if kill < 10**6:
        with pytest.raises(Exception, match="killed"):
            actions.renamed(images(spark, tmp_path / "in"), *args, move=killed_after(str(counter), kill)).collect()
        assert len(os.listdir(tmp_path / "in")) == len(before)
    else:
        actions.renamed(images(spark, tmp_path / "in"), *args).collect()
    out = actions.renamed(images(spark, tmp_path / "in"), *args).collect()
    assert content(tmp_path / "in") == expected() and sorted(expected().values()) == sorted(before.values())
    assert {r.outcome for r in out} <= {"done", "present"} and not [n for n in os.listdir(tmp_path / "in") if n.startswith(".")]
    again = actions.renamed(images(spark, tmp_path / "in"), *args).count()
    assert again == len(out) and content(tmp_path / "in") == expected()


def test_taken_names_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_text("a")
    (tmp_path / "in" / "a.txt").write_text("text of a")
    (tmp_path / "in" / "1.txt").write_text("of no image")
    with pytest.raises(FileExistsError, match="1.txt"):
        actions.renamed(images(spark, tmp_path / "in"), order(), table, str(tmp_path / "j"))
    assert content(tmp_path / "in") == {"a.png": "a", "a.txt": "text of a", "1.txt": "of no image"}


def test_moves_write_nothing_over(spark, tmp_path):
    for name, text in (("in/a.png", "new"), ("in/b.png", "b"), ("out/a.png", "old"), ("out/b.png", "b")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = images(spark, tmp_path / "in")
    with pytest.raises(Exception, match="other content"):
        actions.moved(found.filter("stem = 'a'"), str(tmp_path / "out"), table).collect()
    assert (tmp_path / "in" / "a.png").read_text() == "new" and (tmp_path / "out" / "a.png").read_text() == "old"
    assert [r.outcome for r in actions.moved(found.filter("stem = 'b'"), str(tmp_path / "out"), table).collect() if r.source.endswith("png")] == ["done"]
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "a.png").write_text("other")
    with pytest.raises(FileExistsError, match="several files"):
        actions.moved(found.unionByName(images(spark, tmp_path / "in2")), str(tmp_path / "new"), table)
