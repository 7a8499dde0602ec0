"""Rename plans: moves among names that are taken, split into pieces that can go on at the same time.

A move that wants the name of a file which itself moves has to wait for it, so moves form chains and cycles.  A chain is carried
out from its free end: at any time exactly one of its names is free, which tells how far it has come, whoever asks.  In
every cycle the file of the least name is set aside first, and so is one in ``spread`` files of long chains, by hash, so that a folder whose files
all move up by one is many short pieces instead of one.  What is set aside gets a spare name, and its own when all pieces are done.

Chains are ranked by doubling pointers: a round joins every move with the one its pointer has reached, so the rounds are the
logarithm of the longest piece, and no chain is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def _linked(moves: DataFrame, aside: DataFrame) -> DataFrame:
    """(source, target, ptr, last, depth, least) of the moves that are not set aside; ptr is the move that has to go first."""
    rows = moves.join(aside, "source", "left_anti")
    ahead = rows.select(F.col("source").alias("_ahead"))
    rows = rows.join(ahead, rows["target"] == ahead["_ahead"], "left")
    return rows.select("source", "target", F.col("_ahead").alias("ptr"), F.coalesce("_ahead", "source").alias("last"), F.col("_ahead").isNotNull().cast("long").alias("depth"), F.col("source").alias("least"))


def _doubled(rows: DataFrame) -> DataFrame:
    on = rows.select(F.col("source").alias("_s"), F.col("ptr").alias("_p"), F.col("last").alias("_l"), F.col("depth").alias("_d"), F.col("least").alias("_m"))
    met = rows.join(on, rows["ptr"] == on["_s"], "left")
    return met.select(
        "source", "target", F.col("_p").alias("ptr"), F.coalesce("_l", "last").alias("last"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.least("least", "_m").alias("least")
    )


def pieces(moves: DataFrame, keep: Keep, spread: int = 64) -> DataFrame:
    """(source, target, aside, piece, depth) of moves with distinct sources and distinct targets.

    Rows of a piece follow each other by depth, from 0; rows set aside have no piece.  ``keep(df, name)`` writes and rereads a table."""
    moves = keep(moves.filter("source != target").select("source", "target"), "moves")
    sources = moves.select(F.col("source").alias("_taken"))
    waiting = moves.join(sources, moves["target"] == sources["_taken"], "left_semi")
    aside = keep(waiting.filter(F.pmod(F.xxhash64("source"), F.lit(spread)) == 0).select("source"), "aside")
    rows, done = _linked(moves, aside), None
    while True:
        seen = None
        while True:
            rows = keep(rows, "ranks")
            # no end was reached and no least name changed: only cycles are left, and each knows its least name
            state = rows.filter("ptr IS NOT NULL").agg(F.count("*"), F.sum(F.xxhash64("least").cast("decimal(20,0)"))).first()
            if not state[0] or state == seen:
                break
            seen, rows = state, _doubled(rows)
        ended = rows.filter("ptr IS NULL").select("source", "target", F.lit(False).alias("aside"), F.col("last").alias("piece"), "depth")
        done = ended if done is None else done.unionByName(ended)
        if not state[0]:
            break
        cycles = rows.filter("ptr IS NOT NULL")
        leaders = cycles.filter("source = least").select("source")
        aside = aside.unionByName(leaders)
        rows = _linked(cycles.select("source", "target"), leaders)
    spared = moves.join(aside, "source", "left_semi").select("source", "target", F.lit(True).alias("aside"), F.lit(None).cast("string").alias("piece"), F.lit(0).cast("long").alias("depth"))
    return done.unionByName(spared)


def spare(source: Column, name: str) -> Column:
    """A hidden name in the folder of a source that no other file has."""
    folder = F.expr("substring(source, 1, length(source) - length(substring_index(source, '/', -1)))")
    return F.concat(folder, F.lit(f".{name}-"), F.sha2(source, 256))
