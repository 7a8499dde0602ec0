"""Grouping of spelling variants by Aho-Corasick halves.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  Cut the longer of them
(either, if they are as long) in two segments: the edit lies in one, so the other stands unchanged at the same end of the shorter one.

1. Segments: every word is a pattern with its two segments, and a text that is scanned for the segments which words of its own
   length, or of one more, have at its ends.  Rows meet by segment, end and length.
2. Hot segments: where more than ``rows`` rows would meet, the unknown part is cut in two again, and rows meet by what
   is known at both ends, until few meet or one code point is unknown, where only an alphabet of words can meet.
3. Scan: the segments of a shard are compiled into one automaton (pyahocorasick) that reads all words of the shard.  A hit counts at
   the right offset of a word of compatible length; then the unknown parts are compared, which verifies the distance.
4. Forms: the most frequent near word of each word, if it is ``ratio`` times as frequent; roots by doubling the steps along forms.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, taken from whole texts; some runs lose a code point as the caller's ``edit`` says.
Tables of words are joined by shuffles (merge hints): files of a few MB, which Spark would broadcast through the driver, hold millions of words.
Null and empty texts have no words; a null doc_id counts as an empty one in the edit.  Runs of any length are whole words.  Equal rows count each.  Ties between forms go to the
smallest word in code-point order.  An empty table gives an empty result.  Of columns only doc_id and text are read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.rows import expanded
from tagweave.plans.storage import drop, table, tasks_for

_ROW = "word string, n long, pattern boolean, whole int, lo int, hi int, key long"
_PAIR = "a string, b string, a_n long, b_n long"


@dataclass(frozen=True)
class SpellingParams:
    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    rows: int = 256  # rows that may meet; beyond that the segment is split
    shard_rows: int = 20_000  # rows of one automaton, about
    task_rows: int = 200_000
    compared: int = 1 << 20  # code points compared at a time


def dropped_letters(modulus: int = 31) -> Callable[[Column, Column], Column]:
    """An edit by checksum: where ``modulus`` divides the crc32 of ``<doc_id>:<run>``, one code point of the run goes."""

    def edit(run: Column, doc_id: Column) -> Column:
        h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
        at = F.pmod(h, F.length(run).cast("long")).cast("int")
        return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return edit


def vocabulary(docs: DataFrame, p: SpellingParams = SpellingParams(), edit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("([a-zÀ-ÿ]+)"))).alias("word"))
    runs = runs.filter(F.length("word") >= p.least_length)
    if edit is not None:
        runs = runs.select(edit(F.col("word"), F.col("doc_id")).alias("word")).filter(F.length("word") >= p.least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= p.least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of what is known: the first ``lo`` code points and those from ``hi`` on of a word of ``whole``."""
    end = F.col("whole") - F.col("hi")
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.substring(F.col("word"), F.length("word") - end + 1, end)
    return rows.withColumn("key", F.xxhash64("whole", "lo", "hi", head, tail))


def _halves(lo: Column, hi: Column) -> Column:
    """The two parts of lo..hi in which the edit may lie."""
    mid = ((lo + hi) / 2).cast("int")
    return F.array(F.struct(mid.alias("lo"), hi.alias("hi")), F.struct(lo.alias("lo"), mid.alias("hi")))


def _segments(words: DataFrame) -> DataFrame:
    size = F.length("word")
    roles = F.array(F.struct(F.lit(True).alias("pattern"), size.alias("whole")), F.struct(F.lit(False).alias("pattern"), size.alias("whole")), F.struct(F.lit(False).alias("pattern"), (size + 1).alias("whole")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.pattern", "r.whole")
    return rows.select("*", F.explode(_halves(F.lit(0), F.col("whole"))).alias("x")).select("word", "n", "pattern", "whole", "x.lo", "x.hi")


def meetings(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """Rows of ``_ROW`` such that words which may be near share a key; no key has many rows."""
    ready, now = None, _keyed(_segments(words))
    while True:
        sizes = now.groupBy("key").agg(F.count("*").alias("c"), F.count_if("pattern").alias("patterns"))
        sizes = sizes.filter("c > 2 AND patterns > 0")  # a word alone meets itself only
        sized = table(now.join(sizes.select("key", "c").hint("merge"), "key").select("word", "n", "pattern", "whole", "lo", "hi", "key", "c"), "spelling-met")
        split = (F.col("c") > p.rows) & (F.col("hi") - F.col("lo") > 1)
        done = sized.filter(~split).drop("c")
        ready = done if ready is None else ready.unionByName(done)
        hot = sized.filter(split)
        if hot.isEmpty():
            return ready
        parts = hot.select("word", "n", "pattern", "whole", F.explode(_halves(F.col("lo"), F.col("hi"))).alias("x"))
        now = _keyed(parts.select("word", "n", "pattern", "whole", "x.lo", "x.hi"))


def _codes(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of several columns, equal for equal rows."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, number = np.unique(c, return_inverse=True)
        out = np.unique(out * len(values) + number, return_inverse=True)[1]
    return out


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of ``x`` become those of ``y``, as wide or one narrower, by exactly one replaced or deleted code point."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    before = np.cumprod(x[:, :-1] == y, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    after = np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return before + after >= y.shape[1]


def near_pairs(shard: pa.Table, p: SpellingParams) -> pa.RecordBatch:
    """Pairs of near words of one shard, found by an automaton of its segments."""
    every = shard.column("word").to_pylist()
    number: dict[str, int] = {}
    word = np.array([number.setdefault(w, len(number)) for w in every])
    words = list(number)
    pattern, whole, lo, hi, n = (shard.column(c).to_numpy() for c in ("pattern", "whole", "lo", "hi", "n"))
    pattern = pattern.astype(bool)
    segments: dict[str, int] = {}
    head, tail = np.full(len(word), -1), np.full(len(word), -1)
    for i in np.flatnonzero(pattern).tolist():
        if lo[i]:
            head[i] = segments.setdefault(every[i][: lo[i]], len(segments))
        if hi[i] < whole[i]:
            tail[i] = segments.setdefault(every[i][hi[i] :], len(segments))
    machine = ahocorasick.Automaton()
    for s, k in segments.items():
        machine.add_word(s, k)
    machine.make_automaton()
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    joined = "\n".join(words)
    hits = np.fromiter(chain.from_iterable(machine.iter(joined) if segments else ()), np.int64).reshape(-1, 2)
    end, hit = hits[:, 0] + 1, hits[:, 1]
    long = np.array([len(s) for s in segments], np.int64)[hit]
    owner = np.searchsorted(start, end - 1, "right") - 1
    # a text has the segment of a pattern where the automaton hit it at the same end, with the same length
    span = int(size.max(initial=0)) + 2
    texts = np.flatnonzero(~pattern)
    for side, known, at_end in ((head, lo, end - long == start[owner]), (tail, whole - hi, end == (start + size)[owner])):
        place = owner[at_end] * span + long[at_end]
        order = np.argsort(place)
        place, what = place[order], hit[at_end][order]
        asked = word[texts] * span + known[texts]
        at = np.searchsorted(place, asked)
        found = np.zeros(len(texts), bool)
        found[at < len(place)] = place[at[at < len(place)]] == asked[at < len(place)]
        side[texts[found]] = what[at[found]]
        side[texts[~found & (known[texts] > 0)]] = -2
    texts = texts[(head[texts] != -2) & (tail[texts] != -2)]
    meet = _codes([head, tail, whole, lo, hi])
    patterns = np.flatnonzero(pattern)
    patterns = patterns[np.argsort(meet[patterns], kind="stable")]
    a, b = (np.searchsorted(meet[patterns], meet[texts], s) for s in ("left", "right"))
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    width = hi[texts] - lo[texts]
    short = whole[texts] - size[word[texts]]
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for w, d in sorted(set(zip(width[b > a].tolist(), short[b > a].tolist(), strict=True))):
        mine = np.flatnonzero((width == w) & (short == d) & (b > a))
        total = np.cumsum((b - a)[mine])
        cuts = np.searchsorted(total, np.arange(0, total[-1], max(1, p.compared // w)), "left")
        for i, j in zip(cuts, [*cuts[1:], len(mine)], strict=True):
            m = mine[i:j]
            x = patterns[expanded(a[m], (b - a)[m])]
            y = np.repeat(texts[m], (b - a)[m])
            if not d:  # each pair of words as long is met from both sides
                once = word[x] < word[y]
                x, y = x[once], y[once]
            at = lo[x][:, None] + np.arange(w)
            near = _one_edit(letters[start[word[x]][:, None] + at], letters[start[word[y]][:, None] + at[:, : w - d]])
            kept.append((x[near], y[near]))
    x, y = (np.concatenate([k[s] for k in kept]) if kept else np.zeros(0, np.int64) for s in (0, 1))
    strings = pa.array(words, pa.string())
    one, two = strings.take(pa.array(word[x])), strings.take(pa.array(word[y]))
    return pa.RecordBatch.from_arrays([one, two, pa.array(n[x], pa.int64()), pa.array(n[y], pa.int64())], names=["a", "b", "a_n", "b_n"])


def _scanned(p: SpellingParams):
    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= p.shard_rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield near_pairs(whole.slice(0, cut), p)
                held = whole.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield near_pairs(pa.Table.from_batches(held).combine_chunks(), p)

    return run


def near_words(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """(a, b, a_n, b_n): every pair of near words of ``words`` (word, n) once."""
    rows = meetings(words, p)
    parts = max(tasks_for(words.sparkSession), -(-rows.count() // p.task_rows))
    pairs = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_scanned(p), _PAIR)
    swapped = F.col("a") > F.col("b")
    ends = [F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("a_n", "b_n"), ("b_n", "a_n"))]
    return pairs.select(*ends).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): every round doubles the steps."""
    now = table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.filter("moved").isEmpty():
        further = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        after = now.join(further.hint("merge"), F.col("root") == F.col("_at"), "left")
        before, now = now, table(after.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "spelling-roots")
        drop(before)
    return now.drop("moved")


def grouped(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n)."""
    words = table(words, "spelling-words")
    pairs = near_words(words, p)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n")))
    best = both.groupBy("a", "a_n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("x"))
    form = -F.col("x.less") >= p.ratio * F.col("a_n")
    best = table(best.select(F.col("a").alias("word"), "n_near", F.when(form, F.col("x.b")).alias("form"), F.when(form, -F.col("x.less")).alias("form_n")), "spelling-best")
    roots = _roots(best.filter("form IS NOT NULL"))
    out = words.join(best.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=dropped_letters()))
