"""Captioning by a model that may be remote: one limit of requests for all tasks, and errors that cost a row.

With a limit the tasks of a captioning run are one barrier stage.  In each round they tell each other how many rows they have and
agree on a start; from it on every request slot of the whole job belongs to one task.  A slot is used at its time or not at all, and slots lie so far
apart that no ``period`` of seconds, wherever it begins, holds more than ``limit`` requests, whatever the number of tasks
and however long requests take.  The clocks of the machines must agree within ``_LEEWAY`` seconds.

An exception of the model becomes an answer that is routed like the service's own: over quota, blocked, or an invalid key.
After an invalid key no task asks any more; rows not asked have a null response and the route "unasked".
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import tags
from tagweave.sources import actions, files, folder
from tagweave.sources.places import located
from tagweave.sources.sink import write_files

# The answers that stand for errors, and what tells them apart in an exception's text.
INVALID, QUOTA, BLOCKED = "Invalid API Key!", "CHECK QUOTA", "BLOCKED CONTENT"
_TELLS = (("API_KEY_INVALID", INVALID), ("429", QUOTA))

# Our own words for what a captioner is asked by default; any other text can be given.
SYSTEM_PROMPT = (
    "Describe each image for a training set in one caption of at most fifty words. State what can be seen and nothing else: "
    "subject, action, clothing, surroundings, then light and style. Where tags are given, merge those that say the same. "
    "Name no real people. Answer with the caption alone."
)
BASE_PROMPT = "Caption this image."

_LOADED: dict[str, object] = {}
_LEEWAY = 0.1  # seconds that a request may start after its slot, clocks included
_GATHER = 1.2  # seconds from the last task's message to the first slot of a round
_ROUND = 64  # slots of a task in one round

Captioner = Callable[[list, list, str | None], list]


class InvalidKey(RuntimeError):
    pass


def once(name: str, factory: Callable[[], object]) -> object:
    """One instance of a model in each worker process."""
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def unload(name: str | None = None) -> None:
    for key in [name] if name else list(_LOADED):
        _LOADED.pop(key, None)


def answer_of(error: Exception) -> str:
    return next((answer for tell, answer in _TELLS if tell in str(error)), BLOCKED)


def asked(model: Captioner, contents: list, prompts: list, system: str | None) -> list[str]:
    """Answers of a model; where it fails on several rows, each is asked by itself."""
    try:
        out = list(model(contents, prompts, system))
        if len(out) != len(contents):
            raise ValueError(f"{len(out)} answers to {len(contents)} images")
        return out
    except Exception as e:  # noqa: BLE001
        if len(contents) == 1:
            return [answer_of(e)]
        return [a for c, p in zip(contents, prompts, strict=True) for a in asked(model, [c], [p], system)]


def slots(counts: list[int], rank: int) -> list[int]:
    """Slots of one task: tasks take turns as long as they have rows."""
    out, at = [], 0
    for turn in range(max(counts)):
        having = [r for r, c in enumerate(counts) if c > turn]
        if rank in having:
            out.append(at + having.index(rank))
        at += len(having)
    return out


def _limited(name: str, factory: Callable, system: str | None, limit: int, period: float, load: Callable | None):
    step = (period + _LEEWAY) / limit

    def run(batches):
        context = BarrierTaskContext.get()
        model = once(name, factory)
        rank, free, stopped = context.partitionId(), 0.0, False
        batch, answers = None, []
        batches = iter(batches)
        while True:
            while batch is None or len(answers) == batch.num_rows:
                if batch is not None:
                    yield batch.drop_columns(["_prompt"]).append_column("response", pa.array(answers, pa.string()))
                batch, answers = next(batches, None), []
                if batch is None:
                    break
            mine = 0 if batch is None else min(_ROUND, batch.num_rows - len(answers))
            told = [json.loads(x) for x in context.allGather(json.dumps([mine, stopped, time.time()]))]
            stopped = any(s for _, s, _ in told)
            counts = [c for c, *_ in told]
            if not any(counts):
                return
            if stopped:
                if batch is not None:
                    answers += [None] * (batch.num_rows - len(answers))
                continue
            start = max(free, max(t for *_, t in told) + _GATHER)
            free = start + step * sum(counts)
            for slot in slots(counts, rank):
                due = start + step * slot
                time.sleep(max(0.0, due - time.time()))
                if time.time() > due + _LEEWAY / 2:
                    continue  # the last answer took too long: this slot stays unused
                row = len(answers)
                content = load(batch.column("path")[row].as_py()) if load else batch.column("content")[row].as_py()
                if time.time() > due + _LEEWAY / 2:
                    continue
                answers += asked(model, [content], [batch.column("_prompt")[row].as_py()], system)
                if answers[-1] == INVALID:
                    stopped = True
                    break

    return run


def read_file(path: str) -> bytes:
    filesystem, base = located(path)
    with filesystem.open_input_stream(base) as f:
        return f.read()


def captioned(
    df: DataFrame, prompt: Column, name: str, factory: Callable[[], Captioner], system: str | None = SYSTEM_PROMPT, limit: int | None = None, period: float = 60.0, callers: int | None = None, load: Callable[[str], bytes] | None = None
) -> DataFrame:
    """Adds the response of a captioner to (content, prompt, system prompt) and its route: captioned, failed or unasked.

    The captioner takes lists of contents and prompts, and the system prompt.  With a ``limit`` it is asked one row at a time, at most so
    often in any ``period``, by ``callers`` tasks at once, which the cluster must be able to run together.  With ``load`` a
    content is read by its path when it is asked for.  Responses cost: write the result once before it is used twice."""
    rows = df.withColumn("_prompt", prompt)
    if limit is None:

        @F.pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = once(name, factory)
            for content, prompts in batches:
                contents = [load(c) for c in content] if load else content.tolist()
                yield pd.Series(asked(model, contents, prompts.tolist(), system), dtype=object)

        out = rows.withColumn("response", run("path" if load else "content", "_prompt")).drop("_prompt")
    else:
        callers = callers or df.sparkSession.sparkContext.defaultParallelism
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        out = rows.repartition(callers).mapInArrow(_limited(name, factory, system, limit, period, load), f"{schema}, response string", barrier=True)
    response = F.col("response")
    return out.withColumn("route", F.when(response.isNull() | (response == INVALID), "unasked").otherwise(files.route(response)))


def caption_folder(
    spark: SparkSession, source: str, target: str, failed: str, user_prompt: str, name: str, factory: Callable[[], Captioner], keep: actions.Keep, system: str | None = SYSTEM_PROMPT, limit: int | None = None, period: float = 60.0, callers: int | None = None
) -> DataFrame:
    """Caption the images of a folder: path, response, route.

    Images go to ``target`` with their captions as side texts, those blocked or over quota to ``failed``; what was not asked stays.  The prompt is an
    image's side text, else the user's, else the base prompt.  Images whose stem has an image in ``target`` are passed over.  Captions are
    written before their images move, so a run that breaks asks again for no more than those that had not moved.  An invalid key is an error, after what was answered has been saved."""
    folder.register(spark)
    for path in (target, failed):
        filesystem, base = located(path)
        filesystem.create_dir(base, recursive=True)
    images = spark.read.format("imagefolder").schema("path string, dir string, stem string, ext string, txt string").load(source)
    done = spark.read.format("imagefolder").schema("stem string").load(target)
    prompt = tags.first_prompt(F.col("txt"), F.lit(user_prompt), F.lit(BASE_PROMPT))
    answers = keep(captioned(files.pending(images, done), prompt, name, factory, system, limit, period, callers, read_file), "captions")
    good = answers.filter("route = 'captioned'")
    write_files(good.select(F.concat("stem", F.lit(".txt")).alias("name"), F.regexp_replace("response", r"\s+\z", "").alias("content")), target)
    for rows, path in ((good, target), (answers.filter("route = 'failed'"), failed)):
        actions.moved(rows, path, keep, sides=False).collect()
    if not answers.filter(F.col("response") == INVALID).isEmpty():
        raise InvalidKey("the captioner refused the key")
    return answers.select("path", "response", "route")
