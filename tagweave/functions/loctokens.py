"""Location tokens of vision-language output: task queries, region strings, boxes, quads, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.tags import let

RANGE = 1000

# Task, token, prompt, needs region, needs sub-prompt, returns text, labels, boxes, polygons.
TASKS = (
    ("Caption", "<CAPTION>", "What does the image describe?", False, False, True, False, False, False),
    ("DetailedCaption", "<DETAILED_CAPTION>", "Describe in detail what is shown in the image.", False, False, True, False, False, False),
    ("MoreDetailedCaption", "<MORE_DETAILED_CAPTION>", "Describe with a paragraph what is shown in the image.", False, False, True, False, False, False),
    ("Ocr", "<OCR>", "What is the text in the image?", False, False, True, False, False, False),
    ("OcrWithRegions", "<OCR_WITH_REGION>", "What is the text in the image, with regions?", False, False, False, True, True, True),
    ("ObjectDetection", "<OD>", "Locate the objects with category name in the image.", False, False, False, True, True, False),
    ("DenseRegionCaption", "<DENSE_REGION_CAPTION>", "Locate the objects in the image, with their descriptions.", False, False, False, True, True, False),
    ("RegionProposal", "<REGION_PROPOSAL>", "Locate the region proposals in the image.", False, False, False, True, True, False),
    ("CaptionToGrounding", "<CAPTION_TO_PHRASE_GROUNDING>", "Locate the phrases in the caption: {0}", False, True, False, True, True, False),
    ("ReferringExpressionSegmentation", "<REFERRING_EXPRESSION_SEGMENTATION>", "Locate {0} in the image with mask", False, True, False, False, False, True),
    ("OpenVocabularyDetection", "<OPEN_VOCABULARY_DETECTION>", "Locate {0} in the image.", False, True, False, True, False, True),
    ("RegionToSegmentation", "<REGION_TO_SEGMENTATION>", "What is the polygon mask of region {0}", True, False, False, False, False, True),
    ("RegionToCategory", "<REGION_TO_CATEGORY>", "What is the region {0}?", True, False, True, False, False, False),
    ("RegionToDescription", "<REGION_TO_DESCRIPTION>", "What does the region {0} describe?", True, False, True, False, False, False),
    ("RegionToOcr", "<REGION_TO_OCR>", "What text is in the region {0}?", True, False, True, False, False, False),
)
# The token patterns in ``numbers``, ``boxes``, ``quads`` and ``labelled_polygons`` are the format's own.
TASK_SCHEMA = "task string, token string, prompt string, needs_region boolean, needs_sub_prompt boolean, text boolean, labels boolean, boxes boolean, polygons boolean"


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TASKS), TASK_SCHEMA)


def region_tokens(left: float, top: float, right: float, bottom: float) -> str:
    """Region of fractions as tokens."""
    return "".join(f"<loc_{min(max(int(v * RANGE), 0), RANGE - 1)}>" for v in (left, top, right, bottom))


def task_query(task: str, region: tuple[float, float, float, float] | None = None, sub_prompt: str | None = None) -> str:
    """The prompt of a task; it must be given exactly what it needs."""
    row = next((t for t in TASKS if t[0] == task), None)
    if row is None:
        raise ValueError(f"unknown task {task}")
    if row[3] != (region is not None) or row[4] != (sub_prompt is not None):
        raise ValueError(f"{task} {'needs' if row[3] or row[4] else 'takes no'} region or sub-prompt")
    return row[2].replace("{0}", region_tokens(*region) if region else sub_prompt or "")


def encoded(*values: Column) -> Column:
    """Fractions as location tokens."""
    return F.concat(*[F.concat(F.lit("<loc_"), F.least(F.greatest((v * RANGE).cast("int"), F.lit(0)), F.lit(RANGE - 1)).cast("string"), F.lit(">")) for v in values])


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<loc_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def region(text: Column, width: Column, height: Column) -> Column:
    """Exactly four tokens as (x, y, w, h) in whole pixels; else null."""
    n = numbers(text)
    at = lambda i, size: F.floor(F.element_at(n, i) * size / RANGE).cast("int")
    x, y = at(1, width), at(2, height)
    return F.when(F.size(n) == 4, F.struct(x.alias("x"), y.alias("y"), (at(3, width) - x).alias("w"), (at(4, height) - y).alias("h")))


def _scaled(v: Column, size: Column, half: float = 0.5) -> Column:
    return ((v + half) * size / RANGE).cast("int")


def boxes(text: Column, width: Column, height: Column) -> Column:
    """(label, x, y, w, h) for each group of four tokens after a label; a label is its last word only."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\w+(?:<loc_\d+><loc_\d+><loc_\d+><loc_\d+>)+)"), F.lit(1))

    def of(run: Column) -> Column:
        label = F.substring_index(run, "<loc_", 1)
        at = lambda n, i, k: F.element_at(n, (i * 4 + k).cast("int"))
        return let(numbers(run), lambda n: F.transform(F.sequence(F.lit(0), (F.size(n) / 4).cast("int") - 1), lambda i: F.struct(
            label.alias("label"), _scaled(at(n, i, 1), width).alias("x"), _scaled(at(n, i, 2), height).alias("y"),
            _scaled(at(n, i, 3) - at(n, i, 1), width, 0.0).alias("w"), _scaled(at(n, i, 4) - at(n, i, 2), height, 0.0).alias("h"))))

    return F.flatten(F.transform(runs, of))


def _points(tokens: Column, width: Column, height: Column, count) -> Column:
    """Pairs of token numbers as points; ``count`` gives how many, from the numbers."""
    none = F.array().cast("array<struct<x:int,y:int>>")
    point = lambda n, i: F.struct(_scaled(F.element_at(n, (i * 2 - 1).cast("int")), width).alias("x"), _scaled(F.element_at(n, (i * 2).cast("int")), height).alias("y"))
    return let(tokens, lambda n: F.when(count(n) > 0, F.transform(F.sequence(F.lit(1), count(n)), lambda i: point(n, i))).otherwise(none))


def quads(text: Column, width: Column, height: Column) -> Column:
    """(label, points, x, y, w, h): four corners and their bounding rectangle, for a label and exactly eight tokens."""
    runs = F.regexp_extract_all(text, F.lit(r"([^<]+(?:<loc_\d+>){8})"), F.lit(1))

    def of(run: Column) -> Column:
        def framed(p: Column) -> Column:
            xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
            return F.struct(F.substring_index(run, "<loc_", 1).alias("label"), p.alias("points"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))

        return let(_points(numbers(run), width, height, lambda n: F.lit(4)), framed)

    return F.transform(runs, of)


def labelled_polygons(text: Column, width: Column, height: Column) -> Column:
    """(label, points) of label<poly>tokens</poly>; points are null where the number of tokens is odd."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\w+<poly>(?:<loc_\d+>)+</poly>)"), F.lit(1))

    def of(run: Column) -> Column:
        n = numbers(run)
        points = F.when(F.size(n) % 2 == 0, _points(n, width, height, lambda m: (F.size(m) / 2).cast("int")))
        return F.struct(F.substring_index(run, "<poly>", 1).alias("label"), points.alias("points"))

    return F.transform(runs, of)


def polygon(text: Column, width: Column, height: Column) -> Column:
    """All tokens as one polygon; a last x without y is dropped."""
    return _points(numbers(text), width, height, lambda n: F.floor(F.size(n) / 2).cast("int"))


def parsed(text: Column, width: Column, height: Column, task: Column) -> Column:
    """(text, boxes, quads, labelled, polygon) as the flags of the task row say; the others are null."""
    q = task["labels"] & task["boxes"] & task["polygons"]
    b = task["labels"] & task["boxes"] & ~task["polygons"]
    lp = task["labels"] & ~task["boxes"] & task["polygons"]
    p = ~task["labels"] & task["polygons"]
    return F.struct(F.when(~q & ~b & ~lp & ~p & task["text"], text).alias("text"), F.when(b, boxes(text, width, height)).alias("boxes"), F.when(q, quads(text, width, height)).alias("quads"), F.when(lp, labelled_polygons(text, width, height)).alias("labelled"), F.when(p, polygon(text, width, height)).alias("polygon"))


def zipped(labels: Column, found: Column) -> Column:
    """Lines "'label' -> [w, h]", as many as the shorter list has."""
    n = F.least(F.size(labels), F.size(found))
    return F.array_join(F.zip_with(F.slice(labels, F.lit(1), n), F.slice(found, F.lit(1), n), lambda a, b: F.format_string("'%s' -> [%d, %d]", a, b["w"], b["h"])), "\n")
