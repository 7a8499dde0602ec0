"""Model stages as pluggable scorers: tagging, decoding loops, segmentation, inpainting, captioning.

No weights are shipped.  A scorer is a picklable factory that an executor calls once per worker; tests
use deterministic stand-ins, and nothing here claims to equal any trained model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import geometry, loctokens, pixels, scores, tags
from tagweave.operators.captions import once
from tagweave.sources import files, png

Scorer = Callable[[list], np.ndarray]


def onnx_session(path: str):
    """A CPU session of one thread, or the best provider that is there."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = 1
    wanted = ["CUDAExecutionProvider", "ROCMExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider"]
    return ort.InferenceSession(path, options, providers=[p for p in wanted if p in ort.get_available_providers()])


def scored(df: DataFrame, content: str, name: str, factory: Callable[[], Scorer], into: str = "scores") -> DataFrame:
    """Adds the model's scores of a column, computed batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(name, factory)
        for values in batches:
            yield pd.Series(list(np.asarray(model(values.tolist()), np.float32)))

    return df.withColumn(into, run(content))


def tagged(df: DataFrame, labels: Column, existing: str | None = None, threshold: float = 0.2, weighted: bool = False, mode: str = "overwrite") -> DataFrame:
    """Tag text from ``scores``: "overwrite", "append" to the existing text, or "keep" redundant tags."""
    rows = scores.ranked(F.col("scores"), labels, threshold)
    text = tags.join(scores.weighted(rows) if weighted else scores.label_list(rows))
    if mode == "append":
        text = F.when(F.col(existing).isNull() | (F.col(existing) == ""), text).otherwise(tags.appended(F.col(existing), text))
    out = df.withColumn("tag_text", text)
    return out if mode == "keep" else out.withColumn("tag_text", tags.redundancy_removed("tag_text"))


def joined_inputs(image: np.ndarray, text: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Image and text features along the sequence, and their attention mask (1 for the image, the text's own for padding)."""
    return np.concatenate([image, text], axis=1), np.concatenate([np.ones(image.shape[:2], mask.dtype), mask], axis=1)


def greedy(step: Callable[[list[int]], np.ndarray], start: int = 2, end: int = 2, most: int = 1024) -> list[int]:
    """Greedy decoding: the largest logit, first of equals, until the end token or ``most`` tokens."""
    out = [start]
    for _ in range(most):
        token = int(np.argmax(step(out)))
        out.append(token)
        if token == end:
            break
    return out


def best_mask(masks: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
    """The mask of the largest predicted overlap, the first of equals."""
    return masks[int(np.argmax(overlaps))]


def segmented(image: np.ndarray, boxes: list, encode: Callable, decode: Callable) -> np.ndarray:
    """Union mask of all boxes; the image is encoded once."""
    features = encode(pixels.segmenter_input(image))
    h, w = image.shape[:2]
    masks = [pixels.rendered_mask(best_mask(*decode(features, b)), w, h) for b in boxes]
    return pixels.combined_masks(masks)


def inpainted(image: np.ndarray, mask: np.ndarray | None, paint: Callable, tile: int = 512, overlap: int = 126) -> np.ndarray:
    """Tiles whose mask is empty pass through; without any mask the image is returned as it is."""
    if mask is None:
        return image
    h, w = image.shape[:2]

    def starts(size: int) -> list[int]:
        n = 1 if size <= tile else -(-(size - tile) // (tile - overlap)) + 1
        return [size - tile if i == n - 1 and size > tile else i * (tile - overlap) for i in range(n)]

    done = []
    for y in starts(h):
        for x in starts(w):
            part, hole = pixels.tile_pair(image, mask, x, y, tile)
            done.append((paint(part, hole) if (hole > 0).any() else part, x, y))
    return pixels.blended(done, w, h, tile, overlap)


class Registry:
    """Models by name, filled by the user: what they are for and where their files are."""

    def __init__(self):
        self.models: dict[str, dict] = {}

    def add(self, name: str, kind: str, paths: dict[str, str], **facts) -> None:
        if name in self.models:
            raise ValueError(f"{name} is there")
        self.models[name] = {"kind": kind, "paths": dict(paths), **facts}

    def of(self, name: str, kind: str | None = None) -> dict:
        found = self.models.get(name)
        if found is None or kind is not None and found["kind"] != kind:
            raise KeyError(f"no {kind or 'model'} named {name}")
        return found

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, m in self.models.items() if kind in (None, m["kind"]))

    def session(self, name: str, part: str = "model"):
        """The session of one of a model's files, once for each worker."""
        path = self.of(name)["paths"][part]
        return once(f"{name}/{part}", lambda: onnx_session(path))


def _images(df: DataFrame, f: Callable[[dict, np.ndarray], np.ndarray | None], columns: list[str]) -> DataFrame:
    """(path, content) of new images; rows whose content cannot be decoded, or for which ``f`` gives nothing, have null content."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = png.decoded(row["content"])
                made = f(row, image) if image is not None else None
                out.append(None if made is None else png.encoded(np.clip(np.rint(made), 0, 255)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return df.select("path", "content", *columns).mapInArrow(run, "path string, content binary")


SAMPLERS = ("lanczos", "mitchell", "bicubic", "detail")


def resized_files(df: DataFrame, side: int, sampler: str = "lanczos") -> DataFrame:
    """Images scaled and cut to the aspect-aligned size of ``side``, by one of four samplers."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler}")
    sized = df.withColumn("_size", files.image_size(F.col("content")))
    sized = sized.withColumn("_target", geometry.aligned_size(F.col("_size.width"), F.col("_size.height"), side))

    def one(row: dict, image: np.ndarray) -> np.ndarray:
        w, h = row["_target"].values()
        return pixels.detail_preserving(image[:, :, :3], w, h) if sampler == "detail" else pixels.crop_resized(image, w, h, sampler)

    return _images(sized, one, ["_target"])


def cropped_files(df: DataFrame, box: Column) -> DataFrame:
    """Images cut to a box (x, y, width, height in pixels, held to the image); without a box as they are."""

    def one(row: dict, image: np.ndarray) -> np.ndarray:
        if row["_box"] is None:
            return image
        x, y, w, h = (int(v) for v in row["_box"].values())
        x, y = min(max(x, 0), image.shape[1] - 1), min(max(y, 0), image.shape[0] - 1)
        return image[y : max(y + 1, min(y + h, image.shape[0])), x : max(x + 1, min(x + w, image.shape[1]))]

    return _images(df.withColumn("_box", box), one, ["_box"])


def upscaled_files(df: DataFrame, name: str, factory: Callable) -> DataFrame:
    """Images through an upscaler, which takes and gives 1 x 3 x height x width, blue first, 0 to 1."""

    def one(row: dict, image: np.ndarray) -> np.ndarray:
        out = np.asarray(once(name, factory)(pixels.upscaler_input(image[:, :, :3])))
        return out[0].transpose(1, 2, 0)[:, :, ::-1] * 255

    return _images(df, one, [])


def inpainted_files(df: DataFrame, mask: str, name: str, factory: Callable) -> DataFrame:
    """Images whose mask (a PNG in the column ``mask``, or null) is painted over, tile by tile."""

    def one(row: dict, image: np.ndarray) -> np.ndarray:
        hole = png.decoded(row[mask])
        return inpainted(image[:, :, :3], None if hole is None else hole[:, :, 0], once(name, factory))

    return _images(df, one, [mask])


def segmented_files(df: DataFrame, boxes: str, encode: Callable, decode: Callable) -> DataFrame:
    """Union masks, as PNG files, of the boxes in a column (arrays of four numbers); null without boxes."""

    def one(row: dict, image: np.ndarray) -> np.ndarray | None:
        return segmented(image[:, :, :3], row[boxes], encode, decode) if row[boxes] else None

    return _images(df, one, [boxes])


END = "</s>"


def vision(df: DataFrame, task: str, encoder: Callable, name: str, factory: Callable, region=None, sub_prompt: str | None = None, most: int = 1024) -> DataFrame:
    """A prompted vision task over (path, content): adds answer, its size and ``parsed``, by the flags of the task.

    ``encoder()`` gives the tokenizer; ``factory()`` a model with ``start(pixels, ids)``, which returns a function
    from the tokens so far to the next logits.  Decoding is greedy.  Images that cannot be read have a null answer."""
    prompt = loctokens.task_query(task, region, sub_prompt)

    def run(batches):
        words, model = once(f"{name}/words", encoder), once(name, factory)
        ids = words.ids(prompt)
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                image = png.decoded(content)
                if image is None:
                    out.append((None, None, None))
                    continue
                step = model.start(pixels.captioner_input(image[:, :, :3]), ids)
                text = words.decode(greedy(step, most=most)).strip()
                out.append((text.removesuffix(END).rstrip(), image.shape[1], image.shape[0]))
            columns = zip(*out, strict=True) if out else ((),) * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *arrays], names=["path", "answer", "width", "height"])

    answers = df.select("path", "content").mapInArrow(run, "path string, answer string, width int, height int")
    row = next(t for t in loctokens.TASKS if t[0] == task)
    flags = F.struct(*[F.lit(v).alias(n.split()[0]) for v, n in zip(row, loctokens.TASK_SCHEMA.split(", "), strict=True)])
    return answers.withColumn("parsed", loctokens.parsed(F.col("answer"), F.col("width"), F.col("height"), flags))


def pending_files(df: DataFrame, done: DataFrame) -> DataFrame:
    """Images of which no output of the same stem is there, for resuming any of these stages."""
    return files.pending(df, done)


def text_removed(df: DataFrame, detect: Callable, segment: Callable, paint: Callable, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Detect, segment, inpaint: three stages over (path, content) whose results ``keep(df, name)`` writes and rereads."""

    def stage(f, into: str, kind: pa.DataType):
        def run(batches):
            for b in batches:
                rows = b.to_pylist()
                yield b.append_column(into, pa.array([f(r) for r in rows], kind))

        return run

    schema = df.select("path", "content").schema.simpleString()[7:-1].replace(":", " ")
    found = keep(df.select("path", "content").mapInArrow(stage(lambda r: detect(r["content"]), "boxes", pa.list_(pa.list_(pa.float64()))), f"{schema}, boxes array<array<double>>"), "boxes")
    masks = keep(found.mapInArrow(stage(lambda r: segment(r["content"], r["boxes"]) if r["boxes"] else None, "mask", pa.binary()), f"{schema}, boxes array<array<double>>, mask binary"), "masks")
    return masks.mapInArrow(stage(lambda r: paint(r["content"], r["mask"]) if r["mask"] else r["content"], "result", pa.binary()), f"{schema}, boxes array<array<double>>, mask binary, result binary").select("path", "result")
