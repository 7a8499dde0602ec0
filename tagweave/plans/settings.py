"""Settings of the operators: defaults, permitted ranges, JSON load and save."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass


def _within(low: float, high: float, default: float):
    return field(default=default, metadata={"range": (low, high)})


class _Section:
    def __post_init__(self) -> None:
        for f in fields(self):
            if "range" in f.metadata:
                low, high = f.metadata["range"]
                object.__setattr__(self, f.name, type(f.default)(min(max(getattr(self, f.name), low), high)))


@dataclass(frozen=True)
class TaggerSettings(_Section):
    threshold: float = _within(0.0, 1.0, 0.2)
    weighted: bool = False


@dataclass(frozen=True)
class CropSettings(_Section):
    score_threshold: float = _within(0.0, 1.0, 0.5)
    overlap_threshold: float = _within(0.0, 1.0, 0.35)
    expansion: float = _within(1.0, 2.0, 1.1)
    dimension: int = _within(512, 4096, 512)


@dataclass(frozen=True)
class PromptSettings(_Section):
    tags: int = _within(1, 50, 10)
    prompts: int = _within(10, 65535, 1000)


@dataclass(frozen=True)
class InpaintSettings(_Section):
    tile: int = _within(64, 4096, 512)
    overlap: int = _within(0, 512, 126)
    dilation: int = _within(0, 64, 2)


@dataclass(frozen=True)
class Settings:
    tagger: TaggerSettings = TaggerSettings()
    crop: CropSettings = CropSettings()
    prompt: PromptSettings = PromptSettings()
    inpaint: InpaintSettings = InpaintSettings()

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Missing or null sections and fields take their defaults."""
        data = json.loads(text) or {}
        sections = {}
        for f in fields(cls):
            given = data.get(f.name) or {}
            known = {x.name for x in fields(f.default)} if is_dataclass(f.default) else set()
            sections[f.name] = type(f.default)(**{k: v for k, v in given.items() if k in known and v is not None})
        return cls(**sections)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)
