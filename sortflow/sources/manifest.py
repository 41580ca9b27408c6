"""Declared sources: what to read, how to name and label it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from sortflow.functions.vocabulary import CATEGORIES, MIN_CONTENT_CHARS

LOCAL = "local_file"
HUB = "huggingface"


@dataclass(frozen=True)
class SourceSpec:
    """One source. ``id_column`` names a unique integer column, if the table has one: it fixes the row
    order, and makes full-row deduplication unnecessary."""

    label: str
    content_columns: tuple[str, ...]
    kind: str = LOCAL
    path: str | None = None
    dataset: str | None = None
    config: str | None = None
    split: str = "train"
    format: str | None = None
    filename_columns: tuple[str, ...] = ()
    filename_from_content_prefix: bool = False
    sample_limit: int = 0
    min_content_length: int = MIN_CONTENT_CHARS
    filters: Mapping[str, Any] = field(default_factory=dict)
    drop_duplicates: bool = True
    retries: int | None = None
    required: bool = False
    id_column: str | None = None

    def __post_init__(self) -> None:
        if self.label not in CATEGORIES:
            raise ValueError(f"Not a category: {self.label}")
        if not self.content_columns:
            raise ValueError(f"No content columns given for a {self.label} source.")
        if self.kind not in {LOCAL, HUB}:
            raise ValueError(f"No such kind of source: {self.kind}")

    @property
    def name(self) -> str:
        return self.dataset or self.path or self.label

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> SourceSpec:
        known = {f.name for f in fields(cls)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        values.setdefault("label", None)
        values.setdefault("content_columns", ())
        for key in ("sample_limit", "min_content_length"):
            if key in values:
                values[key] = int(values[key] or 0)
        return cls(**values)


@dataclass(frozen=True)
class Manifest:
    """Raw source entries stay unparsed, so that one bad entry fails alone and not the whole manifest."""

    sources: tuple[Mapping[str, Any] | SourceSpec, ...]
    label_target_counts: Mapping[str, int] = field(default_factory=dict)
    synthetic_counts: Mapping[str, int] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Manifest:
        if not isinstance(raw.get("sources"), list):
            raise ValueError("A manifest needs a list of sources.")
        return cls(
            tuple(raw["sources"]),
            dict(raw.get("label_target_counts", {})),
            dict(raw.get("synthetic_counts", {})),
        )

    @classmethod
    def load(cls, path: str) -> Manifest:
        file = Path(path)
        if not file.exists():
            raise FileNotFoundError(f"No manifest at {path}")
        return cls.from_dict(json.loads(file.read_text(encoding="utf-8")))
