"""Configuration and the setting that names every derived artifact."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

DATA_BASES = ("only_theorems", "full_text")
TOKEN_METHODS = ("plaintext", "kristianto", "lin")
GRANULARITIES = ("paragraphs", "documents")


@dataclass(frozen=True)
class Config:
    lin_max_token_length: int = 200
    debug_max_items: int | None = None
    force_gen: bool = False
    min_token_count: int = 3
    max_author_rank: int = 2

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        """Reads a JSON file; unknown keys are ignored, missing ones keep their default."""
        raw = json.loads("\n".join(r[0] for r in spark.read.text(path).limit(10_000).collect()))
        return cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})


@dataclass(frozen=True)
class Setting:
    data_basis: str = "full_text"
    token_method: str = "plaintext"
    granularity: str = "documents"

    def __post_init__(self):
        for value, known in ((self.data_basis, DATA_BASES), (self.token_method, TOKEN_METHODS), (self.granularity, GRANULARITIES)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")

    @property
    def key(self) -> str:
        return f"{self.data_basis}__{self.token_method}__{self.granularity}"
