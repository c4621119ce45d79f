"""Typed settings; what is not given falls back to the environment where it has a name there."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

#: Names in the environment.
ENVIRONMENT = {"model_id": "MODEL_ID", "api_key": "MODEL_API_KEY", "base_url": "MODEL_BASE_URL"}


@dataclass(frozen=True)
class Model:
    model_id: str = ""
    api_key: str = field(default="", repr=False)
    base_url: str = ""
    max_tokens: int = 0
    temperature: float = 0.0
    top_p: float = 0.0
    extra: dict = field(default_factory=dict)

    def from_environment(self) -> Model:
        return replace(self, **{f.name: os.environ.get(ENVIRONMENT[f.name], "") for f in fields(self) if f.name in ENVIRONMENT and not getattr(self, f.name)})


@dataclass(frozen=True)
class Driver:
    """The name and options of a registered driver."""

    driver: str = ""
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Memory:
    structured: Driver = Driver()
    embedding: Driver = Driver()
    vector: Driver = Driver()
    graph: Driver = Driver()


@dataclass(frozen=True)
class Retrieval:
    max_doc_size: int = 50 * 2**20
    collection: str = "documents"


@dataclass(frozen=True)
class Context:
    max_tokens: int = 102_400
    reserve: float = 0.1
    min_relevance: float = 0.3
    recency_weight: float = 0.3
    relevance_weight: float = 0.7
