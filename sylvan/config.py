"""Limits and weights, passed explicitly; environment variables ``SYLVAN_*`` override defaults on request."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

#: Column weights of the index: as meant, and as some SQL full-text engines in effect apply them.
DOCUMENTED = {"title": 5.0, "summary": 2.0, "body": 10.0, "code_blocks": 1.0, "front_matter": 2.0}
COMPAT = {"title": 10.0, "summary": 1.0, "body": 2.0, "code_blocks": 1.0, "front_matter": 1.0}


@dataclass(frozen=True)
class Config:
    top_k_docs: int = 3
    max_nodes_per_doc: int = 5
    budget_chars: int = 32_000
    ancestor_decay: float = 0.6
    phrase_boost: float = 1.5
    candidates: int = 5_000
    anchor_top_k: int = 5
    path_top_k: int = 3
    max_expansions: int = 40
    max_hops: int = 3
    early_stop: float = 0.95
    least_frontier: float = 0.1
    max_walked_docs: int = 20
    max_siblings: int = 2
    tree_ratio: float = 0.30
    merge_strategy: str = "interleave"
    search_mode: str = "auto"
    text_mode: str = "full"
    weights: dict = field(default_factory=lambda: dict(DOCUMENTED))

    @classmethod
    def from_env(cls, **options) -> Config:
        """Options before environment before defaults."""
        found = {}
        for f in fields(cls):
            if f.name != "weights" and (v := os.environ.get(f"SYLVAN_{f.name.upper()}")) is not None:
                found[f.name] = type(f.default)(v)
        return replace(cls(**found), **options)
