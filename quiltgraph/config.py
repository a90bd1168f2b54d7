"""Typed settings. Unknown keys are an error; secrets come from the environment."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunking, in tokens
    chunk_tokens: int = 512
    chunk_overlap: int = 32
    min_tail_tokens: int = 300
    hard_slack_tokens: int = 400
    meaningful_tokens: int = 10
    # Backslash-n twice, as four characters: real blank lines do not split.
    separator: str = "\\n\\n"
    # extraction and summaries
    model_attempts: int = 3
    short_context_tokens: int = 300
    entity_list_tokens: int = 20000
    embedding_tokens: int = 2048
    # linking
    min_docs: int = 2
    max_docs: int = 10
    model_weight: float = 0.7
    vector_weight: float = 0.3
    link_threshold: float = 7.0
    # retrieval
    route_top_k: int = 5
    rrf_k: int = 60
    expansion_limit: int = 5
    chunk_limit: int = 2
    max_turns: int = 3
    # physical limits: a side is broadcast only when a count proves it is below these
    broadcast_rows: int = 200_000
    query_block_rows: int = 4096
    salts: int = 16

    @classmethod
    def from_mapping(cls, values: dict) -> "Settings":
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)

    @property
    def chunk_step(self) -> int:
        return self.chunk_tokens - self.chunk_overlap

    def recall_width(self, top_k: int) -> int:
        return max(top_k * 2, 10)


def api_key() -> str:
    """Key of the model service, from the environment only."""
    return os.environ.get("QUILTGRAPH_API_KEY", "")
