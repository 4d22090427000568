"""All registered queries of this subpackage."""

from __future__ import annotations

from . import (  # noqa: F401
    chat,
    fingerprints,
    knn,
    manifest,
    mixing,
    near_dedup,
    pieces,
    pii,
    pipeline_query,
    planes,
    quality,
    substrings,
    token_counts,
    warc,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
