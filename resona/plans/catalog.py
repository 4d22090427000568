"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_eval,
    catalog_ingest,
    catalog_labels,
    catalog_metrics,
    catalog_streaming,
    catalog_text,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
