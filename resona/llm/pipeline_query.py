"""The whole pipeline as a registered query."""

from __future__ import annotations

import corpus_pipeline

from .registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
