"""Registered queries of the training-data operators and their pipeline."""

from __future__ import annotations

import corpus_pipeline

from .queries import LLM_ORACLES, LLM_QUERIES

LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
