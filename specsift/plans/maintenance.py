"""Corpus maintenance jobs: spec fill (Q9) and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import hashed_ids
from ..functions.text import plain_embedding_text
from ..operators.specs import fill_impact, fill_missing_specs, spec_coverage

__all__ = ["FillResult", "fill_specs_job", "spec_coverage"]


@dataclass
class FillResult:
    entries: DataFrame          # corpus with filled clause lists (+ ``filled`` flag)
    impact: DataFrame           # one row: missing_before, missing_after, filled
    vectors: DataFrame | None   # re-encoded (plain text, F2) when anything was filled


def fill_specs_job(entries: DataFrame, reference: DataFrame, dims: int = 256,
                   reencode: bool = True) -> FillResult:
    """Q9: fill empty clause lists from the reference corpus (J3), count the
    impact (A11) and, if at least one entry was filled, re-encode every entry
    from its plain text (F2), as the reference does after a fill."""
    filled = fill_missing_specs(entries, reference)
    impact = fill_impact(filled)
    vec = None
    if reencode and filled.where("filled").limit(1).count() > 0:
        text = plain_embedding_text("name", "documentation", "signature", "requires_clauses", "ensures_clauses")
        vec = filled.select("entry_pos", hashed_ids(text, dims).alias("ids"))
    return FillResult(filled, impact, vec)
