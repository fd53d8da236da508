"""Columns that an operator does not read travel apart from its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REST = "rest__"


def set_apart(docs: DataFrame, used: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``docs`` with the used columns and one struct of all others, what gives
    the columns of ``docs`` back): names that an operator adds cannot clash."""
    used = [c for c in docs.columns if c in used]
    others = [c for c in docs.columns if c not in used]
    narrow = docs.select(*[F.col(f"`{c}`") for c in used], F.struct(*[F.col(f"`{c}`") for c in others]).alias(REST)) if others else docs

    def whole(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{c}`") if c in used else F.col(REST)[c].alias(c) for c in docs.columns])

    return narrow, whole
