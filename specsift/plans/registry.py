"""Registered queries: key -> (spark builder, duckdb oracle or None).

Every builder reads the driver's tables at ``sf_dir`` (whole tables) and
returns a lazy DataFrame.  Column names equal the oracle's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.keyword import keyword_index
from ..sources import fixtures as fx
from . import oracle as O
from . import q_audit, q_build, q_io, q_search, q_text  # noqa: F401  (register their queries)
from ._reg import ORACLES, QUERIES, register  # noqa: F401
from .search import keyword_search


@register("keyword_search", O.keyword_search_sql("entries"))
def q_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_search(keyword_index(fx.entries(spark, sf)), fx.query_batch(spark, sf)).select(
        "query_id", "rank", "entry_pos", "name", "score"
    )


@register("keyword_search_docs", O.keyword_search_sql("docs"))
def q_keyword_search_docs(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_search(keyword_index(fx.docs(spark, sf)), fx.query_batch(spark, sf)).select(
        "query_id", "rank", "entry_pos", "name", "score"
    )
