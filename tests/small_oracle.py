"""The library's own SQL statements of the searches, run by DuckDB on small inline tables."""

from __future__ import annotations

import duckdb

from specsift.plans import oracle as O
from specsift.plans.q_text import normalize_sql


def search_sql(kind: str, k: int) -> str:
    """keyword, semantic, hybrid, fuzzy or keyword_only over tables c (entries) and q (query_id, query)."""
    keys = ["query_id"]
    ctes: dict[str, str] = dict(O.corpus_vector_ctes("c"))
    if kind == "keyword":
        ctes.update(O.keyword_top_ctes("s_", "c", "q", keys, "query", k))
    elif kind == "semantic":
        ctes.update(O.semantic_ctes("s_", "c", "q", keys, "query", k))
    elif kind == "hybrid":
        ctes.update(O.semantic_ctes("s_", "c", "q", keys, "query", 2 * k))
        ctes.update(O.keyword_top_ctes("s_", "c", "q", keys, "query", 2 * k))
        ctes.update(O.hybrid_ctes("s_", keys, k))
    elif kind == "fuzzy":
        ctes.update(O.fuzzy_ctes("s_", "c", "q", "query_id", "query", k))
    else:
        ctes["nq"] = f"SELECT query_id, {normalize_sql('query')} AS nq FROM q"
        ctes.update(O.keyword_top_ctes("s_", "c", "nq", keys, "nq", k))
    last = {"keyword": "s_kwt", "semantic": "s_sem", "hybrid": "s_hyb", "fuzzy": "s_fz", "keyword_only": "s_kwt"}[kind]
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes.items()) + f"\nSELECT query_id, rank, entry_pos, name, score FROM {last}"


def run(sql: str, entries: list[dict], queries: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    con.execute("CREATE TABLE c (entry_pos BIGINT, name VARCHAR, documentation VARCHAR, signature VARCHAR, "
                "requires_clauses VARCHAR[], ensures_clauses VARCHAR[])")
    cols = ("entry_pos", "name", "documentation", "signature", "requires_clauses", "ensures_clauses")
    con.executemany("INSERT INTO c VALUES (?, ?, ?, ?, ?, ?)", [[e[c] for c in cols] for e in entries])
    con.execute("CREATE TABLE q (query_id BIGINT, query VARCHAR)")
    con.executemany("INSERT INTO q VALUES (?, ?)", [list(r) for r in queries])
    return sorted((q, r, p, n, round(s, 9)) for q, r, p, n, s in con.execute(sql).fetchall())
