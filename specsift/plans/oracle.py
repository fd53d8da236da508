"""DuckDB twins of the fixture views and the SQL oracles for ``queries()``.

Each oracle is plain SQL over the driver's base tables: a WITH prelude
re-derives the views, then the query follows.  Text is written from the
arithmetic of each operator, not from the Spark code.
"""

from __future__ import annotations

W = r"'([\p{L}\p{N}_]+)'"  # word pattern (Unicode letters, digits, underscore)

VIEWS = {
    "entries": """
  SELECT p_partkey AS entry_pos, 'lemma_' || replace(p_name,' ','_') AS name,
    'src/' || lower(p_type) || '/' || replace(lower(p_brand),'#','_') || '.rs' AS file_path,
    CAST(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS INTEGER) AS line_number,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'About ' || p_name || ' of ' || lower(p_type) END AS documentation,
    'pub proof fn lemma_' || replace(p_name,' ','_') || '(x: int, y: int)' AS signature,
    CASE p_partkey % 4 WHEN 1 THEN list_value('x > ' || CAST(p_size % 5 AS VARCHAR))
                       WHEN 2 THEN list_value('x > ' || CAST(p_size % 5 AS VARCHAR), 'y > 0')
                       ELSE CAST([] AS VARCHAR[]) END AS requires_clauses,
    CASE p_partkey % 4 WHEN 3 THEN CAST([] AS VARCHAR[])
                       ELSE list_value('x * ' || CAST(p_size % 6 AS VARCHAR) || ' >= y') END AS ensures_clauses,
    'sym ' || CAST(p_partkey AS VARCHAR) AS symbol_id,
    CASE WHEN p_partkey % 3 = 0 THEN 'reflib' ELSE 'project' END AS source
  FROM part""",
    "occ": """
  SELECT 'sym ' || CAST(l_partkey AS VARCHAR) AS symbol_id,
    'src/doc_' || CAST(l_suppkey AS VARCHAR) || '.rs' AS doc_path,
    l_linenumber AS symbol_roles,
    CASE WHEN l_quantity % 10 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS start_line,
    l_suppkey AS doc_pos, l_orderkey AS k1, l_extendedprice AS k2, l_shipdate AS k3, l_quantity AS k4
  FROM lineitem""",
    "src": """
  SELECT file_path, string_agg(decl, '' ORDER BY p_partkey) AS content FROM (
    SELECT 'src/' || lower(p_type) || '/' || replace(lower(p_brand),'#','_') || '.rs' AS file_path, p_partkey,
      CASE WHEN p_partkey % 5 = 0 THEN 'pub fn lemma_' ELSE 'pub proof fn lemma_' END
      || replace(p_name,' ','_') || '_' || CAST(p_partkey AS VARCHAR) || '(x: int, y: int)' || chr(10)
      || CASE WHEN p_partkey % 4 IN (1,2) THEN '    requires x > ' || CAST(p_size AS VARCHAR) || ', y > 0,' || chr(10) ELSE '' END
      || CASE WHEN p_partkey % 4 <> 3 THEN '    ensures x * y >= ' || CAST(p_size AS VARCHAR) || ',' || chr(10) ELSE '' END
      || CASE WHEN p_partkey % 6 = 0 THEN '    decreases x' || chr(10) ELSE '' END
      || CASE WHEN p_partkey % 13 = 0 THEN ';' ELSE '{' || chr(10) || '}' END || chr(10) AS decl FROM part) t
  GROUP BY file_path""",
    "docs": """
  SELECT doc_id AS entry_pos, 'doc_' || CAST(doc_id AS VARCHAR) AS name,
    'docs/' || source || '/' || lang || '.txt' AS file_path, CAST(NULL AS INTEGER) AS line_number,
    string_split(text, chr(10))[1] AS documentation, source || ' ' || lang AS signature,
    CAST([] AS VARCHAR[]) AS requires_clauses,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ensures_clauses,
    'doc ' || CAST(doc_id AS VARCHAR) AS symbol_id, lang AS source
  FROM documents""",
    "nodes": """
  SELECT conv_id*1000+turn AS node_id, 'doc_' || CAST(conv_id % 100 AS VARCHAR) AS display_name, text AS body
  FROM conversations""",
    "vectors": "SELECT vec_id AS entry_pos, embedding AS v FROM embeddings",
    "query_batch": "SELECT item_id AS query_id, text AS query FROM benchmark",
}


def prelude(*names: str, extra: dict[str, str] | None = None) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(parts) + "\n"


def searchable(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (
        f"concat_ws(' ', 'Name: ' || {a}name, 'Documentation: ' || coalesce({a}documentation, ''), "
        f"'Signature: ' || {a}signature, "
        f"CASE WHEN len({a}requires_clauses) > 0 THEN 'Preconditions: ' || array_to_string({a}requires_clauses, ' AND ') END, "
        f"CASE WHEN len({a}ensures_clauses) > 0 THEN 'Postconditions: ' || array_to_string({a}ensures_clauses, ' AND ') END)"
    )


def keyword_scores_sql(corpus: str, queries: str, keys: str = "query_id", text: str = "query",
                       p: str = "") -> dict[str, str]:
    """CTEs computing {p}kw: (keys, entry_pos, score) for all pairs with score > 0."""
    return {
        f"{p}kq": f"SELECT DISTINCT {keys}, unnest(regexp_extract_all(lower({text}), {W}, 1)) AS term FROM {queries}",
        f"{p}ke": f"""SELECT entry_pos, name, lower(name) AS lname, lower(coalesce(documentation,'')) AS ldoc,
                  list_distinct(regexp_extract_all(lower({searchable()}), {W}, 1)) AS terms FROM {corpus}""",
        f"{p}ket": f"SELECT DISTINCT entry_pos, unnest(terms) AS term FROM {p}ke",
        f"{p}kw": f"""SELECT {keys}, entry_pos, CAST(sum(w) AS DOUBLE) AS score FROM (
                    SELECT {keys}, entry_pos, 1.0 AS w FROM {p}kq JOIN {p}ket USING (term)
                    UNION ALL
                    SELECT {keys}, entry_pos,
                      CASE WHEN instr(ke.lname, kq.term) > 0 THEN 2.0 ELSE 0.0 END
                      + CASE WHEN instr(ke.ldoc, kq.term) > 0 THEN 1.5 ELSE 0.0 END AS w
                    FROM {p}kq kq JOIN {p}ke ke ON instr(ke.lname, kq.term) > 0 OR instr(ke.ldoc, kq.term) > 0) u
                  GROUP BY ALL HAVING sum(w) > 0""",
    }


def keyword_search_sql(corpus_view: str, k: int = 10) -> str:
    ctes = {"c": f"SELECT * FROM {corpus_view}", "qb": "SELECT * FROM query_batch"}
    ctes.update(keyword_scores_sql("c", "qb"))
    ctes["r"] = "SELECT kw.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_pos) AS rank FROM kw"
    return prelude(corpus_view, "query_batch", extra=ctes) + f"""
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.entry_pos, c.name, r.score
FROM r JOIN c USING (entry_pos) WHERE r.rank <= {k}"""


# --------------------------------------------------------------------------
# Hashed-vector cosine, hybrid and fuzzy search (SQL twins of Q2-Q6).
DIMS = 256
KEYWORD_WEIGHT = 0.3


def _k(keys, alias=""):
    a = f"{alias}." if alias else ""
    return ", ".join(f"{a}{k}" for k in keys)


def sparse_sql(src: str, keys: list[str], text: str, dims: int = DIMS) -> str:
    return f"""SELECT {_k(keys)}, bucket, CAST(sum(sgn) AS BIGINT) AS v FROM (
      SELECT {_k(keys)}, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % {dims} AS INTEGER) AS bucket,
             CASE WHEN CAST('0x' || substr(h, 9, 1) AS INTEGER) % 2 = 1 THEN -1 ELSE 1 END AS sgn
      FROM (SELECT {_k(keys)}, md5(unnest(regexp_extract_all(lower({text}), {W}, 1))) AS h FROM {src}) a) b
    GROUP BY ALL HAVING sum(sgn) <> 0"""


def ids_digest(text: str, dims: int = DIMS) -> str:
    """Columns n_ids and ids_sum of the signed bucket ids of a text."""
    toks = f"regexp_extract_all(lower({text}), {W}, 1)"
    sign = "CASE WHEN CAST('0x' || substr(md5(x), 9, 1) AS INTEGER) % 2 = 1 THEN -1 ELSE 1 END"
    one = f"({sign}) * (CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % {dims} + 1)"
    return (f"CAST(len({toks}) AS INTEGER) AS n_ids, CAST(coalesce(list_sum(list_transform({toks}, lambda x: {one})), 0) AS BIGINT) AS ids_sum")


def semantic_ctes(p: str, corpus: str, queries: str, keys: list[str], text: str, n: int) -> dict[str, str]:
    """CTE {p}sem: keys, rank, entry_pos, name, score (top n by score desc, entry_pos)."""
    on = " AND ".join(f"dt.{k} = qn.{k}" for k in keys)
    return {
        f"{p}qs": sparse_sql(queries, keys, text),
        f"{p}qn": f"SELECT {_k(keys)}, sum(v * v) AS n2 FROM {p}qs GROUP BY ALL",
        f"{p}dt": f"SELECT {_k(keys, 'q')}, e.entry_pos, sum(q.v * e.v) AS dot FROM {p}qs q JOIN ces e USING (bucket) GROUP BY ALL",
        f"{p}sc": f"""SELECT {_k(keys, 'qn')}, en.entry_pos,
            CAST(coalesce(dt.dot, 0) AS DOUBLE) / sqrt(CAST(qn.n2 AS DOUBLE) * CAST(en.n2 AS DOUBLE)) AS score
            FROM {p}qn qn CROSS JOIN cen en LEFT JOIN {p}dt dt ON {on} AND dt.entry_pos = en.entry_pos""",
        f"{p}sem": f"""SELECT * FROM (SELECT s.*, c.name, CAST(row_number() OVER (PARTITION BY {_k(keys, 's')}
            ORDER BY s.score DESC, s.entry_pos) AS INTEGER) AS rank FROM {p}sc s JOIN {corpus} c USING (entry_pos)) x
            WHERE rank <= {n}""",
    }


def corpus_vector_ctes(corpus: str) -> dict[str, str]:
    text = _ops(searchable())
    return {
        "ces": sparse_sql(corpus, ["entry_pos"], text),
        "cen": "SELECT entry_pos, sum(v * v) AS n2 FROM ces GROUP BY ALL",
    }


def _ops(x: str) -> str:
    from .q_text import _ops_sql

    return _ops_sql(x)


def keyword_top_ctes(p: str, corpus: str, queries: str, keys: list[str], text: str, n: int) -> dict[str, str]:
    """CTE {p}kwt: keys, rank, entry_pos, name, score (keyword top n)."""
    ctes = keyword_scores_sql(corpus, queries, _k(keys), text, p)
    ctes[f"{p}kwt"] = f"""SELECT * FROM (SELECT w.*, c.name, CAST(row_number() OVER (PARTITION BY {_k(keys, 'w')}
        ORDER BY w.score DESC, w.entry_pos) AS INTEGER) AS rank FROM {p}kw w JOIN {corpus} c USING (entry_pos)) x
        WHERE rank <= {n}"""
    return ctes


def hybrid_ctes(p: str, keys: list[str], n: int, w: float = KEYWORD_WEIGHT) -> dict[str, str]:
    """Given {p}sem and {p}kwt (depth 2n), CTE {p}hyb: keys, rank, entry_pos, name, score."""
    sw = repr(1 - w)
    kk = _k(keys)
    return {
        f"{p}sn": f"""SELECT s.*, CASE WHEN m.mx > 0 THEN s.score / m.mx ELSE 0.0 END * CAST({sw} AS DOUBLE) AS c
            FROM {p}sem s JOIN (SELECT {kk}, max(score) AS mx FROM {p}sem GROUP BY ALL) m USING ({kk})""",
        f"{p}sg": f"""SELECT {kk}, name, arg_max(entry_pos, rank) AS s_entry, arg_max(c, rank) AS s_c, min(rank) AS first_s
            FROM {p}sn GROUP BY ALL""",
        f"{p}kn": f"""SELECT k.*, (k.score / m.mx) * CAST({w!r} AS DOUBLE) AS c
            FROM {p}kwt k JOIN (SELECT {kk}, max(score) AS mx FROM {p}kwt GROUP BY ALL) m USING ({kk})""",
        f"{p}kg": f"""SELECT {kk}, name, list(c ORDER BY rank) AS cs, arg_min(entry_pos, rank) AS k_entry, min(rank) AS first_k
            FROM {p}kn GROUP BY ALL""",
        f"{p}hj": f"""SELECT {kk}, name, coalesce(s_entry, k_entry) AS entry_pos,
            list_reduce(coalesce(cs, CAST([] AS DOUBLE[])), lambda a, x: a + x, coalesce(s_c, CAST(0.0 AS DOUBLE))) AS score,
            CASE WHEN s_entry IS NOT NULL THEN 0 ELSE 1 END AS grp, coalesce(first_s, first_k) AS first
            FROM {p}sg FULL JOIN {p}kg USING ({kk}, name)""",
        f"{p}hyb": f"""SELECT * FROM (SELECT {kk}, name, entry_pos, score, CAST(row_number() OVER (PARTITION BY {kk}
            ORDER BY score DESC, grp, first) AS INTEGER) AS rank FROM {p}hj) x WHERE rank <= {n}""",
    }


def fuzzy_ctes(p: str, corpus: str, queries: str, key: str, text: str, k: int) -> dict[str, str]:
    """Given corpus vector CTEs (ces, cen), CTE {p}fz: key, rank, entry_pos, name, score."""
    from .q_text import normalize_sql, variations_sql

    keys = [key, "var_pos"]
    ctes = {f"{p}var": variations_sql(queries, key, normalize_sql(text))}
    ctes.update(semantic_ctes(p, corpus, f"{p}var", keys, "variation", 4 * k))
    ctes.update(keyword_top_ctes(p, corpus, f"{p}var", keys, "variation", 4 * k))
    ctes.update(hybrid_ctes(p, keys, 2 * k))
    ctes[f"{p}bst"] = f"""SELECT {key}, name, entry_pos, score,
        row_number() OVER (PARTITION BY {key}, name ORDER BY score DESC, var_pos) AS rb,
        min(var_pos * 100000 + rank) OVER (PARTITION BY {key}, name) AS first FROM {p}hyb"""
    ctes[f"{p}fz"] = f"""SELECT * FROM (SELECT {key}, name, entry_pos, score, CAST(row_number() OVER (PARTITION BY {key}
        ORDER BY score DESC, first) AS INTEGER) AS rank FROM {p}bst WHERE rb = 1) x WHERE rank <= {k}"""
    return ctes
