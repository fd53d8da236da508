"""opN queries: each applies one operator to its whole table.

Operators keep general interfaces; these thin queries fix the columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lexical, licenses, line_dedup, near_dup, packing, quality_model, quality_rules, secrets, token_files, toxicity, whitening

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _register(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn

    return add


@_register("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf, "documents"), shingle_words=4, percent=80)


@_register(
    "op5_line_dedup",
    r"""
    WITH l AS (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
             unnest(range(0, len(string_split(text, chr(10))))) AS pos
      FROM documents WHERE text IS NOT NULL
    ), t AS (
      SELECT doc_id, source, pos, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l
    ), w AS (
      SELECT * FROM t WHERE len(string_split_regex(line, '[\x20\x09-\x0D]+')) >= 5
    ), b AS (
      SELECT line, min(row(doc_id, pos)) AS keep FROM w GROUP BY line HAVING count(DISTINCT source) >= 3
    ), gone AS (
      SELECT w.doc_id, w.pos FROM w JOIN b ON w.line = b.line WHERE row(w.doc_id, w.pos) <> b.keep
    ), r AS (
      SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
    ), k AS (
      SELECT t.doc_id, string_agg(t.raw, chr(10) ORDER BY t.pos) AS text
      FROM t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos WHERE g.pos IS NULL GROUP BY t.doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
           coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed
    FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
    """,
)
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@_register("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_register("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf, "documents")).drop("spans")


@_register("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, sf, "documents")))


@_register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    judged = quality_rules.judge_quality(docs, _table(spark, sf, "labels").filter("quality = 1"))
    return judged.drop("text")


@_register("op8_pack")
def op8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_table(spark, sf, "documents")).drop("ids")


def pack(docs: DataFrame) -> DataFrame:
    """Production packing of ``docs`` with the public byte-level vocabulary."""
    files = {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    return packing.pack_documents(docs, **files, pattern=public_tokenizers.PATTERN, with_ids=False)


@_register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = _table(spark, sf, "labels").filter(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(_table(spark, sf, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "nearest")


@_register("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_model.classify_quality(_table(spark, sf, "documents"), labels)


@_register("op4_html_text")
def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf, "pages"))


@_register("op13_token_files")
def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    files = {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    folder = token_files.write_token_files(_table(spark, sf, "documents"), **files, pattern=public_tokenizers.PATTERN, end_id=2)
    return token_files.read_token_files(spark, folder, with_ids=False).drop("ids")


@_register("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


@_register(
    "op11_lexical_search",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, ts, len(ts)::BIGINT AS n FROM (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0
    ), c AS (
      SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d
    ), i AS (
      SELECT item_id, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term
    ), p AS (
      SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term
    ), w AS (
      SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c
    ), s AS (
      SELECT i.item_id, d.r, any_value(d.doc_id) AS doc_id,
             sum(i.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * d.n * c.big_n) // c.big_l))))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, c GROUP BY i.item_id, d.r
    ), k AS (
      SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
    """,
)
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
