"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Detectors mark spans in each text.  The hashes of the found values are
counted over the whole corpus by distinct repositories (documents) and
distinct owners (column ``source``).  A value that several owners carry is a
widely copied example; a value of one or two owners is live-looking.

Spans are found without a UDF: each match is wrapped in two private marker
characters (replaced beforehand wherever a text has them itself), the marked
text is split on them, and lengths in code points give the places.

Defined results: a null text counts as empty; a text without spans has empty
digests; a null owner is no owner (a value with no owner at all is live);
rows alike in doc_id, owner and text share their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage

OPEN, CLOSE, PLAIN = "\ue000", "\ue001", "\ufffd"

#: (kind, pattern, group of the value, least length of the value, cheap test).
#: The first three are the base kinds; a match whose value is too short is dropped.
DETECTORS: list[tuple[str, str, int, int, str | None]] = [
    (
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
        None,
    ),
    ("access", r"(AKIA[A-Z0-9]{16,}+)", 1, 20, "AKIA"),
    ("hex", r"([0-9a-f]{24,}+)", 1, 24, None),
    ("bearer", r"[bB]earer\x20+([A-Za-z0-9+/_.=-]{16,}+)", 1, 16, "earer"),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{30,}+)", 1, 34, "gh"),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 1, 30, "eyJ"),
    ("pem", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 10, "PRIVATE KEY-----"),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,}+)", 1, 14, "xox"),
    ("stripe", r"([rs]k_live_[A-Za-z0-9]{16,}+)", 1, 24, "k_live_"),
    ("urlpass", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._-]{1,64}:([^\x00-\x20:@/]{3,64})@", 1, 3, "://"),
]
BASE = ("assign", "access", "hex")
#: A value that at least so many owners carry is a widely copied example.
EXAMPLE_OWNERS = 3

_SPAN = "struct<kind: string, start: int, end: int, value: bigint>"


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, needle: str | None) -> Column:
    """array<struct(kind, start, end, value hash)> of one detector, in order."""
    marked = F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}")
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]")  # odd pieces (from 0) are matches

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        value = F.regexp_extract(piece, pattern, group)
        hit = acc["inside"] & (F.length(value) >= least)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), F.xxhash64(value).alias("value"))
        return F.struct(
            end.alias("at"),
            (~acc["inside"]).alias("inside"),
            F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("spans"))
    found = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    test = text.rlike(pattern) if needle is None else text.contains(needle) & text.rlike(pattern)
    return F.when(test, found).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, d in enumerate(DETECTORS) for x in (F.lit(d[0]), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(doc_id, spans, live, example) per row of ``docs``: all spans, and those
    of live-looking and of widely copied values (arrays of kind, start, end)."""
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.xxhash64(id_col, owner_col, text_col).alias("row_key"),
        F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), OPEN + CLOSE, PLAIN + PLAIN).alias("text"),
    )
    found = source.select("doc_id", "owner", "row_key", F.concat(*[_matches(F.col("text"), *d) for d in DETECTORS]).alias("spans"))
    found = write_stage(found, "secret-spans")
    each = found.filter(F.size("spans") > 0).select("row_key", "owner", F.inline("spans"))
    owned = each.groupBy("value", "owner", "row_key").agg(F.count("*").alias("n"))
    # distinct owners first, so that a value copied everywhere is summed in parts
    by_owner = owned.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    spread = by_owner.groupBy("value").agg(F.count("owner").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = each.join(spread, "value").groupBy("row_key").agg(
        F.collect_set(F.when(F.col("owners") < EXAMPLE_OWNERS, F.struct("kind", "start", "end"))).alias("live"),
        F.collect_set(F.when(F.col("owners") >= EXAMPLE_OWNERS, F.struct("kind", "start", "end"))).alias("example"),
        F.max("repositories").alias("most_repositories"),
    )
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return found.join(judged, "row_key", "left").select(
        "doc_id",
        "spans",
        F.coalesce("live", none).alias("live"),
        F.coalesce("example", none).alias("example"),
        F.coalesce("most_repositories", F.lit(0).cast("long")).alias("most_repositories"),
    )


def secret_digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets`` rows."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        _listed(F.col("live")).alias("live_spans"),
        _listed(F.col("example")).alias("example_spans"),
        "most_repositories",
    )
