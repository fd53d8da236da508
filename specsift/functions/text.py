"""Scalar text functions as Spark Column expressions.

All of these compile to JVM expressions, so they stay inside whole-stage
codegen (or Catalyst's interpreted higher-order functions) and never ship
rows to Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Whole-word, case-insensitive operator rewrites, applied in this order.
OPERATOR_REWRITES: tuple[tuple[str, str], ...] = (
    ("times", "*"),
    ("mul", "*"),
    ("multiply", "*"),
    ("div", "/"),
    ("divide", "/"),
    ("modulo", "mod"),
    ("when", "if"),
    ("iff", "if and only if"),
    ("leq", "<="),
    ("geq", ">="),
    ("neq", "!="),
)
# Source tag whose entries get the package icon on display cards.
STDLIB_SOURCE = "vstd"
DEFAULT_SOURCE = "project"
CARD_TITLE_ICON = "\U0001f4cb"  # clipboard
CARD_STDLIB_ICON = "\U0001f4e6"  # package
CARD_FILE_ICON = "\U0001f4c1"  # folder
CARD_DOC_ICON = "\U0001f4ac"  # speech balloon
CARD_SIG_ICON = "✍️"  # writing hand
CARD_CHECK = "✓"
CARD_BULLET = "•"
# Size units, base 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
# ---------------------------------------------------------------------------

# Unicode word characters (Java's and RE2's \w are ASCII-only).
WORD_PATTERN = r"([\p{L}\p{N}_]+)"
# Single-letter variable followed by an operator, or by "if"/"then".
VARIABLE_PATTERN = r"(?i)\b([a-z])\b(?=\s*[*+\-/<>=]|\s+if\b|\s+then\b)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_strings() -> Column:
    return F.array().cast("array<string>")


# F1
def searchable_text(name, documentation, signature, requires, ensures, normalize: bool = False) -> Column:
    name, documentation, signature = _c(name), _c(documentation), _c(signature)
    requires, ensures = _c(requires), _c(ensures)
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Name: "), name),
        F.concat(F.lit("Documentation: "), documentation),
        F.concat(F.lit("Signature: "), signature),
        F.when(F.size(requires) > 0, F.concat(F.lit("Preconditions: "), F.array_join(requires, " AND "))),
        F.when(F.size(ensures) > 0, F.concat(F.lit("Postconditions: "), F.array_join(ensures, " AND "))),
    )
    return normalize_operators(text) if normalize else text


# F2
def plain_embedding_text(name, documentation, signature, requires, ensures) -> Column:
    return F.concat_ws(
        " ",
        _c(name),
        F.nullif(_c(documentation), F.lit("")),
        F.nullif(_c(signature), F.lit("")),
        _c(requires),
        _c(ensures),
    )


# F3
def display_card(name, file_path, line_number, documentation, signature, requires, ensures, source) -> Column:
    source, line_number = _c(source), _c(line_number)
    documentation, requires, ensures = _c(documentation), _c(requires), _c(ensures)
    label = F.when(source != F.lit(DEFAULT_SOURCE), F.concat(F.lit(" ("), source, F.lit(")"))).otherwise(F.lit(""))
    icon = F.when(source == F.lit(STDLIB_SOURCE), F.lit(CARD_STDLIB_ICON)).otherwise(F.lit(CARD_FILE_ICON))
    anchor = F.when(F.coalesce(line_number, F.lit(0)) != 0, F.concat(F.lit(":"), line_number.cast("string")))

    def bullets(arr: Column, title: str) -> Column:
        return F.when(
            F.size(arr) > 0,
            F.concat(
                F.lit(f"   {CARD_CHECK} {title}:\n"),
                F.array_join(F.transform(arr, lambda x: F.concat(F.lit(f"      {CARD_BULLET} "), F.trim(x))), "\n"),
            ),
        )

    return F.concat_ws(
        "\n",
        F.concat(F.lit(f"{CARD_TITLE_ICON} "), _c(name), label),
        F.concat(F.lit("   "), icon, F.lit(" "), _c(file_path), F.coalesce(anchor, F.lit(""))),
        F.when(F.coalesce(documentation, F.lit("")) != F.lit(""), F.concat(F.lit(f"   {CARD_DOC_ICON} "), documentation)),
        F.concat(F.lit(f"   {CARD_SIG_ICON}  "), _c(signature)),
        bullets(requires, "requires"),
        bullets(ensures, "ensures"),
    )


# F4
def permalink(base_url, branch, path_prefix, file_path, line_number) -> Column:
    file_path, path_prefix, line_number = _c(file_path), F.coalesce(_c(path_prefix), F.lit("")), _c(line_number)
    path = F.when(
        (path_prefix != F.lit("")) & ~file_path.startswith(path_prefix), F.concat(path_prefix, file_path)
    ).otherwise(file_path)
    url = F.concat(_c(base_url), F.lit("/blob/"), _c(branch), F.lit("/"), path)
    url = F.when(
        F.coalesce(line_number, F.lit(0)) != 0, F.concat(url, F.lit("#L"), line_number.cast("string"))
    ).otherwise(url)
    return F.when(F.coalesce(file_path, F.lit("")) != F.lit(""), url)


# F5
def round_score(score, digits: int = 3) -> Column:
    """Half-even rounding, like Python's round()."""
    return F.bround(_c(score), digits)


# F6
def normalize_operators(text) -> Column:
    return reduce(
        lambda acc, rw: F.regexp_replace(acc, rf"(?i)\b{rw[0]}\b", rw[1]),
        OPERATOR_REWRITES,
        _c(text),
    )


# F7
def variables_of(text) -> Column:
    found = F.regexp_extract_all(_c(text), F.lit(VARIABLE_PATTERN), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x))))


def normalize_variables(text) -> Column:
    text = _c(text)
    vars_ = variables_of(text)
    numbered = F.arrays_zip(vars_.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(vars_), F.lit(1))).alias("i"))
    renamed = F.aggregate(
        F.filter(numbered, lambda s: s["v"].isNotNull()),
        text,
        lambda acc, s: F.regexp_replace(
            acc,
            F.concat(F.lit(r"(?i)\b"), s["v"], F.lit(r"\b")),
            F.concat(F.lit("var"), s["i"].cast("string")),
        ),
    )
    return renamed


# F8
def normalize_query(text) -> Column:
    return normalize_variables(normalize_operators(text))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


# F9 (patterns avoid look-around so they read the same in RE2 dialects)
IF_THEN = r"(?i)if\s+([^\n]+?)\s+then\s+([^\n]+?)\n?\z"
BACKWARD_IF = r"(?i)^([^\n]+?)\s+if\s+([^\n]+)\n?\z"
AND_SPLIT = r"(?i)\s+and\s+"


def query_variations(text) -> Column:
    q = _c(text)
    lq = F.lower(q)
    has_mod, has_pct = lq.contains("mod"), q.contains("%")
    mod_variant = F.when(has_mod & ~has_pct, F.replace(q, F.lit("mod"), F.lit("%"))).when(
        has_pct & ~has_mod, F.replace(q, F.lit("%"), F.lit("mod"))
    )
    if_then = q.rlike(IF_THEN)
    cond1 = _strip(F.regexp_extract(q, IF_THEN, 1))
    concl1 = _strip(F.regexp_extract(q, IF_THEN, 2))
    reverse = F.when(if_then, F.concat_ws(" if ", concl1, cond1))
    backward = q.rlike(BACKWARD_IF) & ~lq.contains("then")
    concl2 = _strip(F.regexp_extract(q, BACKWARD_IF, 1))
    cond2 = _strip(F.regexp_extract(q, BACKWARD_IF, 2))
    forward = F.when(backward, F.concat(F.lit("if "), cond2, F.lit(" then "), concl2))
    parts = F.split(cond2, AND_SPLIT)
    two = backward & F.lower(cond2).contains(" and ") & (F.size(parts) == 2)
    swapped = F.concat(parts.getItem(1), F.lit(" and "), parts.getItem(0))
    sw_rev = F.when(two, F.concat(concl2, F.lit(" if "), swapped))
    sw_fwd = F.when(two, F.concat(F.lit("if "), swapped, F.lit(" then "), concl2))
    all_ = F.array(q, mod_variant, reverse, forward, sw_rev, sw_fwd)
    return F.array_distinct(F.filter(all_, lambda x: x.isNotNull()))


# F10
def terms(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 1))


def tokens(text) -> Column:
    """All word tokens in order, with repeats (for the hashing encoder)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 1)


def replacement_words() -> dict[str, list[str]]:
    """word -> the tokens that stand for it after ``normalize_operators``.

    A rewrite replaces a whole word, i.e. one token (matched case-
    insensitively; tokens are already lower-case), by the tokens of its
    replacement: operators have none, the others are words.  Saves a second
    regex pass over long texts.
    """
    return {word: [w for w in rep.split(" ") if any(ch.isalnum() or ch == "_" for ch in w)] for word, rep in OPERATOR_REWRITES}


# F11
def substring_term_hits(term_array, text) -> Column:
    low = F.lower(_c(text))
    return F.size(F.filter(_c(term_array), lambda t: F.instr(low, t) > 0))


# F12
def node_query_text(display_name, body) -> Column:
    display_name, body = _c(display_name), _c(body)
    head = F.array_join(F.slice(F.split(body, "\n"), 1, 5), " ")
    return F.when(
        F.coalesce(body, F.lit("")) != F.lit(""), F.concat(display_name, F.lit(" "), head)
    ).otherwise(display_name)


# F13
def join_documentation(doc_lines) -> Column:
    return F.array_join(F.coalesce(_c(doc_lines), empty_strings()), " ")


# F14
def human_size(nbytes) -> Column:
    x = _c(nbytes).cast("double")
    out = None
    for i, unit in enumerate(SIZE_UNITS):
        scaled = x / F.lit(float(1024**i))
        shown = F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(f" {unit}"))
        if i == len(SIZE_UNITS) - 1:
            out = out.otherwise(shown)
        else:
            cond = scaled < F.lit(1024.0)
            out = F.when(cond, shown) if out is None else out.when(cond, shown)
    return out
