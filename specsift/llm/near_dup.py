"""MinHash near-duplicate detection with HyperMinHash sketches.

One pass hashes each text's distinct word shingles and keeps, per bucket of
the hash space, the minimum in compressed form: its leading-zero count plus
mantissa bits (16 bits a register).  Empty registers borrow from a filled one
picked by a fixed random sequence, so a register of two texts agrees with
probability J whatever their sizes.  Bands of registers give candidates; an
estimate corrected for chance collisions of compressed registers drops the
hopeless ones; what is left is confirmed on the full shingle sets.

Work stays linear in a group's size.  Equal sets collapse to one node first.
Inside a band's bucket every node is compared with the bucket's smallest node
only (a star).  After joining those links, only buckets that still hold
several components matter.  Where few nodes lie outside a bucket's main
component, each of them meets the nodes of other components.  Where many do
(copies that differ just too much), overlapping buckets are merged into one
group, dealt into blocks, and each pair of blocks counts all shared shingles
at once by a matrix product; only links between components leave it.
At similarity 0.8 a pair shares 17 of 51 bands on average and none with
probability 2e-9.

Defined results: null or wordless text has no shingles, is linked with
nothing and is its own component.  Rows with one doc_id are one node.  A row
without doc_id cannot be named: component_id null, kept true.  Other columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .components import components
from .words import SPACED, grams, mix, split_words

REGISTERS = 256
MANTISSA = 10
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
EMPTY = 0xFFFF
#: A bucket with up to this many nodes outside its main component is compared
#: pair by pair between components.
FEW_OUTSIDE = 16
#: Nodes and shingles of a block of a group that is compared as a whole.
BLOCK_NODES, BLOCK_SHINGLES = 1000, 1 << 20
#: Members of one centre that one group of the check holds.
STAR_SPLIT = 200

_U = np.uint64
_DONORS = np.random.default_rng(20240229).integers(0, REGISTERS, size=(64, REGISTERS))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, hashes, bounds) per slice: row i's sorted distinct shingles are
    ``hashes[bounds[i]:bounds[i + 1]]``; a text of under k words is one shingle."""
    for words in split_words(column, SPACED):
        h, first, n = words.hashes(), words.first, words.counts
        per_doc = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(per_doc)])
        flat = np.empty(at[-1], dtype=np.uint64)
        g = grams(h, k)
        doc = words.doc_of()
        pos = np.arange(len(h)) + (k - 1) < first[doc + 1] if len(h) else np.zeros(0, bool)
        long_doc = np.repeat(n >= k, per_doc)
        flat[long_doc] = g[pos[: len(g)]]
        for d in np.flatnonzero((n > 0) & (n < k)):
            flat[at[d]] = mix(grams(h[first[d] : first[d + 1]], int(n[d])) + _U(n[d]))[0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a > 1:
                flat[a:b].sort()
        keep = np.ones(len(flat), dtype=bool)
        keep[1:] = flat[1:] != flat[:-1]
        keep[at[:-1][per_doc > 0]] = True
        bounds = np.concatenate([[0], np.cumsum(keep)])[at]
        yield words.rows, flat[keep], bounds


def registers(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densified HyperMinHash registers (texts x REGISTERS) and filled counts."""
    docs = len(bounds) - 1
    out = np.full((docs, REGISTERS), EMPTY, dtype=np.uint16)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    bucket = (hashes >> _U(56)).astype(np.int64)
    first = np.ones(len(hashes), dtype=bool)  # hashes are sorted: a bucket's first one is its minimum
    first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    m, e = np.frexp(((hashes[first] << _U(8)) >> _U(11)).astype(np.float64))
    zeros = np.where(m == 0, 53, 53 - e).astype(np.int64)
    mantissa = np.maximum((m * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out[doc[first], bucket[first]] = zeros * (1 << MANTISSA) + mantissa
    filled = (out != EMPTY).sum(axis=1)
    own = out.copy()
    rows, cols = np.nonzero((out == EMPTY) & (filled > 0)[:, None])
    for step in range(64 + REGISTERS):
        if not len(rows):
            break
        donor = _DONORS[step, cols] if step < 64 else (cols + step - 63) % REGISTERS
        v = own[rows, donor]
        ok = v != EMPTY
        out[rows[ok], cols[ok]] = v[ok]
        rows, cols = rows[~ok], cols[~ok]
    return out, filled


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band (texts x BANDS)."""
    r = regs[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = key * _U(0x9E3779B97F4A7C15) + r[:, :, i] + _U(1)
    return mix(key)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the compressed minima of two unrelated buckets are equal.

    With a = n / REGISTERS elements a bucket, the minimum x in (0, 1] has
    density a exp(-a x); the cells between 2^-(i+1) and 2^-i are
    2^-(i+1+MANTISSA) wide.
    """
    a, b = n / REGISTERS, m / REGISTERS
    out = np.zeros(len(a))
    for i in range(48):
        w = np.exp(-(a + b) * 2.0 ** -(i + 1)) - np.exp(-(a + b) * 2.0**-i)
        out += 2.0 ** -(i + 1 + MANTISSA) * w
    return out * a * b / (a + b) / ((1 - np.exp(-a)) * (1 - np.exp(-b)))


def jaccard_estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    same = (x == y).mean(axis=1)
    chance = collision_rate(n.astype(float), m.astype(float))
    return (same - chance) / (1 - chance)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, bounds in shingle_sets(batch.column("text"), k):
                regs, filled = registers(h, bounds)
                raw = h.tobytes()
                digest = [
                    hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest()
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(rows.start, len(rows)),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.array(filled.astype(np.int32)),
                    ],
                    names=["doc_id", "n_shingles", "set", "regs", "filled"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            key = band_keys(_matrix(part.column("regs")))
            node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])


def _estimates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                p = batch.slice(at, 8192)
                get = lambda c: p.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                j = jaccard_estimate(_matrix(p.column("regs_a")), _matrix(p.column("regs_b")), get("n_a"), get("n_b"))
                # six standard errors of what the filled registers can tell
                error = 6 * np.sqrt(0.25 / np.minimum(get("filled_a"), get("filled_b")))
                ok = pa.array(j >= threshold - error)
                yield p.select(["a", "b"]).filter(ok)

    return run


def _confirmed(k: int, percent: int):
    """Rows come by (b, part, role): the centre's texts (role 0), then members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, {}
        for batch in batches:
            keys = list(zip(batch.column("b").to_pylist(), batch.column("part").to_pylist()))
            doc, role = batch.column("doc").to_pylist(), batch.column("role").to_pylist()
            links: list[tuple[int, int]] = []
            for rows, h, bounds in shingle_sets(batch.column("text"), k):
                for i, row in enumerate(rows):
                    own = h[bounds[i] : bounds[i + 1]]
                    if keys[row] != at:
                        at, centre = keys[row], {}
                    if role[row] == 0:
                        centre[own.tobytes()] = own.copy()
                        continue
                    for other in centre.values():
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(other) - both):
                            links.append((doc[row], at[0]))
                            break
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"]
            )

    return run


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    side = lambda s: nodes.select(
        F.col("node").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n").alias(f"n_{s}"), F.col("filled").alias(f"filled_{s}")
    )
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimates(threshold), "a long, b long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough; a centre with many
    members is copied to several groups of bounded size."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_SPLIT).cast("int").alias("parts"))
    members = pairs.join(parts, "b").select(
        F.col("a").alias("doc"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")
    )
    centres = parts.select(
        F.col("b").alias("doc"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role")
    )
    return (
        members.unionByName(centres)
        .join(texts, "doc")
        .repartition("b", "part")
        .sortWithinPartitions("b", "part", "role")
        .select("b", "part", "role", "doc", "text")
        .mapInArrow(_confirmed(k, percent), "a long, b long")
    )


def _mixed(members: DataFrame) -> DataFrame:
    """(key, main, outside) of the buckets that hold several components."""
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"))
    return whole.filter("size > top.n").select("key", F.col("top.comp").alias("main"), (F.col("size") - F.col("top.n")).alias("outside"))


def _between(few: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components."""
    x = few.filter("comp <> main").select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    y = few.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    pairs = x.join(y, "key").filter("comp_a <> comp_b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared elements of every two sets, by matrix products over slices of
    the elements that at least two sets have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int((times > 1).sum()), 4096):
        i, j = np.searchsorted(at, [low, low + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        out += m @ m.T
    return out


def _block_links(nodes: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components, as many as join them."""
    n = np.array([len(x) for x in sets])
    both = _overlaps(sets).astype(np.int64)
    comp = np.array(comps)
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
    top = {c: c for c in comps}
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))):
        p, q = comps[i], comps[j]
        while top[p] != p:
            p = top[p]
        while top[q] != q:
            q = top[q]
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((nodes[i], nodes[j]))
    return out


def _blocks(k: int, percent: int):
    """Rows come by (team, i, j): the nodes of two blocks of one team."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, comps, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            links = _block_links(nodes, comps, sets, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("team", "i", "j"))))
            doc, comp = batch.column("doc").to_pylist(), batch.column("comp").to_pylist()
            for rows, h, bounds in shingle_sets(batch.column("text"), k):
                for i, row in enumerate(rows):
                    if keys[row] != at:
                        yield done()
                        at, nodes, comps, sets = keys[row], [], [], []
                    nodes.append(doc[row])
                    comps.append(comp[row])
                    sets.append(h[bounds[i] : bounds[i + 1]].copy())
        yield done()

    return run


def _team_links(many: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components among the nodes of overlapping buckets."""
    first = many.groupBy("key").agg(F.min("node").alias("b"))
    teams = components(many.join(first, "key").select(F.col("node").alias("a"), "b").distinct())
    sized = nodes.groupBy("node").agg(F.max("n").alias("n"))
    rows = teams.select(F.col("id").alias("node"), F.col("comp").alias("team")).join(sized, "node")
    rows = rows.join(many.select("node", "comp").distinct(), "node")
    blocks = rows.groupBy("team").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    dealt = rows.join(blocks, "team").select(
        "team", F.col("node").alias("doc"), "comp", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    return (
        dealt.select("team", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "comp")
        .join(texts, "doc")
        .repartition("team", "i", "j")
        .sortWithinPartitions("team", "i", "j")
        .select("team", "i", "j", "doc", "comp", "text")
        .mapInArrow(_blocks(k, percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Two texts are linked if 100 x |A and B| >= percent x |A or B| over their
    distinct shingles of ``shingle_words`` words (ASCII letters lower-cased);
    component_id is the smallest doc_id reachable over links.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = write_stage(
        source.mapInArrow(
            _sketches(shingle_words), "doc_id long, n_shingles long, set binary, regs binary, filled int"
        ),
        "near-dup-sketches",
    )
    named = sketches.filter("n_shingles > 0 and doc_id is not null")
    nodes = write_stage(
        named.groupBy("set").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("filled").alias("filled")
        ),
        "near-dup-nodes",
    )
    bands = nodes.select("node", "regs").mapInArrow(_bands, "key long, node long")
    shared = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre")).filter("size > 1")
    members = write_stage(bands.join(shared.select("key", "centre"), "key"), "near-dup-buckets")
    candidates = members.select("node").distinct()
    texts = write_stage(
        source.filter("doc_id is not null").join(candidates, F.col("doc_id") == F.col("node"), "left_semi").withColumnRenamed("doc_id", "doc"),
        "near-dup-texts",
    )

    stars = members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    check = lambda pairs: write_stage(_links(write_stage(pairs, "near-dup-likely"), texts, shingle_words, percent), "near-dup-links")
    links = check(_likely(stars, nodes, percent / 100))
    groups = components(links)

    labelled = members.select("key", "node").join(groups.withColumnRenamed("id", "node"), "node", "left")
    labelled = labelled.withColumn("comp", F.coalesce("comp", "node"))
    mixed = write_stage(labelled.join(_mixed(labelled), "key"), "near-dup-mixed")
    # the stars' pairs are settled already
    across = _between(mixed.filter(F.col("outside") <= FEW_OUTSIDE)).join(stars, ["a", "b"], "left_anti")
    more = check(_likely(across, nodes, percent / 100))
    many = mixed.filter(F.col("outside") > FEW_OUTSIDE)
    if not many.isEmpty():
        more = more.unionByName(write_stage(_team_links(many, nodes, texts, shingle_words, percent), "near-dup-teams"))
    final = groups if more.isEmpty() else components(links.unionByName(more))

    of_set = nodes.select("set", "node").join(final.withColumnRenamed("id", "node"), "node", "left").select(
        "set", F.coalesce("comp", "node").alias("component")
    )
    out = sketches.select("doc_id", "n_shingles", "set").join(of_set, "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each group: the row with the smallest doc_id.
    Of repeated rows with that doc_id one stays; rows without doc_id stay."""
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_rows__"))
    kept = write_stage(kept, "near-dup-kept")
    once = docs.join(kept.filter("n_rows__ = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(kept.filter("n_rows__ > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    out = once.unionByName(again).unionByName(docs.filter(F.col("doc_id").isNull()))
    return out.select(docs.columns)
