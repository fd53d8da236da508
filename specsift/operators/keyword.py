"""Keyword scoring (J5 + A1) over a stored postings index.

score(q, e) = |terms(q) & terms(text(e))|
            + name_boost * #{t in terms(q) : t is a substring of lower(name(e))}
            + doc_boost  * #{t in terms(q) : t is a substring of lower(doc(e))}

The index is written once per corpus.  Entries are dealt by a hash into shards
of about ``SHARD_ENTRIES``; a shard is one row, a compressed Arrow batch of its
entries and its postings: for each word, the entries with it and where it stands
(text, name, documentation).  A query term is a run of word characters, so it
can only stand inside one word of a name or documentation; a task finds the
words of its shard that hold a term (``operators.qgrams.pairs_within``).

The shards meet the queries of each bucket (``operators.queries.meet``), a few
buckets at a time.  A task goes through its shards one by one: it takes the
postings that the queries' terms hit, bounds every query's score in each block of
``BLOCK`` entries by the sum of its terms' block maxima, scores blocks by
falling bound and stops below the running n-th best.  Many queries at once are
scored against the whole shard instead: words that many of them share by a
matrix product, the others by their postings.  Tasks hold one shard and one
bucket of queries, whatever their numbers.

Counts of text, name and documentation hits are added as whole numbers, so a
score does not depend on the order of the terms, for any boosts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SearchConfig
from ..functions.text import searchable_text, terms
from ..session import write_stage
from .qgrams import GramIndex, gram_index, pairs_within, substring_pairs
from .queries import BUCKET_QUERIES, QueryBatch, cells, in_waves, meet, query_batch
from .topk import top_k

SHARD_ENTRIES = 4096
BLOCK = 64
#: Where a word stands; with the position in one number.
TEXT, NAME, DOC, PLACE = 1, 2, 4, 8
#: What the flags of a place are made of.
BITS = np.array([[(f >> b) & 1 for b in range(3)] for f in range(PLACE)], dtype=float)
#: (query, entry) pairs of a task that lists all hits; postings it looks at, and pairs it counts, at once.
TASK_PAIRS = 1 << 22
AT_ONCE = 1 << 20
#: Postings that are added to the sums of queries at once.
ADDED = 1 << 17
#: From as many queries on a shard is scored whole; queries scored at once.
TOGETHER, CHUNK = 16, 256
#: A word is a column of the product if its queries' postings in a chunk are more than this, the commonest first.
SHARED_POSTINGS, SHARED_WORDS = 4096, 1024
#: Posting rows that the index reader hands on at once.
POSTING_ROWS = 1 << 14
#: Shards that a task meets at most.
TASK_SHARDS = 64


@dataclass
class KeywordIndex:
    held: DataFrame  # shard, held: its entries and postings (``_held``)
    shards: int

    @cached_property
    def postings(self) -> DataFrame:
        """shard, word, run (name or documentation), places: position * PLACE + flag."""
        return self.held.mapInArrow(_posting_rows, "shard long, word string, run boolean, places array<long>")

    @cached_property
    def grams(self) -> GramIndex:
        """Of the words of names and documentations; written when term facts first need it."""
        # as many tasks as the cores need: a word gives far more bytes of grams than it has itself
        tasks = min(4 * self.shards, max(8 * self.held.sparkSession.sparkContext.defaultParallelism, self.shards // 2))
        return gram_index(self.postings.where("run").select("word").repartition(tasks, "word").distinct())


def keyword_columns(corpus: DataFrame) -> DataFrame:
    """entry_pos, name, terms (distinct lower-case words of the searchable
    text), name_runs / doc_runs (of the name / documentation)."""
    doc = F.coalesce("documentation", F.lit(""))
    return corpus.select(
        "entry_pos",
        "name",
        terms(searchable_text("name", doc, "signature", "requires_clauses", "ensures_clauses")).alias("terms"),
        terms("name").alias("name_runs"),
        terms(doc).alias("doc_runs"),
    )


def index_keywords(columns: DataFrame) -> KeywordIndex:
    """The stored index of ``keyword_columns``."""
    shards = max(1, -(-columns.count() // SHARD_ENTRIES))
    shard = F.pmod(F.xxhash64("entry_pos"), F.lit(shards)).alias("shard")
    whole = F.col("terms").isNotNull() & F.col("name_runs").isNotNull() & F.col("doc_runs").isNotNull()  # an entry without a name has no postings
    # words hold no space: joined, a list takes half the bytes
    joined = [F.when(whole, F.array_join(c, " ")).alias(c) for c in ("terms", "name_runs", "doc_runs")]
    dealt = columns.where("entry_pos IS NOT NULL").select(shard, "entry_pos", "name", *joined)
    tasks = min(shards, max(2 * columns.sparkSession.sparkContext.defaultParallelism, shards // 8))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard")
    return KeywordIndex(write_stage(dealt.mapInArrow(_shard_rows, "shard long, held binary"), "shards"), shards)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard as one row: a shard at a time."""
    for (shard,), parts in cells(batches, ["shard"]):
        rows = pa.Table.from_batches(parts)
        order = [("entry_pos", "ascending"), ("name", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([_held(rows)], pa.binary())], names=["shard", "held"])


def _held(rows: pa.Table) -> bytes:
    """positions and names of the entries in their order; then for texts and for
    runs (names and documentations) the distinct words, their numbers of places,
    and the steps from place to place: entry * PLACE + flag, the first entry of
    equal positions."""
    position = rows["entry_pos"].to_numpy()
    entry = np.searchsorted(position, position)
    lists = {"positions": pa.array(position), "names": rows["name"].combine_chunks()}
    for kind, columns in (("text", (("terms", TEXT),)), ("run", (("name_runs", NAME), ("doc_runs", DOC)))):
        words, places = [], []
        for column, flag in columns:
            split = words_of(rows[column])
            words.append(split.flatten())
            places.append(np.repeat(entry * PLACE + flag, split.value_lengths().to_numpy()))
        coded = pc.dictionary_encode(pa.concat_arrays(words))
        code, place = coded.indices.to_numpy(), np.concatenate(places)
        order = np.lexsort((place, code))
        lists[f"{kind}_words"] = coded.dictionary
        lists[f"{kind}_counts"] = pa.array(np.bincount(code, minlength=len(coded.dictionary)))
        lists[f"{kind}_steps"] = pa.array(np.diff(place[order], prepend=0))
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in lists.values()], names=list(lists))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(row)
    return out.getvalue().to_pybytes()


def words_of(joined: pa.ChunkedArray) -> pa.ListArray:
    """The lists of words that were joined by spaces; a null is an empty list."""
    joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], pa.string())
    split = pc.split_pattern(joined, " ")
    words = split.flatten()
    some = pc.not_equal(words, "")  # the split of an empty string is one
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.fill_null(split.value_lengths(), 0).to_numpy())
    return pa.ListArray.from_arrays(pa.array(before[np.concatenate([[0], ends]).astype(np.int64)], pa.int32()), words.filter(some))


class _Held:
    """A shard's row, opened: ``_held``."""

    def __init__(self, held: pa.BinaryScalar):
        row = pa.ipc.open_stream(held.as_buffer()).read_next_batch()
        self.positions, self.names = row["positions"].flatten(), row["names"].flatten()
        at = self.positions.to_numpy()
        self.words, self.places = {}, {}
        for kind in ("text", "run"):
            self.words[kind] = row[f"{kind}_words"].flatten()
            place = np.cumsum(row[f"{kind}_steps"].flatten().to_numpy())
            ends = np.cumsum(row[f"{kind}_counts"].flatten().to_numpy())
            places = at[place // PLACE] * PLACE + place % PLACE if len(place) else place
            self.places[kind] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(places, pa.int64()))

    def matched(self, terms: pa.Array) -> pa.Table:
        """A row of the entries (kind 1), and rows of the postings that terms (distinct)
        hit (kind 2): a word of names and documentations is hit by every term inside
        it, a word of the texts by the term itself."""
        same = pc.index_in(self.words["text"], terms)
        text = np.flatnonzero(same.is_valid().to_numpy(zero_copy_only=False))
        inside, word = pairs_within(terms, self.words["run"])
        order = np.argsort(word, kind="stable")
        run, first = np.unique(word[order], return_index=True)
        hit = pa.concat_arrays([terms.take(same.drop_null()), terms.take(pa.array(inside[order]))])
        ends = np.concatenate([np.arange(len(text)), len(text) + first, [len(hit)]])
        places = pa.concat_arrays([self.places["text"].take(pa.array(text)), self.places["run"].take(pa.array(run))])
        rows, none = len(places), np.zeros(len(places) + 1, np.int32)
        one = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, none + len(x)], pa.int32()), x)
        return pa.table({
            "kind": pa.array([1] + [2] * rows, pa.int32()), "positions": one(self.positions), "names": one(self.names),
            "terms": pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), hit),
            "places": pa.concat_arrays([pa.array([[]], pa.list_(pa.int64())), places])})


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, word, run, places of all postings."""
    for batch in batches:
        for shard, held in zip(batch["shard"], batch["held"]):
            shown = _Held(held)
            for kind in ("text", "run"):
                words, places = shown.words[kind], shown.places[kind]
                for a in range(0, len(words), POSTING_ROWS):
                    n = min(POSTING_ROWS, len(words) - a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.as_py()] * n, pa.int64()), words.slice(a, n), pa.array([kind == "run"] * n), places.slice(a, n)],
                        names=["shard", "word", "run", "places"])


def keyword_index(corpus: DataFrame) -> KeywordIndex:
    return index_keywords(keyword_columns(corpus))


def matched_postings(index: KeywordIndex, vocabulary: DataFrame) -> DataFrame:
    """Posting rows that terms of ``vocabulary`` (term; distinct) hit: terms, shard,
    places.  A word of names and documentations is hit by every term inside it, a
    word of the texts by the term itself."""
    texts = vocabulary.join(index.postings.where("NOT run").withColumnRenamed("word", "term"), "term")
    inside = substring_pairs(vocabulary, index.grams).groupBy("word").agg(F.collect_list("term").alias("terms"))
    runs = inside.join(index.postings.where("run"), "word")
    cols = ["terms", "shard", "places"]
    return texts.withColumn("terms", F.array("term")).select(cols).unionByName(runs.select(cols))


def term_facts(index: KeywordIndex, vocabulary: DataFrame) -> DataFrame:
    """(entry_pos, term, tok, nm, dc): one row for each entry a term hits."""
    m = matched_postings(index, vocabulary.select("term").distinct())
    hit = m.select(F.explode("terms").alias("term"), "places").select("term", F.explode("places").alias("at"))
    entry = F.expr(f"(at - pmod(at, {PLACE})) div {PLACE}")
    g = hit.groupBy(entry.alias("entry_pos"), "term").agg(F.bit_or(F.pmod("at", F.lit(PLACE))).alias("f"))
    has = lambda f: (F.col("f").bitwiseAND(f) != 0).cast("int")
    return g.select("entry_pos", "term", has(TEXT).alias("tok"), has(NAME).alias("nm"), has(DOC).alias("dc"))


def query_terms(queries: DataFrame, keys: Sequence[str], text_col: str = "query") -> DataFrame:
    return queries.select(*keys, F.explode(terms(text_col)).alias("term"))


def keyword_hits(index: KeywordIndex, queries: DataFrame, keys: Sequence[str] = ("query_id",), text_col: str = "query") -> DataFrame:
    """(keys..., entry_pos, tok, nm, dc): numbers of text, name and documentation
    hits of all (query, entry) pairs with a hit.  Every shard counts its own
    pairs, so pairs are neither shuffled nor sorted."""
    batch = query_batch(query_terms(queries, keys, text_col).groupBy(*keys).agg(F.collect_list("term").alias("terms")), keys)
    each = max(1, TASK_PAIRS // (BUCKET_QUERIES * SHARD_ENTRIES if batch.buckets > 1 else max(1, batch.queries) * SHARD_ENTRIES))
    met = _met(index, batch, min(index.shards, max(batch.groups(index.shards), -(-index.shards // each))))
    schema = T.StructType([*batch.key_fields, T.StructField("entry_pos", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("tok", "nm", "dc")]])
    return met.mapInArrow(_all_hits(batch.keys), schema)


def keyword_scores(
    index: KeywordIndex,
    queries: DataFrame,
    keys: Sequence[str] = ("query_id",),
    text_col: str = "query",
    cfg: SearchConfig = SearchConfig(),
) -> DataFrame:
    """All (query, entry) pairs with score > 0: keys..., entry_pos, score."""
    hits = keyword_hits(index, queries, keys, text_col)
    score = F.col("tok") + F.col("nm") * F.lit(float(cfg.name_match_boost)) + F.col("dc") * F.lit(float(cfg.doc_match_boost))
    return hits.select(*keys, "entry_pos", score.alias("score")).where("score > 0")


def _met(index: KeywordIndex, batch: QueryBatch, groups: int) -> DataFrame:
    """Each bucket's queries with the shards."""
    grp = F.pmod("shard", F.lit(groups)).cast("int").alias("grp")
    buckets = F.explode(F.sequence(F.lit(0), F.lit(batch.buckets - 1)))
    shards = index.held.select("shard", F.lit(1).alias("kind"), "held", grp, buckets.alias("bucket"))
    return meet(batch, [F.array_join("terms", " ").alias("terms")], shards, groups)


def keyword_topn(index: KeywordIndex, batch: QueryBatch, n: int, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Top n entries per query by keyword score (> 0), ties in corpus order.

    Output: keys..., entry_pos, name, score, rank.
    """
    schema = T.StructType([*batch.key_fields, T.StructField("entry_pos", T.LongType()),
                           T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])
    run = _topn(batch.keys, n, float(cfg.name_match_boost), float(cfg.doc_match_boost))

    def found(part: QueryBatch) -> DataFrame:
        met = _met(index, part, max(part.groups(index.shards), -(-index.shards // TASK_SHARDS)))
        return top_k(met.mapInArrow(run, schema), part.keys, n, [F.col("score").desc(), F.col("entry_pos").asc()])

    return in_waves(batch, found, "matched")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column; a null is an empty list."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return pc.list_flatten(column).to_numpy(), lengths


class _Queries:
    """The queries of a bucket and their best entries so far."""

    def __init__(self, rows: pa.Table, n: int):
        self.rows, self.n = rows.select([c for c in rows.column_names if c.startswith("key_")]), n
        coded = pc.dictionary_encode(pc.list_flatten(rows["terms"]).combine_chunks())
        self.terms, self.term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        _, lengths = flat(rows["terms"])
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.bar = np.zeros(rows.num_rows)  # the n-th best score, 0 before there are n
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * rows.num_rows

    def offer(self, q: int, position: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        if self.best[q] is not None:
            p, m, s = self.best[q]
            position, name, score = np.concatenate([p, position]), np.concatenate([m, name]), np.concatenate([s, score])
        top = np.lexsort((position, -score))[: self.n]
        self.best[q] = position[top], name[top], score[top]
        if len(top) == self.n:
            self.bar[q] = score[top[-1]]

    def result(self, keys: Sequence[str]) -> pa.RecordBatch | None:
        found = [(q, b) for q, b in enumerate(self.best) if b is not None]
        if not found:
            return None
        at = np.repeat([q for q, _ in found], [len(b[0]) for _, b in found])
        columns = [self.rows[f"key_{k}"].combine_chunks().take(pa.array(at)) for k in keys]
        position, name, score = (np.concatenate([b[i] for _, b in found]) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(position), pa.array(name, pa.string()), pa.array(score)], names=[*keys, "entry_pos", "name", "score"])


class _Shard:
    """Matched postings of one shard by term and block, with block maxima."""

    #: Three counts share a float: below 2**17 each.
    WIDE = float(1 << 17)

    def __init__(self, rows: pa.Table, terms: pa.Array, name_boost: float, doc_boost: float):
        of = rows["kind"].to_numpy()
        entry = rows.filter(pa.array(of == 1))
        self.positions, _ = flat(entry["positions"])
        self.names = pc.list_flatten(entry["names"]).to_numpy()
        posting = rows.filter(pa.array(of == 2))
        place, lengths = flat(posting["places"])
        size = len(self.positions)
        entry, flag = np.searchsorted(self.positions, place // PLACE), place % PLACE
        # each term of a row with each of its places
        _, terms_of = flat(posting["terms"])
        found = pc.index_in(pc.list_flatten(posting["terms"]), terms).to_numpy().astype(np.int64)
        self.known, term = np.unique(found, return_inverse=True)  # terms that hit something here, numbered anew
        self.local = np.full(len(terms), -1)
        self.local[self.known] = np.arange(len(self.known))
        each = np.repeat(lengths, terms_of)
        begin = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), terms_of)
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        key, flag = np.repeat(term, each) * size + entry[at], flag[at]
        order = np.argsort(key, kind="stable")
        key, flag = key[order], flag[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, flag = key[starts], np.bitwise_or.reduceat(flag, starts) if len(starts) else flag
        self.weights, self.flag = np.array([1.0, name_boost, doc_boost]), flag.astype(np.uint8)
        self.entry = (key % size if size else key).astype(np.int32)
        self.blocks = -(-size // BLOCK)
        cell = (key // size) * self.blocks + self.entry // BLOCK if size else key
        self.offset = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(self.known) * self.blocks))])
        self.top = np.zeros(len(self.known) * self.blocks)
        if len(cell):
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            self.top[cell[first]] = np.maximum.reduceat((BITS @ self.weights)[flag], first)
        self.top = self.top.reshape(len(self.known), self.blocks)

    @cached_property
    def packed(self) -> np.ndarray:
        """The three counts of a posting in one number."""
        return (BITS @ np.array([1.0, self.WIDE, self.WIDE**2]))[self.flag]

    def scores(self, terms: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores above 0) of the entries in these blocks."""
        cell = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
        begin, length = self.offset[cell], self.offset[cell + 1] - self.offset[cell]
        total = int(length.sum())
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(total)
        sums = np.bincount(self.entry[at], weights=self.packed[at])
        entry = np.flatnonzero(sums)
        packed = sums[entry]
        doc = packed // self.WIDE**2
        packed -= doc * self.WIDE**2
        name = packed // self.WIDE
        text = packed - name * self.WIDE
        if len(terms) >= self.WIDE:  # a count may not fit its share
            text, name, doc = (np.bincount(self.entry[at], weights=BITS[self.flag[at], j])[entry] for j in range(3))
        score = text + name * self.weights[1] + doc * self.weights[2]
        kept = score > 0
        return entry[kept], score[kept]

    def terms_of(self, queries: _Queries, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of queries lo to hi that hit something here, and where each query's begin."""
        a, b = queries.first[lo], queries.first[hi]
        terms = self.local[queries.term[a:b]]
        before = np.concatenate([[0], np.cumsum(terms >= 0)])
        return terms[terms >= 0], before[queries.first[lo : hi + 1] - a]

    def count(self, queries: _Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, its hits in text, name and documentation) of all pairs with a hit."""
        size, longest = len(self.positions), self.offset[self.blocks :: self.blocks] - self.offset[: -1 : self.blocks] if self.blocks else 0
        step = max(1, 4 * AT_ONCE // max(1, size))
        for lo in range(0, len(queries.bar), step) if len(self.known) else ():
            hi = min(lo + step, len(queries.bar))
            terms, first = self.terms_of(queries, lo, hi)
            asked = np.repeat(np.arange(hi - lo), np.diff(first))
            total = np.concatenate([[0], np.cumsum(longest[terms])])
            sums = [np.zeros((hi - lo) * size) for _ in range(3)]
            part = 0
            while part < len(terms):  # terms whose postings fit
                to = max(part + 1, int(np.searchsorted(total, total[part] + AT_ONCE, side="right")) - 1)
                length = longest[terms[part:to]]
                begin = self.offset[terms[part:to] * self.blocks]
                at = np.repeat(begin - (total[part:to] - total[part]), length) + np.arange(total[to] - total[part])
                cell = np.repeat(asked[part:to], length) * size + self.entry[at]
                low, high = int(cell.min()), int(cell.max()) + 1
                packed = np.bincount(cell - low, weights=self.packed[at], minlength=high - low)
                if to - part >= self.WIDE:  # a count may not fit its share
                    parts = [np.bincount(cell - low, weights=BITS[self.flag[at], j], minlength=high - low) for j in range(3)]
                else:
                    doc = packed // self.WIDE**2
                    name = (packed - doc * self.WIDE**2) // self.WIDE
                    parts = [packed - doc * self.WIDE**2 - name * self.WIDE, name, doc]
                for s, x in zip(sums, parts):
                    s[low:high] += x
                part = to
            pair = np.flatnonzero(sums[0] + sums[1] + sums[2])
            yield lo + pair // size, pair % size, np.stack([s[pair] for s in sums]).astype(np.int64)

    def search_together(self, queries: _Queries) -> None:
        """Offers every query its n best entries of the shard, a chunk of queries at a time."""
        size, asked = len(self.positions), len(queries.bar)
        if not size or not len(self.known):
            return
        terms, first = self.terms_of(queries, 0, asked)
        begin, length = self.offset[: -1 : self.blocks], np.diff(self.offset[:: self.blocks])
        work = np.bincount(terms, minlength=len(self.known)) * length * min(1.0, CHUNK / asked)
        shared = np.argsort(-work, kind="stable")[: min(SHARED_WORDS, int((work > SHARED_POSTINGS).sum()))]
        column = np.full(len(self.known), -1)
        column[shared] = np.arange(len(shared))
        # sums of 1/64ths below 2**24 are exact in 32 bits, in any order; else the counts are added apart
        most = max(1, int(np.diff(first).max())) * self.weights.sum() * 64
        whole = most < 1 << 24 and np.array_equal(self.weights * 64, np.rint(self.weights * 64))
        values = [v[self.flag] for v in ([BITS @ self.weights] if whole else BITS.T)]
        dense = np.zeros((len(values), len(shared), size), np.float32)
        for c, t in enumerate(shared):
            at = slice(begin[t], begin[t] + length[t])
            for d, value in zip(dense, values):
                d[c, self.entry[at]] = value[at]
        for lo in range(0, asked, CHUNK):
            hi = min(lo + CHUNK, asked)
            own, query = terms[first[lo] : first[hi]], np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
            if not len(own):
                continue
            held = column[own] >= 0
            asks = np.zeros((hi - lo, len(shared)), np.float32)
            asks[query[held], column[own[held]]] = 1
            sums = [asks @ d if whole else (asks @ d).astype(float) for d in dense]
            self._add_postings(sums, values, own[~held], query[~held], begin, length)
            score = sums[0] if whole else sums[0] + sums[1] * self.weights[1] + sums[2] * self.weights[2]
            kept = _first_n(score, queries.bar[lo:hi].astype(score.dtype), queries.n)
            row, entry = np.nonzero(kept)
            cuts = np.searchsorted(row, np.arange(hi - lo + 1))
            for q in np.flatnonzero(np.diff(cuts)):
                e = entry[cuts[q] : cuts[q + 1]]
                queries.offer(lo + int(q), self.positions[e], self.names[e], score[q, e].astype(float))

    def _add_postings(self, sums, values, terms, query, begin, length) -> None:
        """Adds the postings of (term, query) pairs, by query, to the sums, about ``ADDED`` at a time."""
        size = len(self.positions)
        total = np.concatenate([[0], np.cumsum(length[terms])])
        part = 0
        while part < len(terms):
            to = max(part + 1, int(np.searchsorted(total, total[part] + ADDED, side="right")) - 1)
            own, low, high = length[terms[part:to]], int(query[part]), int(query[to - 1]) + 1
            at = np.repeat(begin[terms[part:to]] - (total[part:to] - total[part]), own) + np.arange(total[to] - total[part])
            cell = np.repeat(((query[part:to] - low) * size).astype(np.int32), own) + self.entry[at]
            for s, value in zip(sums, values):
                s[low:high] += np.bincount(cell, weights=value[at], minlength=(high - low) * size).reshape(-1, size)
            part = to

    def search(self, queries: _Queries, chunk: int = 256) -> None:
        """Offers every query what can be among its n best."""
        if len(queries.bar) >= TOGETHER:
            return self.search_together(queries)
        for lo in range(0, len(queries.bar), chunk):
            hi = min(lo + chunk, len(queries.bar))
            known, first = self.terms_of(queries, lo, hi)
            bound = np.zeros((hi - lo, self.blocks))
            some = np.flatnonzero(np.diff(first))
            if not len(some) or not self.blocks:
                continue
            bound[some] = np.add.reduceat(self.top[known], first[:-1][some])
            bound *= 1 + 1e-9  # sums in another order
            order = np.argsort(-bound, axis=1, kind="stable")
            for i in np.flatnonzero((bound.max(axis=1) > 0) & (bound.max(axis=1) >= queries.bar[lo:hi])):
                q, at, step = lo + int(i), 0, 4
                terms = known[first[i] : first[i + 1]]
                own = order[i]
                while at < self.blocks:
                    take = own[at : at + step]
                    take = take[(bound[i, take] >= queries.bar[q]) & (bound[i, take] > 0)]
                    if not len(take):
                        break
                    entry, score = self.scores(terms, take)
                    kept = score >= queries.bar[q]
                    if kept.any():
                        queries.offer(q, self.positions[entry[kept]], self.names[entry[kept]], score[kept])
                    at, step = at + step, 2 * step


def _first_n(score: np.ndarray, bar: np.ndarray, n: int) -> np.ndarray:
    """Which entries (columns) can be among the n best of a query (row): scores
    above 0 and not below the bar, of equal scores the first."""
    kept = (score > 0) & (score >= bar[:, None])
    many = np.flatnonzero(np.count_nonzero(kept, axis=1) > n)
    if len(many):
        some = score[many]
        last = np.partition(some, some.shape[1] - n, axis=1)[:, some.shape[1] - n, None]
        above, equal = some > last, some == last
        room = n - np.count_nonzero(above, axis=1)
        kept[many] = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room[:, None]))
    return kept


def _with_words(rows: pa.Table) -> pa.Table:
    """The query rows with their terms as lists."""
    return rows.set_column(rows.column_names.index("terms"), "terms", words_of(rows["terms"]))


def _topn(keys: list[str], n: int, name_boost: float, doc_boost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cell = None, None
        for (bucket, grp, shard), parts in cells(batches):
            rows = pa.Table.from_batches(parts)
            if (bucket, grp) != cell:
                if queries is not None and (found := queries.result(keys)) is not None:
                    yield found
                cell, queries = (bucket, grp), None
            if shard < 0:
                queries = _Queries(_with_words(rows), n)
            elif queries is not None:
                for held in rows["held"]:
                    _Shard(_Held(held).matched(queries.terms), queries.terms, name_boost, doc_boost).search(queries)
        if queries is not None and (found := queries.result(keys)) is not None:
            yield found

    return run


def _all_hits(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cell = None, None
        for (bucket, grp, shard), parts in cells(batches):
            rows = pa.Table.from_batches(parts)
            if (bucket, grp) != cell:
                cell, queries = (bucket, grp), None
            if shard < 0:
                queries = _Queries(_with_words(rows), 0)
            elif queries is not None:
                for held in rows["held"]:
                    own_shard = _Shard(_Held(held).matched(queries.terms), queries.terms, 1.0, 1.0)
                    for query, entry, counts in own_shard.count(queries):
                        own = [queries.rows[f"key_{k}"].combine_chunks().take(pa.array(query)) for k in keys]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(own_shard.positions[entry]), *[pa.array(c) for c in counts]],
                                                         names=[*keys, "entry_pos", "tok", "nm", "dc"])

    return run
