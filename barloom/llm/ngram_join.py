"""Jaccard self-join of documents on word n-grams, with adaptive multi-match prefixes.

1.  Every text becomes its set of hashed n-grams (64 bits). Documents with equal sets
    form a class; only classes are compared.
2.  A global order puts n-grams that many documents have last. In that order the first
    ``size - needed + k`` n-grams of two similar sets share at least ``k``. Each class
    chooses its own ``k``: a longer prefix costs more rows, but candidates must share
    more before they are verified. The choice weighs both by the n-grams' counts.
    Two classes must share the smaller of their two ``k``.
3.  Only classes of similar size are brought together. N-grams in the prefixes of up
    to ``SMALL_BUCKET`` such classes give pairs, which are counted and kept if they
    share enough. The classes so connected form clusters. An n-gram in more prefixes
    sends its classes to one place, named after the first of them, so that n-grams of
    the same group name the same place.
4.  Within each cluster and place the sets are compared exactly, in pairs of blocks of
    bounded bytes and rows, by matrix products. What leaves a pair of blocks is a
    spanning forest of its links, at most a row per class, never all pairs.
5.  Components of those rows give each document the smallest id it is linked with.

The order needs no exact counts, only the same ones everywhere: an n-gram counts with all
others of its cell, of ``2**CELL_BITS`` cells in all. Cells differ little by chance, so an
n-gram of a few dozen documents stands out and comes late in the order, at any size.

Nulls and the like: a document without words has an empty set and is linked with
nothing. Rows with a null id have no component and link nothing; they are never
removed. Repeated rows fall in one class; an id repeated with another text counts in
the class of each. Of equal ids and sets any row may stay. Very long texts are one set
like others, in memory in proportion to their words. An empty table gives empty results.
Only ``doc_id`` and ``text`` are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import batches_of, slices
from barloom.llm.cells import cells_of, gathered, mix, only_ids, tally
from barloom.llm.components import components
from barloom.scratch import stored

CELL_BITS = 22
SMALL_BUCKET = 32
MOST_MATCHES = 8
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1000
HASHED_BYTES = 1 << 20  # of texts hashed together
BATCH_BYTES = 2 << 20  # sent to Python at once

_U64 = np.uint64


# --- sets --------------------------------------------------------------------


_GOLDEN = _U64(0x9E3779B97F4A7C15)
_PLACES = 64
#: A random number for each byte at each place of a word.
_OF_BYTE = mix(np.arange(1, _PLACES * 256 + 1, dtype=_U64) * _GOLDEN)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], np.int64)


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text: where each starts, and its hash.

    A hash adds up random numbers of its bytes by their places; each further 64 places
    count by another odd factor.
    """
    raw = np.frombuffer(text, np.uint8)
    inside = ~_IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, _U64)
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    values = _OF_BYTE[(place % _PLACES << 8) + _LOWER[raw[inside]]]
    if int(lengths.max()) > _PLACES:
        values *= mix((place // _PLACES).astype(_U64) * _GOLDEN) | _U64(1)
    return starts, mix(np.add.reduceat(values, before) + lengths.astype(_U64) * _GOLDEN)


def sets_of(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams.

    A-Z are lower-cased, ASCII white space separates words. A text of fewer words has
    one n-gram, all its words. All texts are hashed together.
    """
    starts, hashes = _word_hashes(b"\n".join([*(text or b"" for text in texts), b""]))
    ends = np.cumsum([len(text or b"") + 1 for text in texts])
    last = np.searchsorted(starts, ends).tolist()
    grams = _grams(hashes, n)
    found, first = [], 0
    for end in last:
        if end - first >= n:
            found.append(np.unique(grams[first : end - n + 1]))
        else:
            found.append(_grams(hashes[first:end], end - first))
        first = end
    return found


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all stretches of ``n`` words."""
    count = max(0, len(hashes) - n + 1) if n else 0
    mixed = np.full(count, n, _U64)
    for k in range(n):
        mixed = mix(mixed * _GOLDEN + hashes[k : k + count])
    return mixed


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The set of one text."""
    return sets_of([text], n)[0]


def _all_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sets of a column of texts, hashed by stretches of bounded bytes."""
    for start, count in slices(texts, HASHED_BYTES):
        yield from sets_of(texts.slice(start, count).to_pylist(), n)


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


# --- prefixes ----------------------------------------------------------------


@dataclass(frozen=True)
class Frequent:
    """Counts of n-grams, ascending; or, without n-grams, of all cells, with the usual count of one."""

    tokens: np.ndarray | None
    counts: np.ndarray
    usual: int = 0

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if self.tokens is None:
            return self.counts[cells_of(tokens, CELL_BITS)].astype(np.int64)
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)


def frequent(docs: DataFrame, n: int) -> Frequent:
    """The counts of the n-grams of all documents, by cell."""
    texts = docs.select(F.col("text").cast("binary"))
    pieces = stored(tally(texts, lambda batch: _all_sets(batch.column(0), n), CELL_BITS), "counts")
    counts = gathered(pieces, CELL_BITS)
    # Two bytes a cell: what more documents have is frequent anyway.
    return Frequent(None, np.minimum(counts, 65535).astype(np.uint16), int(counts.mean()))


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int, usual: int = 0) -> tuple[int, np.ndarray]:
    """The matches a set asks for, and the n-grams of its prefix.

    What counts have beyond the ``usual`` one of a cell is the n-gram's own. Posting visits cost one each; a candidate costs a share of the set's size to verify,
    and each further match asked for leaves about a quarter of the candidates.
    """
    size = len(tokens)
    needed = -(-percent * size // 100)
    order = np.argsort(counts, kind="stable")  # tokens are ascending, so ties are by token
    most = min(MOST_MATCHES, needed)
    visits = np.cumsum(np.maximum(counts[order] - usual, 1))
    matches = np.arange(1, most + 1)
    visited = visits[size - needed + matches - 1].astype(float)
    cost = visited * (1 + size / 16 / matches / 4.0 ** (matches - 1))
    k = int(np.argmin(cost)) + 1
    return k, tokens[order[: size - needed + k]]


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per distinct set: ``cid``, ``sig``, ``size``, ``k``, ``prefix``, smallest ``doc_id``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, n))
    schema = "doc_id long, sig binary, size int, k int, prefix array<long>"
    rows = _with_ids(docs).mapInArrow(lambda batches: _prefixes(batches, shared, n, percent), schema)
    grouped = rows.groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("k").alias("k"),
        F.first("prefix").alias("prefix"),
    )
    return stored(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")


def _with_ids(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _prefixes(
    batches: Iterator[pa.RecordBatch], shared: Broadcast, n: int, percent: int
) -> Iterator[pa.RecordBatch]:
    table = shared.value
    for batch in batches:
        sigs, sizes, ks, prefixes, rows = [], [], [], [], []
        for row, tokens in enumerate(_all_sets(batch.column(1), n)):
            if len(tokens):
                k, chosen = prefix(tokens, table.of(tokens), percent, table.usual)
                rows.append(row)
                sigs.append(signature(tokens))
                sizes.append(len(tokens))
                ks.append(k)
                prefixes.append(chosen.view(np.int64))
        offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *prefixes])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(sigs, pa.binary()),
                pa.array(sizes, pa.int32()),
                pa.array(ks, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ],
            ["doc_id", "sig", "size", "k", "prefix"],
        )


# --- candidates --------------------------------------------------------------


def places(found: DataFrame, percent: int) -> DataFrame:
    """Where each class is compared: ``place`` and ``cid``. Similar classes share a place.

    Sizes of similar sets lie in the same band or in neighbouring ones, where a band
    spans one factor of the similarity. A class stands in the bucket of each of its
    n-grams for its own band and for the next one; two classes count as met in the
    bucket of the larger's band.
    """
    band = F.floor(F.log(F.col("size")) / float(np.log(100 / percent)) + 1e-9).alias("band")
    tokens = found.select(F.explode("prefix").alias("token"), "cid")
    several = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    sizes = found.select("cid", "size", "k", band)
    met = tokens.join(several, "token").join(sizes, "cid")
    rows = stored(met.select("token", "cid", "size", "k", "band", F.explode(F.array("band", F.col("band") + 1)).alias("at")), "met")
    keys = ["token", "at"]
    buckets = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.min("cid").alias("first"), F.max("band").alias("most"))
        .where("n > 1 and most = at")
        .select(*keys, "n", "first")
    )
    rows = stored(rows.join(buckets, keys), "buckets")
    large = rows.where(F.col("n") > SMALL_BUCKET).select(
        F.struct("at", F.col("first").alias("id")).alias("place"), "cid"
    )
    lists = (
        rows.where(F.col("n") <= SMALL_BUCKET)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("cid", "size", "k", "band")).alias("xs"))  # at most SMALL_BUCKET
    )
    pair = F.flatten(F.transform("xs", lambda x: F.transform(
        F.filter("xs", lambda y: (x.cid < y.cid) & (F.greatest(x.band, y.band) == F.col("at"))
                 & (100 * F.least(x.size, y.size) >= percent * F.greatest(x.size, y.size))),
        lambda y: F.struct(x.cid.alias("a"), y.cid.alias("b"), F.least(x.k, y.k).alias("k")),
    )))
    shared = (
        lists.select(F.explode(pair).alias("p"))
        .groupBy("p.a", "p.b")
        .agg(F.count("*").alias("n"), F.first("p.k").alias("k"))
        .where("n >= k")
    )
    clusters = components(shared).select(
        F.struct(F.lit(-1).cast("long").alias("at"), F.col("root").alias("id")).alias("place"), F.col("node").alias("cid")
    )
    return large.union(clusters).distinct()


def links(docs: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows ``a``, ``b`` of class ids that connect exactly the classes that links connect."""
    placed = stored(places(found, percent), "places").join(found.select("cid", "doc_id", "sig", "size"), "cid")
    blocks = placed.groupBy("place").agg(
        F.greatest(
            F.ceil(F.sum(F.col("size").cast("long")) * 8 / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_ROWS)
        ).alias("blocks")
    )
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block")
    job = F.struct(
        "place", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    jobs = (
        placed.join(blocks, "place")
        .select("cid", "doc_id", "sig", "place", "blocks", block)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .groupBy("cid", "doc_id", "sig")
        .agg(F.collect_list(job).alias("jobs"))  # places of one prefix, times blocks
    )
    # Shuffled at every size: the lists of places have no bound that would allow a broadcast.
    side = stored(jobs, "jobs").withColumnRenamed("doc_id", "id").hint("shuffle_hash")
    texts = only_ids(_with_ids(docs), side.select("id")).join(side, F.col("doc_id") == F.col("id"))

    @F.arrow_udf("binary")
    def tokens_of(sources: pa.Array, sigs: pa.Array) -> pa.Array:
        sets = zip(_all_sets(sources, n), sigs.to_pylist())
        # An id may be repeated with another text; that row stands for another class.
        return pa.array([s.tobytes() if signature(s) == sig else None for s, sig in sets], pa.binary())

    rows = (
        texts.select("cid", "jobs", tokens_of("text", "sig").alias("tokens"))
        .where("tokens is not null")
        .select("cid", "tokens", F.explode("jobs").alias("job"))
        .select("cid", "tokens", "job.*")
    )
    return rows.groupBy("place", "one", "two").applyInArrow(
        lambda group: _compare(group, percent), "a long, b long"
    )


def _compare(group: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between two blocks, or within one."""
    cids, first = np.unique(group["cid"].to_numpy(), return_index=True)
    sets = [np.frombuffer(group["tokens"][int(i)].as_py(), _U64) for i in first]
    in_one = (group["block"].to_numpy() == group["one"].to_numpy())[first]
    within = group["one"][0].as_py() == group["two"][0].as_py()
    left = np.arange(len(cids)) if within else np.flatnonzero(in_one)
    right = left if within else np.flatnonzero(~in_one)
    if not len(left) or not len(right):
        return _edges([], [])
    sizes = np.array([len(s) for s in sets])
    common = _overlaps(sets, left, right)
    linked = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
    near: list[list[np.ndarray]] = [[] for _ in cids]
    for i, row in zip(left, linked):
        near[i].append(right[row])
    if not within:
        for j, column in zip(right, linked.T):
            near[j].append(left[column])
    a, b, seen = [], [], np.zeros(len(cids), bool)
    for start in range(len(cids)):
        if seen[start]:
            continue
        seen[start], stack = True, [start]
        while stack:
            for others in near[stack.pop()]:
                new = others[~seen[others]]
                seen[new] = True
                stack += new.tolist()
                a += [cids[start]] * len(new)
                b += cids[new].tolist()
    return _edges(a, b)


def _edges(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of all intersections, by products over stretches of the n-grams in several sets."""
    tokens, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = counts > 1
    number = np.cumsum(several) - 1
    kept = several[column]
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(several.sum()), width):
        low, high = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(sets), width), np.float32)
        has[row[low:high], column[low:high] - start] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    return common


# --- results -----------------------------------------------------------------


def class_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Each set's ``sig``, its smallest ``doc_id``, its component's (``component_id``).

    ``stays`` marks the one set of each component that has that smallest id.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        found = classes(docs, n, percent)
        linked = stored(links(docs, found, n, percent), "links")
    roots = components(linked)
    rooted = found.join(roots, found.cid == roots.node, "left").select(
        "sig", "doc_id", F.coalesce("root", "cid").alias("root")
    )
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    return rooted.join(first, "root").select(
        "sig",
        "doc_id",
        F.col("first.doc_id").alias("component_id"),
        (F.col("sig") == F.col("first.sig")).alias("stays"),
    )


def with_sets(docs: DataFrame, n: int) -> DataFrame:
    """Each whole ``row`` of ``docs`` with the ``sig`` and size (``n_shingles``) of its set; no ``sig`` if empty."""

    @F.arrow_udf("sig binary, n_shingles long")
    def measured(texts: pa.Array) -> pa.Array:
        sigs, sizes = [], []
        for tokens in _all_sets(texts, n):
            sigs.append(signature(tokens) if len(tokens) else None)
            sizes.append(len(tokens))
        return pa.StructArray.from_arrays([pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], ["sig", "n_shingles"])

    found = docs.select(F.struct("*").alias("row"), measured(F.col("text").cast("binary")).alias("found"))
    return found.select("row", "found.sig", "found.n_shingles")


def _has_word(text: Column) -> Column:
    """Whether a text has a word: the search ends at the first one."""
    return F.coalesce(F.rlike(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles`` and ``component_id``."""
    found = class_components(docs, n, percent).select("sig", "component_id")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    rows = docs.select("doc_id", "text")
    worded = with_sets(rows.where(_has_word(F.col("text"))), n).select("row.doc_id", "sig", "n_shingles")
    with batches_of(docs.sparkSession, BATCH_BYTES):
        worded = stored(worded, "sets")
    # Rows without words would all meet under one key.
    rest = rows.where(~_has_word(F.col("text"))).select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return worded.join(found, "sig", "left").select("doc_id", "n_shingles", named).unionByName(rest)


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id; all without words stay.

    Rows that repeat both an id and its set count as one document. The columns of ``docs``
    may have any names and come back as they are.
    """
    stays = stored(class_components(docs, n, percent).where("stays").select("sig", F.col("doc_id").alias("id")), "stays")
    repeated = stored(
        docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"), "repeated"
    )
    rows = docs.select(F.struct("*").alias("row"))
    has_word = _has_word(F.col("row.text"))
    with_id = F.col("row.doc_id").isNotNull()
    worded = rows.where(with_id & has_word)
    free = rows.where(~with_id | ~has_word)
    is_same = F.col("row.doc_id") == F.col("id")
    kept = free.union(worded.join(stays.select("id").hint("shuffle_hash"), is_same, "left_semi"))
    if not repeated.isEmpty():
        # Only these need their sets again: other rows of the id may have another.
        once = kept.join(repeated, is_same, "left_anti")
        again = with_sets(rows.join(repeated, is_same, "left_semi").select("row.*"), n)
        own = stays.withColumnRenamed("id", "first")
        again = again.join(own, "sig", "left").where(F.col("sig").isNull() | (F.col("row.doc_id") == F.col("first")))
        again = again.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "sig"]).select("row")
        kept = once.union(again)
    return kept.select("row.*")
