"""Finding and removing benchmark passages.

Texts are normalised (A-Z lower-cased, anything but digits, letters and bytes above
ASCII separates words). Every benchmark item gives its windows of ten consecutive
words, or one window of all its words if it has fewer. The set of windows is
broadcast; one pass over the documents looks for runs of words that windows use,
checks every window-long stretch of such a run against the set and keeps those that
are equal. Documents are never shuffled.

What is broadcast is at most ``MAX_INDEX_BYTES``: a larger benchmark is cut by hash
into blocks of that size, and the documents are passed once for each block, with the
finds so far kept in a stored table between passes. Rows are the same either way.

Nulls and the like: a null or empty text has no words, so no windows and no hits. An
item without an id counts as one named with the empty string. Repeated items and rows
change nothing. Without items nothing is hit. Texts are scanned whole, in one pass and in
memory in proportion to the longest. ``scan`` adds ``n_words``, ``spans`` and ``items`` in place of
columns of these names; all other columns, whatever their names, stay as they are, and the two
functions that remove give back the columns they got.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.scratch import stored

WINDOW = 10
MAX_INDEX_BYTES = 32 << 20

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes(b if b in _WORD_BYTES else b | 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPANS = "array<struct<start:int,end:int>>"
ADDED = ("n_words", "spans", "items")


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def item_windows(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct (``item``, ``window``) of all items."""

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = [sorted(item_windows(normal_words(t.as_py()), window)) for t in texts]
        return pa.array(rows, pa.list_(pa.binary()))

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(item, F.explode(cut(F.col("text").cast("binary"))).alias("window")).distinct()


@dataclass(frozen=True)
class WindowSet:
    """Windows with their items, the words they use and the lengths they have."""

    items: dict[bytes, list[str]]
    words: frozenset[bytes] = field(default=frozenset())
    lengths: tuple[int, ...] = ()
    run: re.Pattern[bytes] | None = None

    @staticmethod
    def of(rows: Iterable[tuple[str, bytes]]) -> WindowSet:
        items: dict[bytes, list[str]] = defaultdict(list)
        for item, window in rows:
            items[bytes(window)].append(item)
        split = [w.split() for w in items]
        lengths = tuple(sorted({len(w) for w in split}))
        shortest = lengths[0] if lengths else 1
        run = re.compile(b"\x01{%d,}" % shortest)
        return WindowSet(dict(items), frozenset(x for w in split for x in w), lengths, run)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The word spans that windows cover, and the items of these windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for run in self.run.finditer(bytes(map(self.words.__contains__, words))):
            for length in self.lengths:
                for start in range(run.start(), run.end() - length + 1):
                    named = self.items.get(b" ".join(words[start : start + length]))
                    if named is not None:
                        spans.append((start, start + length))
                        items.update(named)
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, the hit word ``spans`` and the ``items`` found."""
    cut = stored(windows(benchmark), "windows")
    weight = F.length("window") + F.octet_length("item") + 64
    total = cut.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -(-total // max_index_bytes))
    rest = [c for c in docs.columns if c not in ADDED]
    found = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        part = cut.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == block)
        rows = [(row.item, bytes(row.window)) for row in part.collect()]  # max_index_bytes, about
        if block:
            found = stored(found, "scanned")
        found = _scan_block(found, rest, WindowSet.of(rows))
    return found


def _scan_block(docs: DataFrame, rest: list[str], windows: WindowSet) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @F.arrow_udf(f"n_words long, spans {SPANS}, items array<string>")
    def scanned(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        find, counts, all_spans, all_items = shared.value.find, [], [], []
        for text, before, named in zip(texts, spans, items):
            words = normal_words(text.as_py())
            new, new_items = find(words)
            old = [(s["start"], s["end"]) for s in before.as_py()]
            counts.append(len(words))
            all_spans.append([{"start": s, "end": e} for s, e in merged(new + old)])
            all_items.append(sorted(new_items.union(named.as_py())))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(all_spans, pa.list_(span)), pa.array(all_items, pa.list_(pa.string()))],
            list(ADDED),
        )

    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    got = scanned(F.col("text").cast("binary"), "spans", "items").alias("found")
    return docs.select(row, got).select("row.*", *[f"found.{name}" for name in ADDED])


def hit_words(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their own columns, whatever their names."""
    found = scan(docs.select(F.struct("*").alias("row"), "text"), benchmark)
    return found.where(F.size("spans") == 0).select("row.*")


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    starts_ends = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : starts_ends[start][0]])
        at = starts_ends[end - 1][1]
    return b"".join([*kept, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, with the hit words taken out of their texts."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, found in zip(texts, spans):
            pairs = [(s["start"], s["end"]) for s in found.as_py()]
            raw = text.as_py()
            rows.append(raw if raw is None else without_spans(raw, pairs).decode())
        return pa.array(rows, pa.string())

    text = F.when(F.size("spans") > 0, cleaned(F.col("text").cast("binary"), "spans")).otherwise(F.col("text"))
    found = scan(docs.select(F.struct("*").alias("row"), "text"), benchmark)
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
