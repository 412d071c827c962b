"""Token ids in files of directly addressable codes.

Documents are dealt by ranges of their id, sorted, encoded and packed into segments.
In a segment each id is split into chunks of eight bits: all lowest chunks form level
0, the next chunks of the ids that need them level 1, and so on. A bitmap per level
marks the ids that go on, and a rank directory counts its marks up to every block of
512, so any token is read with one lookup per level and no block is decoded.

Segments are rows of a Parquet table (Spark's committed writes survive lost
executors); its partition numbers follow the order of ids. A second pass over the
small ``n_tokens`` column gives where each segment starts.

Nulls and the like: a null text has only the end id, a null id sorts first, equal ids
are ordered by a hash of their text and each keeps its own row. An empty table gives
no segments. Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import array
import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.batches import slices

END_ID = 0
SEGMENT_TOKENS = 1 << 19
CACHED_CHUNKS = 300_000  # in each of two generations
BATCH_BYTES = 8 << 20  # text encoded at once
RANK_BLOCK = 512  # marks between entries of the rank directory

SEGMENTS = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<int>, codes binary"


# --- ids ---------------------------------------------------------------------


#: White space as the splitting pattern sees it, and more; in the syntax of Arrow's expressions.
_SPACES = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD_SPACES = f"[{_SPACES}][{_SPACES}]|^[{_SPACES}]|[{_SPACES}]$|[^\\S \\n]|[\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CUT, _END = "\x00", "\x01"
_STOPS = (".", ",")
_CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def _shown_bytes() -> dict[int, str]:
    """The characters in which byte-level vocabularies are written.

    Bytes of visible Latin-1 characters stand for themselves, the others for characters
    from U+0100 on, in order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(others)) for b in range(256)}


class Encoder:
    """A byte-level tokenizer that encodes each distinct chunk of a batch once.

    Its splitting pattern lets a space only start a token and keeps a single line feed
    between other characters apart, so a text may be cut before a single space and
    around a single line feed. Chunks are told apart and counted by Arrow, and a
    bounded cache of two generations keeps those of earlier batches. Texts with a special token's own
    string, or with the characters that mark cuts, go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alone = "|".join([_CUT, _END, *map(re.escape, special)])
        self.merge = self.tokenizer.model.tokenize
        self.shown = _shown_bytes()
        self.space = self.shown[0x20]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stops = {stop: self._encode(stop) for stop in _STOPS}

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text and the end id, as unsigned 32-bit integers."""
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and how many each has."""
        texts = texts.fill_null("")
        alone = pc.match_substring_regex(texts, self.alone)
        if not pc.any(alone).as_py():
            return self._cached(texts)
        ids, lengths = self._cached(pc.if_else(alone, "", texts))
        rows = np.split(ids, np.cumsum(lengths)[:-1])
        for i in np.flatnonzero(alone.to_numpy(zero_copy_only=False)):
            found = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            rows[i] = np.array([*found, END_ID], "<u4")
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def _cached(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring(texts, " ", _CUT + " ")
        cut = pc.replace_substring(cut, "\n", f"{_CUT}\n{_CUT}")
        odd = pc.match_substring_regex(texts, _ODD_SPACES)
        if pc.any(odd).as_py():
            careful = [_CUT.join(_CUTS.split(t)) for t in texts.filter(odd).to_pylist()]
            cut = pc.replace_with_mask(cut, odd, pa.array(careful, pa.string()))
        chunks = pc.split_pattern(pc.binary_join_element_wise(cut, _END, _CUT), _CUT)
        coded = chunks.flatten().dictionary_encode()
        known = self._look_up(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        values, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        size = sizes[which]
        ends = np.cumsum(size)
        places = np.repeat(starts[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.append(0, ends)[chunks.offsets.to_numpy()]
        return values[places], np.diff(upto)

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks. A stop or comma after a letter is a token of its own."""
        words = [c[:-1] if c[-1:] in _STOPS and c[-2:-1].isalpha() else c for c in chunks]
        recent, older, stops = self.recent, self.older, self.stops
        for word in set(words).difference(recent):
            recent[word] = older.get(word) or self._encode(word)
        found = [recent[w] if len(w) == len(c) else recent[w] + stops[c[-1]] for w, c in zip(words, chunks)]
        if len(recent) > CACHED_CHUNKS:
            self.recent, self.older = {}, recent
        return found

    def _encode(self, chunk: str) -> bytes:
        """The ids of one chunk. Letters, or a space and letters, are one unit of the merges."""
        if chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha()):
            if chunk.isascii():
                shown = self.space + chunk[1:] if chunk[0] == " " else chunk
            else:
                shown = chunk.encode().decode("latin-1").translate(self.shown)
            ids = [token.id for token in self.merge(shown)]
        elif chunk == _END:
            ids = [END_ID]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- codes -------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Ids as levels of 8-bit chunks with continuation marks and rank directories.

    Layout, little-endian: number of levels (4 bytes), then for each level its length
    (8), its chunks, its marks (bits, low first, zeros up to a full block) and the
    directory (8 for each block: marks before it).
    """
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        goes_on = rest > 0xFF
        blocks = -(-len(rest) // RANK_BLOCK)
        marks = np.zeros(blocks * RANK_BLOCK, np.uint8)
        marks[: len(rest)] = goes_on
        ranks = np.concatenate([[0], np.cumsum(marks.reshape(blocks, RANK_BLOCK).sum(1, dtype=np.int64))])[:-1]
        levels.append(
            len(rest).to_bytes(8, "little")
            + (rest & 0xFF).astype(np.uint8).tobytes()
            + np.packbits(marks, bitorder="little").tobytes()
            + ranks.astype("<i8").tobytes()
        )
        rest = rest[goes_on] >> 8
        if not len(rest):
            break
    return len(levels).to_bytes(4, "little") + b"".join(levels)


class Codes:
    """Packed ids: any one by its place, or a stretch of them."""

    def __init__(self, data: bytes):
        at, self.levels = 4, []
        for _ in range(int.from_bytes(data[:4], "little")):
            n = int.from_bytes(data[at : at + 8], "little")
            blocks = -(-n // RANK_BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            marks = np.frombuffer(data, np.uint8, blocks * RANK_BLOCK // 8, at + 8 + n)
            after = at + 8 + n + len(marks)
            self.levels.append((chunks, marks, np.frombuffer(data, "<i8", blocks, after)))
            at = after + 8 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """The id at a place, with one lookup for each of its chunks."""
        value = shift = 0
        for chunks, marks, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(marks, ranks, i)
        return value

    @staticmethod
    def _rank(marks: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before a place: the directory's, and those in its block."""
        block = i // RANK_BLOCK
        first = block * RANK_BLOCK // 8
        within = int.from_bytes(marks[first : (i >> 3) + 1].tobytes(), "little")
        return int(ranks[block]) + (within & ((1 << (i - block * RANK_BLOCK)) - 1)).bit_count()

    def all(self) -> np.ndarray:
        """All ids, from the last level up."""
        upper = np.zeros(0, np.uint32)
        for chunks, marks, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            goes_on = np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)
            ids[goes_on] |= upper << np.uint32(8)
            upper = ids
        return upper


# --- files -------------------------------------------------------------------


def write(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode all documents and write their segments in ascending order of ``doc_id``."""
    in_order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*in_order).sortWithinPartitions(*in_order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        for seq, (doc_ids, tokens, lengths) in enumerate(_segments(model, batches)):
            row = {
                "part": [part],
                "seq": [seq],
                "n_tokens": [len(tokens)],
                "doc_ids": [doc_ids],
                "lengths": [lengths.tolist()],
                "codes": [pack(tokens)],
            }
            yield pa.RecordBatch.from_pydict(row, _ARROW_SEGMENTS)

    dealt.mapInArrow(run, SEGMENTS).write.parquet(path)


_ARROW_SEGMENTS = pa.schema([
    ("part", pa.int32()),
    ("seq", pa.int32()),
    ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())),
    ("codes", pa.binary()),
])


def _segments(model: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, tokens and lengths, cut after ``SEGMENT_TOKENS`` at the end of a document."""
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for start, length in slices(batch.column(1), BATCH_BYTES):
            part = batch.slice(start, length)
            ids, lengths = model.batch(part.column(1))
            held.append((part.column(0).to_pylist(), ids, lengths))
            if sum(len(h[1]) for h in held) >= SEGMENT_TOKENS:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(held: list[tuple[list, np.ndarray, np.ndarray]]) -> tuple[list, np.ndarray, np.ndarray]:
    doc_ids, ids, lengths = zip(*held)
    return [d for some in doc_ids for d in some], np.concatenate(ids), np.concatenate(lengths)


def segment_starts(segments: DataFrame) -> DataFrame:
    """``part``, ``seq`` and the number of ids in all segments before.

    Only totals of parts meet in one task, one short row for each part.
    """
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return (
        sizes.withColumn("in_part", in_part)
        .join(parts.select("part", before.alias("before")), "part")
        .select("part", "seq", (F.col("before") + F.col("in_part")).alias("segment_start"))
    )


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and its ``ids``.

    ``start`` counts the ids of all documents before it; the checksum is of the ids as
    little-endian unsigned 32-bit integers.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    fields = "part int, seq int, offset long, doc_id long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, doc_ids, lengths, codes in zip(*batch.columns):
                ids = Codes(codes.as_py()).all().astype("<u4")
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                offsets = ends - sizes
                pieces = [ids[a:b] for a, b in zip(offsets, ends)]
                columns = [
                    pa.array([part.as_py()] * len(sizes), pa.int32()),
                    pa.array([seq.as_py()] * len(sizes), pa.int32()),
                    pa.array(offsets),
                    pa.array(doc_ids.as_py(), pa.int64()),
                    pa.array(sizes),
                    pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                ]
                if with_ids:
                    bounds = pa.array(np.append(0, ends).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                names = [*("part", "seq", "offset", "doc_id", "n_tokens", "ids_crc32"), *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = segments.select("part", "seq", "doc_ids", "lengths", "codes").mapInArrow(
        run, fields + (", ids array<int>" if with_ids else "")
    )
    return rows.join(segment_starts(segments), ["part", "seq"]).select(
        "doc_id",
        (F.col("segment_start") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *["ids"] * with_ids,
    )


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The id at each ``place`` (counted over all documents), without decoding blocks.

    A place goes to its segment by the ranges of ``segment_starts``; places outside
    the files and null places have no row.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    starts = segment_starts(segments).join(segments.select("part", "seq", "n_tokens"), ["part", "seq"])
    wanted = (
        places.select(F.col("place").cast("long").alias("place"))
        .join(
            starts,
            (F.col("place") >= F.col("segment_start"))
            & (F.col("place") < F.col("segment_start") + F.col("n_tokens")),
        )
        .select("part", "seq", "place", (F.col("place") - F.col("segment_start")).alias("offset"))
    )
    asked = wanted.groupBy("part", "seq").agg(F.collect_list(F.struct("place", "offset")).alias("asked"))

    @F.arrow_udf("array<int>")
    def look_up(codes: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for data, wanted in zip(codes, places):
            found = Codes(data.as_py())
            out.append([found.token(w["offset"]) for w in wanted.as_py()])
        return pa.array(out, pa.list_(pa.int32()))

    got = segments.join(asked, ["part", "seq"]).select(
        F.col("asked.place").alias("places"), look_up("codes", "asked").alias("ids")
    )
    return got.select(F.explode(F.arrays_zip("places", "ids")).alias("x")).select(
        F.col("x.places").alias("place"), F.col("x.ids").alias("id")
    )
