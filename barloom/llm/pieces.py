"""SentencePiece encoding that keeps track of the bytes every piece came from.

A text is normalised as its model says: at each place the longest entry of the
compiled character map (a double-array trie stored in the model) is replaced, white
space is handled, and for every normalised byte the source byte is recorded. Pieces
are contiguous in the normalised text, so that record projects each to a span of
bytes of the original.

The normalised text is cut where no piece of the vocabulary can reach across (before
a word mark that follows other characters, and around line feeds if no piece has
one); cuts that a vocabulary does not allow are not made. The library encodes each
distinct chunk, and a bounded cache in the worker keeps the frequent ones.

Everything runs inside the scan's tasks: no shuffle, and batches leave in slices, so
memory follows the longest text, not the batch.

Nulls and the like: a null text is encoded as an empty one, which has only the end
id. Invalid UTF-8 cannot occur in a Spark string column read from Parquet text; such
bytes normalise to U+FFFD, one by one. Equal rows get equal results, an empty table an
empty one. Added columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from barloom.llm.batches import slices

MARK = "▁"  # stands for a space in normalised text
CACHED_CHUNKS = 400_000
SLICE_BYTES = 1 << 20  # text of one batch that leaves a task

ADDED = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>"}


class CharMap:
    """The compiled character map: longest-prefix replacement through its trie.

    The blob holds the trie's size, its 32-bit units, and the replacements as strings
    that end with a zero byte. A unit's bits give the label that leads to it, whether
    a value follows, and the offset to its children.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest entry that starts at a byte, and its length."""
        units, found = self.units, None
        if not units:
            return None
        place = self._children(units[0])
        for i in range(at, len(text)):
            place ^= text[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != text[i]:
                break
            place ^= self._children(unit)
            if unit >> 8 & 1:
                found = units[place] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(0, start)], length

    @staticmethod
    def _children(unit: int) -> int:
        return unit >> 10 << ((unit >> 9 & 1) * 8)

    def step(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What stands at a byte after normalisation, and how many bytes it took."""
        found = self.longest(text, at)
        if found is not None:
            return found
        lead = text[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        char = text[at : at + length]
        try:
            char.decode()
            return char, length
        except UnicodeDecodeError:
            return b"\xef\xbf\xbd", 1


class Normaliser:
    """Normalised bytes, and for each the source byte at which what it came from starts."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = (
            spec.add_dummy_prefix,
            spec.remove_extra_whitespaces,
            spec.escape_whitespaces,
        )
        self.mark = MARK.encode() if self.escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units and not self.squeeze:
            return self._plain(text)
        out, source, at = bytearray(), [], 0
        after_space = self.squeeze
        end = len(text)
        while at < len(text):
            new, taken = self.map.step(text, at)
            while after_space and new.startswith(b" "):
                new = new[1:]
            if new:
                if not out and self.prefix:
                    out += self.mark
                    source += [at] * len(self.mark)
                shown = new.replace(b" ", self.mark)
                out += shown
                source += [at] * len(shown)
                after_space = self.squeeze and new.endswith(b" ")
            at += taken
        if self.squeeze:
            while out.endswith(self.mark):
                del out[-len(self.mark) :]
                end = source[-len(self.mark)]
                del source[-len(self.mark) :]
        return bytes(out), np.array([*source, end], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change, so alignment is arithmetic."""
        if not text:
            return b"", np.zeros(1, np.int64)
        width = np.ones(len(text) + 1, np.int64)
        if self.escape:
            width[:-1] += 2 * (np.frombuffer(text, np.uint8) == 0x20)
        source = np.repeat(np.arange(len(text) + 1), width)
        shown = text.replace(b" ", self.mark)
        if self.prefix:
            shown = self.mark + shown
            source = np.concatenate([np.zeros(len(self.mark), np.int64), source])
        return shown, source


class Encoder:
    """One model: its normaliser, its vocabulary and the chunks seen so far."""

    def __init__(self, model_path: str):
        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.whole.serialized_model_proto())
        self.normalise = Normaliser(proto.normalizer_spec)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        joined = [p.piece for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        self.end_id = self.whole.eos_id()
        self.cuts_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p in joined)
        self.cuts_lines = self.cuts_words and not any("\n" in p for p in joined)
        widths = [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces]
        self.widths = np.array(widths, np.int64)
        self.unknown = self.whole.unk_id()
        self.cache: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The normalised text in parts that no piece reaches across."""
        if not self.cuts_words:
            return [text]
        if not self.cuts_lines:
            return self._words(text)
        lines = text.split("\n")
        return list(chain.from_iterable(
            self._words(line) if i == 0 else ["\n", *self._words(line)] for i, line in enumerate(lines)
        ))

    @staticmethod
    def _words(line: str) -> list[str]:
        if MARK + MARK in line:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)
        first, *rest = line.split(MARK)
        words = [MARK + word for word in rest]
        return [first, *words] if first else words

    def ids(self, normalised: bytes) -> np.ndarray:
        chunks = self.chunks(normalised.decode())
        cache = self.cache
        try:
            return np.frombuffer(b"".join([cache[c] for c in chunks]), np.int32)
        except KeyError:
            new = [c for c in dict.fromkeys(chunks) if c not in cache]
        if len(cache) + len(new) > CACHED_CHUNKS:
            cache.clear()
            new = list(dict.fromkeys(chunks))
        for chunk, ids in zip(new, self.plain.encode(new, num_threads=1)):
            cache[chunk] = np.array(ids, np.int32).tobytes()
        return np.frombuffer(b"".join([cache[c] for c in chunks]), np.int32)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id, and the first and last-plus-one source byte of each piece."""
        normalised, source = self.normalise(text)
        ids = self.ids(normalised)
        widths = self.widths[ids]
        if self.unknown in ids:
            widths = self._unknown_widths(normalised, ids, widths)
        places = np.concatenate([[0], np.cumsum(widths)])
        if places[-1] != len(normalised):
            raise ValueError("pieces do not add up to the normalised text")
        bounds = source[places]
        end = np.array([len(text)])
        return (
            np.append(ids, np.int32(self.end_id)),
            np.concatenate([bounds[:-1], end]),
            np.concatenate([bounds[1:], end]),
        )

    def _unknown_widths(self, normalised: bytes, ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Unknown pieces have the width of what they stand for, found chunk by chunk."""
        proto = self.plain.encode(normalised.decode(), out_type="immutable_proto")
        return np.array([len(p.surface.encode()) for p in proto.pieces], np.int64)


@functools.lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    return Encoder(model_path)


def encode(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``starts`` and ``ends``; on request also ``decoded`` text."""
    added = ADDED | ({"decoded": "string"} if decoded else {})
    rest = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in rest]
    new = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items()))
    schema = T.StructType([*rest, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for start, length in slices(texts, SLICE_BYTES):
                part = texts.slice(start, length)
                rows = [model.encode((t.as_py() or "").encode()) for t in part]
                columns = [batch.column(name).slice(start, length) for name in names]
                columns += [_lists([row[k] for row in rows]) for k in range(3)]
                if decoded:
                    ids = [row[0].tolist() for row in rows]
                    columns.append(pa.array(model.whole.decode(ids, num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(run, schema)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the text ``decoded`` from a column of ids; null ids give null."""
    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        model = encoder(model_path)
        return pa.array([None if not x.is_valid else model.whole.decode(x.as_py()) for x in lists], pa.string())

    return encoded.withColumn("decoded", texts(F.col(ids)))
