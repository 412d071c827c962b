"""Language identification with bit-sliced Bloom filters of letter n-grams.

Training counts every three-letter gram (word edges included) of all labelled texts,
per language, in Spark. A language contains a gram if it uses it often enough, and not
far less often than the language that uses it most. All languages share one filter:
each slot holds a mask with a bit per language, and the masks at a gram's slots,
combined by AND, name every language that contains it, at the price of one lookup.

A text's masks are counted per language. The counts are corrected by each language's
rate of false positives, which follows from how full its bits are, and the largest
decides; its share of all corrected counts is the score.

A gram is kept only if it makes up ``MIN_RATE`` of a language's grams, so a language
keeps at most ``1 / MIN_RATE`` of them: that bounds what is collected and broadcast.

Nulls and the like: a null text, or one without a letter, is ``und`` with score 0.
Rows without a language teach nothing. A text none of whose grams is known gets the
language with the most training text, with score 0. With nothing to learn from every
text is ``und``. Equal rows get equal results; ties go to the first language by name.
Added columns replace columns of the same name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.scratch import stored

MIN_RATE = 5e-5
MIN_SHARE = 0.25  # of the rate in the language that uses the gram most
SLOTS_LOG2 = 19
HASHES = 3
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and gram codes (three code points of 21 bits), block by block.

    A gram's middle is a letter; what is no letter reads as a space. Texts longer than
    a block go through in parts that overlap by two characters, so each gram comes once.
    """
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        shown = f" {text.lower()} " if text else ""
        for start in range(0, max(0, len(shown) - 2), BLOCK_CHARS):
            parts.append(shown[start : start + BLOCK_CHARS + 2])
            rows.append(row)
            size += len(parts[-1])
            if size >= BLOCK_CHARS:
                yield _codes(parts, rows)
                parts, rows, size = [], [], 0
    if parts:
        yield _codes(parts, rows)


def _codes(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    # Two spaces between parts: no gram with a letter in its middle reaches across.
    points = np.frombuffer("  ".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    shown = np.where(is_letter, points, 32).astype(np.uint64)
    row = np.repeat(np.array(rows), [len(p) + 2 for p in parts])[: len(points)]
    inner = np.ones(len(points), bool)  # ends of parts belong to the neighbouring part
    ends = np.cumsum([len(p) + 2 for p in parts])
    inner[ends - 3] = False
    inner[np.append(0, ends[:-1])] = False
    middle = np.flatnonzero(is_letter & inner)
    codes = shown[middle - 1] << np.uint64(42) | shown[middle] << np.uint64(21) | shown[middle + 1]
    return row[middle], codes


def _slots(codes: np.ndarray, which: int) -> np.ndarray:
    """The slot of each code under one of the hash functions."""
    x = codes + np.uint64((0x9E3779B97F4A7C15 * (which + 1)) & (2**64 - 1))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    languages: list[str]
    fallback: int
    masks: np.ndarray  # slot x byte: bit ``i % 8`` of byte ``i // 8`` is language ``i``
    false_positives: np.ndarray  # per language

    @staticmethod
    def build(languages: list[str], fallback: str, kept: Iterable[tuple[str, int]]) -> LanguageFilter:
        number = {name: i for i, name in enumerate(languages)}
        masks = np.zeros((1 << SLOTS_LOG2, max(1, -(-len(languages) // 8))), np.uint8)
        by_language: dict[int, list[int]] = {}
        for language, gram in kept:
            by_language.setdefault(number[language], []).append(gram)
        for i, codes in by_language.items():
            for which in range(HASHES):
                masks[_slots(np.array(codes, np.uint64), which), i // 8] |= np.uint8(1 << i % 8)
        full = np.array([(masks[:, i // 8] >> i % 8 & 1).mean() for i in range(len(languages))])
        return LanguageFilter(languages, number.get(fallback, 0), masks, full**HASHES)

    def contained(self, codes: np.ndarray) -> np.ndarray:
        """For each gram the mask of all languages that contain it."""
        found = self.masks[_slots(codes, 0)]
        for which in range(1, HASHES):
            found = found & self.masks[_slots(codes, which)]
        return found

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and how many of them each language contains."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for rows, codes in grams(texts):
            total += np.bincount(rows, minlength=len(texts))
            masks, first = self.contained(codes), int(rows[0]) if len(rows) else 0
            for byte in range(masks.shape[1]):
                width = min(8, len(self.languages) - 8 * byte)
                span = int(rows[-1]) - first + 1 if len(rows) else 0
                seen = np.bincount((rows - first) * 256 + masks[:, byte], minlength=span * 256)
                bits = np.arange(256)[:, None] >> np.arange(width) & 1
                hits[first : first + span, 8 * byte : 8 * byte + width] += seen.reshape(span, 256) @ bits
        return total, hits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, hits = self.counts(texts)
        expected = total[:, None] * self.false_positives
        corrected = np.maximum((hits - expected) / (1 - np.minimum(self.false_positives, 0.999)), 0)
        best, summed = corrected.argmax(1), corrected.sum(1)
        best = np.where(summed > 0, best, self.fallback)
        score = corrected[np.arange(len(texts)), best] / np.maximum(summed, 1e-12)
        known = total > 0  # a gram has a letter in its middle
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, np.clip(score, 0, 1), 0.0)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``language``, ``gram``, ``n`` over all texts, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = batch.column(0).dictionary_encode()
            names, of_row = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
            for rows, codes in grams(batch.column(1).to_pylist()):
                languages = of_row[rows]
                for language in np.unique(languages):
                    found, n = np.unique(codes[languages == language], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[int(language)].as_py()] * len(found)), pa.array(found.astype(np.int64)), pa.array(n)],
                        ["language", "gram", "n"],
                    )

    rows = labelled.select("lang", "text").mapInArrow(run, "language string, gram long, n long")
    return rows.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame) -> LanguageFilter:
    """The filter of all languages in ``lang``, from rows that have one and a text."""
    counts = stored(gram_counts(labelled.where("lang is not null and text is not null")), "grams")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "language").withColumn("rate", F.col("n") / F.col("total"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = (
        rates.where(F.col("rate") >= MIN_RATE)
        .join(most, "gram")
        .where(F.col("rate") >= MIN_SHARE * F.col("most"))
        .select("language", "gram")
        .collect()  # at most 1 / MIN_RATE for each language
    )
    sizes = sorted((row.language, row.total) for row in totals.collect())
    fallback = max(sizes, key=lambda x: x[1])[0] if sizes else ""
    return LanguageFilter.build([name for name, _ in sizes], fallback, kept)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from their texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    return docs.select(row, predicted("text").alias("guess")).select("row.*", "guess.lang_pred", "guess.score")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
