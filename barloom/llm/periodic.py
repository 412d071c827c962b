"""Periodic runs of words, found at many scales by minimizers.

A run is a longest stretch of words that repeats with a smallest period ``q`` (words
``q`` apart are identical), of at least ``copies`` periods and ``least_words`` words.
Many texts are searched at once, joined with a mark of its own after each.

1.  Periods up to ``DIRECT`` are too short for windows: for each such lag the words are
    compared with those a lag further on, and long stretches of equal ones are runs.
2.  Longer periods fall in scales ``low..high`` with ``2 * high <= 3 * low``. At a scale
    ``high`` words in a row are one gram, and each window of ``2 * low`` words has its
    minimizer, the gram of the smallest hash, the leftmost of equal ones. Inside a run
    of period ``q`` a window and the window ``q`` further on hold the same words, so the
    minimizer comes again ``q`` further on; and as a gram is no shorter than ``q`` it
    cannot come in between, or ``q`` were not the smallest period. Hence every run has two
    neighbouring equal minimizers ``q`` apart: the seed.
3.  Seeds are extended to both sides by comparing words, so a chance agreement of hashes
    adds nothing. A stretch with a shorter period is left to that period's scale.

Grams of any length are hashed from two overlapping hashes of a power of two, by a
nonlinear mixture: texts made to defeat rolling sums are of no effect. The work is
linear in the words for each of the scales, whose number grows with the logarithm of the
longest text; a scale looks only at texts of at least ``copies`` times its periods.

Nulls and the like: a null or empty text has no words and no runs. Overlapping runs are
all reported, and a word is dropped if any run repeats it. Texts are never cut; a very
long one is searched in one task, in memory in proportion to its length. Repeated rows
are each judged; an empty table stays empty. Added columns come back under the names
given; a column of the same name is replaced, all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import slices

LEAST_WORDS = 24
COPIES = 3
DIRECT = 8
SEARCHED_BYTES = 4 << 20  # of texts searched together

_U64 = np.uint64
_RUN = "array<struct<start:long,length:long,period:long>>"


# --- hashes and windows ------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U64(32)) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ x >> _U64(32)) * _U64(0xD6E8FEB86659FD93)
    return x ^ x >> _U64(32)


def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of grams from those of their beginnings and of their ends, ``shift`` further on."""
    count = max(0, len(right) - shift)
    return _mix(left[:count] * _U64(0x9E3779B97F4A7C15) + (right[shift : shift + count] ^ _U64(shift)))


def _leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places that are the minimum of some window, the leftmost of equal ones.

    The place fills the low bits, so order is by the high bits of the hash, then place.
    """
    count = len(hashes)
    if count < width:
        return np.zeros(0, np.int64)
    bits = _U64(int(count).bit_length())
    blocks = -(-count // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, _U64)
    keys[:count] = hashes >> bits << bits | np.arange(count, dtype=_U64)
    table = keys.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: count - width + 1], ahead[width - 1 : count])
    chosen = np.zeros(count, bool)
    chosen[(least & ((_U64(1) << bits) - _U64(1))).view(np.int64)] = True
    return np.flatnonzero(chosen)


# --- runs of numbered words --------------------------------------------------


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``lag`` apart are identical."""
    start, step = at, 64
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + lag : start + lag])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    end, step = at, 64
    while end < len(words) - lag:
        high = min(len(words) - lag, end + step)
        differ = np.flatnonzero(words[end:high] != words[end + lag : high + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, 2 * step
    return start, end + lag


def _has_shorter_period(words: np.ndarray, start: int, period: int) -> bool:
    """Whether one period is itself several copies of something shorter."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        shift = period // factor
        if np.array_equal(words[start : start + period - shift], words[start + shift : start + period]):
            return True
        while rest % factor == 0:
            rest //= factor
    return False


def runs(words: np.ndarray, lengths: np.ndarray, least_words: int = LEAST_WORDS, copies: int = COPIES) -> np.ndarray:
    """Rows of start, length and period: all runs of texts laid end to end.

    ``lengths`` are those of the texts, falling; each text's last number is a mark that
    occurs nowhere else.
    """
    if copies < 3:
        raise ValueError("runs are found from three copies on")
    ends = np.cumsum(lengths)
    found: list[tuple[int, int, int]] = []

    def long_enough(least: int) -> np.ndarray:
        """The words of the texts that have so many."""
        some = int(np.searchsorted(-lengths, -(least + 1), "right"))
        return words[: ends[some - 1] if some else 0]

    def keep(start: int, length: int, period: int) -> None:
        if length >= max(least_words, copies * period) and not _has_shorter_period(words, start, period):
            found.append((start, length, period))

    for lag in range(1, DIRECT + 1):
        some = long_enough(max(least_words, copies * lag))
        if not len(some):
            break
        differ = np.flatnonzero(some[:-lag] != some[lag:])
        edges = np.r_[-1, differ, len(some) - lag]
        equal = np.diff(edges) - 1
        for i in np.flatnonzero(equal >= max(least_words, copies * lag) - lag).tolist():
            keep(int(edges[i]) + 1, int(equal[i]) + lag, lag)

    low, power = DIRECT + 1, 1
    some = long_enough(max(least_words, copies * low))
    hashes = _mix(some.astype(np.int64).view(_U64) + _U64(0x5851F42D4C957F2D))  # of grams of ``power`` words
    while len(some := long_enough(max(least_words, copies * low))):
        high = 3 * low // 2
        while 2 * power <= high:
            hashes = _joined(hashes, hashes, power)
            power *= 2
        hashes = hashes[: max(0, len(some) - power + 1)]
        grams = _joined(hashes, hashes, high - power) if high > power else hashes
        places = _leftmost_minima(grams, 2 * low - high + 1)
        by_gram = places[np.argsort(grams[places], kind="stable")]
        apart = np.diff(by_gram)
        seeds = (grams[by_gram[1:]] == grams[by_gram[:-1]]) & (apart >= low) & (apart <= high)
        at, lags = by_gram[:-1][seeds], apart[seeds]
        for lag in np.unique(lags).tolist():
            starts = np.sort(at[lags == lag])
            i = 0
            while i < len(starts):
                start, end = _stretch(some, int(starts[i]), lag)
                keep(start, end - start, lag)
                i = int(np.searchsorted(starts, end - lag))
        low = high + 1
    return np.array(sorted(found), np.int64).reshape(-1, 3)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def runs_of_texts(texts: list[list[bytes]], least_words: int = LEAST_WORDS, copies: int = COPIES) -> list[np.ndarray]:
    """For each text, given as its words, the rows of start, length and period of its runs."""
    found = [np.zeros((0, 3), np.int64)] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= least_words), key=lambda i: -len(texts[i]))
    if not order:
        return found
    numbers = _Numbers()
    lengths = np.array([len(texts[i]) + 1 for i in order])
    words = np.empty(lengths.sum(), np.int64)
    ends = np.cumsum(lengths)
    for mark, (i, end) in enumerate(zip(order, ends.tolist())):
        words[end - len(texts[i]) - 1 : end - 1] = np.fromiter(map(numbers.__getitem__, texts[i]), np.int64, len(texts[i]))
        words[end - 1] = -1 - mark
    rows = runs(words, lengths, least_words, copies)
    text = np.searchsorted(ends, rows[:, 0], "right")
    for nth in np.unique(text).tolist():
        own = rows[text == nth]
        found[order[nth]] = own - [ends[nth] - lengths[nth], 0, 0]
    return found


def without_repeats(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words, each run reduced to its first period."""
    if not len(found):
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found.tolist():
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


# --- tables ------------------------------------------------------------------


def with_runs(
    docs: DataFrame,
    text: str = "text",
    least_words: int = LEAST_WORDS,
    copies: int = COPIES,
    names: tuple[str, str, str] = ("n_words", "runs", "collapsed"),
) -> DataFrame:
    """``docs`` with the number of words, the runs by start and period, and the text without repeats.

    The collapsed text is the kept words with one space between them.
    """

    others = [c for c in docs.columns if c not in names]
    found = _found_runs(docs.select(*[f"`{c}`" for c in {**dict.fromkeys(others), text: None}]), text, least_words, copies)
    added = [F.col(f"found.{a}").alias(b) for a, b in zip(("n", "runs", "kept"), names)]
    return found.select(*[F.col(f"row.`{c}`") for c in others], *added)


def _found_runs(docs: DataFrame, text: str, least_words: int, copies: int) -> DataFrame:
    """The whole ``row`` as one column beside what is ``found``, so that no names meet."""

    @F.arrow_udf(f"n long, runs {_RUN}, kept string")
    def searched(texts: pa.Array) -> pa.Array:
        parts = [_searched(texts.slice(start, count), least_words, copies) for start, count in slices(texts, SEARCHED_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], _FOUND)

    return docs.select(F.struct("*").alias("row"), searched(F.col(f"`{text}`").cast("binary")).alias("found"))


_FOUND = pa.struct([
    ("n", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("kept", pa.string()),
])


def _searched(texts: pa.Array, least_words: int, copies: int) -> pa.Array:
    words = [(text.as_py() or b"").split() for text in texts]
    found = runs_of_texts(words, least_words, copies)
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    each = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
    offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
    kept = pa.array([b" ".join(without_repeats(w, f)) for w, f in zip(words, found)], pa.binary()).cast(pa.string())
    counts = pa.array([len(w) for w in words], pa.int64())
    return pa.StructArray.from_arrays([counts, pa.ListArray.from_arrays(offsets, each), kept], fields=list(_FOUND))


def most_repeated(found: Column) -> Column:
    """The run of the greatest length over period, exactly; the first of equal ones. Null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, none, lambda best, run: F.when(
        best.isNull() | (run.length * best.period > best.length * run.period), run
    ).otherwise(best))


def collapse(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, copies: int = COPIES) -> DataFrame:
    """``docs`` with every run reduced to its first period; texts without runs stay as they are."""
    found = _found_runs(docs, text, least_words, copies)
    shorter = F.when(F.size("found.runs") > 0, F.col("found.kept")).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[shorter.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
