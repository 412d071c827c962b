"""Quality rules judged by an isolation forest.

Each text is reduced to counts (words, symbols, repeated lines, repeated word
windows). Two plain rules fail a text outright. The rest is judged by an isolation
forest over rule statistics: random splits of their ranges leave ordinary documents
deep in the trees and put odd ones alone after a few splits, so a short mean path
marks an anomaly. How short is too short is calibrated from labelled rows.

The forest and its threshold are fitted on at most ``SAMPLE_ROWS`` labelled rows
(the first by a hash of their id, so every run takes the same). Counting and judging
is one pass over the documents, with no shuffle.

Nulls and the like: a null or empty text has no words and fails the rules. Labels
that are null, or whose document is missing, teach nothing. Without labelled good and
bad documents there is no threshold, and the plain rules alone decide. Equal rows get
equal verdicts. Added columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.sampling import first_by_hash

SAMPLE_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
N_TREES = 100
TREE_ROWS = 256
DEPTH = 8
GOOD_COST = 20  # a good document lost counts as this many bad ones kept

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space, UTF-8 continuation bytes
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The value of each rule statistic at which the rule is fully broken.
RULE_LIMITS = {"symbols_per_word": 0.1, "dup_lines": 0.5, "repeated_words": 0.5, "word_length": 3.0}
USUAL_WORD_LENGTH = 5.0


def count_text(text: bytes | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one UTF-8 text. ``bytes.split`` splits at ASCII white space only."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        repeated = _repeated_words(windows)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


def _repeated_words(windows: list[tuple[bytes, ...]]) -> int:
    seen: dict[tuple[bytes, ...], int] = {}
    covered = bytearray(len(windows) + 2)
    for at, window in enumerate(windows):
        first = seen.setdefault(window, at)
        if first != at:
            covered[at : at + 3] = covered[first : first + 3] = b"\1\1\1"
    return covered.count(1)


def count_texts(texts: pa.Array) -> np.ndarray:
    rows = [count_text(text.as_py()) for text in texts]
    return np.array(rows, np.int64).reshape(len(rows), len(COUNTS))


def fails_rules(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])


def rule_statistics(counts: np.ndarray) -> np.ndarray:
    """How far each rule is broken, from 0 to 1."""
    words, chars, symbols, dup_lines, repeated, lines = counts.astype(float).T
    some = np.maximum(words, 1)
    broken = (
        symbols / some,
        dup_lines / np.maximum(lines, 1),
        repeated / some,
        np.abs(chars / some - USUAL_WORD_LENGTH),
    )
    return np.minimum(np.stack(broken, 1) / np.array(list(RULE_LIMITS.values())), 1.0)


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """The mean depth of an unsuccessful search among ``n`` rows of a random tree."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays: node ``i`` has the children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # tree x inner node
    split: np.ndarray
    path: np.ndarray  # tree x leaf: length of the path that ends there

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1, higher for shorter mean paths."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at_row, feature[node]] >= split[node])
            total += path[node - len(feature)]
        return 2 ** (-total / len(self.path) / _mean_path(TREE_ROWS))


def grow_forest(ordinary: np.ndarray, seed: int = 7) -> Forest:
    """Trees over samples of ordinary rows, split at random points of the whole 0-1 range.

    Splitting the range of all rows rather than that of the sample is what isolates
    values that ordinary rows never take.
    """
    rng = np.random.default_rng(seed)
    inner, width = 2**DEPTH - 1, ordinary.shape[1]
    features = np.zeros((N_TREES, inner), np.int64)
    splits, paths = np.zeros((N_TREES, inner)), np.zeros((N_TREES, inner + 1))
    for tree in range(N_TREES):
        size = min(TREE_ROWS, len(ordinary))
        nodes = {0: (ordinary[rng.choice(len(ordinary), size, replace=False)], np.zeros(width), np.ones(width))}
        ended: dict[int, float] = {}
        for node in range(2 * inner + 1):
            depth = (node + 1).bit_length() - 1
            if node > 0 and (parent := (node - 1) // 2) in ended:
                ended[node] = ended[parent]
                rows = None
            else:
                rows, low, high = nodes.pop(node)
                if len(rows) <= 1 or depth == DEPTH:
                    ended[node] = depth + float(_mean_path(len(rows)))
            if depth == DEPTH:
                paths[tree, node - inner] = ended[node]
            elif rows is not None:
                f = int(rng.integers(width))
                at = rng.uniform(low[f], high[f])
                features[tree, node], splits[tree, node] = f, at
                right = rows[:, f] >= at
                below, above = high.copy(), low.copy()
                below[f] = above[f] = at
                nodes[2 * node + 1], nodes[2 * node + 2] = (rows[~right], low, below), (rows[right], above, high)
    return Forest(features, splits, paths)


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The score above which a document is rejected, by labelled documents."""
    if good.all() or not good.any():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    ranked, is_good = scores[order], good[order]
    caught, lost = np.cumsum(~is_good) / (~good).sum(), np.cumsum(is_good) / good.sum()
    last_of_tie = np.append(ranked[1:] < ranked[:-1], True)
    gain = np.where(last_of_tie, caught - GOOD_COST * lost, -np.inf)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    following = ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1e-6
    # Close to the bad rows: documents unlike either kind are kept.
    return float(ranked[best] - (ranked[best] - following) / 10)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Forest, float] | None:
    """The forest and its threshold, from at most ``sample_rows`` labelled documents."""
    labelled = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    sample = first_by_hash(labelled, sample_rows, F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"))
    counts = _counts(F.col("text"))
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # at most sample_rows short rows
        .select("quality", counts.alias("counts"))
        .select("quality", *[f"counts.{name}" for name in COUNTS])
        # Only repeated ids can exceed the sample; which of their rows stay follows from the rows.
        .orderBy(F.xxhash64("quality", *COUNTS), "quality", *COUNTS)
        .limit(2 * sample_rows)
        .toPandas()
        .sort_values(["quality", *COUNTS])
    )
    rows = found[list(COUNTS)].to_numpy(np.int64).reshape(-1, len(COUNTS))
    passed = ~fails_rules(rows) if len(rows) else np.zeros(0, bool)
    rows, good = rows[passed], found["quality"].to_numpy()[passed] == 1
    if not good.any():
        return None
    statistics = rule_statistics(rows)
    forest = grow_forest(statistics[good])
    return forest, calibrate(forest.score(statistics), good)


def _counts(text: Column) -> Column:
    @F.arrow_udf(", ".join(f"{name} long" for name in COUNTS))
    def counted(texts: pa.Array) -> pa.Array:
        columns = count_texts(texts).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(COUNTS))

    return counted(text.cast("binary"))


def judge(docs: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    """``docs`` with their counts, ``base_failed``, the anomaly ``score`` and ``kept``."""
    fields = [*((name, "long") for name in COUNTS), ("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")]

    @F.arrow_udf(", ".join(f"{name} {kind}" for name, kind in fields))
    def judged(texts: pa.Array) -> pa.Array:
        counts = count_texts(texts)
        failed, score = fails_rules(counts), np.zeros(len(counts))
        odd = np.zeros(len(counts), bool)
        if model is not None:
            score = model[0].score(rule_statistics(counts))
            odd = score > model[1]
        columns = [*counts.T, failed, score, ~failed & ~odd]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], [name for name, _ in fields])

    names = [name for name, _ in fields]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("row")
    got = judged(F.col("text").cast("binary")).alias("judged")
    return docs.select(row, got).select("row.*", *[f"judged.{name}" for name in names])
