"""From raw documents to token ids: five stages, each a use of one operator.

Every stage takes all rows its predecessor kept, is written as Parquet to the shared
folder and read again, so a lost executor costs tasks of one stage only. All stages but
the last return the columns of ``documents``.

Nulls and the like follow the operators: a null or empty text fails the quality rules;
rows with a null id are never removed as copies; an empty table passes through empty.
Of equal ids and texts one stays, of near copies the smallest id; ties in any score are
judged alike. Texts of any length are taken whole. Extra columns of ``documents`` pass
through all stages but the last whatever their names, as operators work beside the row.

Every stage leaves the session with batches to Python of about ``BATCH_BYTES``, as its rows
are taken after it returned. Executors keep the memory of the largest batches of any stage,
outside the heap and in idle Python workers, and later stages come on top of that.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, ngram_join, pieces, quality, secrets
from barloom.llm.batches import bound_batches
from barloom.scratch import stored

PIECE_MODEL = "piece_bpe_32k.model"
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
BATCH_BYTES = 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _beside(docs: DataFrame, *needed: str) -> DataFrame:
    """Each whole ``row`` as one column, and beside it what an operator needs."""
    return docs.select(F.struct("*").alias("row"), *needed)


def _in_small_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


@_in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(_beside(docs, "text"), model).where("kept").select("row.*")


@_in_small_batches
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.deduplicate(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


@_in_small_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.remove_documents(docs, _table(spark, sf_dir, "benchmark"))


@_in_small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    words = secrets.dictionary(docs)
    trees = secrets.train(secrets.rule_labels(docs), words)
    scanned = secrets.scan(_beside(docs, "text", "source"), trees, words)
    has_secret = F.exists("findings", lambda f: f.is_secret)
    masked = secrets.redact(scanned.withColumn("has_secret", has_secret))
    kind = docs.schema["n_chars"].dataType
    n_chars = F.when(F.col("has_secret"), F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return masked.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_in_small_batches
def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with the end id."""
    encoded = pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL cannot grow the forests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
