from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import ngram_join as nj
from barloom.llm.cells import cells_of, gathered, mix, only_ids, tally


def test_counts_of_cells_are_those_of_all_rows(spark):
    rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("id"))

    def keys(batch: pa.RecordBatch):
        yield mix(batch.column(0).to_numpy().view(np.uint64))

    found = gathered(tally(rows, keys, 18), 18)
    every = np.array([5 if i % 3 == 0 else i for i in range(3000)], np.uint64)
    assert (found == np.bincount(cells_of(mix(every), 18), minlength=1 << 18)).all()
    assert found.max() >= 1001
    assert not gathered(tally(rows.limit(0), keys, 18), 18).any()


def test_rows_of_ids_stay_and_few_others(spark):
    rows = spark.range(-5000, 5000).withColumn("text", F.lit("x"))
    wanted = {-5000, -1, 0, 1, 77, 4999}
    kept = {r.id for r in only_ids(rows, spark.createDataFrame([(i,) for i in wanted], "id long")).collect()}
    assert wanted <= kept and len(kept) < 20
    assert only_ids(rows, spark.range(0)).count() == 0


def test_a_passage_of_few_documents_brings_them_to_no_place(spark):
    """Each document in a block of its own, so that no block has the passage twice."""
    passage = " ".join(f"shared{i}" for i in range(20))
    count = 2 * nj.SMALL_BUCKET
    own = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i)))
    text = F.concat_ws(" ", F.concat_ws(" ", own), F.lit(passage))
    table = spark.range(0, count, 1, count).select(F.col("id").alias("doc_id"), text.alias("text"))
    for n, percent in [(3, 90), (5, 80)]:
        assert nj.places(nj.classes(table, n, percent), percent).count() == 0
