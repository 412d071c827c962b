from __future__ import annotations

import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import queries, sharding
from tests.llm.helpers import docs, empty


def _place(spark, table, n_shards=3, n_slots=64):
    sized = table.select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32")
    )
    slotted = sharding.with_slots(sized, ("doc_id", "text_crc32"), n_slots)
    loads = sharding.slot_loads(slotted, n_slots)
    return loads, sharding.assign(slotted, loads, sharding.edit_map(loads, n_shards)).toPandas()


def test_query_places_every_document(spark):
    placed = queries.op1_sharding(spark, "/root/testdata/sf0.01").toPandas()
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text.map(str.encode)
    placed = placed.set_index("doc_id").loc[texts.index]
    assert placed["size"].tolist() == [len(t) + 16 for t in texts]
    assert placed.text_crc32.tolist() == [zlib.crc32(t) for t in texts]
    assert all(sorted(g) == list(range(len(g))) for _, g in placed.groupby("shard").slot)
    loads = placed.groupby("shard")["size"].sum()
    assert sorted(loads.index) == list(range(40))
    assert loads.max() - loads.min() <= placed["size"].max()
    assert loads.max() <= 1.02 * loads.mean()


def test_nulls_repeats_and_clashing_columns(spark):
    table = docs(spark, [None, "", "a", "a", "é"], [None, None, 1, 1, 2]).withColumn("shard", F.lit("mine"))
    _, placed = _place(spark, table)
    assert sorted(placed["size"]) == [16, 16, 17, 17, 18]
    assert sorted(placed.text_crc32)[:2] == [0, 0]
    assert all(sorted(g) == list(range(len(g))) for _, g in placed.groupby("shard").slot)


def test_empty_table(spark):
    loads, placed = _place(spark, empty(spark))
    assert len(placed) == 0
    assert loads.count() == 64


def test_growing_moves_few_slots_and_keeps_versions(spark, tmp_path):
    rows = [(i, 10 + i % 7, 1000 + 37 * (i % 11)) for i in range(256)]
    loads = spark.createDataFrame(rows, "virtual_slot int, records long, bytes long")
    path = str(tmp_path / "map")
    sharding.write_map(sharding.edit_map(loads, 4), path)
    old = sharding.read_map(spark, path)
    sharding.write_map(sharding.edit_map(loads, 5, old), path)
    first = sharding.read_map(spark, path, 1).toPandas().set_index("virtual_slot").shard
    second = sharding.read_map(spark, path).toPandas().set_index("virtual_slot")
    assert set(second.version) == {2}
    moved = second.shard[second.shard != first.loc[second.index]]
    assert 256 / 5 * 0.8 <= len(moved) <= 256 / 5 * 1.3
    weight = pd.Series({slot: size for slot, _, size in rows})
    totals = weight.groupby(second.shard).sum()
    assert totals.max() - totals.min() <= weight.max()


def test_shrinking_empties_the_last_shard(spark):
    loads = spark.createDataFrame([(i, 1, 100) for i in range(60)], "virtual_slot int, records long, bytes long")
    four = sharding.edit_map(loads, 4)
    three = sharding.edit_map(loads, 3, four).toPandas()
    assert three.shard.value_counts().to_dict() == {0: 20, 1: 20, 2: 20}


def test_slots_are_bounded(spark):
    with pytest.raises(ValueError):
        sharding.with_slots(empty(spark), n_slots=sharding.MAX_SLOTS + 1)
