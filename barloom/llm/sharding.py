"""Sharding over fixed virtual slots.

Records hash into a few thousand slots whose number never changes. Bytes are summed
per slot, and a stored, versioned table says which shard holds each slot. Balancing
and growing edit that table: records never hash anew, only whole slots move.

Everything is DataFrame work. The only tables that meet in one task or are broadcast
have a row per slot, at most ``MAX_SLOTS``.

Nulls and the like: a null text counts as an empty one, a null key hashes as null.
Equal records are each placed and counted. An empty table gives a map of empty slots.
Columns of the input that share a name with an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
MAX_SLOTS = 1 << 16  # bounds the map that is broadcast
RECORD_OVERHEAD = 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_OVERHEAD


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def with_slots(
    docs: DataFrame, keys: Sequence[str | Column] = ("doc_id", "text"), n_slots: int = N_SLOTS
) -> DataFrame:
    """``docs`` with the virtual slot of each record, by its keys alone.

    With the text among the keys, rows that share an id still spread over slots.
    """
    if not 0 < n_slots <= MAX_SLOTS:
        raise ValueError(f"n_slots must be from 1 to {MAX_SLOTS}")
    return docs.withColumn("virtual_slot", F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int"))


def slot_loads(slotted: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Records and bytes of every slot, empty ones too. Combined before the shuffle."""
    found = slotted.groupBy("virtual_slot").agg(
        F.count("*").alias("records"), F.sum("size").alias("bytes")
    )
    slots = slotted.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(found, "virtual_slot", "left").na.fill(0, ["records", "bytes"])


def edit_map(loads: DataFrame, n_shards: int, current: DataFrame | None = None) -> DataFrame:
    """The next version of the map (``version``, ``virtual_slot``, ``shard``).

    A shard keeps its largest slots as long as they fit in its fair share of all
    bytes; the slots left over go, largest first, each to the lightest shard. Without
    a current map all slots are dealt. Shards differ by little more than one slot.
    """
    if current is None:
        placed, version = loads.withColumn("shard", F.lit(None).cast("int")), F.lit(1)
    else:
        shard = F.when(F.col("shard") < n_shards, F.col("shard")).alias("shard")
        placed = loads.join(current.select("virtual_slot", shard, "version"), "virtual_slot", "left")
        version = F.coalesce(F.max("version").over(Window.partitionBy()), F.lit(0)) + 1
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    share = F.sum("bytes").over(Window.partitionBy()) / n_shards
    stays = F.col("shard").isNotNull() & (F.sum("bytes").over(largest_first) <= share)
    placed = placed.select(
        "virtual_slot", "bytes", F.when(stays, F.col("shard")).alias("shard"), version.alias("version")
    )
    slots = F.collect_list(F.struct("bytes", "virtual_slot", "shard"))
    dealt = placed.groupBy("version").agg(slots.alias("slots")).select("version", _dealt(n_shards))
    return dealt.select("version", F.explode("moves").alias("move")).select(
        F.col("version").cast("int"), "move.virtual_slot", "move.shard"
    )


def _dealt(n_shards: int) -> Column:
    """Kept slots as they are; each of the others to the shard with the fewest bytes."""
    kept = F.filter("slots", lambda s: s.shard.isNotNull())
    freed = F.reverse(F.array_sort(F.filter("slots", lambda s: s.shard.isNull())))
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda shard: F.aggregate(
            F.filter(kept, lambda s: s.shard == shard), F.lit(0).cast("long"), lambda a, s: a + s.bytes
        ),
    )
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def deal(state: Column, slot: Column) -> Column:
        def to(shard: Column) -> Column:
            loads = F.transform(
                state.loads, lambda load, i: F.when(i == shard, load + slot.bytes).otherwise(load)
            )
            return F.struct(loads.alias("loads"), F.concat(state.shards, F.array(shard)).alias("shards"))

        lightest = (F.array_position(state.loads, F.array_min(state.loads)) - 1).cast("int")
        return F.element_at(F.transform(F.array(lightest), to), 1)  # binds the shard once

    moves = F.zip_with(
        freed,
        F.aggregate(freed, start, deal, lambda state: state.shards),
        lambda s, shard: F.struct(s.virtual_slot.alias("virtual_slot"), shard.alias("shard")),
    )
    rest = F.transform(
        kept, lambda s: F.struct(s.virtual_slot.alias("virtual_slot"), s.shard.alias("shard"))
    )
    return F.concat(rest, moves).alias("moves")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to the stored ones."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest unless one is named."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        newest = stored.groupBy().agg(F.max("version").alias("version"))
        return stored.join(F.broadcast(newest), "version", "left_semi")  # one row
    return stored.where(F.col("version") == version)


def assign(slotted: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record with its shard and its place there, without gaps from 0.

    A slot's records start where the slots before it in its shard end, so places are
    counted slot by slot and no task sees a whole shard.
    """
    by_slot = Window.partitionBy("shard").orderBy("virtual_slot")
    starts = loads.join(slot_map, "virtual_slot").select(
        "virtual_slot", "shard", (F.sum("records").over(by_slot) - F.col("records")).alias("before")
    )
    kept = [c for c in slotted.columns if c not in ("shard", "slot", "before")]
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.select(*kept)
        .join(F.broadcast(starts), "virtual_slot")  # at most MAX_SLOTS rows
        .withColumn("slot", F.col("before") + F.row_number().over(in_slot) - 1)
        .drop("before")
    )
