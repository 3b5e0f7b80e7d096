"""Sharding by fixed virtual slots: rows hash into thousands of slots, and a versioned map sends slots to shards.

Only the map is ever edited. Bytes are added up for each slot, a map is built from them by longest-processing-time
assignment, and rebalancing moves as few slots as it takes, as a new version of the map. Slots are a fixed number,
so sums and maps have that many rows at most, whatever the input. All of it is DataFrame expressions.

Defined results: a null text is empty (size 1, crc 0); a null doc_id hashes as a value of its own; repeated rows
are rows of their own; an empty table gives no rows (and a map of empty slots); other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 4096
LAW = "bytes"


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds size (UTF-8 bytes and 1), text_crc32 and vslot. The text's crc spreads rows that repeat a doc_id."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select(
        "*",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) for all slots, empty ones too. Partial sums leave one row a slot and task to shuffle."""
    sums = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _lightest(load: Column) -> Column:
    return (F.array_position(load, F.array_min(load)) - 1).cast("int")


def _add(load: Column, at: Column, n: Column) -> Column:
    return F.transform(load, lambda x, i: F.when(i == at, x + n).otherwise(x))


def build_map(sums: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, vslot, shard): the heaviest slot first, each to the shard that is lightest so far.

    The fold goes over the slots, whose number is fixed, not over rows.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot")))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"),
        F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"),
    )

    def place(state: Column, slot: Column) -> Column:
        at = _lightest(state["load"])
        return F.struct(
            _add(state["load"], at, -slot["less"]).alias("load"),
            F.concat(state["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), at.alias("shard")))).alias("placed"),
        )

    return (
        sums.agg(order.alias("slots"))
        .select(F.explode(F.aggregate("slots", empty, place, lambda s: s["placed"])).alias("p"))
        .select(F.lit(version).alias("version"), "p.vslot", "p.shard")
    )


def rebalance(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for a new number of shards; slots move only from shards that hold too much.

    Each shard keeps slots, in order of their hash, up to its even share of the bytes; slots beyond it, and those of
    shards that are gone, go to the lightest shards.
    """
    held = current.join(sums, "vslot")
    kept_before = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot"))
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / F.lit(shards))
    marked = held.select("version", "vslot", "bytes", "shard", ((kept_before <= share) & (F.col("shard") < shards)).alias("stays"))
    slots = F.sort_array(F.collect_list(F.struct((~F.col("stays")).alias("moves"), (-F.col("bytes")).alias("less"), "vslot", "shard")))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"),
        F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"),
    )

    def place(state: Column, slot: Column) -> Column:
        at = F.when(slot["moves"], _lightest(state["load"])).otherwise(slot["shard"])
        return F.struct(
            _add(state["load"], at, -slot["less"]).alias("load"),
            F.concat(state["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), at.alias("shard")))).alias("placed"),
        )

    return (
        marked.groupBy().agg(slots.alias("slots"), (F.max("version") + 1).alias("version"))
        .select("version", F.explode(F.aggregate("slots", empty, place, lambda s: s["placed"])).alias("p"))
        .select("version", "p.vslot", "p.shard")
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version of a map to the stored ones; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).select("version", "vslot", "shard")


def assign(slotted: DataFrame, slot_map: DataFrame, sums: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, without gaps from 0.

    A place is the number of rows in the shard's earlier virtual slots and the row's rank in its own, so no task
    sees a whole shard. The map and the offsets have one row for each of the fixed slots: safe to broadcast.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    offsets = slot_map.join(sums, "vslot").select("vslot", "shard", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32")) - 1
    return slotted.withColumn("rank", rank).join(F.broadcast(offsets), "vslot").withColumn("slot", F.col("before") + F.col("rank")).drop("rank", "before")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot of every row, under a byte-balanced map."""
    slotted = with_slots(docs.select("doc_id", "text"), slots).drop("text")
    sums = slot_bytes(slotted, slots)
    return assign(slotted, build_map(sums, shards), sums)
