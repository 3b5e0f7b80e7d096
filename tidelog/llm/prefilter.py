"""A set of keys as a bitmap of fixed size, to decide which rows of a large table are worth shuffling.

The bitmap lets some keys through by chance, never stops one that is in the set, and has a proven size, so it may be
broadcast whatever the input. What it lets through is settled exactly by whoever uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB at most: bits / 32768 rows of 4 KB.
BITS = 1 << 26


def cells(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(cell, bitmap) of the keys, 64-bit hashes."""
    slot = F.pmod(key, F.lit(bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def marked(rows: DataFrame, found: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """Adds __hit, true for each row whose key may be in the set of cells."""
    slot = F.pmod(key, F.lit(bits)) + 1
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    side = F.broadcast(found.select(F.col("cell").alias("__cell"), F.col("bitmap").alias("__bitmap")))
    return rows.join(side, F.bitmap_bucket_number(slot) == F.col("__cell"), "left").withColumn("__hit", F.coalesce(bit, F.lit(False))).drop("__cell", "__bitmap")


def remove(rows: DataFrame, gone: DataFrame, key: Column, again: DataFrame | None = None) -> DataFrame:
    """The rows whose key (a string or number, never null) isn't in gone; of those with a key in again, one each.

    gone and again have one column. Only rows that the bitmap lets through are shuffled, so the whole texts of the
    rest stay where they are.
    """
    side = gone.select(F.col(gone.columns[0]).alias("__gone"))
    twice = None if again is None else again.select(F.col(again.columns[0]).alias("__gone"))
    asked = side if twice is None else side.union(twice)
    seen = marked(rows.withColumn("__key", key), cells(asked, F.xxhash64("__gone")), F.xxhash64("__key"))
    clear = seen.where(~F.col("__hit")).drop("__hit", "__key")
    rest = seen.where("__hit").join(side, F.col("__key") == F.col("__gone"), "left_anti")
    if twice is not None:
        rest = rest.dropDuplicates(["__key"])
    return clear.unionByName(rest.drop("__hit", "__key"))
