"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: from an offset by a step,
both hashed from its name. Shards take turns, each claiming the first slot of its order that is
free, until the table is full; so shards own equal shares within one slot, and few slots move when
a shard joins or leaves. A row's key is hashed to a slot, and a broadcast of the table, whose size
is the parameter `slots`, gives its shard. Only SQL functions are used; no row is shuffled.

Cases: a null key is placed like the empty text; equal keys share a shard; other columns pass,
those named slot and shard are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over 100 times the number of shards keeps shares within one percent.
SLOTS = 2039


def number(value: Column, seed: str) -> Column:
    """The first 8 hex digits of the MD5 of seed and value, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), value)), 1, 8), 16, 10).cast("long")


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: `slots` rows. Turns are taken in the order of the shards' names."""
    names = sorted(set(shards))
    if not names or slots < len(names) or slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be named and slots be a prime of at least their number")
    one = spark.range(1).select(F.array(*map(F.lit, names)).alias("names"))
    starts = F.transform("names", lambda s: F.struct((number(s, "offset:") % slots).alias("offset"), (number(s, "step:") % (slots - 1) + 1).alias("step")))

    def turn(state: Column, k: Column) -> Column:
        mine = state["starts"][(k % len(names)).cast("int")]
        free = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), lambda j: state["owners"][((mine["offset"] + j * mine["step"]) % slots).cast("int")] == -1)
        slot = ((mine["offset"] + free[0] * mine["step"]) % slots).cast("int")
        owners = F.concat(F.slice(state["owners"], F.lit(1), slot), F.array((k % len(names)).cast("int")), F.slice(state["owners"], slot + 2, F.lit(slots)))
        return F.struct(owners.alias("owners"), state["starts"].alias("starts"))

    # the starts travel in the state, so that each is hashed once
    empty = F.struct(F.array_repeat(F.lit(-1), slots).alias("owners"), starts.alias("starts"))
    filled = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), empty, turn)["owners"]
    return one.select("names", F.posexplode(filled).alias("slot", "owner")).select(F.col("slot").cast("long").alias("slot"), F.col("names")[F.col("owner")].alias("shard"))


def place(df: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """df with slot and shard."""
    slot = number(F.coalesce(F.col(key).cast("string"), F.lit("")), "key:") % slots
    return df.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot")


def write(df: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, rows_a_file: int = 1_000_000) -> None:
    """The rows in a folder for each shard. Tasks write what they hold, so that no shard is gathered in one task."""
    place(df, shards, key, slots).drop("slot").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
