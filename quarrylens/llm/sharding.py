"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's key is hashed to one of N_SLOTS virtual slots, for good.  A small versioned table maps slots to
shards; resharding edits that table and moves whole slots.  Three edits exist:

* initial_map   slots are dealt round-robin, so the shard of a key follows from the key and the shard count;
* grow_map      one more shard takes an even share of the slots of every old shard and nothing else moves;
* rebalance_map slots move from shards with too many bytes to shards with too few, by bytes measured per slot.

The query stores version 0 and its successors and the bytes of each slot in the shared folder and reads them back:
`shard` is from version 0, `grown_shard` from version 1 (one more shard), and `balanced_shard` from version 2, the
edit of version 0 by the measured bytes, which makes shard sizes near equal but follows the data, not the law `key`.

The map has N_SLOTS rows whatever the corpus holds, so it may be broadcast and its windows are bounded.

Defined results: a null text has no bytes (size 1); a null key is hashed by the text instead, so that many
null keys do not meet in one slot; rows that repeat share a shard and get different positions; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarrylens.llm.rows import pick
from quarrylens.session import Scratch

N_SLOTS = 4096


def virtual_slot(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text)), F.lit(n_slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes of every slot that has rows; combined before the shuffle, at most n_slots rows a task."""
    docs = pick(docs, doc_id=key, text=text)
    return (
        docs.select(virtual_slot(F.col("doc_id"), F.col("text"), n_slots).alias("vslot"), record_size(F.col("text")).alias("size"))
        .groupBy("vslot")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    )


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slot s belongs to shard s mod n_shards."""
    s = F.col("id").cast("int")
    return spark.range(0, n_slots, 1, 1).select(F.lit(0).alias("version"), s.alias("vslot"), (s % n_shards).alias("shard"))


def grow_map(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version, with shard number n_shards added: of every old shard's k slots it takes the last
    floor(k / (n_shards + 1)) in slot order; every other slot stays where it was."""
    w = Window.partitionBy("shard")
    place = F.row_number().over(w.orderBy(F.desc("vslot")))
    share = F.floor(F.count(F.lit(1)).over(w) / F.lit(n_shards + 1))
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "vslot", F.when(place <= share, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard")
    )


def rebalance_map(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The next version, edited by bytes: every shard keeps its slots, smallest first, while they fit its even
    share of all bytes; slots beyond it are surplus and fill the free room of the other shards in order.

    Surplus slots and free room are laid on one line each (running sums of bytes), and a slot goes to the shard
    whose room covers the slot's middle, so no shard ends more than one slot's bytes above the even share.
    """
    total = stats.agg(F.sum("bytes").alias("all_bytes"))
    m = slot_map.join(F.broadcast(stats.select("vslot", "bytes")), "vslot", "left").na.fill({"bytes": 0}).crossJoin(F.broadcast(total))
    fair = F.coalesce(F.col("all_bytes"), F.lit(0)) / F.lit(n_shards)
    m = m.withColumn("fair", fair).withColumn("cum", F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot")))
    m = m.withColumn("stays", F.col("cum") <= F.col("fair"))
    kept = m.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("kept"), F.first("fair").alias("fair"))
    shards = slot_map.sparkSession.range(0, n_shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
    line = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    rooms = (
        shards.join(F.broadcast(kept), "shard", "left")
        .crossJoin(F.broadcast(total.select((F.coalesce("all_bytes", F.lit(0)) / F.lit(n_shards)).alias("even"))))
        .select("shard", (F.col("even") - F.coalesce("kept", F.lit(0))).alias("room"))
        .select(F.col("shard").alias("to_shard"), (F.sum("room").over(line) - F.col("room")).alias("lo"), F.sum("room").over(line).alias("hi"))
    )
    moved = m.where(~F.col("stays")).withColumn("_end", F.sum("bytes").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("bytes"), "vslot")))
    moved = moved.select("vslot", (F.col("_end") - F.col("bytes") / 2).alias("mid"))
    # at most n_slots rows against n_shards ranges, both fixed by parameters
    placed = moved.join(F.broadcast(rooms), (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi"))).groupBy("vslot").agg(F.min("to_shard").alias("to_shard"))
    return slot_map.join(F.broadcast(placed), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to_shard", "shard").cast("int").alias("shard")
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored map, a folder for each version."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of a stored map, or the newest."""
    maps = spark.read.parquet(path)
    if version is None:
        newest = maps.agg(F.max("version").alias("version"))
        return maps.join(F.broadcast(newest), "version", "left_semi").select("version", "vslot", "shard")
    return maps.where(F.col("version") == version).select("version", "vslot", "shard")


def assign(docs: DataFrame, slot_map: DataFrame, stats: DataFrame, also: dict[str, DataFrame] | None = None, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Every row with its shard and its gapless position there (ordered by slot, key, then text checksum).

    Positions need no sort of a whole shard: rows are numbered inside their virtual slot, and the rows of the
    earlier slots of the shard, known from stats, are added.  also: shards by other versions, by column name.
    """
    docs = pick(docs, doc_id=key, text=text)
    k, t = F.col("doc_id"), F.col("text")
    rows = docs.select(k, record_size(t).alias("size"), F.crc32(F.coalesce(t, F.lit(""))).cast("long").alias("text_crc32"), virtual_slot(k, t, n_slots).alias("vslot"))
    m = slot_map.select("vslot", "shard")
    for name, version in (also or {}).items():
        m = m.join(F.broadcast(version.select("vslot", F.col("shard").alias(name))), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    m = m.join(F.broadcast(stats.select("vslot", "rows")), "vslot", "left").withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(F.broadcast(m), "vslot")
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("_in") - 1).cast("long").alias("slot"), *(also or {}), F.col("vslot").alias("virtual_slot"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, path: str | None = None) -> DataFrame:
    """Law `key`: doc_id and shard count decide, and one more shard takes rows only into itself.  The map's versions
    and the slots' bytes are stored at path, else in the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    stats = scratch.table(slot_stats(docs), "slots")
    path, first = path or scratch.path("map"), initial_map(spark, n_shards)
    balanced = rebalance_map(first, stats, n_shards).withColumn("version", F.lit(2))
    for version in (first, grow_map(first, n_shards), balanced):
        store_map(version, path)
    first, grown, balanced = (load_map(spark, path, v) for v in range(3))
    return assign(docs, first, stats, {"grown_shard": grown, "balanced_shard": balanced})
