"""Sharding by fixed virtual slots, with DataFrame operations only.

A record hashes into one of ``SLOTS`` virtual slots, for ever. Bytes are summed per slot, and a versioned table maps
slots to shards. The first version places the slots by size; rebalancing and growing edit that table, and records
move only with the slots whose row changed. What one task or the driver sees of the slots is bounded by ``SLOTS``.

Null texts have no bytes. Null ids hash as any value does; the text's checksum takes part in the hash, so rows that
repeat an id or lack one spread as well. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLOTS = 16384
OVERHEAD = 16
MAP_COLUMNS = ("version", "vslot", "shard")


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16) and text_crc32."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )


def virtual_slot(*columns: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_sizes(sized: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the slots that hold records."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def place_slots(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A first slot-to-shard map: largest slot first, each to the shard with the fewest bytes so far.

    One row holds all slots (at most SLOTS) and one fold places them, so the largest and the smallest shard
    differ by no more than one slot.
    """
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def put(state: Column, slot: Column) -> Column:
        load = state["load"]
        least = F.array_position(load, F.array_min(load)).cast("int")
        return F.struct(
            F.transform(load, lambda v, k: F.when(k + 1 == least, v - slot["minus"]).otherwise(v)).alias("load"),
            F.concat(state["to"], F.array(least - 1)).alias("to"),
        )

    placed = ordered.select("slots", F.aggregate("slots", start, put)["to"].alias("to"))
    pair = placed.select(F.explode(F.arrays_zip("slots.vslot", "to")).alias("p")).select(F.col("p.vslot").alias("vslot"), F.col("p.to").alias("shard"))
    return pair.select(F.lit(version).alias("version"), "vslot", "shard")


def loads(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """(shard, bytes) under a map."""
    return slot_map.join(sizes, "vslot", "left").groupBy("shard").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def grow(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with one more shard (number ``shards``): every shard hands slots to the new one only.

    Each shard gives its smallest slots, by bytes, as long as what it has given stays within 1 / (shards + 1) of its own bytes.
    """
    known = slot_map.join(sizes, "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    by_shard = W.partitionBy("shard")
    given = F.sum("bytes").over(by_shard.orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0))
    fair = F.sum("bytes").over(by_shard) / (shards + 1)
    return known.select((F.col("version") + 1).alias("version"), "vslot", F.when(given <= fair, shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.05) -> DataFrame:
    """The next version of a map after sizes have changed: only shards above (1 + tolerance) of the mean give slots away.

    Their smallest slots leave until they are at the mean; the leavers go to the shards below it, in order of the room
    they have. Slots of shards within the tolerance keep their place unless they receive.
    """
    known = slot_map.join(sizes, "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    by_shard = W.partitionBy("shard")
    mean = known.agg((F.sum("bytes") / shards).alias("mean"))
    total = known.withColumn("total", F.sum("bytes").over(by_shard)).crossJoin(F.broadcast(mean))  # one row
    left = F.sum("bytes").over(by_shard.orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0))
    marked = total.withColumn("leaves", (F.col("total") > F.col("mean") * (1 + tolerance)) & (left <= F.col("total") - F.col("mean")))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    room = known.sparkSession.range(1).select(F.explode(every).alias("shard")).join(loads(slot_map, sizes), "shard", "left").crossJoin(F.broadcast(mean))
    room = room.select("shard", F.greatest(F.col("mean") - F.coalesce("bytes", F.lit(0)), F.lit(0.0)).alias("room"))
    upto = room.withColumn("upto", F.sum("room").over(W.orderBy("shard")))  # at most one row a shard
    leavers = marked.filter("leaves").withColumn("at", F.sum("bytes").over(W.orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes") / 2)  # at most SLOTS rows
    bands = upto.filter("room > 0").select((F.col("upto") - F.col("room")).alias("lo"), "upto", F.col("shard").alias("to"))
    moved = leavers.join(F.broadcast(bands), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("upto")), "left").select("vslot", "to")
    return marked.join(moved, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored table; versions are never rewritten."""
    slot_map.select(*MAP_COLUMNS).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last one by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).select(*MAP_COLUMNS)


def numbered(placed: DataFrame) -> DataFrame:
    """Adds ``slot``, the row's place in its shard, gapless from 0.

    Rows are numbered within each virtual slot and moved up by the rows of the shard's slots before it, so no task ever holds a whole shard.
    """
    counts = placed.groupBy("shard", "vslot").agg(F.count("*").alias("n"))  # at most SLOTS rows
    before = counts.select("vslot", (F.sum("n").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("within", within).join(F.broadcast(before), "vslot").withColumn("slot", (F.col("before") + F.col("within")).cast("long")).drop("within", "before")


def shard_documents(docs: DataFrame, shards: int = 40, slot_map: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (``bytes``: shard sizes near equal), shard, slot, grown_shard (null), virtual_slot.

    ``slot_map`` places by a stored map instead of a new one; slots that it lacks go to shard vslot mod shards.
    """
    sized = with_sizes(docs).withColumn("vslot", virtual_slot("doc_id", "text_crc32", "size"))
    table = place_slots(slot_sizes(sized), shards) if slot_map is None else slot_map
    placed = sized.join(F.broadcast(table.select("vslot", "shard")), "vslot", "left")
    placed = placed.withColumn("shard", F.coalesce("shard", F.col("vslot") % shards).cast("int"))
    return numbered(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot")
    )
