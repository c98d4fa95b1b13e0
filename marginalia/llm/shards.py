"""Sharding over fixed virtual slots.

A record belongs to one of SLOTS slots for good, by a hash of its id and text, and its further copies to the
slots behind that one.  A small table maps slots to shards; it is stored by version, and rebalancing appends a
new version that moves as few slots as it needs.  Bytes are summed by slot, so the map is worked out on SLOTS
rows whatever the size of the corpus.

Records that are equal in all that is returned are counted before they are
shuffled and dealt out again at the end, and a slot with many records is numbered
in parts, so no task holds a hot slot or a group of equal records.

Everything is DataFrame and SQL functions.  The law is `bytes`: shards hold
nearly equal bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import saved, shared_folder

SLOTS = 4096
#: Distinct records of a slot that are numbered in one place; a larger slot is numbered in parts.
PART_ROWS = 1_000_000
#: Equal records that one row is dealt out to in one place.
COPIES = 100_000


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record by its id and text."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, own, vslot, copies): the distinct records, and how often they occur in a slot.

    The first copy of a record is in its own slot, the second in the next one, and so on around. size is the
    UTF-8 bytes of the text plus 8; a null text has none and the crc32 of nothing.
    """
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), slot_of(doc_id, text, slots).alias("own"))
    counted = rows.groupBy("doc_id", "size", "text_crc32", "own").agg(F.count("*").alias("c"))
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("c"), F.lit(slots)) - 1)))
    copies = F.floor((F.col("c") - F.col("k") - 1) / slots) + 1
    return each.select("doc_id", "size", "text_crc32", "own", F.pmod(F.col("own") + F.col("k"), F.lit(slots)).alias("vslot"), copies.alias("copies"))


def first_map(spark, n_shards: int, slots: int = SLOTS) -> DataFrame:
    """(version, vslot, shard): version 1, equal runs of slots."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").alias("vslot"), F.floor(F.col("id") * n_shards / slots).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map: slots stay where they are while their shard is below its share, the rest go to the emptiest shard.

    The share is the mean of what is left when slots that are larger than it have taken a shard of their own.

    slot_bytes has (vslot, bytes). Slots are taken from the largest down, so the small ones even out what is
    left. This is one fold over the array of slots, of which there is a fixed number.
    """
    version = slot_map.agg(F.max("version").alias("v"))
    latest = slot_map.join(F.broadcast(version), F.col("version") == F.col("v")).drop("v")
    sized = latest.join(slot_bytes, "vslot", "left").select("version", "vslot", F.col("shard").cast("int").alias("home"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    one = sized.groupBy("version").agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "home"))).alias("s"), F.sum("bytes").alias("total"))

    def place(acc: Column, slot: Column) -> Column:
        load, size, rest, left = acc["load"], -slot["less"], acc["rest"], acc["left"]
        alone = (left > 1) & (size * left > rest)
        emptiest = (F.array_position(load, F.array_min(load)) - 1).cast("int")
        home = (slot["home"] < n_shards) & ~alone & ((F.get(load, slot["home"]) + size) * left <= rest)
        shard = F.when(home, slot["home"]).otherwise(emptiest)
        return F.struct(F.transform(load, lambda x, i: F.when(i == shard, x + size).otherwise(x)).alias("load"), F.concat(acc["to"], F.array(shard)).alias("to"), F.when(alone, rest - size).otherwise(rest).alias("rest"), F.when(alone, left - 1).otherwise(left).alias("left"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"), F.array().cast("array<int>").alias("to"), F.col("total").alias("rest"), F.lit(n_shards).alias("left"))
    placed = one.select((F.col("version") + 1).alias("version"), F.arrays_zip(F.col("s.vslot").alias("vslot"), F.aggregate("s", start, place)["to"].alias("shard")).alias("z"))
    return placed.select("version", F.explode("z").alias("z")).select("version", F.col("z.vslot").alias("vslot"), F.col("z.shard").alias("shard"))


def append_version(slot_map: DataFrame, folder: str) -> None:
    """Appends the versions of a map (version, vslot, shard) to those stored in a folder; a version is one directory."""
    slot_map.select("version", "vslot", "shard").coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(version, vslot, shard) of a stored version, by default the latest; only its directory is read."""
    every = spark.read.schema("vslot long, shard int, version int").parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).select("version", "vslot", "shard")


def rebalance(folder: str, slot_bytes: DataFrame, n_shards: int) -> DataFrame:
    """Appends the rebalanced version of the latest map of a folder for the bytes of slots (vslot, bytes), and returns it."""
    append_version(rebalanced(stored_map(slot_bytes.sparkSession, folder), slot_bytes, n_shards), folder)
    return stored_map(slot_bytes.sparkSession, folder)


def assigned(docs: DataFrame, n_shards: int = 24, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version) of every row.

    vslot is the fixed virtual slot, slot the gapless place of the row in its shard. The map is stored in
    `folder`: if one is named, its latest version holds; else a new one of the shared folder gets the first map
    and the one rebalanced by the bytes of docs. grown_shard is null under this law. Records without id and those
    that share one are dealt by their texts; equal rows go around the virtual slots and have places of their own.
    Other columns of docs change nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = saved(records(docs, id_col, text_col), "records")
    if folder is None:
        folder = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
        append_version(first_map(spark, n_shards), folder)
        latest = rebalance(folder, rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), n_shards)
    else:
        latest = stored_map(spark, folder)
    # SLOTS rows, and below a row for each PART_ROWS records besides: where each part of a slot begins in its shard.
    parts = rows.groupBy("vslot").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    rows = rows.join(F.broadcast(parts), "vslot").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), "parts"))
    placed = rows.groupBy("vslot", "part").agg(F.sum("copies").alias("n")).join(F.broadcast(latest), "vslot")
    begin = F.sum("n").over(W.partitionBy("shard").orderBy("vslot", "part")) - F.col("n")
    placed = placed.select("vslot", "part", "shard", "version", begin.alias("begin"))
    order = W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "own")
    numbered = rows.withColumn("inside", F.sum("copies").over(order) - F.col("copies")).join(F.broadcast(placed), ["vslot", "part"])
    numbered = numbered.select("doc_id", "size", "text_crc32", "shard", "vslot", "version", "copies", (F.col("begin") + F.col("inside")).alias("at"))
    return dealt(numbered).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("at").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def dealt(rows: DataFrame) -> DataFrame:
    """A row for each of the `copies` of a row, with places from `at` on; those of many copies are spread first."""
    few = rows.filter(F.col("copies") <= COPIES)
    many = rows.filter(F.col("copies") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    many = many.withColumns({"at": F.col("at") + F.col("from"), "copies": F.least(F.lit(COPIES), F.col("copies") - F.col("from"))}).drop("from").repartition("at")
    return few.unionByName(many).withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("copies") - 1)))
