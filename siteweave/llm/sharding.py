"""Operator 10: shards by fixed virtual slots.

Records are hashed by text into a fixed number of virtual slots. Bytes are summed up by
slot, slots are dealt to shards heaviest first, and the slot-to-shard map is stored with
a version. Every version holds every slot, also those without bytes, so that any new record
finds its shard. Rebalancing reads the newest map, moves as little as it can and stores the
next version. Law: ``bytes``, near equal sizes.

Equal texts share a slot and therefore a shard. A text whose copies alone outweigh a
shard's fair share can't be kept whole and even at once: its rows, and no others, are dealt
by doc_id and number among their equals to parts of their slot. The map lists these texts;
there are fewer than shards.

Cases: a null text counts one byte and has the checksum of no bytes; null and repeated
doc_ids are told apart by their text, and equal rows by a running number, so copies of a
heavy text are dealt evenly whatever their doc_ids are; other repeated rows share a shard and
get positions of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.shared import new_path, stored

SLOTS = 4096
UNITS = 4096  # ranges of a hash of rows in which positions are counted
PARTS = 64  # parts of a text that is too heavy for one shard
BROADCAST_ROWS = 200_000
MAP = "version int, virtual_slot int, part int, text_hash long, bytes long, shard int"
Key = tuple[int, int, int]  # slot, part (0: whole) and the hash of the text that was split (0: all others)


def assign(weights: dict[Key, int], shards: int) -> dict[Key, int]:
    """Heaviest first, each to the lightest shard; ties to the smaller number."""
    heap, out = [(0, s) for s in range(shards)], {}
    for key, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + weight, shard))
        out[key] = shard
    return out


def rebalanced(old: dict[Key, int], weights: dict[Key, int], shards: int) -> dict[Key, int]:
    """Edit a map for new weights or another shard count.

    Slots stay where they are unless their shard is above the fair share or gone; what is
    taken off goes, heaviest first, to the lightest shards. Slots without bytes stay, too.
    """
    weights = dict.fromkeys(old, 0) | weights
    fair = sum(weights.values()) / shards
    load, kept, loose = [0] * shards, {}, []
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        shard = old.get(key, shards)
        if shard < shards and load[shard] + weights[key] <= fair:
            kept[key], load[shard] = shard, load[shard] + weights[key]
        else:
            loose.append(key)
    for key in loose:
        shard = min(range(shards), key=lambda s: (load[s], s))
        kept[key], load[shard] = shard, load[shard] + weights[key]
    return kept


def slotted(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, virtual_slot, unit`` of ``docs(doc_id, text)``, stored."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.pmod(F.xxhash64(text), F.lit(SLOTS)).cast("int").alias("virtual_slot"),
            F.xxhash64(F.lit(7), "doc_id", F.xxhash64(text)).alias("row_hash"),
            F.spark_partition_id().alias("chunk"),
        ),
        "shard-rows",
    )
    return units(rows)


def units(rows: DataFrame) -> DataFrame:
    """Stored rows with their ``unit``, by hash; the n-th of equal rows takes the unit of its number n.

    Equal rows are numbered in the chunks in which they were stored and the chunks added
    up, so that a row which makes up much of the table is not numbered in one task.
    """
    counts = rows.groupBy("row_hash", "chunk").count()
    repeated = counts.groupBy("row_hash").agg(F.sum("count").alias("n")).where("n > 1").select("row_hash")
    if repeated.isEmpty():
        return rows.withColumn("unit", F.pmod("row_hash", F.lit(UNITS)).cast("int")).drop("row_hash", "chunk")
    before = W.partitionBy("row_hash").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.join(repeated, "row_hash").select("row_hash", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("row_hash", "chunk").orderBy(F.lit(0))) - 1
    numbered = rows.withColumn("nth", nth).join(offsets, ["row_hash", "chunk"], "left").withColumn("nth", F.col("nth") + F.coalesce("offset", F.lit(0)))
    unit = F.when(F.col("nth") == 0, F.col("row_hash")).otherwise(F.xxhash64("row_hash", "nth"))
    return stored(numbered.withColumn("unit", F.pmod(unit, F.lit(UNITS)).cast("int")).drop("row_hash", "chunk", "nth", "offset"), "shard-units")


def weigh(rows: DataFrame, shards: int, split: frozenset[int] = frozenset()) -> dict[Key, int]:
    """Bytes of every slot, and of the parts of texts that outweigh a shard's fair share.

    The sums of ``SLOTS`` slots reach the driver; texts are summed only within slots that
    are heavier than a fair share, so fewer than ``shards`` of them are found to be. Texts
    of ``split``, from the map before, stay split.
    """
    sums = {r.virtual_slot: r.bytes for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    fair = sum(sums.values()) / shards
    suspects = [s for s, b in sums.items() if b > fair]
    heavy = {}
    if suspects or split:
        texts = rows.where(F.col("virtual_slot").isin(suspects) | F.col("text_hash").isin(list(split))).groupBy("text_hash", "virtual_slot").agg(F.sum("size").alias("bytes"))
        heavy = {r.text_hash: r.virtual_slot for r in texts.where((F.col("bytes") > fair) | F.col("text_hash").isin(list(split))).collect()}
    weights = {(s, 0, 0): sums.get(s, 0) for s in range(SLOTS)}
    if heavy:
        parts = rows.where(F.col("text_hash").isin(list(heavy))).groupBy("text_hash", (F.col("unit") % PARTS).alias("part")).agg(F.sum("size").alias("bytes")).collect()
        weights |= {(s, p + 1, h): 0 for h, s in heavy.items() for p in range(PARTS)}
        for r in parts:
            weights[heavy[r.text_hash], r.part + 1, r.text_hash] = r.bytes
            weights[heavy[r.text_hash], 0, 0] -= r.bytes
    return weights


def store_map(spark: SparkSession, path: str, version: int, owner: dict[Key, int], weights: dict[Key, int]) -> DataFrame:
    """Append one version of a map to the table at ``path`` and return it as it was stored."""
    table = spark.createDataFrame([(version, *key, weights.get(key, 0), owner[key]) for key in sorted(owner)], MAP).select("version", "virtual_slot", "part", "text_hash", "bytes", "shard")
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    table = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def rebalance(spark: SparkSession, path: str, rows: DataFrame, shards: int) -> DataFrame:
    """Store the next version of the map at ``path``, edited for the bytes of ``rows`` and for ``shards``."""
    before = load_map(spark, path).collect()  # SLOTS rows, and PARTS for each split text
    old = {(r.virtual_slot, r.part, r.text_hash): r.shard for r in before}
    weights = weigh(rows, shards, frozenset(h for _, _, h in old if h))
    return store_map(spark, path, before[0].version + 1, rebalanced(old, weights, shards), weights)


def owners(rows: DataFrame, slot_map: DataFrame, name: str = "shard") -> DataFrame:
    """Rows with ``part`` and the shard that the map gives them; every row finds one."""
    entries = slot_map.select("virtual_slot", "part", "text_hash", "shard").collect()  # as in ``rebalance``
    spark = rows.sparkSession
    whole = F.broadcast(spark.createDataFrame([(r.virtual_slot, r.shard) for r in entries if not r.part], "virtual_slot int, _whole int"))
    rows = rows.join(whole, "virtual_slot", "left")
    if split := [(r.text_hash, r.part, r.shard) for r in entries if r.part]:
        parts = F.broadcast(spark.createDataFrame(split, "text_hash long, _part int, _split int"))
        rows = rows.withColumn("_part", (F.col("unit") % PARTS + 1).cast("int")).join(parts, ["text_hash", "_part"], "left")
        rows = rows.withColumn("part", F.when(F.col("_split").isNotNull(), F.col("_part")).otherwise(0)).withColumn(name, F.coalesce("_split", "_whole")).drop("_part", "_split")
    else:
        rows = rows.withColumn("part", F.lit(0)).withColumn(name, F.col("_whole"))
    return rows.drop("_whole")


def placed(rows: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """Rows with their shard and a position in it, gapless from 0.

    Positions follow ranges of the rows' hash: only sums by (shard, range), a fixed
    number, are added up in order, so no shard is sorted in one task.
    """
    rows = owners(rows, slot_map)
    counts = rows.groupBy("shard", "unit").count()
    before = W.partitionBy("shard").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "unit", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("unit", "shard").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    offsets = F.broadcast(offsets) if UNITS * shards <= BROADCAST_ROWS else offsets
    return ranked.join(offsets, ["shard", "unit"]).withColumn("slot", (F.col("offset") + F.col("rank")).cast("long"))


def op10_shards(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """Shards by the first map of all documents, and by its next version for one shard more."""
    rows = slotted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    path, weights = new_path(spark, "slot-map"), weigh(rows, shards)
    first = store_map(spark, path, 1, assign(weights, shards), weights)
    second = rebalance(spark, path, rows, shards + 1)
    out = owners(placed(rows, first, shards).withColumnRenamed("part", "first_part"), second, "rebalanced_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("first_part").alias("part"), "rebalanced_shard")
