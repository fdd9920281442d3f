"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed by id and text checksum into a fixed number of slots, and the copies of a record go to slots in turn. The bytes of each slot are added up, and a slot-to-shard map places
whole slots: largest first, each on the shard with the least bytes so far. The map is a small versioned table; growing or
rebalancing writes a new version that moves some slots and leaves all others where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countspark.llm.common import materialise

SLOTS = 4096
RUN = 1 << 16  # copies that are written out from one row


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot) for every row; size: the text's UTF-8 bytes, none for null, plus one.

    The checksum is hashed too, so that rows with one id, or none, don't meet in one slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    named = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), crc.alias("text_crc32"))
    return named.withColumn("virtual_slot", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slots)).cast("int"))


def spread(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, run, copies): equal rows counted, their copies dealt to the slots in turn from
    their own one on, and those of a slot cut into runs."""
    alike = rows.groupBy("id", "size", "text_crc32", "virtual_slot").agg(F.count("*").alias("_all"))
    turns = F.sequence(F.lit(0).cast("long"), F.least(F.col("_all"), F.lit(slots)) - 1)
    dealt = alike.withColumn("_turn", F.explode(turns)).withColumn("virtual_slot", F.pmod(F.col("virtual_slot") + F.col("_turn"), F.lit(slots)).cast("int"))
    here = F.floor(F.col("_all") / slots) + F.when(F.col("_turn") < F.col("_all") % slots, 1).otherwise(0)
    runs = dealt.withColumn("_here", here).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_here") - 1) / RUN))))
    return runs.select("id", "size", "text_crc32", "virtual_slot", "run", F.least(F.lit(RUN), F.col("_here") - F.col("run") * RUN).alias("copies"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for each of the slots, empty ones included."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", zero("bytes"), zero("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard, bytes, rows). It works on one row per slot, whatever the data."""
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "rows")
    every = sizes.agg(F.sort_array(F.collect_list(entry)).alias("slots"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("owners"),
    )

    def place(done, slot):
        least = (F.array_position(done["loads"], F.array_min(done["loads"])) - 1).cast("int")
        loads = F.transform(done["loads"], lambda load, i: F.when(i == least, load + slot["bytes"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(done["owners"], F.array(least)).alias("owners"))

    placed = every.select("slots", F.aggregate("slots", start, place)["owners"].alias("owners"))
    return placed.select(F.explode(F.arrays_zip("slots", "owners")).alias("x")).select(
        F.lit(1).alias("version"), "x.slots.virtual_slot", F.col("x.owners").alias("shard"), "x.slots.bytes", "x.slots.rows"
    )


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one more shard, which takes slots from each of the others down to the new mean, and only takes."""
    total = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    load = Window.partitionBy("shard")
    spare = F.sum("bytes").over(load) - F.sum("bytes").over(total) / (shards + 1)
    return slot_map.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(F.sum("bytes").over(upto) <= spare, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        "bytes",
        "rows",
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for new sizes: overfull shards give their smallest slots away, in turn to those with the most room."""
    now = slot_map.drop("bytes", "rows").join(sizes, "virtual_slot")
    upto = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    marked = now.withColumn("over", F.sum("bytes").over(Window.partitionBy("shard")) - mean).withColumn("moves", F.sum("bytes").over(upto) <= F.col("over"))
    held = marked.filter("not moves").groupBy("shard").agg(F.sum("bytes").alias("kept"))
    room = now.sparkSession.range(shards).select(F.col("id").cast("int").alias("to")).join(held.withColumnRenamed("shard", "to"), "to", "left")
    room = room.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("kept", F.lit(0)), "to")) - 1).select("to", "turn")
    under = F.greatest(F.lit(1), F.floor(F.lit(shards) / 2)).cast("int")
    turn = F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bytes"), "virtual_slot")) - 1, under)
    given = marked.filter("moves").withColumn("turn", turn).join(F.broadcast(room), "turn")
    columns = [(F.col("version") + 1).alias("version"), "virtual_slot", "shard", "bytes", "rows"]
    return marked.filter("not moves").select(*columns).union(given.drop("shard").withColumnRenamed("to", "shard").select(*columns))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows' places, and the map that gave them.

    Places: (id, size, text_crc32, virtual_slot, shard, slot) for every row; slot is the place in the shard, gapless from 0, in
    the order of virtual slot, id and checksum. Rows that are equal in all of these are counted, not sorted; their copies are
    spread over the slots in turn and share out the places that they hold together. An empty table gives empty places and a map of empty slots.
    """
    alike = materialise(spread(records(docs, slots, id_col, text_col), slots))
    sizes = slot_sizes(alike.select("virtual_slot", (F.col("size") * F.col("copies")).alias("size")), slots).drop("rows")
    counts = alike.groupBy("virtual_slot").agg(F.sum("copies").alias("rows"))
    sizes = sizes.join(counts, "virtual_slot", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    slot_map = materialise(first_map(sizes, shards))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("copies").over(upto)
    placed = alike.withColumn("last", last).join(F.broadcast(base), "virtual_slot")
    place = F.explode(F.sequence(F.col("base") + F.col("last") - F.col("copies"), F.col("base") + F.col("last") - 1)).alias("slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", place), slot_map


def write_map(slot_map: DataFrame, path: str) -> None:
    """Store a map under its version in a folder of maps; a version that is there already is an error, and earlier ones stay."""
    for row in slot_map.select("version").distinct().collect():  # one row: a map has one version
        slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={row['version']}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map of a version, by default the last one."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows")
