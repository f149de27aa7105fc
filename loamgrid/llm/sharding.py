"""Sharding by fixed virtual slots.

Method: hash records into thousands of slots, aggregate bytes per slot, keep a versioned slot-to-shard
map, and edit that map (never the hash) when rebalancing.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The number of virtual slots never changes for a corpus; it bounds the map and all that reaches the driver.
SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, n_rows long, bytes long"


def virtual_slot(record_id: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: 32 bits of the MD5 of its id as text, modulo the number of slots. A null id has slot 0."""
    word = F.conv(F.substring(F.md5(record_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(word, F.lit(slots)), F.lit(0)).cast("int")


def slot_bytes(records: DataFrame, slot_col: str, size_col: str) -> DataFrame:
    """Rows and bytes of each slot that holds something: at most as many rows as there are slots."""
    return records.groupBy(F.col(slot_col).alias("virtual_slot")).agg(F.count("*").alias("n_rows"), F.sum(size_col).alias("bytes"))


def first_map(usage: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[tuple]:
    """Version 1 of the map: slots in descending order of bytes, each to the shard with fewest bytes so far."""
    heap = [(0, 0, shard) for shard in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-usage.get(s, (0, 0))[1], s)):
        n_rows, size = usage.get(slot, (0, 0))
        held, count, shard = heapq.heappop(heap)
        out.append((1, slot, shard, n_rows, size))
        heapq.heappush(heap, (held + size, count + 1, shard))
    return out


def rebalanced(current: list[tuple], usage: dict[int, tuple[int, int]], shards: int) -> list[tuple]:
    """The next version of a map: edited, not made anew.

    Shards over the mean give up their smallest fitting slots, largest load first, to the shard with the
    fewest bytes, as long as each move lowers the larger of the two. A new shard starts empty, so slots
    move into it; slots of a shard that no longer exists all move.
    """
    version = max(row[0] for row in current) + 1
    where = {slot: shard for _, slot, shard, _, _ in current}
    size = {slot: usage.get(slot, (0, 0))[1] for slot in where}
    load = {shard: 0 for shard in range(shards)}
    homeless = []
    for slot, shard in where.items():
        if shard in load:
            load[shard] += size[slot]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size[s], s)):
        where[slot] = min(load, key=lambda s: (load[s], s))
        load[where[slot]] += size[slot]
    held: dict[int, list[int]] = {shard: [] for shard in load}
    for slot, shard in where.items():
        held[shard].append(slot)
    for _ in range(len(where)):
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [s for s in held[high] if 0 < size[s] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - size[s]), s))
        held[high].remove(slot)
        held[low].append(slot)
        where[slot] = low
        load[high] -= size[slot]
        load[low] += size[slot]
    return [(version, slot, shard, *usage.get(slot, (0, 0))) for slot, shard in sorted(where.items())]


def usage_of(slots: DataFrame) -> dict[int, tuple[int, int]]:
    """The usage table as a dict; bounded by the number of slots, not by the data."""
    return {row["virtual_slot"]: (row["n_rows"], row["bytes"]) for row in slots.collect()}


def write_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Stores one version of the map beside the others; a version that is there already is an error."""
    (version,) = {row[0] for row in rows}
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def has_map(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored_map(spark: SparkSession, usage: dict[int, tuple[int, int]], shards: int, slots: int, path: str) -> list[tuple]:
    """The map to use, read back from ``path``: made and stored there first if there is none, then edited where an edit moves a slot.

    An edit is stored as the next version; older versions stay.
    """
    if not has_map(spark, path):
        write_map(spark, first_map(usage, shards, slots), path)
    current = read_map(spark, path)
    edited = rebalanced(current, usage, shards)
    if {r[1]: r[2] for r in edited} != {r[1]: r[2] for r in current} or {r[1:] for r in edited} != {r[1:] for r in current}:
        write_map(spark, edited, path)
    return read_map(spark, path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """One version of a stored map, the latest by default."""
    stored = spark.read.parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    names = ("version", "virtual_slot", "shard", "n_rows", "bytes")
    return [tuple(row[n] for n in names) for row in stored.where(F.col("version") == version).collect()]


def assign(records: DataFrame, slot_map: list[tuple], slot_col: str = "virtual_slot", order: list[str] | None = None) -> DataFrame:
    """``records`` with ``map_version``, ``shard`` and ``slot``, the row's place in its shard, gapless from 0.

    A row's place is the number of rows that the map puts before its virtual slot plus its place inside
    that slot, so the only window is over thousands of evenly hashed slots, never over a whole shard.
    """
    spark = records.sparkSession
    placed = spark.createDataFrame(slot_map, MAP_SCHEMA)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        F.col("version").alias("map_version"), F.col("virtual_slot").alias(slot_col), "shard",
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(slot_col).orderBy(*(order or ["doc_id"]))
    numbered = records.withColumn("__place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(placed), slot_col).withColumn("slot", (F.col("__start") + F.col("__place")).cast("long")).drop("__start", "__place")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Every document with its size, CRC-32, virtual slot, shard and place in that shard.

    Size is the UTF-8 length of the text (null: none) plus 8. Near-equal shard sizes are the law kept.
    With ``map_path`` the map is the one stored there, edited for today's sizes (see ``stored_map``); without,
    it is made anew.

    Defined cases: null and empty texts have size 8 and CRC-32 0; rows with the same id share a slot and
    get places of their own, ordered by CRC-32; rows with a null id are dealt by the CRC-32 of their text; an empty table gives an empty
    table; other columns pass through, except that the names made here replace theirs.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    made = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text), "virtual_slot": virtual_slot(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("no id "), F.crc32(text))), slots)}
    keep = [c for c in docs.columns if c not in ("map_version", "shard", "slot", "__start", "__place")]
    records = docs.select(keep).withColumns(made).drop(text_col)
    usage = usage_of(slot_bytes(docs.select(made["size"].alias("size"), made["virtual_slot"].alias("virtual_slot")), "virtual_slot", "size"))
    slot_map = stored_map(docs.sparkSession, usage, shards, slots, map_path) if map_path else first_map(usage, shards, slots)
    return assign(records, slot_map, order=[id_col, "text_crc32", "size"])
