"""Sharding over fixed virtual slots.

A record is hashed by its id into one of ``slots`` virtual slots, for good. Which shard holds a slot is said by a map
with a version, kept as a table in the shared folder. Version 1 deals the slots out evenly without looking at the
data; rebalancing measures the bytes of each slot and edits the map into the next version: a shard above the share
gives up its smallest slots until it is not, and each slot given up, the largest first, goes to the shard that holds
least by then. The share is the mean, without slots that are larger than it and the shards these fill. Adding a shard is the same edit, with the new shard empty (and, on request, as the only taker).

Law of the result: ``bytes`` (the shards' sizes are near equal). The map has ``slots`` rows whatever the size of the
table, so it is edited on the driver and broadcast; rows are only ever grouped by slot.

Defined cases: a NULL or empty text has size 8 and CRC 0; a NULL id is hashed as the empty string; repeated rows stay
together in one slot and get places of their own; an empty table gives no row (and a map of empty slots); other columns
are not read. A slot is never split, so one id repeated often bounds how equal the shards can be; the work on it is
still spread, as places come from range-partitioned rows.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import running_total
from .tables import shared_folder, written
from .text import quoted

SLOTS = 8192
SHARDS = 24
# Bytes counted for a record besides its text.
RECORD_BYTES = 8


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Shard of each slot before any record was seen."""
    return [s * shards // slots for s in range(slots)]


def edited(shard_of: list[int], sizes: list[int], shards: int, only_into: int | None = None) -> list[int]:
    """The map after rebalancing for these bytes per slot; slots that hold nothing stay where they are.

    With ``only_into`` no other shard takes a slot: what finds no room there goes back to where it was.
    """
    total, among, out, given = sum(sizes), shards, list(shard_of), []
    running, loads = [0] * shards, [0] * shards
    by_size = sorted((s for s in range(len(out)) if sizes[s]), key=lambda s: (-sizes[s], s))
    for slot in by_size:
        if sizes[slot] * among <= total:
            break
        total, among = total - sizes[slot], among - 1
    for slot in by_size:
        shard = out[slot]
        running[shard] += sizes[slot]
        if running[shard] * among <= total:
            loads[shard] = running[shard]
        else:
            given.append(slot)
    if only_into is not None:
        for slot in given:
            if (loads[only_into] + sizes[slot]) * among <= total:
                loads[only_into] += sizes[slot]
                out[slot] = only_into
        return out
    lightest = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(lightest)
    for slot in given:
        load, shard = lightest[0]
        out[slot] = shard
        heapq.heapreplace(lightest, (load + sizes[slot], shard))
    return out


def store(spark: SparkSession, shard_of: list[int], version: int, folder: str | None = None) -> str:
    """Writes one version of the map; earlier versions stay. Returns the folder of the map."""
    folder = folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = spark.createDataFrame(list(enumerate(shard_of)), "virtual_slot int, shard int")
    rows.coalesce(1).write.parquet(f"{folder}/version={version}")
    return folder


def stored(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """One version of the map: (virtual_slot, shard)."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")


def as_list(shard_map: DataFrame) -> list[int]:
    return [r.shard for r in shard_map.orderBy("virtual_slot").collect()]  # one row per slot


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record."""
    name, body = F.col(quoted(doc_id)).cast("long"), F.coalesce(F.col(quoted(text)), F.lit(""))
    digest = F.substring(F.md5(F.coalesce(name.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return docs.select(
        name.alias("doc_id"),
        (F.octet_length(body) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> list[int]:
    out = [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect():  # one row per slot
        out[r.virtual_slot] = r.n
    return out


def placed(records: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Adds the shard and the record's place there (``slot``, gapless from 0)."""
    order = ["virtual_slot", "doc_id", "text_crc32", "size", "row"]
    dealt = records.join(F.broadcast(shard_map), "virtual_slot").withColumn("row", F.monotonically_increasing_id())
    ranked = running_total(dealt, ["shard"], order, out="slot")
    return ranked.withColumn("slot", F.col("slot") - 1).drop("row")


def balanced(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, shards: int = SHARDS) -> tuple[DataFrame, str]:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) under the second version of a new map, and the map's folder."""
    spark = docs.sparkSession
    records = written(measured(docs, doc_id, text, slots))
    before = first_map(slots, shards)
    folder = store(spark, before, 1)
    store(spark, edited(before, slot_bytes(records, slots), shards), 2, folder)
    return placed(records, stored(spark, folder, 2)), folder


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all documents under the law of equal bytes."""
    rows, _ = balanced(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


# The same edit: running sums within the shards of the first map, then one given slot after the other by recursion.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
texts AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
coded AS (SELECT body, xor(list_reduce(list_transform(range(len(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1]), 4294967295), 4294967295) AS text_crc32 FROM (SELECT body, hex(encode(body)) AS x FROM texts), tab),
rec_ AS (SELECT doc_id, CAST(octet_length(encode(body)) + 8 AS BIGINT) AS size, text_crc32, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 8192 AS virtual_slot
  FROM documents JOIN coded ON coalesce(text, '') = body),
bytes AS (SELECT virtual_slot, sum(size) AS n, virtual_slot * 24 // 8192 AS shard FROM rec_ GROUP BY 1),
sized AS (SELECT n, 25 - row_number() OVER (ORDER BY n DESC, virtual_slot) AS among, sum(n) OVER () - sum(n) OVER (ORDER BY n DESC, virtual_slot) + n AS total FROM bytes),
share AS (SELECT max(among) AS among, arg_max(total, among) AS total FROM sized WHERE n * among <= total),
running AS (SELECT bytes.*, sum(n) OVER (PARTITION BY shard ORDER BY n DESC, virtual_slot) * among <= total AS kept FROM bytes, share),
given AS (SELECT virtual_slot, n, row_number() OVER (ORDER BY n DESC, virtual_slot) AS i FROM running WHERE NOT kept),
start AS (SELECT list(l ORDER BY k) AS loads FROM (SELECT k, coalesce((SELECT sum(n) FROM running r WHERE r.shard = k AND kept), 0) AS l FROM range(24) x(k))),
moves AS (SELECT CAST(0 AS BIGINT) AS i, loads, CAST(NULL AS BIGINT) AS virtual_slot, CAST(0 AS BIGINT) AS shard FROM start
  UNION ALL SELECT i, list_transform(loads, lambda v, k: CASE WHEN k = goal THEN v + n ELSE v END), virtual_slot, goal - 1
  FROM (SELECT g.i, g.virtual_slot, g.n, m.loads, CAST(list_position(m.loads, list_min(m.loads)) AS BIGINT) AS goal FROM moves m JOIN given g ON g.i = m.i + 1)),
map AS (SELECT virtual_slot, shard FROM running WHERE kept UNION ALL SELECT virtual_slot, shard FROM moves WHERE virtual_slot IS NOT NULL)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(virtual_slot AS INTEGER) AS virtual_slot
FROM rec_ JOIN map USING (virtual_slot)
"""
