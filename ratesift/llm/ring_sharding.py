"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots. Every shard owns virtual nodes at hashed slots; a row's home is the shard of the
first node at or after its own slot, clockwise. No shard takes more than its load: the row count divided by the
shards, one more on the first ones where it doesn't divide evenly. Rows beyond a full shard go on clockwise to the
next node whose shard still has room, so that row counts of shards are at most one apart, and adding a shard moves
little besides what the new shard takes and what the smaller loads push on.

Homes are filled first, then the rows that overflowed are placed, both in ring order (slot, then place in the slot).
That needs only the number of rows per slot, a table of fixed size; the rows themselves are placed by one join.

Defined cases: a null text has no bytes; null and repeated doc_ids are keys like any other (identical rows may swap
places); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratesift.llm.columns import text_or_empty, values
from ratesift.session import durable

SLOTS = 4096
#: Rows of one slot are ranked in so many pieces, cut by text, so that one id with many texts is spread.
PIECES = 16


def ring(spark: SparkSession, shards: int, nodes: int) -> tuple[list[int], list[int]]:
    """Slots of the virtual nodes in ring order and their shards."""
    if shards * nodes > SLOTS:
        raise ValueError(f"more than {SLOTS} virtual nodes")
    spots = (
        spark.range(shards * nodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
        .select(F.pmod(F.xxhash64(F.lit("node"), "shard", "node"), F.lit(SLOTS)).alias("slot"), "shard", "node")
        .orderBy("slot", "node", "shard")
        .collect()
    )
    return [s.slot for s in spots], [s.shard for s in spots]


def loads(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def fill(counts: dict[int, int], spots: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (slot, first place, end place, shard, shard's first row) that deal out every slot's rows."""
    room, taken, runs, overflow = loads(sum(counts.values()), shards), [0] * shards, [], []

    def give(slot: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, room[shard] - taken[shard])
        if n > 0:
            runs.append((slot, start, start + n, shard, taken[shard]))
            taken[shard] += n
        return start + max(n, 0)

    for slot in sorted(counts):
        home = bisect_left(spots, slot) % len(spots)
        if (start := give(slot, 0, counts[slot], owners[home])) < counts[slot]:
            overflow.append((slot, start, home))
    for slot, start, node in overflow:
        while start < counts[slot]:
            node = (node + 1) % len(spots)
            start = give(slot, start, counts[slot], owners[node])
    return runs


def shard_rows(docs: DataFrame, shards: int = 8, nodes: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    spark, text = docs.sparkSession, F.encode(text_or_empty(), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("key"), "doc_id"), F.lit(SLOTS)).alias("ring_slot"),
    ).withColumn("piece", F.pmod("text_crc32", F.lit(PIECES)))
    rows = durable(rows, "ring")
    pieces = rows.groupBy("ring_slot", "piece").agg(F.count("*").alias("n"))
    counts = {r.ring_slot: r.n for r in pieces.groupBy("ring_slot").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("ring_slot").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("ring_slot", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("ring_slot", "piece").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(order) - 1).join(
        F.broadcast(offsets), ["ring_slot", "piece"]  # SLOTS * PIECES rows at most
    )
    runs = fill(counts, *ring(spark, shards, nodes), shards) or [(-1, 0, 0, 0, 0)]
    dealt = values(spark, runs, "run_slot, start, end, shard, base")  # SLOTS rows and one more per filled shard at most
    place = F.col("place") + F.col("offset")
    return placed.join(
        F.broadcast(dealt),
        (F.col("ring_slot") == F.col("run_slot")) & (place >= F.col("start")) & (place < F.col("end")),
    ).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("base") + place - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
