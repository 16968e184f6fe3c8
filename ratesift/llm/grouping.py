"""Groups of rows that share a key, and components over links, without gathering a group anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratesift.session import durable


#: So many ids at most (of 8 bytes) are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def picked(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose ``id`` is (left_semi) or isn't (left_anti) among ``ids``, a stored table of one column."""
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.toDF("picked_id")
    return rows.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("picked_id"), how)


def stars(rows: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """(key, center_..., ...) for every row whose key others share: the row and the first row of its group.

    All columns are longs. Rows are dealt by range of (key, ids), so a group with many rows is cut into several ranges,
    each with a first row of its own; ``joined_stars`` ties those together. A group's rows pass by one at a time.
    Some rows that share their key with none are among the results, as their own center.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [key, *(f"center_{c}" for c in ids), *ids]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, None  # the range's first key; the row before: values, its center, whether it has company
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch[c].to_numpy() for c in (key, *ids)])
            if first is None:
                first = table[0, 0]
            if held:
                table = np.concatenate((held[0][:, None], table), axis=1)
            keys, size = table[0], table.shape[1]
            new = np.ones(size, bool)
            new[1:] = keys[1:] != keys[:-1]
            center = table[1:, np.maximum.accumulate(np.where(new, np.arange(size), 0))]
            company = ~new
            if held:
                center[:, : (np.flatnonzero(new[1:])[0] + 1 if new[1:].any() else size)] = held[1][:, None]
                company[0] = held[2]
            shared = company | np.append(~new[1:], False) | (keys == first)
            held = (table[:, -1], center[:, -1], bool(company[-1]))
            keep = np.flatnonzero(shared[:-1])
            yield pa.record_batch([pa.array(c[keep]) for c in (keys, *center, *table[1:])], names=names)
        if held:
            yield pa.record_batch([pa.array([v]) for v in (held[0][0], *held[1], *held[0][1:])], names=names)

    dealt = rows.select(key, *ids).repartitionByRange(n, key, *ids).sortWithinPartitions(key, *ids)
    return dealt.mapInArrow(walk, ", ".join(f"{c} long" for c in names))


def joined_stars(stars_: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Distinct (center_..., ...) pairs of stars, with the centers of one key tied to its first."""
    centers = [f"center_{c}" for c in ids]
    heads = stars_.select(key, *centers).distinct()
    tops = heads.groupBy(key).agg(F.min(F.struct(*centers)).alias("top"), F.count("*").alias("n")).where("n > 1")
    ties = heads.join(tops.select(key, "top"), key).select(
        *[F.col(f"top.{c}").alias(c) for c in centers], *[F.col(c).alias(i) for c, i in zip(centers, ids)]
    )
    pairs = stars_.select(*centers, *ids).unionByName(ties)
    same = " AND ".join(f"{c} = {i}" for c, i in zip(centers, ids))
    return pairs.where(f"NOT ({same})").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links (a, b): the smallest id that links reach.

    Every round takes the lowest label around and then that label's own label; only counts return to the driver, and
    rounds go on until none changes.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    around = durable(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "around")
    labels = durable(around.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        there = labels.select(F.col("id").alias("b"), "component")
        near = around.join(there, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = durable(lower, "lower")
        ahead = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = durable(
            lower.join(ahead, "component", "left").select("id", "old", F.least("component", "next").alias("component")), "labels"
        )
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels
