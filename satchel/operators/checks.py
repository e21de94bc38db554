"""Consistency checks and reference counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(items: DataFrame, bi: DataFrame, queue: DataFrame) -> DataFrame:
    """(hash, n) of each table's references, counted before they are brought together."""
    own = [(items, "object_hash"), (items, "conflict_object"), (bi, "base_object"), (queue, "object_hash")]
    every = None
    for table, column in own:
        part = table.filter(F.col(column).isNotNull()).select(F.col(column).alias("hash"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("hash").agg(F.count("*").alias("expected"))


def refcount_drift(objects: DataFrame, items: DataFrame, bi: DataFrame, queue: DataFrame) -> DataFrame:
    rows = objects.join(references(items, bi, queue), "hash", "left").withColumn("expected", F.coalesce("expected", F.lit(0)).cast("bigint"))
    return rows.filter(F.col("refcount") != F.col("expected")).select("hash", "refcount", "expected")


def dangling_bindings(bi: DataFrame, items: DataFrame) -> DataFrame:
    return bi.join(items.select("collection", "link_id"), ["collection", "link_id"], "left_anti").select("collection", "link_id", "source")


def dangling_item_objects(items: DataFrame, objects: DataFrame) -> DataFrame:
    rows = items.filter(F.col("object_hash").isNotNull())
    return rows.join(objects.select(F.col("hash").alias("object_hash")), "object_hash", "left_anti").select("collection", "link_id", "object_hash")


def dangling_queue_objects(queue: DataFrame, objects: DataFrame) -> DataFrame:
    rows = queue.filter(F.col("object_hash").isNotNull())
    return rows.join(objects.select(F.col("hash").alias("object_hash")), "object_hash", "left_anti").select("id", "object_hash")


def orphan_blobs(blobs: DataFrame, objects: DataFrame) -> DataFrame:
    return blobs.join(objects.select("hash"), "hash", "left_anti").select("hash", "size")


def missing_blobs(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    return objects.join(blobs.select("hash"), "hash", "left_anti").select("hash", "size")


def garbage(objects: DataFrame) -> DataFrame:
    return objects.filter("refcount = 0").select("hash", "size")


def refcount_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(hash, delta) of hashes whose number of references changed; both given as (hash, n)."""
    signed = before.select("hash", (-F.col("n")).alias("d")).unionByName(after.select("hash", F.col("n").alias("d")))
    return signed.groupBy("hash").agg(F.sum("d").cast("bigint").alias("delta")).filter("delta <> 0")


def adjust(objects: DataFrame, delta: DataFrame) -> DataFrame:
    return objects.join(delta, "hash", "left").withColumn("refcount", F.col("refcount") + F.coalesce("delta", F.lit(0))).drop("delta")


def collect(objects: DataFrame) -> DataFrame:
    """objects without garbage; the bodies of what goes are unlinked only after the new snapshot is in place."""
    return objects.filter("refcount <> 0")
