"""Differences of hub states, and write batches over whole tables.

A batch holds operations in the order of `n`: upsert (a source's copy of an item) and drop (a source's copy has gone). The last
operation of a (collection, link, source) decides; the batch is then a full outer join of old and new rows, so its cost
follows the changed rows and one shuffle of the keys, not their number of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.operators import changes
from satchel.operators.reads import retained

KEYS = ["collection", "link_id"]
#: What makes an item count as changed. The sort key isn't among it: it is written along, but changes nothing by itself.
COMPARED = ("flags", "object_hash", "meta", "level", "deleted", "conflicted", "conflict_object")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection, link_id, change): insert, update or remove, for items that differ."""
    a = old.select(*KEYS, F.struct(*COMPARED).alias("a"))
    b = new.select(*KEYS, F.struct(*COMPARED).alias("b"))
    change = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "remove").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return a.join(b, KEYS, "full_outer").select(*KEYS, change.alias("change")).filter("change is not null")


def project(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """What a source sees: a placement for each item, with a status. A bound item that is deleted is a tombstone; a live one is a
    conflict, or clean if it equals its base, created if it has none, dirty otherwise. A live item that the source isn't bound to is
    created, without a handle, if its body is there. Retained items, and others' tombstones, aren't seen."""
    own = tables["bindings"].filter(F.col("source") == source).withColumnRenamed("conflicted", "bound").drop("source")
    rows = tables["items"].filter(~retained()).drop("conflicted").join(own, KEYS, "left")
    bound, live = F.col("bound").isNotNull(), F.col("deleted") == 0
    base = F.coalesce("base_flags", "base_object", "base_revision").isNotNull()
    same = C.flags_decode(F.col("flags")).eqNullSafe(C.flags_decode(F.col("base_flags"))) & F.col("object_hash").eqNullSafe(F.col("base_object"))
    status = (
        F.when(bound & ~live, "tombstone").when(bound & (F.col("bound") == 1), "conflict").when(bound & ~base, "created").when(bound & same, "clean").when(bound, "dirty")
        .when(live & F.col("object_hash").isNotNull(), "created")
    )
    rows = rows.withColumn("status", status).filter("status is not null")
    return rows.select(*KEYS, "seq", "handle", "status", "flags", "object_hash", "meta", "sort_key", "level", F.when(F.col("status") == "conflict", F.col("conflict_revision")).alias("conflict_revision"), "base_flags", "base_object", "base_revision")


def write_batch(tables: dict[str, DataFrame], ops: DataFrame, now: str, account: str | None = None, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables after a batch. ops: n, op ('upsert' or 'drop'), collection, link_id, source, handle, flags, object_hash, meta,
    sort_key, level, base_flags, base_object, base_revision; if they have them, size (of the body) and conflict_revision (which makes
    the binding conflicted). account: that of collections made on the way. links: (link_id, seq) of all items, where tables holds
    those of some collections alone.

    An upsert makes the item, revives it from the trash (same number), or replaces its content, and binds the source. A drop
    unbinds the source: other bindings left make a tombstone, none left sends the item to the trash as dropped by that source.
    Items get their numbers by link. Reference counts follow by the difference, and bodies without references go."""
    from satchel.operators.checks import adjust, collect, refcount_delta

    after = write_rows(tables, ops, now, account, links)
    given = bodies(ops)
    held = tables["objects"] if given is None else changes.store_objects(tables["objects"], given)
    delta = refcount_delta(_refs(tables["items"], tables["bindings"]), _refs(after["items"], after["bindings"]))
    return after | {"objects": collect(adjust(held, delta))}


def bodies(ops: DataFrame) -> DataFrame | None:
    """(hash, size) of the bodies that a batch brings."""
    if "size" not in ops.columns:
        return None
    return ops.filter("op = 'upsert' and object_hash is not null and size is not null").select(F.col("object_hash").alias("hash"), "size")


def write_rows(tables: dict[str, DataFrame], ops: DataFrame, now: str, account: str | None = None, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """write_batch without the objects."""
    items, bi, meta = (tables[n] for n in ("items", "bindings", "meta"))
    if "conflict_revision" not in ops.columns:
        ops = ops.withColumn("conflict_revision", F.lit(None).cast("string"))
    last = Window.partitionBy(*KEYS, "source").orderBy(F.desc("n"))
    ops = ops.withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k")
    ups, drops = ops.filter("op = 'upsert'"), ops.filter("op = 'drop'").select(*KEYS, "source")

    bind = ups.select(*KEYS, "source", "handle", "base_flags", "base_object", "base_revision", F.col("conflict_revision").isNotNull().cast("int").alias("conflicted"), "conflict_revision")
    new_bi = changes.upsert(changes.without(bi, drops), bind, [*KEYS, "source"], ["handle", "base_flags", "base_object", "base_revision", "conflicted", "conflict_revision"])

    final = Window.partitionBy(*KEYS).orderBy(F.desc("n"))
    content = ups.withColumn("__k", F.row_number().over(final)).filter("__k = 1").select(*KEYS, F.struct("flags", "object_hash", "meta", "sort_key", "level").alias("__new"))
    left = new_bi.groupBy(*KEYS).agg(F.count("*").alias("__bound"))
    dropped = drops.groupBy(*KEYS).agg(F.max("source").alias("__by"))
    # a link's number is known from any collection
    fresh = changes.allocate_seq(content.select(*KEYS).join(items.select(KEYS), KEYS, "left_anti"), items if links is None else links, meta.first().next_seq).select(*KEYS, F.col("seq").alias("__seq"))
    joined = items.withColumn("__old", F.lit(True)).join(content, KEYS, "full_outer").join(left, KEYS, "left").join(dropped, KEYS, "left").join(fresh, KEYS, "left")
    up, was = F.col("__new").isNotNull(), F.coalesce("__old", F.lit(False))
    out = F.col("__by").isNotNull() & ~up & was & ~retained()
    trash, stone = out & F.col("__bound").isNull(), out & F.col("__bound").isNotNull()
    changed = up & (~was | retained() | ~F.struct("flags", "object_hash", "meta", "level", "deleted").eqNullSafe(F.struct("__new.flags", "__new.object_hash", "__new.meta", "__new.level", F.lit(0))))
    take = lambda c: F.when(changed, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    columns = {
        "seq": F.coalesce("seq", "__seq"),
        **{c: take(c) for c in ("flags", "object_hash", "meta", "sort_key", "level")},
        "deleted": F.when(up, 0).when(trash | stone, 1).otherwise(F.col("deleted")),
        "retained_at": F.when(trash, now).when(~up, F.col("retained_at")),
        "retained_by": F.when(trash, F.col("__by")).when(~up, F.col("retained_by")),
        "conflicted": F.coalesce("conflicted", F.lit(0)),
    }
    new_items = joined.select(*((columns[c].alias(c) if c in columns else F.col(c)) for c in items.columns))
    new_meta = meta.crossJoin(new_items.agg((F.max("seq") + 1).alias("__m"))).withColumn("next_seq", F.greatest("next_seq", "__m")).select(meta.columns)

    co = changes.ensure_collections(tables["collections"], ops.select(F.col("collection").alias("id")), account)
    return tables | {"items": new_items, "bindings": new_bi, "collections": co, "meta": new_meta}


def _refs(items: DataFrame, bi: DataFrame) -> DataFrame:
    every = items.select(F.explode(F.array("object_hash", "conflict_object")).alias("hash")).unionByName(bi.select(F.col("base_object").alias("hash")))
    return every.filter("hash is not null").groupBy("hash").agg(F.count("*").alias("n"))
