"""Changes as functions from tables to tables; nothing here writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.operators.reads import retained
from satchel.sources import session


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """rows into table by keys: known keys have the columns of `update` replaced, new rows are added whole."""
    own = rows.select(*keys, F.struct(*(c for c in table.columns if c not in keys)).alias("__new"))
    both = table.withColumn("__old", F.lit(True)).join(own, keys, "full_outer")
    fresh, known = F.col("__old").isNull(), F.col("__new").isNotNull()
    return both.select(*((F.col(c) if c in keys else F.when(fresh | (known if c in update else F.lit(False)), F.col(f"__new.{c}")).otherwise(F.col(c))).alias(c) for c in table.columns))


def patch(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def without(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def ensure_collections(co: DataFrame, ids: DataFrame, account: str | None = None) -> DataFrame:
    """Collections for ids (id, or id and account) that aren't there: no kind, named as their id, in their or the handle's account."""
    account = F.coalesce("account", F.lit(account).cast("string")) if "account" in ids.columns else F.lit(account).cast("string")
    new = ids.select("id", account.alias("account")).dropDuplicates(["id"]).join(co.select("id"), "id", "left_anti")
    null = F.lit(None).cast("string")
    rows = new.select("id", "account", F.lit("").alias("kind"), F.col("id").alias("name"), null.alias("parent"), F.lit(None).cast("int").alias("sort_order"), F.lit("manual").alias("conflict"), F.lit(1).alias("generation"))
    return co.unionByName(rows, allowMissingColumns=True)


def set_kind(co: DataFrame, collection: str, kind: str, account: str | None = None) -> DataFrame:
    """A collection's kind alone; it is made if it isn't there."""
    ids = co.sparkSession.createDataFrame([(collection,)], "id string")
    return patch(ensure_collections(co, ids, account), F.col("id") == collection, kind=F.lit(kind))


def set_account(co: DataFrame, collection: str, account: str | None) -> DataFrame:
    return patch(co, F.col("id") == collection, account=F.lit(account).cast("string"))


def set_conflict(co: DataFrame, collection: str, policy: str) -> DataFrame:
    return patch(co, F.col("id") == collection, conflict=F.lit(policy))


def bump_generation(co: DataFrame, collection: str) -> DataFrame:
    return patch(co, F.col("id") == collection, generation=F.col("generation") + 1)


def set_sort_key(items: DataFrame, collection: str, link: str, key: str) -> DataFrame:
    return patch(items, (F.col("collection") == collection) & (F.col("link_id") == link), sort_key=F.lit(key))


def rename_collection(tables: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    """A collection under a new id, with what refers to it; targets inside payloads stay as they were written."""
    if not tables["collections"].filter(F.col("id") == new).isEmpty():
        raise ValueError(f"collection {new} exists")
    out = dict(tables)
    for name, columns in (("collections", ("id", "parent")), ("items", ("collection",)), ("bindings", ("collection",)), ("sources", ("collection",)), ("queue", ("collection",))):
        if name in tables:
            out[name] = tables[name].withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in columns})
    return out


def upsert_checkpoint(sources: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(sources, rows, ["collection", "source"], ["checkpoint"])


def store_objects(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """Bodies (hash, size): a new one has no references yet; a known one has its size refreshed alone."""
    return upsert(objects, rows.select("hash", "size", F.lit(0).cast("bigint").alias("refcount")).dropDuplicates(["hash"]), ["hash"], ["size"])


def retain(items: DataFrame, bi: DataFrame, gone: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Items of `gone` (collection, link_id, by) to the trash, their bindings dropped."""
    marked = items.join(gone.select("collection", "link_id", F.col("by").alias("__by")), ["collection", "link_id"], "left")
    hit = F.col("__by").isNotNull()
    out = patch(marked, hit, deleted=F.lit(1), retained_at=F.lit(now), retained_by=F.col("__by")).select(items.columns)
    return out, without(bi, gone.select("collection", "link_id"))


def revive(items: DataFrame, back: DataFrame) -> DataFrame:
    """Retained items that come back: content adopted from `back`, number kept."""
    content = ["flags", "object_hash", "meta", "sort_key", "level"]
    own = back.select("collection", "link_id", F.struct(*content).alias("__new"))
    joined = items.join(own, ["collection", "link_id"], "left")
    hit = F.col("__new").isNotNull() & retained()
    null = F.lit(None).cast("string")
    return patch(joined, hit, deleted=F.lit(0), **{c: F.col(f"__new.{c}") for c in content}, retained_by=null, retained_at=null).select(items.columns)


def purge_one(items: DataFrame, collection: str, seq: int) -> DataFrame:
    """items without one retained item; live ones can't be reached."""
    return items.filter(~((F.col("collection") == collection) & (F.col("seq") == seq) & retained()))


def purge_each(items: DataFrame, which: DataFrame) -> DataFrame:
    """items without the retained ones of `which`: (collection, seq), or (seq) for those numbers in whatever collection. Only what is
    retained is shuffled."""
    keys = [c for c in ("collection", "seq") if c in which.columns]
    return items.filter(~retained()).unionByName(items.filter(retained()).join(which.select(*keys), keys, "left_anti"))


def purge_before(items: DataFrame, cutoff: str) -> DataFrame:
    return items.filter(~retained() | (F.col("retained_at") >= cutoff))


def purge_report(before: DataFrame, after: DataFrame, objects: DataFrame, others: DataFrame) -> DataFrame:
    """(items, bytes): rows purged, and bytes of bodies that nothing refers to afterwards. others: (hash) of all references
    outside items."""
    keys = ["collection", "link_id"]
    gone = before.join(after.select(keys), keys, "left_anti")
    lost = gone.filter(F.col("object_hash").isNotNull()).select(F.col("object_hash").alias("hash")).distinct()
    still = after.filter(F.col("object_hash").isNotNull()).select(F.col("object_hash").alias("hash")).unionByName(others.select("hash"))
    freed = objects.join(lost.join(still, "hash", "left_anti"), "hash", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
    return gone.agg(F.count("*").alias("items")).crossJoin(freed)


def numbered(rows: DataFrame, order: list[str], first: int, name: str) -> DataFrame:
    """rows with the column `name`: first, first + 1, ... in the order of columns that tell all rows apart. Rows are sorted by ranges
    and written; each range then counts on from those before it, so no task sorts all rows."""
    placed = session.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    starts, total = {}, first
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each range
        starts[r.p] = total
        total += r["count"]
    if not starts:
        return placed.withColumn(name, F.col("__at")).drop("__at")
    return placed.withColumn(name, F.element_at(F.create_map(*(F.lit(x) for p in starts.items() for x in p)), part).cast("bigint") + within).drop("__at")


def allocate_seq(rows: DataFrame, items: DataFrame, next_seq: int) -> DataFrame:
    """seq for new (collection, link_id): that of the link if it is known anywhere, else the next, in order of each link's
    first (collection, link_id). items needs link_id and seq alone."""
    links = rows.select("link_id").distinct()
    known = items.join(links, "link_id", "left_semi").groupBy("link_id").agg(F.min("seq").alias("known"))
    new = rows.select("collection", "link_id").join(known.select("link_id"), "link_id", "left_anti").groupBy("link_id").agg(F.min("collection").alias("first"))
    fresh = numbered(new, ["first", "link_id"], next_seq, "fresh").select("link_id", "fresh")
    return rows.join(known, "link_id", "left").join(fresh, "link_id", "left").withColumn("seq", F.coalesce("known", "fresh")).drop("known", "fresh")


def enqueue(queue: DataFrame, rows: DataFrame, first_id: int) -> DataFrame:
    """rows (created_at, producer, collection, action, payload, object_hash) after the queue's rows, in order of created_at, then
    of the other columns."""
    order = ["created_at", "producer", "payload", "collection", "action", "object_hash"]
    more = numbered(rows, [*order], first_id, "id").withColumns({"attempts": F.lit(0), "error": F.lit(None).cast("string")})
    return queue.unionByName(more.select(queue.columns))


def cancel(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return without(queue, ids.select("id"))


def park(queue: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of errors (id, why) parked, one attempt more."""
    joined = queue.join(errors.select("id", F.col("why").alias("__why")), "id", "left")
    hit = F.col("__why").isNotNull()
    return patch(joined, hit, error=F.col("__why"), attempts=F.col("attempts") + 1).select(queue.columns)


def fail(queue: DataFrame, id_: int, why: str, permanent: bool) -> DataFrame:
    """A failed action: tried once more later, or parked for good. An unknown id changes nothing."""
    hit = F.col("id") == id_
    return patch(queue, hit, attempts=F.col("attempts") + 1, **({"error": F.lit(why)} if permanent else {}))
