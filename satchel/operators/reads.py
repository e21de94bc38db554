"""Reads: pages by key, lookups, placements, counts. Each takes store tables and returns a DataFrame.

A page of one collection is a filter on the key's columns, written out so that it reaches the scan, and a top-k; all pages of all
collections at once are one window over a shuffle by collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 50
ITEM = ("seq", "link_id", "flags", "meta", "sort_key", "object_hash", "level")


def live() -> Column:
    return F.col("deleted") == 0


def retained() -> Column:
    return F.col("retained_at").isNotNull()


def order_of(order: str) -> list[Column]:
    return {"link": [F.asc("link_id")], "asc": [F.asc("sort_key"), F.asc("seq")], "desc": [F.desc("sort_key"), F.desc("seq")], "retained": [F.asc("seq")]}[order]


def beyond(order: str, after: tuple) -> Column:
    """What lies strictly beyond a cursor, as plain comparisons."""
    key, seq = F.col("sort_key"), F.col("seq")
    if order == "link":
        return F.col("link_id") > after[0]
    if order == "retained":
        return seq > after[0]
    k, s = after
    if order == "asc":
        return (key >= k) & ((key > k) | ((key == k) & (seq > s)))
    return (key <= k) & ((key < k) | ((key == k) & (seq < s)))


def page(items: DataFrame, collection: str, order: str, after: tuple | None = None, limit: int = PAGE) -> DataFrame:
    """One page of a collection's live items (order link, asc or desc)."""
    rows = items.filter((F.col("collection") == collection) & live())
    if after is not None:
        rows = rows.filter(beyond(order, after))
    return rows.select(*ITEM).orderBy(*order_of(order)).limit(limit)


def retained_page(items: DataFrame, objects: DataFrame, collection: str, after: int | None = None, limit: int = PAGE) -> DataFrame:
    """One page of a collection's trash, with the sizes of its bodies."""
    rows = items.filter((F.col("collection") == collection) & retained())
    if after is not None:
        rows = rows.filter(beyond("retained", (after,)))
    rows = rows.orderBy("seq").limit(limit)
    return rows.join(objects.select(F.col("hash").alias("object_hash"), "size"), "object_hash", "left").select(*ITEM, "size", "retained_at", "retained_by").orderBy("seq")


def pages(items: DataFrame, order: str, limit: int = PAGE) -> DataFrame:
    """All live items of all collections (or the retained ones) with the page and the place in it where page() shows them."""
    rows = items.filter(retained() if order == "retained" else live())
    n = F.row_number().over(Window.partitionBy("collection").orderBy(*order_of(order))).cast("bigint")
    return rows.withColumn("n", n).select("collection", F.floor((F.col("n") - 1) / limit).alias("page"), ((F.col("n") - 1) % limit).alias("place"), *ITEM, "retained_at", "retained_by")


def sized(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """rows with the sizes of their bodies."""
    return rows.join(objects.select(F.col("hash").alias("object_hash"), "size"), "object_hash", "left")


def pages_after(items: DataFrame, cursors: DataFrame, order: str, limit: int = PAGE) -> DataFrame:
    """For each (collection, sort_key, seq) of cursors, the page beyond it."""
    at = cursors.select("collection", F.col("sort_key").alias("k"), F.col("seq").alias("s"))
    key, seq, k, s = F.col("sort_key"), F.col("seq"), F.col("k"), F.col("s")
    far = (key > k) | ((key == k) & (seq > s)) if order == "asc" else (key < k) | ((key == k) & (seq < s))
    n = F.row_number().over(Window.partitionBy("collection").orderBy(*order_of(order))).cast("bigint")
    return items.filter(live()).join(at, "collection").filter(far).withColumn("place", n - 1).filter(F.col("place") < limit).select("collection", "place", *ITEM)


def get_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live items by (collection, seq)."""
    return items.filter(live()).join(wanted.select("collection", "seq").distinct(), ["collection", "seq"], "left_semi").select("collection", *ITEM)


def get_item(items: DataFrame, collection: str, seq: int) -> DataFrame:
    return items.filter((F.col("collection") == collection) & (F.col("seq") == seq) & live()).select(*ITEM)


def seq_by_link(items: DataFrame) -> DataFrame:
    """The number of each (collection, link), deleted or not."""
    return items.select("collection", "link_id", "seq")


def seq_for_link(items: DataFrame) -> DataFrame:
    """The one number of each link, in whatever collection."""
    return items.groupBy("link_id").agg(F.min("seq").alias("seq"))


def load_items(items: DataFrame) -> DataFrame:
    """What a hub loads: all but retained items."""
    return items.filter(~retained())


def retained_before(items: DataFrame, cutoff: str) -> DataFrame:
    """Retained strictly before the cutoff, as texts compare."""
    return items.filter(retained() & (F.col("retained_at") < cutoff))


def collections(co: DataFrame) -> DataFrame:
    """All collections with their place in the list; those without an order come last."""
    n = F.row_number().over(Window.orderBy(F.asc_nulls_last("sort_order"), "id")).cast("bigint")  # a few rows
    return co.withColumn("place", n)


def collections_by_account(co: DataFrame, account: str | None) -> DataFrame:
    return collections(co.filter(F.col("account").eqNullSafe(F.lit(account))))


def collections_per_account(co: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("account").orderBy(F.asc_nulls_last("sort_order"), "id")).cast("bigint")
    return co.select("account", n.alias("place"), "id", "name", "kind", "sort_order")


def accounts(co: DataFrame) -> DataFrame:
    return co.filter(F.col("account").isNotNull()).select("account").distinct()


def sources(bi: DataFrame) -> DataFrame:
    """The sources that bindings name."""
    return bi.select("collection", "source").distinct()


def setting(co: DataFrame, collection: str, what: str) -> DataFrame:
    """A collection's account, kind, conflict policy or generation: no row if there is no such collection."""
    return co.filter(F.col("id") == collection).select(what)


def placements(items: DataFrame, co: DataFrame, by: str) -> DataFrame:
    """Where each link (or body) lies: non-retained live placements, ordered by account (none last) and collection."""
    rows = items.filter(live() & ~retained() & F.col(by).isNotNull()).join(co.select(F.col("id").alias("collection"), "account"), "collection")
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("account"), "collection", "seq")).cast("bigint")
    return rows.select(F.col(by).alias("key"), n.alias("place"), "collection", "account", "seq", "link_id", F.col("object_hash").alias("object"), "flags", "level")


def json_ids(lists: DataFrame, column: str) -> DataFrame:
    """(link_id) of JSON lists of ids."""
    return lists.select(F.explode(F.from_json(column, "array<string>")).alias("link_id"))


def retained_item(items: DataFrame, collection: str, seq: int | None = None, link: str | None = None) -> DataFrame:
    """One retained item, by its number or its link."""
    return items.filter((F.col("collection") == collection) & retained() & (F.col("seq") == seq if link is None else F.col("link_id") == link))


def retained_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Retained items by (collection, seq)."""
    return items.filter(retained()).join(wanted.select("collection", "seq").distinct(), ["collection", "seq"], "left_semi").select("collection", *ITEM, "retained_at")


def lookup_objects(items: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The body of each link that has one; of several, that of the last collection."""
    rows = items.filter(F.col("object_hash").isNotNull())
    if links is not None:
        rows = rows.join(links.select("link_id").distinct(), "link_id", "left_semi")
    return rows.groupBy("link_id").agg(F.max_by("object_hash", "collection").alias("object_hash"))


def counts(items: DataFrame, co: DataFrame) -> DataFrame:
    """Each collection's generation, live and retained items; empty collections too."""
    n = items.groupBy(F.col("collection").alias("id")).agg(F.count_if(live()).alias("live"), F.count_if(retained()).alias("retained"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return co.select("id", "generation").join(n, "id", "left").select("id", "generation", zero("live"), zero("retained"))


def retained_bytes(items: DataFrame, objects: DataFrame) -> DataFrame:
    """For each collection with retained items, the bytes of the distinct bodies that they pin."""
    pins = items.filter(retained()).select("collection", F.col("object_hash").alias("hash")).distinct()
    return pins.join(objects.select("hash", "size"), "hash", "left").groupBy("collection").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def live_bytes(items: DataFrame, objects: DataFrame) -> DataFrame:
    pins = items.filter(~retained()).select(F.col("object_hash").alias("hash"))
    return objects.join(pins, "hash", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def object_stats(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def retained_preview(items: DataFrame, objects: DataFrame, cutoff: str) -> DataFrame:
    """What a sweep would take: rows, and bytes counted for each row."""
    rows = retained_before(items, cutoff).join(objects.select(F.col("hash").alias("object_hash"), "size"), "object_hash", "left")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def store_info(items: DataFrame, co: DataFrame, objects: DataFrame, bi: DataFrame) -> DataFrame:
    """One row of totals."""
    a = co.agg(F.count("*").alias("collections"), F.countDistinct("account").alias("accounts"))
    b = items.agg(F.count_if(live()).alias("live"), F.count_if(retained()).alias("retained"))
    c = object_stats(objects).select(F.col("n").alias("objects"), "bytes")
    d = bi.agg(F.countDistinct("source").alias("sources"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(live_bytes(items, objects).withColumnRenamed("bytes", "live_bytes"))


def item_show(items: DataFrame, co: DataFrame) -> DataFrame:
    """A row for each placement of each number, retained ones too."""
    n = F.row_number().over(Window.partitionBy("seq").orderBy(F.asc_nulls_last("account"), "collection")).cast("bigint")
    rows = items.join(co.select(F.col("id").alias("collection"), "account"), "collection")
    return rows.select("seq", n.alias("place"), "collection", "account", "link_id", "object_hash", F.when(retained(), "retained").when(live(), "live").otherwise("tombstone").alias("state"))


def hub_nested(items: DataFrame, bi: DataFrame) -> DataFrame:
    """Items with their bindings, sorted by source, as one list for each item."""
    one = F.struct("source", "handle", "base_flags", "base_object", "base_revision", F.when(F.col("conflicted") == 1, F.col("conflict_revision")).alias("conflict_revision"))
    held = bi.groupBy("collection", "link_id").agg(F.array_sort(F.collect_list(one)).alias("bindings"))
    return load_items(items).join(held, ["collection", "link_id"], "left")


def pending(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("error").isNull())


def parked(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("error").isNotNull())


def queued_collections(queue: DataFrame) -> DataFrame:
    return pending(queue).select("collection").distinct()
