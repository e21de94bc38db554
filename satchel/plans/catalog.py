"""The queries of the store: for each name a function of the store tables and the same in DuckDB SQL over the same definitions.

Every query runs over whole tables; lookups by key are registered as lookups of all keys at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.operators import changes, checks, drain, export, hub, reads
from satchel.sources.store_tables import oracle, tables

Tables = dict[str, DataFrame]
CUTOFF = "2024-01-15T00:00:00.000Z"
NOW = "2030-01-01T00:00:00.000Z"
ITEM = "seq, link_id, flags, meta, sort_key, object_hash, level"
FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f: Callable[[Tables], DataFrame]):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _pages(order: str, where: str) -> str:
    return f"""select collection, cast(floor((n - 1) / 50) as bigint) as page, (n - 1) % 50 as place, {ITEM}, retained_at, retained_by
from (select *, row_number() over (partition by collection order by {order}) as n from items where {where}) x"""


@query(_pages("link_id", "deleted = 0"))
def items_page_link(t: Tables) -> DataFrame:
    return reads.pages(t["items"], "link")


@query(_pages("sort_key, seq", "deleted = 0"))
def items_page_asc(t: Tables) -> DataFrame:
    return reads.pages(t["items"], "asc")


@query(_pages("sort_key desc, seq desc", "deleted = 0"))
def items_page_desc(t: Tables) -> DataFrame:
    return reads.pages(t["items"], "desc")


@query(_pages("seq", "retained_at is not null"))
def retained_page(t: Tables) -> DataFrame:
    return reads.pages(t["items"], "retained")


@query("select collection, cast(ceil(count(*) / 50.0) as bigint) as pages, count(*) as n from items where deleted = 0 group by collection")
def items_page_exhaust(t: Tables) -> DataFrame:
    return reads.pages(t["items"], "asc").groupBy("collection").agg((F.max("page") + 1).alias("pages"), F.count("*").alias("n"))


def _after(order: str, direction: str) -> str:
    return f"""select x.collection, x.n - 1 as place, {", ".join("x." + c for c in ITEM.split(", "))} from (
select i.*, row_number() over (partition by i.collection order by i.sort_key {order}, i.seq {order}) as n from items i
join (select collection, sort_key, seq from (select *, row_number() over (partition by collection order by sort_key {order}, seq {order}) as k from items where deleted = 0) y where k = 5) c
on c.collection = i.collection where i.deleted = 0 and (i.sort_key {direction} c.sort_key or (i.sort_key = c.sort_key and i.seq {direction} c.seq))) x where x.n <= 50"""


def _fifth(t: Tables, order: str) -> DataFrame:
    return reads.pages(t["items"], order, 5).filter("page = 0 and place = 4")


@query(_after("asc", ">"))
def items_page_asc_after(t: Tables) -> DataFrame:
    return reads.pages_after(t["items"], _fifth(t, "asc"), "asc")


@query(_after("desc", "<"))
def items_page_desc_after(t: Tables) -> DataFrame:
    return reads.pages_after(t["items"], _fifth(t, "desc"), "desc")


@query(f"select i.collection, {ITEM} from items i where deleted = 0 and exists (select 1 from queue q where q.collection = i.collection and q.id = i.seq)")
def get_item(t: Tables) -> DataFrame:
    return reads.get_items(t["items"], t["queue"].select("collection", F.col("id").alias("seq")))


@query("select collection, link_id, seq from items")
def seq_by_link(t: Tables) -> DataFrame:
    return reads.seq_by_link(t["items"])


@query("select link_id, min(seq) as seq from items group by link_id")
def seq_for_link(t: Tables) -> DataFrame:
    return reads.seq_for_link(t["items"])


@query("select id, account, kind, conflict, generation from collections")
def collection_settings(t: Tables) -> DataFrame:
    return t["collections"].select("id", "account", "kind", C.policy(F.col("conflict")).alias("conflict"), "generation")


@query("select *, row_number() over (order by sort_order is null, sort_order, id) as place from collections")
def collections_list(t: Tables) -> DataFrame:
    return reads.collections(t["collections"])


@query("select account, row_number() over (partition by account order by sort_order is null, sort_order, id) as place, id, name, kind, sort_order from collections")
def collections_by_account(t: Tables) -> DataFrame:
    return reads.collections_per_account(t["collections"])


@query("select *, row_number() over (order by sort_order is null, sort_order, id) as place from collections where account is not distinct from null")
def collections_null_account(t: Tables) -> DataFrame:
    return reads.collections_by_account(t["collections"], None)


@query("select distinct account from collections where account is not null")
def accounts(t: Tables) -> DataFrame:
    return reads.accounts(t["collections"])


@query("select distinct collection, source from bindings")
def sources(t: Tables) -> DataFrame:
    return reads.sources(t["bindings"])


def _placements(by: str) -> str:
    return f"""select {by} as key, row_number() over (partition by {by} order by account is null, account, collection, seq) as place, collection, account, seq, link_id, object_hash as object, flags, level
from items join collections c on c.id = collection where deleted = 0 and retained_at is null and {by} is not null"""


@query(_placements("link_id"))
def link_placements(t: Tables) -> DataFrame:
    return reads.placements(t["items"], t["collections"], "link_id")


@query(_placements("object_hash"))
def object_placements(t: Tables) -> DataFrame:
    return reads.placements(t["items"], t["collections"], "object_hash")


@query("select link_id, max_by(object_hash, collection) as object_hash from items where object_hash is not null group by link_id")
def lookup_objects(t: Tables) -> DataFrame:
    return reads.lookup_objects(t["items"])


@query("select collection, count(*) as n from items where deleted = 0 group by collection")
def count_items(t: Tables) -> DataFrame:
    return t["items"].filter(reads.live()).groupBy("collection").agg(F.count("*").alias("n"))


@query("select collection, count(*) as n from items where retained_at is not null group by collection")
def count_retained(t: Tables) -> DataFrame:
    return t["items"].filter(reads.retained()).groupBy("collection").agg(F.count("*").alias("n"))


COUNTS = """select c.id, c.generation, count(i.seq) filter (where i.deleted = 0) as live, count(i.seq) filter (where i.retained_at is not null) as retained
from collections c left join items i on i.collection = c.id group by c.id, c.generation"""


@query(COUNTS)
def collection_counts(t: Tables) -> DataFrame:
    return reads.counts(t["items"], t["collections"])


@query("select collection, cast(coalesce(sum(size), 0) as bigint) as bytes from (select distinct collection, object_hash from items where retained_at is not null) x left join objects on hash = object_hash group by collection")
def retained_bytes(t: Tables) -> DataFrame:
    return reads.retained_bytes(t["items"], t["objects"])


@query("select cast(coalesce(sum(size), 0) as bigint) as bytes from objects where hash in (select object_hash from items where retained_at is null and object_hash is not null)")
def live_bytes(t: Tables) -> DataFrame:
    return reads.live_bytes(t["items"], t["objects"])


@query("select count(*) as n, cast(sum(size) as bigint) as bytes from objects")
def object_stats(t: Tables) -> DataFrame:
    return reads.object_stats(t["objects"])


@query("select hash, size from objects")
def object_sizes(t: Tables) -> DataFrame:
    return t["objects"].select("hash", "size")


@query(f"select count(*) as n, cast(coalesce(sum(size), 0) as bigint) as bytes from items left join objects on hash = object_hash where retained_at < '{CUTOFF}'")
def retained_before_preview(t: Tables) -> DataFrame:
    return reads.retained_preview(t["items"], t["objects"], CUTOFF)


@query(f"select collection, link_id, seq, object_hash, retained_at from items where retained_at < '{CUTOFF}'")
def retained_before(t: Tables) -> DataFrame:
    return reads.retained_before(t["items"], CUTOFF).select("collection", "link_id", "seq", "object_hash", "retained_at")


@query("select collection, link_id, seq, retained_at from items where not (retained_at is not null and seq in (select id from queue where error is not null))")
def purge_one(t: Tables) -> DataFrame:
    """In each collection, the retained items that have the numbers of parked actions."""
    return changes.purge_each(t["items"], reads.parked(t["queue"]).select(F.col("id").alias("seq"))).select("collection", "link_id", "seq", "retained_at")


@query(f"select collection, link_id, seq, retained_at from items where retained_at is null or retained_at >= '{CUTOFF}'")
def purge_before_cutoff(t: Tables) -> DataFrame:
    return changes.purge_before(t["items"], CUTOFF).select("collection", "link_id", "seq", "retained_at")


@query(f"""select (select count(*) from items where retained_at < '{CUTOFF}') as items,
(select cast(coalesce(sum(size), 0) as bigint) from objects where hash in (select object_hash from items where retained_at < '{CUTOFF}' and object_hash is not null)
and hash not in (select object_hash from items where object_hash is not null and (retained_at is null or retained_at >= '{CUTOFF}'))
and hash not in (select base_object from bindings where base_object is not null) and hash not in (select object_hash from queue where object_hash is not null)) as bytes""")
def purge_report(t: Tables) -> DataFrame:
    others = t["bindings"].select(F.col("base_object").alias("hash")).unionByName(t["queue"].select(F.col("object_hash").alias("hash"))).filter("hash is not null")
    return changes.purge_report(t["items"], changes.purge_before(t["items"], CUTOFF), t["objects"], others)


@query("select hash, size from objects where refcount = 0")
def garbage(t: Tables) -> DataFrame:
    return checks.garbage(t["objects"])


@query("select hash, size, refcount from objects where refcount <> 0")
def collect_garbage(t: Tables) -> DataFrame:
    return checks.collect(t["objects"]).select("hash", "size", "refcount")


@query("select hash, count(*) as expected from refs group by hash")
def refcount_expected(t: Tables) -> DataFrame:
    return checks.references(t["items"], t["bindings"], t["queue"])


@query("select o.hash, o.refcount, coalesce(n, 0) as expected from objects o left join (select hash, count(*) as n from refs group by hash) r on r.hash = o.hash where o.refcount <> coalesce(n, 0)")
def refcount_drift(t: Tables) -> DataFrame:
    return checks.refcount_drift(t["objects"], t["items"], t["bindings"], t["queue"])


@query("select collection, link_id, source from bindings b where not exists (select 1 from items i where i.collection = b.collection and i.link_id = b.link_id)")
def dangling_bindings(t: Tables) -> DataFrame:
    return checks.dangling_bindings(t["bindings"], t["items"])


@query("select collection, link_id, object_hash from items where object_hash is not null and object_hash not in (select hash from objects)")
def dangling_item_objects(t: Tables) -> DataFrame:
    return checks.dangling_item_objects(t["items"], t["objects"])


@query("select id, object_hash from queue where object_hash is not null and object_hash not in (select hash from objects)")
def dangling_queue_objects(t: Tables) -> DataFrame:
    return checks.dangling_queue_objects(t["queue"], t["objects"])


@query("select hash, size from blobs where hash not in (select hash from objects)")
def orphan_blobs(t: Tables) -> DataFrame:
    return checks.orphan_blobs(t["blobs"], t["objects"])


@query("select hash, size from objects where hash not in (select hash from blobs)")
def missing_blobs(t: Tables) -> DataFrame:
    return checks.missing_blobs(t["objects"], t["blobs"])


@query("select * from items where retained_at is null")
def load_items(t: Tables) -> DataFrame:
    return reads.load_items(t["items"])


@query("select collection, link_id, source, handle, base_flags, base_object, base_revision, conflicted, case when conflicted = 1 then conflict_revision end as conflict_revision from bindings")
def load_bindings(t: Tables) -> DataFrame:
    return t["bindings"].withColumn("conflict_revision", F.when(F.col("conflicted") == 1, F.col("conflict_revision")))


@query("select collection, source, checkpoint from sources")
def load_checkpoints(t: Tables) -> DataFrame:
    return t["sources"]


@query("""select i.collection, i.link_id, i.seq, string_agg(concat(b.source, '=', b.handle), ',' order by b.source) as bound
from items i left join bindings b on b.collection = i.collection and b.link_id = i.link_id where i.retained_at is null group by i.collection, i.link_id, i.seq""")
def hub_nested(t: Tables) -> DataFrame:
    bound = F.array_join(F.transform("bindings", lambda b: F.concat(b["source"], F.lit("="), b["handle"])), ",")
    return reads.hub_nested(t["items"], t["bindings"]).select("collection", "link_id", "seq", bound.alias("bound"))


@query("select distinct collection from queue where error is null")
def queued_collections(t: Tables) -> DataFrame:
    return reads.queued_collections(t["queue"])


@query("select * from queue where error is null")
def pending_actions(t: Tables) -> DataFrame:
    return reads.pending(t["queue"])


@query("select * from queue where error is not null")
def parked_actions(t: Tables) -> DataFrame:
    return reads.parked(t["queue"])


@query("select id, attempts, object_hash from queue")
def action_rows(t: Tables) -> DataFrame:
    return t["queue"].select("id", "attempts", "object_hash")


@query("""select (select count(*) from collections) as collections, (select count(distinct account) from collections) as accounts, (select count(*) from items where deleted = 0) as live,
(select count(*) from items where retained_at is not null) as retained, (select count(*) from objects) as objects, (select cast(sum(size) as bigint) from objects) as bytes,
(select count(distinct source) from bindings) as sources, (select cast(coalesce(sum(size), 0) as bigint) from objects where hash in (select object_hash from items where retained_at is null and object_hash is not null)) as live_bytes""")
def store_info(t: Tables) -> DataFrame:
    return reads.store_info(t["items"], t["collections"], t["objects"], t["bindings"])


@query("select version, hash_algo, next_seq from meta")
def store_version(t: Tables) -> DataFrame:
    return t["meta"].select("version", "hash_algo", "next_seq")


@query("""select 'collections' as tbl, case when id = 'en/src1' then 'en/new' else id end as id, case when parent = 'en/src1' then 'en/new' else parent end as more, count(*) as n from collections group by 1, 2, 3
union all select 'items', case when collection = 'en/src1' then 'en/new' else collection end, null, count(*) from items group by 1, 2
union all select 'bindings', case when collection = 'en/src1' then 'en/new' else collection end, null, count(*) from bindings group by 1, 2
union all select 'sources', case when collection = 'en/src1' then 'en/new' else collection end, null, count(*) from sources group by 1, 2
union all select 'queue', case when collection = 'en/src1' then 'en/new' else collection end, null, count(*) from queue group by 1, 2""")
def rename_cascade(t: Tables) -> DataFrame:
    after = changes.rename_collection(t, "en/src1", "en/new")
    null = F.lit(None).cast("string").alias("more")
    out = after["collections"].groupBy(F.lit("collections").alias("tbl"), "id", F.col("parent").alias("more")).agg(F.count("*").alias("n"))
    for name in ("items", "bindings", "sources", "queue"):
        out = out.unionByName(after[name].groupBy(F.col("collection").alias("id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "id", null, "n"))
    return out


@query("select id, case when id = 'de/src1' then 'work' when id = 'es/src1' then null else account end as account, kind from collections")
def regroup_account(t: Tables) -> DataFrame:
    return changes.set_account(changes.set_account(t["collections"], "de/src1", "work"), "es/src1", None).select("id", "account", "kind")


@query("""select id, account, case when id = 'fr/src2' then 'text/vcard' else kind end as kind, case when id = 'fr/src2' then 'prefer-existing' else conflict end as conflict,
generation + case when id = 'fr/src2' then 1 else 0 end as generation from collections union all select 'new/one', 'me', 'text/calendar', 'manual', 1""")
def collection_changes(t: Tables) -> DataFrame:
    co = changes.set_kind(changes.set_kind(t["collections"], "fr/src2", "text/vcard"), "new/one", "text/calendar", "me")
    co = changes.bump_generation(changes.set_conflict(co, "fr/src2", "prefer-existing"), "fr/src2")
    return co.select("id", "account", "kind", "conflict", "generation")


GONE = "select collection, link_id, min(source) as by_source from bindings group by collection, link_id having count(*) = 1"


@query(f"""select i.collection, i.link_id, i.seq, case when g.link_id is not null then 1 else i.deleted end as deleted, case when g.link_id is not null then '{NOW}' else i.retained_at end as retained_at,
case when g.link_id is not null then g.by_source else i.retained_by end as retained_by from items i left join ({GONE}) g on g.collection = i.collection and g.link_id = i.link_id""")
def retain_items(t: Tables) -> DataFrame:
    gone = t["bindings"].groupBy("collection", "link_id").agg(F.min("source").alias("by"), F.count("*").alias("n")).filter("n = 1")
    return changes.retain(t["items"], t["bindings"], gone, NOW)[0].select("collection", "link_id", "seq", "deleted", "retained_at", "retained_by")


@query(f"select b.collection, b.link_id, b.source from bindings b where not exists (select 1 from ({GONE}) g where g.collection = b.collection and g.link_id = b.link_id)")
def retain_bindings(t: Tables) -> DataFrame:
    gone = t["bindings"].groupBy("collection", "link_id").agg(F.min("source").alias("by"), F.count("*").alias("n")).filter("n = 1")
    return changes.retain(t["items"], t["bindings"], gone, NOW)[1].select("collection", "link_id", "source")


@query("""select collection, link_id, seq, case when retained_at is not null then '["$back"]' else flags end as flags, case when retained_at is not null then 0 else deleted end as deleted, sort_key from items""")
def revive_items(t: Tables) -> DataFrame:
    back = t["items"].filter(reads.retained()).withColumn("flags", F.lit('["$back"]'))
    after = changes.revive(t["items"], back)
    return after.select("collection", "link_id", "seq", "flags", "deleted", "sort_key")


@query("""select 'zz/new' as collection, k.link_id, coalesce(i.seq, (select next_seq from meta) + f.n - 1) as seq
from (select distinct case when item_id % 2 = 0 then concat('bench:', cast(item_id as varchar(20))) else (select min(link_id) from items) end as link_id from benchmark) k
left join (select link_id, min(seq) as seq from items group by link_id) i on i.link_id = k.link_id
left join (select link_id, row_number() over (order by link_id) as n from (select distinct concat('bench:', cast(item_id as varchar(20))) as link_id from benchmark where item_id % 2 = 0) z) f on f.link_id = k.link_id""")
def seq_allocate(t: Tables) -> DataFrame:
    least = t["items"].agg(F.min("link_id").alias("m"))
    ids = t["blobs"].filter("hash like 'orphan-%'").select(F.substring("hash", 8, 20).cast("bigint").alias("item_id")).crossJoin(least)
    link = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("bench:"), F.col("item_id").cast("string"))).otherwise(F.col("m"))
    rows = ids.select(F.lit("zz/new").alias("collection"), link.alias("link_id")).distinct()
    return changes.allocate_seq(rows, t["items"], t["meta"].first().next_seq).select("collection", "link_id", "seq")


@query("""select collection, link_id, case when retained_at is not null then 'remove' else 'update' end as change from items where retained_at is not null or (deleted = 0 and flags <> '["$seen"]')""")
def hub_diff(t: Tables) -> DataFrame:
    new = t["items"].filter(~reads.retained()).withColumn("flags", F.when(reads.live(), '["$seen"]').otherwise(F.col("flags")))
    return hub.diff(t["items"], new)


@query("select hash, -count(*) as delta from (select object_hash as hash from items where retained_at is not null and object_hash is not null) x group by hash")
def refcount_delta(t: Tables) -> DataFrame:
    count = lambda items: checks.references(items, t["bindings"], t["queue"]).withColumnRenamed("expected", "n")
    return checks.refcount_delta(count(t["items"]), count(t["items"].filter(~reads.retained())))


@query("""select seq, row_number() over (partition by seq order by account is null, account, collection) as place, collection, account, link_id, object_hash,
case when retained_at is not null then 'retained' when deleted = 0 then 'live' else 'tombstone' end as state from items join collections c on c.id = collection""")
def item_show(t: Tables) -> DataFrame:
    return reads.item_show(t["items"], t["collections"])


@query("""select collection, case when retained_at is not null then 'retained' else 'live' end as state, seq, link_id, flags, meta, object_hash as object,
case level when 1 then 'meta' when 2 then 'full' else 'probed' end as level, retained_at, retained_by from items where deleted = 0 or retained_at is not null""")
def export_rows(t: Tables) -> DataFrame:
    """What the exported lines of JSON hold when they are read again."""
    line = F.from_json("line", "seq bigint, link_id string, flags array<string>, meta string, object string, level string, retained_at string, retained_by string")
    return export.rows(t["items"]).select("collection", "state", line.alias("l")).select("collection", "state", "l.seq", "l.link_id", F.to_json("l.flags").alias("flags"), "l.meta", "l.object", "l.level", "l.retained_at", "l.retained_by")


@query("""select collection, link_id, array_to_string(list_sort(list_distinct(cast(from_json(flags, '["VARCHAR"]') as varchar[]))), ',') as flags from items""")
def flags_decode(t: Tables) -> DataFrame:
    return t["items"].select("collection", "link_id", F.array_join(C.flags_decode(F.col("flags")), ",").alias("flags"))


PAYLOAD = """select id, case when action in ('add', 'set-flags', 'remove', 'move', 'copy', 'update') then action else 'unknown' end as kind,
case when json_valid(payload) then cast(json_extract(payload, '$.seq') as bigint) end as seq,
case when json_valid(payload) and json_type(payload, '$.to') = 'VARCHAR' then json_extract_string(payload, '$.to') end as target,
case when json_valid(payload) then json_extract_string(payload, '$.object') end as object,
case when action = 'submit' then null when not json_valid(payload) then 'malformed payload' when action = 'update' and json_extract_string(payload, '$.object') is null then 'missing field: object' end as error, action from queue"""


@query(f"select id, kind, seq, target, object, error from ({PAYLOAD}) x")
def payload_decode(t: Tables) -> DataFrame:
    p = C.payload_decode(F.col("action"), F.col("payload"))
    return t["queue"].select("id", p.alias("p")).select("id", "p.kind", "p.seq", F.col("p.to").alias("target"), "p.object", "p.error")


@query(f"""select id, case when error is not null then concat(action, ': ', error) when action = 'copy' then concat(action, ' #', cast(seq as varchar), ' to ', target)
when kind = 'unknown' then concat('unknown: ', action) else concat(action, ' #', cast(seq as varchar)) end as summary from ({PAYLOAD}) x""")
def queue_summary(t: Tables) -> DataFrame:
    return t["queue"].select("id", C.action_summary(F.col("action"), F.col("payload")).alias("summary"))


@query("select collection, link_id, case level when 1 then 'meta' when 2 then 'full' else 'probed' end as level from items")
def level_names(t: Tables) -> DataFrame:
    return t["items"].select("collection", "link_id", C.level_name(F.col("level")).alias("level"))


@query("select hash, case when size >= 1048576 then printf('%.1f MiB', size / 1048576.0) when size >= 1024 then printf('%.1f KiB', size / 1024.0) else concat(cast(size as varchar), ' B') end as shown from objects")
def humanise_bytes(t: Tables) -> DataFrame:
    return t["objects"].select("hash", C.humanise(F.col("size")).alias("shown"))


@query("select hash, concat(substr(hash, 1, 2), '/', substr(hash, 3, 2), '/', hash) as path from objects")
def blob_paths(t: Tables) -> DataFrame:
    return t["objects"].select("hash", C.blob_path(F.col("hash")).alias("path"))


@query("""select coalesce(o.hash, b.hash) as hash, coalesce(b.size + 1, o.size) as size, coalesce(o.refcount, 0) as refcount
from objects o full outer join (select * from blobs) b on b.hash = o.hash""")
def store_objects(t: Tables) -> DataFrame:
    return changes.store_objects(t["objects"], t["blobs"].withColumn("size", F.col("size") + 1))


@query("select collection, source, case when source = 'left' then 'again' else checkpoint end as checkpoint from sources union all select 'zz/new', 'left', 'again'")
def upsert_checkpoints(t: Tables) -> DataFrame:
    new = t["sources"].filter("source = 'left'").select("collection", "source").unionByName(t["sources"].sparkSession.createDataFrame([("zz/new", "left")], "collection string, source string"))
    return changes.upsert_checkpoint(t["sources"], new.withColumn("checkpoint", F.lit("again")))


@query("""select id, action, error, attempts from queue union all
select (select max(id) from queue) + row_number() over (order by created_at, id), action, null, 0 from queue where error is not null""")
def enqueue_actions(t: Tables) -> DataFrame:
    again = t["queue"].filter("error is not null").withColumn("producer", F.lpad(F.col("id").cast("string"), 12, "0"))
    first = t["queue"].agg(F.max("id")).first()[0] + 1
    return changes.enqueue(t["queue"], again.drop("id", "attempts", "error"), first).select("id", "action", "error", "attempts")


@query("select id, action, case when error is null and action = 'submit' then 'no' else error end as error, attempts + case when error is null and action = 'submit' then 1 else 0 end as attempts from queue")
def park_actions(t: Tables) -> DataFrame:
    errors = reads.pending(t["queue"]).filter("action = 'submit'").select("id", F.lit("no").alias("why"))
    return changes.park(t["queue"], errors).select("id", "action", "error", "attempts")


@query("select id, action from queue where error is null")
def cancel_actions(t: Tables) -> DataFrame:
    return changes.cancel(t["queue"], reads.parked(t["queue"])).select("id", "action")


@query("""select collection, link_id, seq, case when retained_at is null and deleted = 0 then 'k' else sort_key end as sort_key from items""")
def restate_sort_keys(t: Tables) -> DataFrame:
    return changes.patch(t["items"], ~reads.retained() & reads.live(), sort_key=F.lit("k")).select("collection", "link_id", "seq", "sort_key")


@query(None)
def write_batch(t: Tables) -> DataFrame:
    """The items after the right source has lost all it had."""
    b = t["bindings"].filter("source = 'right'")
    null = {c: F.lit(None).cast("string") for c in ("flags", "object_hash", "meta", "sort_key", "base_flags", "base_object", "base_revision")}
    ops = b.select("collection", "link_id", "source", "handle").withColumns({"n": F.lit(1).cast("bigint"), "op": F.lit("drop"), "level": F.lit(0), **null})
    return hub.write_batch(t, ops, NOW)["items"].select("collection", "link_id", "seq", "deleted", "retained_at", "retained_by")


DRAIN = """with said as (
select q.id, q.collection, q.action, case when q.action in ('set-flags', 'remove', 'copy', 'update') then q.action else 'unknown' end as kind,
case when not json_valid(payload) then 'malformed payload' when action = 'update' and json_extract_string(payload, '$.object') is null then 'missing field: object' end as bad,
case when json_valid(payload) then cast(json_extract(payload, '$.seq') as bigint) end as seq, case when json_valid(payload) then json_extract_string(payload, '$.object') end as body
from queue q where q.error is null),
found as (select s.*, i.link_id, i.deleted as was, i.flags, i.object_hash, coalesce(i.link_id, concat('#', cast(s.id as varchar))) as grp
from said s left join items i on i.collection = s.collection and i.seq = s.seq and i.retained_at is null),
lived as (select *, coalesce(last_value(case when bad is null and link_id is not null and kind = 'remove' then false end ignore nulls)
over (partition by collection, grp order by id rows between unbounded preceding and 1 preceding), was = 0, false) as live from found),
judged as (select *, case when bad is not null then bad when kind in ('set-flags', 'copy', 'update') and not live then concat('unknown seq: ', cast(seq as varchar)) end as error from lived),
done as (select *, case when error is not null then 'parked' when kind = 'unknown' then 'skipped' else 'applied' end as outcome from judged)"""


@query(f"select * from ({DRAIN} select id, collection, link_id, action, outcome, error from done) x")
def drain_outcomes(t: Tables) -> DataFrame:
    return drain.outcomes(t)


@query(f"select * from ({DRAIN} select count(*) filter (where outcome = 'applied') as applied, count(*) filter (where outcome = 'parked') as parked, count(*) filter (where outcome = 'skipped') as skipped from done) x")
def drain_report(t: Tables) -> DataFrame:
    return drain.report(drain.outcomes(t))


@query(f"""select * from ({DRAIN},
last as (select collection, link_id, max(id) filter (where kind = 'set-flags') as f, max(id) filter (where kind = 'update') as u, max(id) filter (where kind = 'remove' and live) as r
from done where outcome = 'applied' and (kind in ('set-flags', 'update') or (kind = 'remove' and live)) group by collection, link_id)
select i.collection, i.link_id, case when l.f is not null then '["$seen"]' else i.flags end as flags, coalesce(u.body, i.object_hash) as object_hash,
case when l.r is not null then 1 else i.deleted end as deleted, l.link_id is not null as pending
from items i left join last l on l.collection = i.collection and l.link_id = i.link_id left join done u on u.id = l.u) x""")
def overlay(t: Tables) -> DataFrame:
    return drain.overlay(t).select("collection", "link_id", "flags", "object_hash", "deleted", "pending")


@query("""select i.collection, i.link_id, case when b.link_id is not null and i.deleted = 1 then 'tombstone' when b.conflicted = 1 then 'conflict'
when b.link_id is not null and coalesce(b.base_flags, b.base_object, b.base_revision) is null then 'created'
when b.link_id is not null and i.flags = coalesce(b.base_flags, '[]') and i.object_hash is not distinct from b.base_object then 'clean' when b.link_id is not null then 'dirty' else 'created' end as status,
b.handle, case when b.conflicted = 1 and i.deleted = 0 then b.conflict_revision end as conflict_revision
from items i left join bindings b on b.collection = i.collection and b.link_id = i.link_id and b.source = 'right'
where i.retained_at is null and (b.link_id is not null or (i.deleted = 0 and i.object_hash is not null))""")
def projection(t: Tables) -> DataFrame:
    return hub.project(t, "right").select("collection", "link_id", "status", "handle", "conflict_revision")


@query(f"""select x.collection, x.seq, x.link_id, x.object_hash, o.size from (select * from items where retained_at is not null) x left join objects o on o.hash = x.object_hash""")
def retained_sizes(t: Tables) -> DataFrame:
    return reads.sized(t["items"].filter(reads.retained()), t["objects"]).select("collection", "seq", "link_id", "object_hash", "size")


@query("select link_id, max_by(object_hash, collection) as object_hash from items where object_hash is not null and link_id in (select link_id from items where retained_at is not null) group by link_id")
def lookup_objects_json(t: Tables) -> DataFrame:
    """Links given as JSON lists, one for each collection's trash."""
    lists = t["items"].filter(reads.retained()).groupBy("collection").agg(F.to_json(F.collect_list("link_id")).alias("ids"))
    return reads.lookup_objects(t["items"], reads.json_ids(lists, "ids"))


@query(f"select i.collection, {ITEM}, retained_at from items i where retained_at is not null and exists (select 1 from queue q where q.collection = i.collection and q.id = i.seq)")
def retained_item(t: Tables) -> DataFrame:
    return reads.retained_items(t["items"], t["queue"].select("collection", F.col("id").alias("seq")))


def _batch(t: Tables) -> dict[str, DataFrame]:
    """The tables after a batch that brings back all of the trash, restates all live items of full level, adds an item for each orphan
    body, and drops all of the right source."""
    null = F.lit(None).cast("string")
    shared = {"n": F.lit(1).cast("bigint"), "base_revision": null}
    content = ["collection", "link_id", "object_hash", "meta", "sort_key", "level"]
    old = t["items"].filter(reads.retained() | (reads.live() & (F.col("level") == 2)))
    up = old.select(*content, F.when(reads.retained(), '["$back"]').otherwise('["$seen"]').alias("flags"), F.concat(F.lit("R"), F.col("seq").cast("string")).alias("handle"), F.lit(7).cast("bigint").alias("size"))
    new = t["blobs"].filter("hash like 'orphan-%'").select(F.lit("zz/new").alias("collection"), F.concat(F.lit("new:"), "hash").alias("link_id"), F.col("hash").alias("object_hash"), null.alias("meta"), F.lit("").alias("sort_key"), F.lit(2).alias("level"), F.lit("[]").alias("flags"), F.lit("N").alias("handle"), "size")
    ups = up.unionByName(new).withColumns({"op": F.lit("upsert"), "source": F.lit("left"), "base_flags": F.col("flags"), "base_object": F.col("object_hash"), **shared})
    drops = t["bindings"].filter("source = 'right'").select("collection", "link_id", "source", "handle")
    drops = drops.withColumns({"op": F.lit("drop"), "level": F.lit(0), "size": F.lit(None).cast("bigint"), **{c: null for c in ("flags", "object_hash", "meta", "sort_key", "base_flags", "base_object")}, **shared})
    return hub.write_batch(t, ups.unionByName(drops), NOW)


BATCH = """with up as (select * from items where retained_at is not null or (deleted = 0 and level = 2)),
lefts as (select collection, link_id from bindings where source = 'left' union select collection, link_id from up),
rights as (select collection, link_id from bindings where source = 'right'),
fresh as (select hash, size, row_number() over (order by concat('new:', hash)) as n from blobs where hash like 'orphan-%'),
new_items as (
select i.collection, i.link_id, i.seq, case when u.link_id is null then i.flags when i.retained_at is not null then '["$back"]' else '["$seen"]' end as flags, i.object_hash, i.level,
case when u.link_id is not null then 0 when r.link_id is not null then 1 else i.deleted end as deleted,
case when u.link_id is null and r.link_id is not null and l.link_id is null and i.retained_at is null then 'NOW' when u.link_id is null then i.retained_at end as retained_at,
case when u.link_id is null and r.link_id is not null and l.link_id is null and i.retained_at is null then 'right' when u.link_id is null then i.retained_by end as retained_by
from items i left join up u on u.collection = i.collection and u.link_id = i.link_id left join rights r on r.collection = i.collection and r.link_id = i.link_id left join lefts l on l.collection = i.collection and l.link_id = i.link_id
union all select 'zz/new', concat('new:', hash), (select next_seq from meta) + n - 1, '[]', hash, 2, 0, null, null from fresh),
new_bindings as (
select b.collection, b.link_id, b.source, case when u.link_id is null then b.handle else concat('R', cast(u.seq as varchar)) end as handle, case when u.link_id is null then b.base_flags else '["$seen"]' end as base_flags,
case when u.link_id is null then b.base_object else u.object_hash end as base_object, case when u.link_id is null then b.conflicted else 0 end as conflicted
from bindings b left join up u on u.collection = b.collection and u.link_id = b.link_id where b.source = 'left'
union all select u.collection, u.link_id, 'left', concat('R', cast(u.seq as varchar)), case when u.retained_at is not null then '["$back"]' else '["$seen"]' end, u.object_hash, 0
from up u where not exists (select 1 from bindings b where b.source = 'left' and b.collection = u.collection and b.link_id = u.link_id)
union all select 'zz/new', concat('new:', hash), 'left', 'N', '[]', hash, 0 from fresh),
counted as (select hash, cast(sum(d) as bigint) as d from (
select object_hash as hash, -1 as d from items union all select conflict_object, -1 from items union all select base_object, -1 from bindings
union all select object_hash, 1 from new_items union all select conflict_object, 1 from items union all select base_object, 1 from new_bindings) x where hash is not null group by hash),
bodies as (select object_hash as hash, 7 as size from up where object_hash is not null union select hash, size from fresh),
new_objects as (select coalesce(o.hash, b.hash) as hash, coalesce(b.size, o.size) as size, coalesce(o.refcount, 0) + coalesce(c.d, 0) as refcount
from objects o full outer join bodies b on b.hash = o.hash left join counted c on c.hash = coalesce(o.hash, b.hash))""".replace("NOW", NOW)


@query(f"select * from ({BATCH} select * from new_items) x")
def write_items(t: Tables) -> DataFrame:
    return _batch(t)["items"].select("collection", "link_id", "seq", "flags", "object_hash", "level", "deleted", "retained_at", "retained_by")


@query(f"select * from ({BATCH} select * from new_bindings) x")
def write_bindings(t: Tables) -> DataFrame:
    return _batch(t)["bindings"].select("collection", "link_id", "source", "handle", "base_flags", "base_object", "conflicted")


@query(f"select * from ({BATCH} select hash, size, refcount from new_objects where refcount <> 0) x")
def write_objects(t: Tables) -> DataFrame:
    return _batch(t)["objects"].select("hash", "size", "refcount")


@query(f"select * from ({BATCH} select (select max(seq) + 1 from new_items) as next_seq, (select count(*) from collections) + 1 as collections) x")
def write_counters(t: Tables) -> DataFrame:
    after = _batch(t)
    return after["meta"].select("next_seq").crossJoin(after["collections"].agg(F.count("*").alias("collections")))


FOUND["write_batch"] = (
    write_batch,
    f"""select i.collection, i.link_id, i.seq, case when r.link_id is not null then 1 else i.deleted end as deleted,
case when r.link_id is not null and l.link_id is null then '{NOW}' else i.retained_at end as retained_at, case when r.link_id is not null and l.link_id is null then 'right' else i.retained_by end as retained_by
from items i left join (select collection, link_id from bindings where source = 'right') r on r.collection = i.collection and r.link_id = i.link_id
left join (select collection, link_id from bindings where source = 'left') l on l.collection = i.collection and l.link_id = i.link_id""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(tables(spark, sf_dir)) for name, (f, _) in FOUND.items()}


def oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in FOUND.items() if sql}
