"""The queue's pass over the store: each pending action is applied once, parked, or left.

Everything is decided in the JVM. Actions on one item depend on their order, those on different items don't: one window over the
actions of a (collection, link) in the order of ids says, before each action, whether the item is live and what it holds. A
remove or a move leaves it dead and an add leaves it live whatever it was before, so liveness is the last of these, and each
field is what the last action that set it said: a window of running values does, no fold. Adds to and copies into other
collections come back as effects and are applied as one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.operators import changes
from satchel.operators.reads import live, pending, retained
from satchel.sources import session

KEYS = ["collection", "link_id"]
CONTENT = ["flags", "object_hash", "meta", "level", "deleted"]


def resolve(tables: dict[str, DataFrame]) -> DataFrame:
    """Pending actions with their payload and the item that they mean: a live one by its number, any by its link for an add."""
    p = C.payload_decode(F.col("action"), F.col("payload"))
    rows = pending(tables["queue"]).select("id", "collection", "action", "payload", p.alias("p"), C.payload_flags(F.col("payload")).alias("new_flags"), C.payload_meta(F.col("payload")).alias("new_meta"))
    rows = rows.select("id", "collection", "action", "new_flags", "new_meta", F.col("p.kind").alias("kind"), F.col("p.seq").alias("seq"), F.col("p.to").alias("to"), F.col("p.object").alias("body"), F.col("p.error").alias("bad"), F.col("p.link_id").alias("link"), F.col("p.handle").alias("handle"))
    items = tables["items"].filter(~retained())
    own = items.select("collection", "seq", F.col("link_id").alias("own_link"), F.struct(*CONTENT).alias("now"))
    by_seq = rows.filter("kind <> 'add'").join(own.withColumn("named", F.lit(True)), ["collection", "seq"], "left")
    by_link = rows.filter("kind = 'add'").withColumn("own_link", F.coalesce("link", "body")).join(own.drop("seq"), ["collection", "own_link"], "left")
    return by_seq.unionByName(by_link, allowMissingColumns=True).withColumnRenamed("own_link", "link_id").drop("link", "named")


def _last(value: Column, when: Column, window) -> Column:
    """The value at the last row of the window where `when` holds, as a struct: null if there is none."""
    return F.last(F.when(when, F.struct(value.alias("x"))), ignorenulls=True).over(window)


def effects(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each pending action: its outcome, the item's content before and after it, whether it changes the item, and where a
    copy of it goes."""
    # what resolves to no item stands alone
    rows = resolve(tables).withColumn("group", F.coalesce("link_id", F.concat(F.lit("#"), F.col("id").cast("string"))))
    order = Window.partitionBy("collection", "group").orderBy("id")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    kind, good = F.col("kind"), F.col("bad").isNull() & F.col("link_id").isNotNull()
    mark = F.when(good & (kind == "add"), True).when(good & kind.isin("remove", "move"), False)
    rows = rows.withColumn("live", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.col("now.deleted") == 0, F.lit(False)))
    error = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when((kind == "add") & F.col("link_id").isNull(), "no link and no body")
        .when((kind == "add") & F.col("live"), "already present")
        .when(~kind.isin("add", "remove", "unknown") & ~F.col("live"), F.concat(F.lit("unknown seq: "), F.col("seq").cast("string")))
    )
    rows = rows.withColumn("error", error)
    rows = rows.withColumn("outcome", F.when(F.col("error").isNotNull(), "parked").when(kind == "unknown", "skipped").otherwise("applied"))
    done = F.col("outcome") == "applied"
    add, update = done & (kind == "add"), done & (kind == "update")
    gone = done & F.col("live") & kind.isin("remove", "move")
    level = F.when(kind == "update", 2).when(F.col("body").isNotNull(), 2).when(F.col("new_meta").isNotNull(), 1).otherwise(0)
    said = {
        "flags": (F.col("new_flags"), add | (done & (kind == "set-flags"))),
        "object_hash": (F.col("body"), add | update),
        "meta": (F.col("new_meta"), add | (update & F.col("new_meta").isNotNull())),
        "level": (level, add | update),
        "deleted": (F.when(kind == "add", 0).otherwise(1), add | gone),
    }
    state = F.struct(*(F.coalesce(_last(v, w, upto), F.struct(F.col(f"now.{c}").alias("x")))["x"].alias(c) for c, (v, w) in said.items()))
    earlier = F.struct(*(F.coalesce(_last(v, w, before), F.struct(F.col(f"now.{c}").alias("x")))["x"].alias(c) for c, (v, w) in said.items()))
    changes_ = add | update | gone | (done & (kind == "set-flags"))
    target = F.when(done & kind.isin("move", "copy"), F.col("to"))
    return rows.select("id", *KEYS, "action", "outcome", "error", "handle", add.alias("added"), changes_.alias("touches"), target.alias("target"), state.alias("state"), earlier.alias("earlier"))


def outcomes(tables: dict[str, DataFrame], source: str = "left") -> DataFrame:
    return effects(tables).select("id", *KEYS, "action", "outcome", "error")


def report(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "parked", "skipped")))


def final_states(found: DataFrame) -> DataFrame:
    """(collection, link_id, content, last): each changed item's content after the pass, and the last action that changed it."""
    return found.filter("touches").groupBy(*KEYS).agg(F.max_by("state", "id").alias("s"), F.max("id").alias("last")).select(*KEYS, "s.*", "last")


def overlay(tables: dict[str, DataFrame], source: str = "left") -> DataFrame:
    """Items as they will be after what is pending: what a frontend shows to its own writer. Retained items stay as they are."""
    states = final_states(effects(tables)).drop("last").select(*KEYS, F.struct(*CONTENT).alias("__new"))
    joined = tables["items"].join(states, KEYS, "full_outer")
    hit = F.col("__new").isNotNull()
    return joined.select(*KEYS, "seq", *(F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in CONTENT), hit.alias("pending"))


def pending_decoded(queue: DataFrame, collection: str) -> DataFrame:
    """A collection's pending actions with their decoded payloads, in order; a payload that can't be decoded is an error."""
    rows = pending(queue).filter(F.col("collection") == collection)
    p = C.payload_decode(F.col("action"), F.col("payload"))
    ok = F.when(p["error"].isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("action "), F.col("id").cast("string"), F.lit(": "), p["error"])))
    return rows.select("id", "created_at", "producer", "action", p.alias("p"), "attempts", ok.alias("error")).select("id", "created_at", "producer", "action", "p.kind", "p.seq", "p.to", "p.object", "p.link_id", "attempts", "error").orderBy("id")


def drain(tables: dict[str, DataFrame], source: str, broken: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a pass, and the outcome of each action. Applied rows leave the queue with their pins; parked ones stay with
    the reason and one attempt more; unknown kinds stay as they are. Bodies without references go.

    broken: (id) of actions that fail for the time being, as a lost connection makes them fail: such a one stays pending with one
    attempt more and ends its collection's pass, so what comes after it stays as it is. Copies of one item into one collection:
    the last one counts; a copy onto a live item changes nothing."""
    from satchel.operators.checks import adjust, collect, references, refcount_delta

    after, found = drain_rows(tables, source, broken)
    count = lambda t: references(t["items"], t["bindings"], t["queue"]).withColumnRenamed("expected", "n")
    return after | {"objects": collect(adjust(tables["objects"], refcount_delta(count(tables), count(after))))}, found


def reach(queue: DataFrame) -> DataFrame:
    """(collection) of all collections that a pass may change: those with pending actions, and the targets of these."""
    rows = pending(queue)
    to = rows.filter(F.col("action").isin("move", "copy")).select(C.typed(F.col("payload"), "to", "string").alias("collection")).filter("collection is not null")
    return rows.select("collection").unionByName(to)


def drain_rows(tables: dict[str, DataFrame], source: str, broken: DataFrame | None = None, links: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """drain without the objects. links: (link_id, seq) of all items, where tables holds those of some collections alone."""
    queue = tables["queue"]
    reached = tables
    if broken is not None:
        stop = pending(queue).join(broken.select("id").distinct(), "id", "left_semi").groupBy("collection").agg(F.min("id").alias("__stop"))
        rest = queue.join(stop, "collection", "left")
        reached = tables | {"queue": rest.filter("__stop is null or id < __stop").select(queue.columns)}
        queue = changes.patch(rest, F.col("id") == F.col("__stop"), attempts=F.col("attempts") + 1).select(queue.columns)
    found = session.written(effects(reached), "drain")
    queue = changes.park(changes.cancel(queue, found.filter("outcome = 'applied'")), found.filter("outcome = 'parked'").select("id", F.col("error").alias("why")))
    items = tables["items"]
    states = final_states(found)
    copies = found.filter("target is not null").groupBy(F.col("target").alias("collection"), "link_id").agg(F.max_by("earlier", "id").alias("s"), F.max("id").alias("last")).select(*KEYS, "s.*", "last").withColumn("deleted", F.lit(0))
    # onto a live item only if this pass has removed it before
    blocked = items.filter(live()).select(KEYS).join(states.filter("deleted = 1").select(KEYS), KEYS, "left_anti").unionByName(states.filter("deleted = 0").select(KEYS)).distinct()
    copies = copies.join(blocked, KEYS, "left_anti")
    both = states.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))
    every = session.written(both.groupBy(*KEYS).agg(F.max_by(F.struct(*CONTENT, "copied"), "last").alias("__new"), F.max("last").alias("__last")), "states")
    fresh = changes.allocate_seq(every.select(KEYS).join(items.select(KEYS), KEYS, "left_anti"), items if links is None else links, tables["meta"].first().next_seq).select(*KEYS, F.col("seq").alias("__seq"))
    hit = F.col("__new").isNotNull()
    back = hit & (F.col("__new.deleted") == 0)
    joined = items.join(every.drop("__last"), KEYS, "full_outer").join(fresh, KEYS, "left")
    own = {"seq": F.coalesce("seq", "__seq"), **{c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in CONTENT}, "sort_key": F.coalesce("sort_key", F.lit("")), "conflicted": F.coalesce("conflicted", F.lit(0)), "retained_at": F.when(~back, F.col("retained_at")), "retained_by": F.when(~back, F.col("retained_by"))}
    new_items = joined.select(*((own[c].alias(c) if c in own else F.col(c)) for c in items.columns))
    # what is added or copied is bound to the source under a handle to be replaced, without a base: it has still to be pushed
    handle = lambda given, n: F.coalesce(given, F.concat(F.lit("queue-"), n.cast("string")))
    added = found.filter("added").groupBy(*KEYS).agg(F.max_by(handle(F.col("handle"), F.col("id")), "id").alias("handle"))
    put = every.filter("__new.copied").select(*KEYS, handle(F.lit(None).cast("string"), F.col("__last")).alias("handle"))
    null = {c: F.lit(None).cast("string") for c in ("base_flags", "base_object", "base_revision", "conflict_revision")}
    bind = put.unionByName(added.join(put.select(KEYS), KEYS, "left_anti")).withColumns({"source": F.lit(source), "conflicted": F.lit(0), **null})
    bindings = changes.upsert(tables["bindings"], bind, [*KEYS, "source"], ["handle", "conflicted", *null])
    co = changes.ensure_collections(tables["collections"], put.select(F.col("collection").alias("id")))
    meta = tables["meta"].crossJoin(new_items.agg((F.max("seq") + 1).alias("__m"))).withColumn("next_seq", F.greatest("next_seq", "__m")).select(tables["meta"].columns)
    return tables | {"queue": queue, "items": new_items, "bindings": bindings, "collections": co, "meta": meta}, found.select("id", *KEYS, "action", "outcome", "error")
