import json

import pytest
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.operators import changes, checks, drain, hub, reads
from satchel.plans import catalog
from satchel.plans.store import SCHEMAS
from satchel.sources import session

NOW = "2026-06-01T00:00:00.000Z"
OPS = "n bigint, op string, collection string, link_id string, source string, handle string, flags string, object_hash string, size bigint, meta string, sort_key string, level int, base_flags string, base_object string, base_revision string"


def item(collection, link, seq, **more):
    base = dict(collection=collection, link_id=link, seq=seq, flags="[]", object_hash=None, meta=None, sort_key="", level=0, deleted=0, retained_at=None, retained_by=None, conflicted=0, conflict_object=None)
    return base | more


def table(spark, name, rows=()):
    names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[name])


def store(spark, items=(), bindings=(), objects=(), queue=(), next_seq=None):
    seq = next_seq or max([i["seq"] for i in items], default=0) + 1
    return {
        "items": table(spark, "items", items),
        "bindings": table(spark, "bindings", [dict(base_flags="[]", conflicted=0) | b for b in bindings]),
        "objects": table(spark, "objects", objects),
        "queue": table(spark, "queue", [dict(created_at="t", producer="p", attempts=0) | q for q in queue]),
        "collections": table(spark, "collections", [dict(id=c, kind="", name=c, conflict="manual", generation=1) for c in {i["collection"] for i in items}]),
        "meta": spark.createDataFrame([(1, "satchel", 1, "sha256", seq)], SCHEMAS["meta"]),
    }


def op(n, kind, collection, link, source, **more):
    base = dict(n=n, op=kind, collection=collection, link_id=link, source=source, handle="h", flags="[]", object_hash=None, size=None, meta=None, sort_key="", level=1, base_flags="[]", base_object=None, base_revision=None)
    names = [c.split()[0] for c in OPS.split(", ")]
    return tuple((base | more)[k] for k in names)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def saved(t):
    """Tables as they are after a commit."""
    return {k: session.written(v, k) for k, v in t.items()}


def decoded(spark, flags):
    df = spark.createDataFrame([(f,) for f in flags], "f string")
    return [r.x for r in df.select(C.flags_decode(F.col("f")).alias("x")).collect()]


def test_flags(spark):
    assert decoded(spark, ['["b","a","b"]', "[]", None, "nope", '[1,"a"]', '["a",null]', "{}"]) == [["a", "b"], [], [], [], [], [], []]


def test_payload_typing(spark):
    cases = [
        ("remove", '{"v":1,"seq":4}', None), ("remove", '{"v":1.0,"seq":4}', "unsupported version"), ("remove", '{"v":"1","seq":4}', "unsupported version"),
        ("remove", '{"v":2,"seq":4}', "unsupported version"), ("remove", '{"seq":4}', "unsupported version"), ("remove", '{"v":1}', "missing field: seq"),
        ("remove", "nope", "malformed payload"), ("remove", "[1]", "malformed payload"), ("remove", None, "malformed payload"),
        ("move", '{"v":1,"seq":4}', "missing field: to"), ("update", '{"v":1,"seq":4,"object":7}', "missing field: object"), ("submit", "nope", "malformed payload"), ("submit", '{"v":1}', None), ("add", '{"v":1,"link_id":3}', "missing field: link_id"), ("add", '{"v":1,"handle":null}', "missing field: handle"),
    ]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(cases)], "i int, a string, p string")
    got = df.select("i", C.payload_decode(F.col("a"), F.col("p"))["error"].alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, _, e in cases]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_cover_ties(spark, order):
    t = store(spark, [item("c", f"l{i}", i, sort_key=k) for i, k in enumerate(["", "b", "b", "b", "z"], 1)])
    seen, after = [], None
    while page := reads.page(t["items"], "c", order, after, 2).collect():
        seen += [r.seq for r in page]
        after = (page[-1].sort_key, page[-1].seq)
    assert seen == ([1, 2, 3, 4, 5] if order == "asc" else [5, 4, 3, 2, 1])


def test_null_account_and_unknown_collection(spark):
    co = changes.ensure_collections(table(spark, "collections"), spark.createDataFrame([("a",), ("b",)], "id string"))
    co = changes.set_account(co, "a", "me")
    assert [r.id for r in reads.collections_by_account(co, None).collect()] == ["b"]
    assert reads.setting(co, "b", "account").collect()[0][0] is None
    assert reads.setting(co, "zz", "account").collect() == []


def test_cutoff_is_strict_and_textual(spark):
    stamps = ["2026-05-31T00:00:00.000Z", NOW, "2026-06-02T00:00:00.000Z", "2026-06-01T00:00:00Z"]
    t = store(spark, [item("c", f"l{i}", i, deleted=1, retained_at=s, retained_by="left") for i, s in enumerate(stamps, 1)] + [item("c", "x", 9)])
    assert rows(changes.purge_before(t["items"], NOW), "seq") == [(2,), (3,), (4,), (9,)]
    assert rows(changes.purge_one(t["items"], "c", 9), "seq") == [(1,), (2,), (3,), (4,), (9,)]


def test_purge_by_numbers_needs_no_collections(spark):
    gone = dict(deleted=1, retained_at=NOW, retained_by="left")
    parked = [dict(id=i, collection="c", action="submit", error="no") for i in (1, 2, 9)] + [dict(id=3, collection="c", action="submit")]
    t = store(spark, [item("c", "a", 1, **gone), item("d", "a", 1, **gone), item("c", "b", 2), item("d", "b", 2, **gone), item("c", "p", 3, **gone), item("e", "q", 4, **gone)], queue=parked)
    left = [("c", 2), ("c", 3), ("e", 4)]
    assert rows(catalog.purge_one(t), "collection", "seq") == left
    assert rows(catalog.purge_one(t | {"collections": table(spark, "collections")}), "collection", "seq") == left
    plan = catalog.purge_one(t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # collections times actions grows faster than either


def test_purge_of_one_collection_leaves_the_others(spark):
    gone = dict(deleted=1, retained_at=NOW, retained_by="left")
    t = store(spark, [item("c", "a", 1, **gone), item("d", "a", 1, **gone), item("c", "b", 2), item("c", "e", 3, **gone)])
    which = spark.createDataFrame([("c", 1), ("c", 1), ("c", 2), ("zz", 3)], "collection string, seq bigint")
    after = changes.purge_each(t["items"], which)
    assert after.columns == t["items"].columns
    assert rows(after, "collection", "seq") == [("c", 2), ("c", 3), ("d", 1)]


def test_shared_body_survives_until_its_last_holder(spark):
    gone = dict(deleted=1, retained_at="2026-01-01T00:00:00.000Z", retained_by="left")
    t = store(spark, [item("c", "a", 1, object_hash="h", **gone), item("d", "a", 1, object_hash="h")], objects=[dict(hash="h", size=7, refcount=2)])
    none = spark.createDataFrame([], "hash string")
    after = changes.purge_before(t["items"], NOW)
    assert rows(changes.purge_report(t["items"], after, t["objects"], none), "items", "bytes") == [(1, 0)]
    last = after.filter("seq <> 1")
    assert rows(changes.purge_report(t["items"], last, t["objects"], none), "items", "bytes") == [(2, 7)]


def test_write_batch_life_cycle(spark):
    t = store(spark)
    t = saved(hub.write_batch(t, spark.createDataFrame([op(1, "upsert", "c", "a", "left", object_hash="h", size=5, base_object="h"), op(2, "upsert", "c", "a", "right", object_hash="h", size=5, base_object="h"), op(3, "upsert", "d", "a", "left")], OPS), NOW))
    assert rows(t["items"], "collection", "seq", "deleted") == [("c", 1, 0), ("d", 1, 0)]
    assert rows(t["objects"], "hash", "refcount") == [("h", 3)]
    t = saved(hub.write_batch(t, spark.createDataFrame([op(1, "drop", "c", "a", "left")], OPS), NOW))
    assert rows(t["items"].filter("collection = 'c'"), "deleted", "retained_at") == [(1, None)]
    t = saved(hub.write_batch(t, spark.createDataFrame([op(1, "drop", "c", "a", "right")], OPS), NOW))
    assert rows(t["items"].filter("collection = 'c'"), "deleted", "retained_at", "retained_by") == [(1, NOW, "right")]
    assert rows(t["objects"], "hash", "refcount") == [("h", 1)]
    t = saved(hub.write_batch(t, spark.createDataFrame([op(1, "upsert", "c", "a", "left", flags='["x"]'), op(2, "upsert", "c", "b", "left")], OPS), NOW))
    assert rows(t["items"].filter("collection = 'c'"), "link_id", "seq", "flags", "deleted", "retained_at") == [("a", 1, '["x"]', 0, None), ("b", 2, "[]", 0, None)]
    assert t["objects"].count() == 0
    assert checks.refcount_drift(t["objects"], t["items"], t["bindings"], t["queue"]).count() == 0


def test_sort_key_alone_is_no_change(spark):
    t = store(spark, [item("c", "a", 1, sort_key="k", level=1)], [dict(collection="c", link_id="a", source="left", handle="h")])
    after = hub.write_batch(t, spark.createDataFrame([op(1, "upsert", "c", "a", "left", sort_key="other")], OPS), NOW)
    assert rows(after["items"], "sort_key") == [("k",)]
    assert hub.diff(t["items"], t["items"].withColumn("sort_key", F.lit("x"))).count() == 0


def test_rename_cascades_and_refuses_a_clash(spark):
    t = store(spark, [item("c", "a", 1), item("d", "b", 2)], [dict(collection="c", link_id="a", source="left", handle="h")])
    after = changes.rename_collection(t, "c", "e")
    assert rows(after["items"], "collection") == [("d",), ("e",)]
    assert rows(after["bindings"], "collection") == [("e",)]
    with pytest.raises(ValueError):
        changes.rename_collection(t, "c", "d")


def queue(*actions):
    return [dict(id=i, collection="c", action=a, payload=p, object_hash=h) for i, (a, p, h) in enumerate(actions, 1)]


def test_drain(spark):
    actions = queue(
        ("set-flags", '{"v":1,"seq":1,"flags":["$seen"]}', None), ("move", '{"v":1,"seq":1,"to":"d"}', None), ("update", '{"v":1,"seq":2,"object":"new"}', "new"), ("set-flags", '{"v":1,"seq":9,"flags":[]}', None),
        ("remove", '{"v":1,"seq":9}', None), ("submit", '{"v":1}', None), ("remove", "nope", None), ("add", '{"v":1,"link_id":"z","object":"h3"}', "h3"), ("add", '{"v":1,"link_id":"b"}', None), ("remove", '{"v":1,"seq":5}', None), ("set-flags", '{"v":1,"seq":5,"flags":[]}', None),
        ("add", '{"v":1,"link_id":"t","flags":["f"]}', None),
    )
    objects = [dict(hash=h, size=1, refcount=n) for h, n in (("h1", 1), ("h2", 1), ("new", 1), ("h3", 1))]
    items = [item("c", "a", 1, object_hash="h1", level=2), item("c", "b", 2, object_hash="h2", level=2), item("c", "t", 5, deleted=1, retained_at=NOW, retained_by="left")]
    t = store(spark, items, [dict(collection="c", link_id="a", source="left", handle="1")], objects, actions)
    after, done = drain.drain(t, "left")
    after = saved(after)
    got = {r.id: (r.outcome, r.error) for r in done.collect()}
    assert got == {
        1: ("applied", None), 2: ("applied", None), 3: ("applied", None), 4: ("parked", "unknown seq: 9"), 5: ("applied", None), 6: ("skipped", None), 7: ("parked", "malformed payload"),
        8: ("applied", None), 9: ("parked", "already present"), 10: ("applied", None), 11: ("parked", "unknown seq: 5"), 12: ("applied", None),
    }
    assert rows(after["items"], "collection", "link_id", "seq", "flags", "object_hash", "level", "deleted", "retained_at") == [
        ("c", "a", 1, '["$seen"]', "h1", 2, 1, None), ("c", "b", 2, "[]", "new", 2, 0, None), ("c", "t", 5, '["f"]', None, 0, 0, None), ("c", "z", 6, "[]", "h3", 2, 0, None), ("d", "a", 1, '["$seen"]', "h1", 2, 0, None),
    ]
    assert rows(after["queue"], "id", "attempts") == [(11, 1), (4, 1), (6, 0), (7, 1), (9, 1)]
    assert rows(after["objects"], "hash", "refcount") == [("h1", 2), ("h3", 1), ("new", 1)]
    assert rows(after["collections"], "id") == [("c",), ("d",)]
    again, done = drain.drain(after, "left")
    assert [(r.id, r.outcome) for r in done.collect()] == [(6, "skipped")]


def test_fail_and_park(spark):
    t = store(spark, queue=queue(("remove", "{}", None)))
    q = changes.fail(changes.fail(t["queue"], 1, "later", False), 7, "unknown", True)
    assert rows(q, "attempts", "error") == [(1, None)]
    assert rows(changes.fail(q, 1, "no", True), "attempts", "error") == [(2, "no")]


def seq(action, n, **more):
    return (action, json.dumps({"v": 1, "seq": n, **more}), more.get("object"))


def test_what_is_gone_cannot_be_addressed(spark):
    items = [item("c", "a", 1, object_hash="h"), item("c", "b", 2), item("c", "s", 3, deleted=1), item("c", "d", 4)]
    actions = queue(seq("remove", 1), seq("set-flags", 1, flags=["x"]), seq("move", 2, to="d"), seq("move", 2, to="e"), seq("set-flags", 3), seq("remove", 3), seq("copy", 4, to="d"), seq("set-flags", 4, flags=["late"]), seq("copy", 4, to="d"), ("add", '{"v":1,"link_id":"s","handle":"mine"}', None), seq("set-flags", 3, flags=["back"]))
    t = store(spark, items, [dict(collection="c", link_id="s", source="left", handle="old", base_flags="[]")], [dict(hash="h", size=1, refcount=1)], actions)
    after, done = drain.drain(t, "left")
    after = saved(after)
    assert {r.id: r.error for r in done.collect()} == {1: None, 2: "unknown seq: 1", 3: None, 4: "unknown seq: 2", 5: "unknown seq: 3", 6: None, 7: None, 8: None, 9: None, 10: None, 11: None}
    assert rows(after["items"], "collection", "seq", "flags", "deleted") == [("c", 1, "[]", 1), ("c", 2, "[]", 1), ("c", 3, '["back"]', 0), ("c", 4, '["late"]', 0), ("d", 2, "[]", 0), ("d", 4, '["late"]', 0)]
    assert rows(after["bindings"], "collection", "link_id", "source", "handle", "base_flags") == [("c", "s", "left", "mine", None), ("d", "b", "left", "queue-3", None), ("d", "d", "left", "queue-9", None)]
    assert checks.refcount_drift(after["objects"], after["items"], after["bindings"], after["queue"]).count() == 0


def test_a_passing_failure_ends_a_collections_pass(spark):
    t = store(spark, [item("c", "a", 1), item("c", "b", 2)], queue=queue(seq("set-flags", 1, flags=["x"]), seq("set-flags", 2, flags=["y"]), seq("remove", 1)))
    after, done = drain.drain(t, "left", spark.createDataFrame([(2,)], "id bigint"))
    assert rows(done, "id", "outcome") == [(1, "applied")]
    assert rows(after["queue"], "id", "attempts", "error") == [(2, 1, None), (3, 0, None)]


def test_overlay_and_decoded_queue(spark):
    t = store(spark, [item("c", "a", 1), item("c", "b", 2)], queue=queue(seq("set-flags", 1, flags=["x"]), seq("remove", 2), ("add", '{"v":1,"link_id":"n","meta":{"k":1}}', None)))
    assert rows(drain.overlay(t), "link_id", "flags", "deleted", "level", "pending") == [("a", '["x"]', 0, 0, True), ("b", "[]", 1, 0, True), ("n", "[]", 0, 1, True)]
    assert [r.kind for r in drain.pending_decoded(t["queue"], "c").collect()] == ["set-flags", "remove", "add"]
    bad = store(spark, queue=queue(("remove", "nope", None)))
    with pytest.raises(Exception, match="malformed payload"):
        drain.pending_decoded(bad["queue"], "c").collect()


def test_payload_round_trip(spark):
    given = [('link\\"', '["a"]', "h", '{"k": [1, 2]}', "x"), ("l", "[]", None, 'no "json', None), (None, "[]", "h", None, None), ("l", None, None, "3", None)]
    df = spark.createDataFrame(given, "link string, flags string, body string, meta string, handle string")
    text = C.payload_encode(flags=F.from_json("flags", "array<string>"), body=F.col("body"), link=F.col("link"), meta=F.col("meta"), handle=F.col("handle"))
    p = C.payload_decode(F.lit("add"), F.col("t"))
    got = df.select("*", text.alias("t")).select("*", p.alias("p"), C.payload_flags(F.col("t")).alias("f"), C.payload_meta(F.col("t")).alias("m")).collect()
    for r in got:
        assert (r.p.link_id, r.p.object, r.p.handle, r.p.error) == (r.link, r.body, r.handle, None) and r.f == (r.flags or "[]")
        assert r.m == r.meta or json.loads(r.m) == json.loads(r.meta)
    mixed = spark.createDataFrame([('{"v":1,"flags":["b",1,"a",null]}',), ('{"v":1,"flags":"a"}',)], "t string")
    assert [r.f for r in mixed.select(C.payload_flags(F.col("t")).alias("f")).collect()] == ['["a","b"]', "[]"]


def test_projection_and_conflicts(spark):
    bound = lambda link, source="left", **more: dict(collection="c", link_id=link, source=source, handle="h", base_flags=None) | more
    items = [item("c", "clean", 1, flags='["x"]', object_hash="h"), item("c", "dirty", 2, flags='["y"]'), item("c", "made", 3), item("c", "other", 4, object_hash="h"), item("c", "bare", 5), item("c", "stone", 6, deleted=1), item("c", "kept", 7, deleted=1, retained_at=NOW), item("c", "split", 8)]
    bindings = [bound("clean", base_flags='["x"]', base_object="h"), bound("dirty", base_flags="[]"), bound("made"), bound("other", "right"), bound("bare", "right"), bound("stone", base_flags="[]"), bound("split", base_flags="[]", conflicted=1, conflict_revision="r9")]
    t = store(spark, items, bindings)
    got = {r.link_id: (r.status, r.handle, r.conflict_revision) for r in hub.project(t, "left").collect()}
    assert got == {"clean": ("clean", "h", None), "dirty": ("dirty", "h", None), "made": ("created", "h", None), "other": ("created", None, None), "stone": ("tombstone", "h", None), "split": ("conflict", "h", "r9")}
    # a conflict is written with its revision, and a later write without one clears it
    ops = spark.createDataFrame([op(1, "upsert", "c", "dirty", "left", flags='["z"]')], OPS).withColumn("conflict_revision", F.lit("r1"))
    t = saved(hub.write_batch(t, ops, NOW))
    one = t["bindings"].filter("link_id = 'dirty'")
    assert rows(one, "conflicted", "conflict_revision") == [(1, "r1")]
    t = hub.write_batch(t, spark.createDataFrame([op(1, "upsert", "c", "dirty", "left", flags='["z"]')], OPS), NOW, account="me")
    assert rows(t["bindings"].filter("link_id = 'dirty'"), "conflicted", "conflict_revision") == [(0, None)]


def test_write_batch_makes_collections_in_the_account(spark):
    t = hub.write_batch(store(spark), spark.createDataFrame([op(1, "upsert", "new", "a", "left")], OPS), NOW, account="me")
    assert rows(t["collections"], "id", "account") == [("new", "me")]


def test_lookup_by_json_lists(spark):
    t = store(spark, [item("c", "a", 1, object_hash="h1"), item("d", "a", 1, object_hash="h2"), item("c", "b", 2, object_hash="h3"), item("c", "n", 3)])
    ids = spark.createDataFrame([('["a","n"]',), ('["zz"]',), (None,)], "ids string")
    assert rows(reads.lookup_objects(t["items"], reads.json_ids(ids, "ids")), "link_id", "object_hash") == [("a", "h2")]


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k int").repartition(7)
    assert rows(changes.numbered(df, ["k"], 5, "n").filter(F.col("n") != F.col("k") + 5), "k") == []
    assert changes.numbered(df.limit(0), ["k"], 5, "n").count() == 0
