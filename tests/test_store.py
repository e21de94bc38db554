import datetime as dt
import json

import pytest

from satchel import cli
from satchel.operators import checks, export
from satchel.plans import store as S
from satchel.plans.catalog import tables
from satchel.sources import blobs
from satchel.streaming import queue_stream
from tests.test_operators import NOW, OPS, op, rows

DATA = "/root/testdata/sf0.001"
ACTION = "created_at string, collection string, action string, payload string, object_hash string"


def test_roles_and_versions(spark, tmp_path):
    folder = f"{tmp_path}/s"
    with pytest.raises(S.StoreError):
        S.Reader(spark, folder)
    with pytest.raises(S.StoreError):
        S.Producer(spark, folder, "p")
    S.Owner(spark, folder)
    assert S.Reader(spark, folder).tables()["items"].count() == 0
    manifest = tmp_path / "s" / "manifest-0.json"
    (tmp_path / "s" / ".manifest-0.json.crc").unlink(missing_ok=True)
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"version": 2}))
    with pytest.raises(S.StoreError):
        S.Reader(spark, folder)


def test_second_writer_is_busy(spark, tmp_path):
    a, b = S.Owner(spark, f"{tmp_path}/s"), S.Owner(spark, f"{tmp_path}/s")
    a.commit(a.tables(), ["meta"])
    with pytest.raises(S.Busy):
        b.commit(b.tables(), ["meta"])


def test_write_drain_and_unlink(spark, tmp_path):
    folder = f"{tmp_path}/s"
    o = S.Owner(spark, folder)
    assert blobs.put(spark, f"{folder}/objects", "abcdef", b"body") == 4
    assert blobs.put(spark, f"{folder}/objects", "abcdef", b"other") == 0
    o.write(spark.createDataFrame([op(1, "upsert", "c", "a", "left", object_hash="abcdef", size=4)], OPS), NOW, rekey="c")
    assert blobs.get(spark, f"{folder}/objects", "abcdef") == b"body"
    assert rows(o.tables()["collections"], "id", "generation") == [("c", 2)]
    p = S.Producer(spark, folder, "p")
    p.enqueue(spark.createDataFrame([("1", "c", "set-flags", '{"v":1,"seq":1,"flags":["x"]}', None), ("2", "c", "remove", '{"v":1,"seq":8}', None)], ACTION))
    queue_stream.start(spark, folder, f"{tmp_path}/cp").awaitTermination()
    now = S.Reader(spark, folder).tables()
    assert rows(now["items"], "seq", "flags") == [(1, '["x"]')]
    assert now["queue"].count() == 0
    queue_stream.start(spark, folder, f"{tmp_path}/cp2").awaitTermination()  # the same files again: nothing is applied twice
    assert S.Reader(spark, folder).tables()["queue"].count() == 0
    o = S.Owner(spark, folder)
    o.write(spark.createDataFrame([op(1, "drop", "c", "a", "left")], OPS), NOW)
    assert blobs.get(spark, f"{folder}/objects", "abcdef") == b"body"
    report = o.purge_before("2027")
    assert rows(report, "items", "bytes") == [(1, 4)]
    assert blobs.get(spark, f"{folder}/objects", "abcdef") is None


def test_export_and_commands(spark, tmp_path, capsys):
    folder = f"{tmp_path}/s"
    t = tables(spark, DATA)
    S.import_tables(spark, folder, t)
    some = t["items"].filter("object_hash is not null and deleted = 0").first().object_hash
    blobs.put(spark, f"{folder}/objects", some, iter([b"a" * 1000, b"b" * 7]))
    assert b"".join(blobs.stream(spark, f"{folder}/objects", some, 100)) == b"a" * 1000 + b"b" * 7
    got = export.export(S.Reader(spark, folder).tables(), f"{tmp_path}/out", f"{folder}/objects")
    assert (got["objects"], got["object_bytes"]) == (1, 1007) and got["missing_objects"] > 1
    assert (tmp_path / "out" / "objects" / some[:2] / some[2:4] / some).read_bytes()[-7:] == b"b" * 7
    lines = spark.read.text(f"{tmp_path}/out/items").count()
    assert lines == t["items"].filter("deleted = 0 or retained_at is not null").count()
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == got
    for c in got["collections"][:4]:
        assert c["live"] == (spark.read.text(f"{tmp_path}/out/{c['items']}").count() if c["items"] else 0)
    with pytest.raises(SystemExit, match="force"):
        cli.run(spark, [folder, "export", f"{tmp_path}/out"])
    assert cli.run(spark, [folder, "export", f"{tmp_path}/out", "--force", "--no-retained"]) == 0
    assert spark.read.text(f"{tmp_path}/out/items").count() == t["items"].filter("deleted = 0").count()
    for args in (["collections"], ["items", "en/src1", "--limit", "2"], ["retained", "en/src1"], ["show", "1"], ["queue"], ["info"]):
        assert cli.run(spark, [folder, *args]) == 0
    assert cli.run(spark, [folder, "check"]) == 1
    drift = t["objects"].join(checks.references(t["items"], t["bindings"], t["queue"]), "hash", "left").filter("refcount <> coalesce(expected, 0)").count()
    assert f"refcount drift: {drift}" in capsys.readouterr().out and drift > 0
    with pytest.raises(SystemExit):
        cli.run(spark, [folder, "--json", "purge", "--older-than", "1d"])
    gone = t["items"].filter("retained_at is not null").orderBy("seq").first()
    cli.run(spark, [folder, "--source", "left", "restore", str(gone.seq)])
    back = S.Reader(spark, folder).tables()["items"].filter(f"seq = {gone.seq}").first()
    assert (back.deleted, back.retained_at) == (0, None)
    assert cli.run(spark, [folder, "--yes", "purge", "--older-than", "1d"], dt.datetime(2090, 1, 1, tzinfo=dt.UTC)) == 0
    assert S.Reader(spark, folder).tables()["items"].filter("retained_at is not null").count() == 0


def test_durations():
    assert [cli.duration(x) for x in ("90d", "12h", "2weeks", "1h 30m")] == [7776000, 43200, 1209600, 5400]
    with pytest.raises(ValueError):
        cli.duration("soon")
    assert cli.cutoff("9999999d", dt.datetime(2026, 1, 1, tzinfo=dt.UTC)) == "1970-01-01T00:00:00.000Z"


def test_a_queued_body_is_never_swept(spark, tmp_path):
    folder = f"{tmp_path}/s"
    o = S.Owner(spark, folder)
    blobs.put(spark, f"{folder}/objects", "aaaabbbb", b"body")
    o.write(spark.createDataFrame([op(1, "upsert", "c", "a", "left", object_hash="aaaabbbb", size=4)], OPS), NOW)
    add = ("1", "d", "add", '{"v":1,"link_id":"z","object":"aaaabbbb"}', "aaaabbbb", 4)
    S.Producer(spark, folder, "p", account="me").enqueue(spark.createDataFrame([add], ACTION + ", size bigint"))
    seen = S.Reader(spark, folder).tables()
    assert rows(seen["objects"], "hash", "size", "refcount") == [("aaaabbbb", 4, 2)]
    assert rows(seen["collections"].filter("id = 'd'"), "id", "account") == [("d", "me")] and seen["queue"].count() == 1
    drift = lambda t: checks.refcount_drift(t["objects"], t["items"], t["bindings"], t["queue"]).count()
    assert drift(seen) == 0
    # its only item goes, and the trash is emptied
    o = S.Owner(spark, folder)
    o.write(spark.createDataFrame([op(1, "drop", "c", "a", "left")], OPS), NOW)
    o.purge_before("2099")
    assert blobs.get(spark, f"{folder}/objects", "aaaabbbb") == b"body"
    now = S.Reader(spark, folder).tables()
    assert rows(now["objects"], "hash", "refcount") == [("aaaabbbb", 1)] and now["queue"].count() == 1 and drift(now) == 0
    o.drain()
    now = S.Reader(spark, folder).tables()
    assert rows(now["items"], "collection", "object_hash", "deleted") == [("d", "aaaabbbb", 0)] and now["queue"].count() == 0 and drift(now) == 0
    # a cancelled action releases its pin
    S.Producer(spark, folder, "p").enqueue(spark.createDataFrame([("2", "d", "update", '{"v":1,"seq":1,"object":"ccccdddd"}', "ccccdddd", 9)], ACTION + ", size bigint"))
    blobs.put(spark, f"{folder}/objects", "ccccdddd", b"new")
    id_ = S.Reader(spark, folder).tables()["queue"].first().id
    cli.run(spark, [folder, "cancel", str(id_)])
    now = S.Reader(spark, folder).tables()
    assert rows(now["objects"], "hash") == [("aaaabbbb",)] and now["queue"].count() == 0 and drift(now) == 0
    assert blobs.get(spark, f"{folder}/objects", "ccccdddd") is None


def test_a_commit_writes_the_buckets_it_touches(spark, tmp_path):
    o = S.Owner(spark, f"{tmp_path}/s", account="me")
    o.write(spark.createDataFrame([op(k, "upsert", f"c{k}", f"l{k}", "left") for k in range(12)], OPS), NOW)
    before = o.manifest["tables"]
    assert len(before["items"]) > 4
    o.write(spark.createDataFrame([op(1, "upsert", "c3", "more", "left")], OPS), NOW)
    after = o.manifest["tables"]
    differ = [b for b in after["items"] if after["items"][b] != before["items"].get(b)]
    assert len(differ) == 1 and set(after["items"]) >= set(before["items"]) and after["objects"] == before["objects"]
    t = S.Reader(spark, o.folder).tables()
    assert t["items"].count() == 13 and rows(t["items"].filter("link_id = 'more'"), "seq") == [(13,)]
    assert rows(t["meta"], "next_seq") == [(14,)] and rows(t["collections"].filter("id = 'c3'"), "account") == [("me",)]


def test_draft_tables_lack_columns(spark, tmp_path):
    o = S.Owner(spark, f"{tmp_path}/s")
    path = f"{tmp_path}/s/tables/draft"
    spark.createDataFrame([("c", "a", "left", "h", None, None, None)], "collection string, link_id string, source string, handle string, base_flags string, base_object string, base_revision string").write.parquet(path)
    o.manifest["tables"]["bindings"] = {"0": [path]}
    assert rows(o.tables()["bindings"], "handle", "conflicted", "conflict_revision") == [("h", 0, None)]
