"""The store on disk: versioned Parquet snapshots of its tables, and a manifest that names the current one.

A commit writes what has changed under new names and then replaces the manifest by creating manifest-<n+1>, which fails if another
writer was first: the swap is the transaction. Items and bindings lie in buckets of collections, bodies' rows in buckets of hashes;
a commit writes the buckets it touches and keeps the others' files. Bodies are written before it and unlinked after it, so a crash
leaves at worst a body that nothing refers to. Producers write folders of action rows into the inbox; every reader sees them at the
end of the queue, with their collections, bodies and pins, and the next commit of whatever kind takes them in for good."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import changes, checks, drain, hub, reads
from satchel.sources import blobs, session
from satchel.sources.store_tables import NAMES

VERSION = 1
SCHEMAS = {
    "collections": "id string, account string, kind string, name string, parent string, sort_order int, conflict string, generation int",
    "sources": "collection string, source string, checkpoint string",
    "objects": "hash string, size bigint, refcount bigint",
    "items": "collection string, link_id string, seq bigint, flags string, object_hash string, meta string, sort_key string, level int, deleted int, retained_at string, retained_by string, conflicted int, conflict_object string",
    "bindings": "collection string, link_id string, source string, handle string, base_flags string, base_object string, base_revision string, conflicted int, conflict_revision string",
    "queue": "id bigint, created_at string, producer string, collection string, action string, payload string, object_hash string, attempts int, error string",
    "meta": "id int, format string, version int, hash_algo string, next_seq bigint",
}
INBOX = SCHEMAS["queue"] + ", size bigint, account string"
#: Columns that older snapshots may lack, with what they then hold where it isn't null.
ADDED = {"collections": {"conflict": "manual"}, "items": {"sort_key": ""}, "bindings": {"conflicted": 0}}
#: The columns by which tables lie in buckets, and how many a new store has.
PLACED, BUCKETS = {"items": "collection", "bindings": "collection", "objects": "hash"}, 32


class Busy(RuntimeError):
    """Another writer was first."""


class StoreError(RuntimeError):
    pass


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    p, fs = session.hadoop_path(spark, folder)
    if not fs.exists(p):
        return -1, {}
    numbers = [int(n[9:-5]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("manifest-") and n.endswith(".json")]
    if not numbers:
        return -1, {}
    last = max(numbers)
    return last, json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest-{last}.json").collect()))


class Reader:
    """The read-only role: tables of the current snapshot."""

    def __init__(self, spark: SparkSession, folder: str, source: str = "left"):
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source
        self.number, self.manifest = _manifest(spark, self.folder)
        if self.number < 0:
            raise StoreError(f"no store at {folder}")
        if self.manifest["version"] != VERSION:
            raise StoreError(f"version {self.manifest['version']} isn't {VERSION}")

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest.get("buckets", BUCKETS))).cast("int")

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of the snapshot, or some of its buckets."""
        held = self.manifest["tables"][name]
        paths = [p for b, own in held.items() if buckets is None or int(b) in buckets for p in own] if isinstance(held, dict) else held
        df = self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])
        return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in ADDED.get(name, {}).items()})

    def waiting(self) -> list[str]:
        """Producers' folders that no commit has taken in yet."""
        p, fs = session.hadoop_path(self.spark, f"{self.folder}/inbox")
        seen = set(self.manifest.get("taken", []))
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in seen) if fs.exists(p) else []

    def inbox(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(INBOX).parquet(*(f"{self.folder}/inbox/{n}" for n in names))

    def tables(self) -> dict[str, DataFrame]:
        """The snapshot's tables, with what waits in the inbox; `waiting` names its folders."""
        out = {name: self.read(name) for name in NAMES}
        self.names = self.waiting()
        if self.names:
            out |= with_inbox(out, self.inbox(self.names))
        out["blobs"] = blobs.listing(self.spark, f"{self.folder}/objects")
        return out


def with_inbox(tables: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The queue, collections and objects with producers' rows: each is appended, its collection made, its body indexed if its size
    is given, and pinned."""
    first = (tables["queue"].agg(F.max("id")).first()[0] or 0) + 1
    queue = changes.enqueue(tables["queue"], rows.drop("id", "attempts", "error"), first)
    bodies = rows.filter("object_hash is not null")
    pins = bodies.groupBy(F.col("object_hash").alias("hash")).agg(F.count("*").alias("delta"))
    objects = checks.adjust(changes.store_objects(tables["objects"], bodies.filter("size is not null").select(F.col("object_hash").alias("hash"), "size")), pins)
    made = rows.groupBy(F.col("collection").alias("id")).agg(F.min("account").alias("account"))
    return {"queue": queue, "objects": objects, "collections": changes.ensure_collections(tables["collections"], made)}


class Owner(Reader):
    """The owner role: creates the store if it isn't there, and commits. account: that of collections it makes on the way."""

    def __init__(self, spark: SparkSession, folder: str, source: str = "left", account: str | None = None):
        self.account = account
        if _manifest(spark, folder.rstrip("/"))[0] < 0:
            create(spark, folder.rstrip("/"))
        super().__init__(spark, folder, source)

    def _put(self, name: str, df: DataFrame, buckets: set[int] | None = None) -> dict | list:
        """Write a table, or the buckets that df holds, and return its place in the manifest."""
        path = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"
        if name not in PLACED:
            df.write.parquet(path)
            return [path]
        # by buckets, of which adaptive execution gives a large one to many tasks; sorted, so files' statistics serve the pages
        order = ["bucket", PLACED[name], *(["sort_key", "seq"] if name == "items" else [])]
        df.withColumn("bucket", self.bucket(PLACED[name])).hint("rebalance", F.col("bucket")).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)
        p, fs = session.hadoop_path(self.spark, path)
        new = {n[7:]: [f"{path}/{n}"] for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("bucket=")}
        held = self.manifest["tables"].get(name)
        return {b: own for b, own in held.items() if buckets is not None and int(b) not in buckets} | new if isinstance(held, dict) else new

    def commit(self, tables: dict[str, DataFrame], changed: Iterable[str] = NAMES, buckets: dict[str, set[int]] | None = None, done: dict | None = None) -> None:
        """Write the changed tables and swap the manifest; Busy if another commit was first. buckets: of placed tables, those that the
        tables hold, if not all. done: tables that have been written already."""
        taken = list(getattr(self, "names", []))
        now = dict(self.manifest["tables"]) | (done or {})
        for name in dict.fromkeys([*changed, *(("queue", "collections", "objects") if taken else ())]):
            if name not in (done or {}):
                now[name] = self._put(name, tables[name], (buckets or {}).get(name))
        before = [n for n in self.manifest.get("taken", []) if _exists(self.spark, f"{self.folder}/inbox/{n}")]
        _swap(self.spark, self.folder, self.number + 1, self.manifest | {"version": VERSION, "tables": now, "taken": before + taken})
        self.number, self.manifest = _manifest(self.spark, self.folder)
        self.names = []
        for n in self.manifest["taken"]:  # what is in the queue now
            p, fs = session.hadoop_path(self.spark, f"{self.folder}/inbox/{n}")
            fs.delete(p, True)

    def _change(self, change: Callable[[dict[str, DataFrame], DataFrame], tuple[dict[str, DataFrame], DataFrame | None]], where: Callable[[dict[str, DataFrame]], DataFrame], finish: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> None:
        """A commit of a change to the items and bindings of some collections. where: (collection) of them, from the tables. change:
        from the tables, of which items and bindings are those buckets alone, and all (link_id, seq), to the tables after, and
        bodies (hash, size) that it brings. Reference counts follow by the difference."""
        every = self.tables()
        touched = {r[0] for r in where(every).select(self.bucket("collection")).distinct().collect()}  # as many as there are buckets
        part = every | {n: self.read(n, touched) for n in ("items", "bindings")}
        after, bodies = change(part, every["items"].select("link_id", "seq"))
        done, new = {}, dict(after)
        for name in ("items", "bindings", "queue"):
            if after[name] is not part[name]:
                done[name] = self._put(name, after[name], touched)
                paths = done[name] if name not in PLACED else [p for b, own in done[name].items() if int(b) in touched for p in own]
                new[name] = self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])
        count = lambda t: checks.references(t["items"], t["bindings"], t["queue"]).withColumnRenamed("expected", "n")
        delta = session.written(checks.refcount_delta(count(part), count(new)), "delta")
        objects = every["objects"] if bodies is None else changes.store_objects(every["objects"], bodies)
        objects = checks.adjust(objects, delta)
        hashes = delta.select("hash").unionByName(objects.filter("refcount = 0").select("hash"))
        hashes = hashes if bodies is None else hashes.unionByName(bodies.select("hash"))
        if self.names:
            hashes = hashes.unionByName(self.inbox(self.names).filter("object_hash is not null").select(F.col("object_hash").alias("hash")))
        felt = {r[0] for r in hashes.select(self.bucket("hash")).distinct().collect()}
        objects = objects.filter(self.bucket("hash").isin(sorted(felt)))
        gone = session.written(objects.filter("refcount = 0").select("hash"), "gone")
        new["objects"] = checks.collect(objects)
        new["meta"] = every["meta"].crossJoin(new["items"].agg((F.max("seq") + 1).alias("__m"))).withColumn("next_seq", F.greatest("next_seq", "__m")).select(every["meta"].columns)
        if finish:
            new |= finish(new)
        self.commit(new, ("objects", "meta", *(["collections"] if new["collections"] is not every["collections"] else [])), {"objects": felt}, done)
        self._unlink(gone)

    def _unlink(self, gone: DataFrame) -> None:
        """Unlink bodies, but for those that a producer has named since."""
        late = self.waiting()
        if late:
            gone = gone.join(self.inbox(late).select(F.col("object_hash").alias("hash")), "hash", "left_anti")
        for r in gone.toLocalIterator():  # files are unlinked one by one wherever they lie
            blobs.remove(self.spark, f"{self.folder}/objects", r.hash)

    def write(self, ops: DataFrame, now: str, rekey: str | None = None) -> None:
        """A write batch (see hub.write_batch); rekey also raises that collection's generation in the same commit."""
        ops = session.written(ops, "ops")

        def change(t: dict[str, DataFrame], links: DataFrame) -> tuple[dict[str, DataFrame], DataFrame | None]:
            return hub.write_rows(t, ops, now, self.account, links), hub.bodies(ops)

        finish = (lambda t: {"collections": changes.bump_generation(t["collections"], rekey)}) if rekey else None
        self._change(change, lambda t: ops, finish)

    def drain(self, broken: DataFrame | None = None) -> DataFrame:
        """Apply what is pending, once each: effects and the queue's rows change in one swap."""
        held: list[DataFrame] = []

        def change(t: dict[str, DataFrame], links: DataFrame) -> tuple[dict[str, DataFrame], DataFrame | None]:
            after, found = drain.drain_rows(t, self.source, broken, links)
            held.append(found)
            return after, None

        self._change(change, lambda t: drain.reach(t["queue"]))
        return held[0]

    def take_in(self) -> None:
        """Commit what waits in the inbox, and nothing else."""
        tables = self.tables()
        if self.names:
            self.commit(tables, ())

    def cancel(self, ids: DataFrame) -> None:
        """Take actions out of the queue and release their pins."""
        self._change(lambda t, _: (t | {"queue": changes.cancel(t["queue"], ids)}, None), lambda t: t["queue"].join(ids, "id", "left_semi"))

    def purge(self, which: DataFrame) -> None:
        """Delete retained items (collection, seq)."""
        self._change(lambda t, _: (t | {"items": changes.purge_each(t["items"], which)}, None), lambda t: which)

    def purge_before(self, cutoff: str) -> DataFrame:
        before = self.tables()
        others = before["bindings"].select(F.col("base_object").alias("hash")).unionByName(before["queue"].select(F.col("object_hash").alias("hash"))).filter("hash is not null")
        report = session.written(changes.purge_report(before["items"], changes.purge_before(before["items"], cutoff), before["objects"], others), "report")
        self._change(lambda t, _: (t | {"items": changes.purge_before(t["items"], cutoff)}, None), lambda t: reads.retained_before(t["items"], cutoff))
        return report


def create(spark: SparkSession, folder: str) -> None:
    now = {}
    for name, schema in SCHEMAS.items():
        rows = [(1, "satchel", VERSION, "sha256", 1)] if name == "meta" else []
        path = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
        if name in PLACED:
            now[name] = {}
            continue
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        now[name] = [path]
    p, fs = session.hadoop_path(spark, f"{folder}/objects")
    fs.mkdirs(p)
    _swap(spark, folder, 0, {"version": VERSION, "buckets": BUCKETS, "tables": now})


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = session.hadoop_path(spark, path)
    return fs.exists(p)


def _swap(spark: SparkSession, folder: str, number: int, manifest: dict) -> None:
    p, fs = session.hadoop_path(spark, f"{folder}/manifest-{number}.json")
    part, _ = session.hadoop_path(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise Busy(f"manifest {number} exists")


class Producer:
    """The producer role: appends actions; never creates a store. account: that of collections its actions are the first to name."""

    def __init__(self, spark: SparkSession, folder: str, name: str, account: str | None = None):
        number, manifest = _manifest(spark, folder.rstrip("/"))
        if number < 0 or manifest["version"] != VERSION:
            raise StoreError(f"no store of version {VERSION} at {folder}")
        self.spark, self.folder, self.name, self.account = spark, folder.rstrip("/"), name, account

    def enqueue(self, rows: DataFrame) -> None:
        """rows: created_at, collection, action, payload, object_hash, and size for bodies that may be new. From now on the actions are
        in the queue of whoever opens the store, and their bodies pinned."""
        null = lambda t: F.lit(None).cast(t)
        rows = rows if "size" in rows.columns else rows.withColumn("size", null("bigint"))
        more = {"id": null("bigint"), "producer": F.lit(self.name), "attempts": F.lit(0), "error": null("string"), "account": F.lit(self.account).cast("string")}
        rows.withColumns(more).select([c.split()[0] for c in INBOX.split(", ")]).write.parquet(f"{self.folder}/inbox/{uuid.uuid4().hex}")


def import_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> Owner:
    """A store with given tables."""
    owner = Owner(spark, folder)
    typed = {n: tables[n].select([F.col(c.split()[0]).cast(c.split()[1]) for c in s.split(", ")]) for n, s in SCHEMAS.items()}
    owner.commit(typed)
    return owner
