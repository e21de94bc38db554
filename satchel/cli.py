"""Operator commands over a store: python -m satchel.cli FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.operators import checks, export, reads
from satchel.plans.store import Owner, Producer, Reader
from satchel.sources import blobs

UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def duration(text: str) -> int:
    """Seconds of 90d, 12h, 2weeks, 1h 30m."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", text.strip().lower())
    if not parts or "".join(re.sub(r"\s", "", a + b) for a, b in parts) != re.sub(r"\s", "", text.lower()):
        raise ValueError(f"not a duration: {text}")
    return sum(int(n) * UNITS[u if u in UNITS else u.rstrip("s")] for n, u in parts)


def cutoff(age: str, now: dt.datetime) -> str:
    """The instant so long ago, no earlier than 1970."""
    start = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    at = now - dt.timedelta(seconds=min(duration(age), (now - start).total_seconds()))
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def show(df: DataFrame, as_json: bool) -> None:
    if as_json:
        for line in df.toJSON().toLocalIterator():
            print(line)
    else:
        columns = df.columns
        print("\t".join(columns))
        for r in df.toLocalIterator():  # all rows, however many
            print("\t".join("-" if r[c] is None else str(r[c]) for c in columns))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="satchel")
    p.add_argument("folder")
    p.add_argument("--json", action="store_true")
    p.add_argument("--source")
    p.add_argument("--yes", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c.add_argument(a, **k) for c in [sub.add_parser(name)] for a, k in args]
    number = {"type": int}
    add("collections")
    add("items", ("collection", {}), ("--order", {"default": "desc", "choices": ["link", "asc", "desc"]}), ("--after", {"nargs": "*"}), ("--limit", {"type": int, "default": reads.PAGE}))
    add("retained", ("collection", {}), ("--after", number), ("--limit", {"type": int, "default": reads.PAGE}))
    add("show", ("seq", number))
    add("body", ("seq", number))
    add("restore", ("seq", number))
    add("purge", ("collection", {"nargs": "?"}), ("--seq", number), ("--older-than", {}))
    add("queue")
    add("cancel", ("id", number))
    add("drain")
    add("info")
    add("check", ("--fix", {"action": "store_true"}), ("--grace", {"default": "1h"}))
    add("export", ("to", {}), ("--no-objects", {"action": "store_true"}), ("--no-retained", {"action": "store_true"}), ("--force", {"action": "store_true"}))
    return p


def source_of(tables: dict[str, DataFrame], flag: str | None) -> str:
    """The flag, or the only bound source; without bindings "local". Several are refused."""
    if flag:
        return flag
    found = [r.source for r in tables["bindings"].select("source").distinct().limit(2).collect()]
    if len(found) > 1:
        raise SystemExit("several sources: name one with --source")
    return found[0] if found else "local"


def sure(args: argparse.Namespace) -> None:
    if args.yes:
        return
    if args.json or not sys.stdin.isatty():
        raise SystemExit("this deletes: confirm with --yes")
    if input("Delete? [y/N] ").strip().lower() != "y":
        raise SystemExit("left as it is")


def run(spark: SparkSession, argv: list[str], now: dt.datetime | None = None) -> int:
    args = parser().parse_args(argv)
    now = now or dt.datetime.now(dt.UTC)
    reader = Reader(spark, args.folder)
    t = reader.tables()
    out = lambda df: show(df, args.json)
    match args.command:
        case "collections":
            out(reads.counts(t["items"], t["collections"]).orderBy("id"))
        case "items":
            after = None if not args.after else (args.after[0],) if args.order == "link" else (args.after[0], int(args.after[1]))
            limit = max(1, args.limit)
            rows = reads.page(t["items"], args.collection, args.order, after, limit + 1).collect()
            if rows:
                out(spark.createDataFrame(rows[:limit], "seq bigint, link_id string, flags string, meta string, sort_key string, object_hash string, level int"))
            if len(rows) > limit:
                last = rows[limit - 1]
                print("next:", last.link_id if args.order == "link" else f"{last.sort_key} {last.seq}")
        case "retained":
            out(reads.retained_page(t["items"], t["objects"], args.collection, args.after, max(1, args.limit)))
        case "show":
            out(reads.item_show(t["items"].filter(F.col("seq") == args.seq), t["collections"]).orderBy("place"))
        case "body" | "restore":
            rows = t["items"].filter(F.col("seq") == args.seq).collect()
            if len(rows) != 1:
                raise SystemExit(f"{len(rows)} placements of {args.seq}; one is needed")
            if args.command == "body":
                body = blobs.stream(spark, f"{reader.folder}/objects", rows[0].object_hash) if rows[0].object_hash else None
                if body is None:
                    raise SystemExit("no body")
                for piece in body:
                    sys.stdout.buffer.write(piece)
            else:
                if rows[0].retained_at is None:
                    raise SystemExit("not retained")
                r = rows[0]
                payload = C.payload_encode(flags=C.flags_decode(F.lit(r.flags)), body=F.lit(r.object_hash), link=F.lit(r.link_id), meta=F.lit(r.meta))
                made = spark.range(1).select(payload.alias("p")).first().p
                stamp = now.strftime("%Y-%m-%dT%H:%M:%S.000Z")
                Producer(spark, reader.folder, "cli").enqueue(spark.createDataFrame([(stamp, r.collection, "add", made, r.object_hash)], "created_at string, collection string, action string, payload string, object_hash string"))
                Owner(spark, reader.folder, source_of(t, args.source)).drain()
                back = Reader(spark, reader.folder).tables()["items"].filter((F.col("seq") == args.seq) & (F.col("deleted") == 0))
                print("refused" if back.isEmpty() else "applied")
        case "purge":
            owner = Owner(spark, args.folder)
            if args.older_than:
                at = cutoff(args.older_than, now)
                out(reads.retained_preview(t["items"], t["objects"], at))
                sure(args)
                out(owner.purge_before(at))
            else:
                if args.collection is None or args.seq is None:
                    raise SystemExit("name a collection and --seq, or --older-than")
                sure(args)
                owner.purge(spark.createDataFrame([(args.collection, args.seq)], "collection string, seq bigint"))
        case "queue":
            out(t["queue"].select("id", "created_at", "producer", "collection", C.action_summary(F.col("action"), F.col("payload")).alias("summary"), "attempts", C.dash(F.col("error")).alias("error")).orderBy("id"))
        case "cancel":
            Owner(spark, args.folder).cancel(spark.createDataFrame([(args.id,)], "id bigint"))
        case "drain":
            from satchel.operators.drain import report

            out(report(Owner(spark, args.folder, source_of(t, args.source)).drain()))
        case "info":
            out(reads.store_info(t["items"], t["collections"], t["objects"], t["bindings"]))
        case "check":
            found = {
                "refcount drift": checks.refcount_drift(t["objects"], t["items"], t["bindings"], t["queue"]),
                "dangling bindings": checks.dangling_bindings(t["bindings"], t["items"]),
                "items without object": checks.dangling_item_objects(t["items"], t["objects"]),
                "actions without object": checks.dangling_queue_objects(t["queue"], t["objects"]),
                "orphan bodies": checks.orphan_blobs(t["blobs"], t["objects"]),
                "missing bodies": checks.missing_blobs(t["objects"], t["blobs"]),
            }
            total = 0
            for name, df in found.items():
                n = df.count()
                total += n
                print(f"{name}: {n}")
                if n:
                    show(df if args.json else df.limit(20), args.json)
            if args.fix:
                owner = Owner(spark, args.folder)
                owner.take_in()
                t = owner.tables()
                old = t["blobs"].filter(F.col("modified") < F.lit(now - dt.timedelta(seconds=duration(args.grace)))).select("hash", "size")
                for r in checks.orphan_blobs(old, t["objects"]).toLocalIterator():
                    blobs.remove(spark, f"{reader.folder}/objects", r.hash)
            return int(total > 0)
        case "export":
            try:
                done = export.export(t, args.to, None if args.no_objects else f"{reader.folder}/objects", not args.no_retained, args.force, now.strftime("%Y-%m-%dT%H:%M:%SZ"))
            except FileExistsError as e:
                raise SystemExit(f"{e}: pass --force to overwrite it") from e
            print(f"{len(done['collections'])} collections, {sum(c['live'] + c['retained'] for c in done['collections'])} items, {done['objects']} bodies, {done['missing_objects']} missing")
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("satchel").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
