"""Export: a manifest, items as lines of JSON, and bodies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.operators.reads import collections, counts, live, retained, sources
from satchel.sources import blobs, session


def rows(items: DataFrame) -> DataFrame:
    """(collection, state, seq, line): live and retained items; account and sort key aren't exported."""
    line = F.to_json(F.struct("seq", "link_id", C.flags_decode(F.col("flags")).alias("flags"), "meta", F.col("object_hash").alias("object"), C.level_name(F.col("level")).alias("level"), "retained_at", "retained_by"))
    return items.filter(live() | retained()).select("collection", F.when(retained(), "retained").otherwise("live").alias("state"), "seq", line.alias("line"))


def copy_bodies(hashes: DataFrame, source: str, target: str) -> DataFrame:
    """(hash, size) of each body copied from one blob folder to another, size null for one that isn't there. Bodies are copied by
    the tasks, piece by piece."""
    session.ready(hashes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(source)
        out, to = fs.FileSystem.from_uri(target)
        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                at = blobs.path_of(base, name)
                info = files.get_file_info(at)
                sizes.append(info.size if info.type == fs.FileType.File else None)
                if sizes[-1] is not None:
                    path = blobs.path_of(to, name)
                    out.create_dir(path.rsplit("/", 1)[0])
                    fs.copy_files(at, path, source_filesystem=files, destination_filesystem=out)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["hash", "size"])

    return hashes.select("hash").mapInArrow(run, "hash string, size bigint")


def export(tables: dict[str, DataFrame], folder: str, objects: str | None = None, with_retained: bool = True, force: bool = False, now: str | None = None) -> dict:
    """Write items/place=N/state=S/ as text files (N is a collection's place in the list, so ids may hold anything), the bodies in
    the blob folder `objects` that the lines refer to, and manifest.json, which is returned: it names each collection's folders
    and counts. A folder that holds an export is refused unless forced."""
    spark = tables["items"].sparkSession
    p, files = session.hadoop_path(spark, f"{folder}/manifest.json")
    if files.exists(p):
        if not force:
            raise FileExistsError(f"{folder} holds an export already")
        for name in ("manifest.json", "items", "objects", "missing_objects"):
            files.delete(session.hadoop_path(spark, f"{folder}/{name}")[0], True)
    items = tables["items"] if with_retained else tables["items"].filter(~retained())
    listed = collections(tables["collections"])
    lines = rows(items).join(listed.select(F.col("id").alias("collection"), "place"), "collection")
    lines.repartitionByRange("place", "state", "seq").sortWithinPartitions("place", "state", "seq").select("place", "state", "line").write.partitionBy("place", "state").text(f"{folder}/items")
    known = {r.id: r for r in counts(items, tables["collections"]).collect()}  # a row for each collection
    entries = []
    for r in listed.orderBy("place").collect():
        n = known[r.id]
        at = f"items/place={r.place}/state="
        entries.append({"id": r.id, "kind": r.kind, "name": r.name, "parent": r.parent, "sort_order": r.sort_order, "generation": r.generation, "items": at + "live" if n.live else None, "retained_items": at + "retained" if n.retained else None, "live": n.live, "retained": n.retained})
    manifest = {"format": "satchel-export", "format_version": 1, "exported_at": now, "version": tables["meta"].first().version, "sources": sorted(r.source for r in sources(tables["bindings"]).select("source").distinct().collect()), "collections": entries, "objects": 0, "object_bytes": 0, "missing_objects": 0}
    if objects:
        hashes = items.filter(F.col("object_hash").isNotNull() & (live() | retained())).select(F.col("object_hash").alias("hash")).distinct()
        done = session.written(copy_bodies(hashes, session.uri(spark, objects), session.uri(spark, f"{folder}/objects")), "copied")
        n = done.agg(F.count("size").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count_if(F.col("size").isNull()).alias("m")).first()
        manifest |= {"objects": n.n, "object_bytes": n.b, "missing_objects": n.m}
        if n.m:  # their names are a table: there may be any number of them
            done.filter("size is null").select("hash").write.text(f"{folder}/missing_objects")
    out = files.create(p, True)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
    out.close()
    return manifest
