"""Helpers shared by the operators: session settings, scratch tables, Arrow batches and text arrays."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of text that one vectorised step takes; its arrays need some 50 times as much memory. Longer texts are taken in windows.
STEP_BYTES = 1 << 20


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches by bytes and rows (settings of the session)."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("OMP_NUM_THREADS", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one if that is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="satchel-")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


BREAK = re.compile(r"[\W_]")
_LEFT: list[tuple[SparkSession, str]] = []


def scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/satchel-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _LEFT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT[:] = [x for x in _LEFT if x[1] != path]


@atexit.register
def _drop_rest() -> None:
    for spark, path in list(_LEFT):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone
            return


def whole(docs: DataFrame, name: str = "row"):
    """A row of docs as one column, whatever the names of its columns; select(name + ".*") gives docs again."""
    return F.struct("*").alias(name)


def integer(docs: DataFrame, name: str) -> F.Column:
    """An id column as bigint. Ids of other than integer types are refused here, not somewhere in a task."""
    kind = docs.select(F.col(name)).schema[0].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise ValueError(f"{name} must be of an integer type, not {kind}")
    return F.col(name).cast("bigint")


def text_key(text) -> F.Column:
    """A 128-bit key of a text, for grouping equal ones."""
    return F.unhex(F.md5(text))


def lens_of(arr: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each row; nulls have none."""
    arr = pa.compute.fill_null(pa.compute.binary_length(arr), 0)
    return arr.to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' UTF-8 bytes one after another, and the rows' offsets in them. Nulls count as empty."""
    if arr.null_count:
        arr = pa.compute.fill_null(arr, "")
    arr = pa.concat_arrays([arr]) if arr.offset == 0 else pa.concat_arrays([arr.slice(0, 0), arr])
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about limit bytes of text each; a longer text comes alone."""
    return steps_of(batch, lens_of(batch.column(text)), limit)


def steps_of(batch: pa.RecordBatch, lens: np.ndarray, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < len(lens):
        total, end = lens[at], at + 1
        while end < len(lens) and total + lens[end] <= limit:
            total += lens[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def windows(text: str, limit: int = STEP_BYTES // 4, overlap: int = 0) -> Iterator[str]:
    """A long text in parts of about limit characters. A part ends where the next character is neither letter nor digit (a
    longer run of these stays whole), and each but the first begins with the last `overlap` characters before it."""
    at = 0
    while at < len(text):
        m = BREAK.search(text, min(at + limit, len(text)))
        end = m.start() if m else len(text)
        yield text[max(0, at - overlap) : end]
        at = end


def ragged(values: pa.Array, counts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A list column from flat values and the rows' counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Join batches that come sorted by their first columns into tables of about so many rows, no group of equal keys
    divided between two of them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        differs = np.zeros(n, bool)
        for k in range(keys):
            col = table.column(k).to_numpy()
            differs |= col != col[-1]
        cut = np.flatnonzero(differs)
        if len(cut):
            yield table.slice(0, cut[-1] + 1)
            held = table.slice(cut[-1] + 1).combine_chunks().to_batches()
            n -= int(cut[-1]) + 1
    if held:
        yield pa.Table.from_batches(held)
