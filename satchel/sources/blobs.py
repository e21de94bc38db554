"""Bodies as files named by their hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.sources import session


def path_of(folder: str, hash_: str) -> str:
    """The path of a body; names of fewer than four characters lie flat."""
    return f"{folder}/{hash_}" if len(hash_) < 4 else f"{folder}/{hash_[:2]}/{hash_[2:4]}/{hash_}"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, path, size, modified) of all bodies, without reading them; names that begin with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("hash"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(~F.col("hash").startswith("."))


def stream(spark: SparkSession, folder: str, hash_: str, size: int = 1 << 20) -> Iterator[bytes] | None:
    """A body piece by piece, None if it isn't there."""
    p, fs = session.hadoop_path(spark, path_of(folder, hash_))
    if not fs.exists(p):
        return None

    def pieces() -> Iterator[bytes]:
        held = fs.open(p)
        try:
            while piece := bytes(held.readNBytes(size)):
                yield piece
        finally:
            held.close()

    return pieces()


def get(spark: SparkSession, folder: str, hash_: str) -> bytes | None:
    pieces = stream(spark, folder, hash_)
    return None if pieces is None else b"".join(pieces)


def put(spark: SparkSession, folder: str, hash_: str, body: bytes | Iterable[bytes]) -> int:
    """Write a body, or its pieces one after another, beside its place, make it durable, and rename it there; one that exists is kept.
    Returns the bytes written."""
    p, fs = session.hadoop_path(spark, path_of(folder, hash_))
    if fs.exists(p):
        return 0
    part, _ = session.hadoop_path(spark, f"{folder}/.part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    total = 0
    try:
        for piece in [body] if isinstance(body, bytes) else body:
            out.write(bytearray(piece))
            total += len(piece)
        out.hsync()
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    out.close()
    fs.mkdirs(p.getParent())
    if not fs.rename(part, p):
        fs.delete(part, False)
    return total


def remove(spark: SparkSession, folder: str, hash_: str) -> None:
    """Delete a body; one that isn't there is fine."""
    p, fs = session.hadoop_path(spark, path_of(folder, hash_))
    fs.delete(p, False)
