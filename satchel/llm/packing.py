"""Packing by powers of two: a document of n tokens is cut into pieces whose lengths are the powers of two in n (the
longest as often as it takes), longest first. Pieces of one length make up a bucket; a training batch takes pieces of one
bucket, so no sequence crosses documents, is padded or is cut to fit.

A task sends out each bucket's pieces together; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import default_path, rank_encoder

#: The longest pieces have 2**TOP tokens.
TOP = 13
#: Tokens that a task holds before it sends them out by bucket.
HOLD = 1 << 20


def split(n: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, log2 of the length) of all pieces of documents of n tokens, in their order."""
    whole = n >> top
    bits = (n[:, None] >> np.arange(top - 1, -1, -1)) & 1
    doc, bit = np.nonzero(bits)
    doc = np.append(np.repeat(np.arange(len(n)), whole), doc)
    size = np.append(np.full(int(whole.sum()), top), top - 1 - bit)
    order = np.argsort(doc, kind="stable")
    doc, size = doc[order], size[order]
    length = 1 << size
    total = np.cumsum(length) - length
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    return doc, total - np.maximum.accumulate(np.where(first, total, 0)), size


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(bucket, doc_id, piece, start, length, token_ids): piece number `piece` of a document, its tokens from `start` on.
    length is 2**bucket.

    Documents of null or empty text have no pieces. A repeated row gives its pieces again; null ids are kept. Other
    columns, whatever their names, are ignored. An empty table gives an empty result."""
    common.ready(docs.sparkSession)
    path = path or default_path()
    names = ["bucket", "doc_id", "piece", "start", "length", "token_ids"]

    def send(doc_ids: list[pa.Array], ids: list[np.ndarray], n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not doc_ids:
            return
        own, flat, num = pa.concat_arrays(doc_ids), np.concatenate(ids), np.concatenate(n)
        doc, start, size = split(num, top)
        first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
        k = np.arange(len(doc))
        piece = k - np.maximum.accumulate(np.where(first, k, 0)) if len(doc) else k
        at = (np.cumsum(num) - num)[doc] + start
        for s in range(top, -1, -1):
            rows = np.flatnonzero(size == s)
            if len(rows):
                values = flat[(at[rows][:, None] + np.arange(1 << s)).ravel()]
                yield pa.record_batch(
                    [np.full(len(rows), s, np.int32), own.take(pa.array(doc[rows])), piece[rows].astype(np.int32), start[rows], np.full(len(rows), 1 << s, np.int32), common.ragged(pa.array(values), np.full(len(rows), 1 << s))],
                    names=names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(path)
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for part in common.steps(batch, "text"):
                ids, n = own.encode(part.column("text"))
                for to, x in zip(held, (part.column("doc_id"), ids, n), strict=True):
                    to.append(x)
                size += len(ids)
                if size >= HOLD:
                    yield from send(*held)
                    held, size = ([], [], []), 0
        yield from send(*held)

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return kept.mapInArrow(run, f"bucket int, doc_id {dict(kept.dtypes)['doc_id']}, piece int, start bigint, length int, token_ids array<int>")
