"""Token ids as compressed blocks: a static range asymmetric numeral system over interleaved lanes.

One table of frequencies over all documents' tokens is shared by all blocks. A block holds the tokens of some documents in
LANES interleaved lanes, each with its own state; token j goes to lane j % LANES, so a decoder takes a step of all lanes at
once. Blocks are independent. A block's checkpoints hold the lanes' states and the place in the stream at every EVERY-th
step, so its parts can be decoded in parallel, and a CRC-32 for each part and for the stream finds damage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import default_path, rank_encoder, ranks

SCALE = 20
LANES, BLOCK, EVERY = 512, 1 << 18, 128
LOW = np.uint64(1 << 31)
SCHEMA = "kind string, doc_ids array<bigint>, doc_tokens array<int>, n_tokens bigint, stream binary, states binary, starts array<int>, checksums array<bigint>, checksum bigint, table_checksum bigint"


def table_of(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale; every symbol, counted or not, has at least one."""
    total, size = 1 << scale, len(counts)
    if size > total:
        raise ValueError("more symbols than the scale has places")
    counts = counts.astype(np.float64)
    share = counts / max(counts.sum(), 1) * (total - size)
    freq = np.floor(share).astype(np.int64) + 1
    left = total - int(freq.sum())
    by = np.lexsort((np.arange(size), -counts, np.floor(share) - share))
    freq += left // size
    freq[by[: left % size]] += 1
    return freq.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = EVERY) -> tuple[bytes, bytes, list[int], list[int]]:
    """(stream of 32-bit words, states of all checkpoints, their starts in the stream, CRC-32 of each part's ids)."""
    scale = np.uint64(int(freq.sum()).bit_length() - 1)
    base = np.append(0, np.cumsum(freq[:-1])).astype(np.uint64)
    freq = freq.astype(np.uint64)
    steps = -(-len(ids) // lanes)
    fill = np.full(steps * lanes, int(np.argmax(freq)), np.int64)
    fill[: len(ids)] = ids
    rows = fill.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    states = []
    for first in range((steps - 1) // every * every, -1, -every):
        part = rows[first : first + every]
        f_part, b_part = freq[part], base[part]
        top = f_part << (np.uint64(63) - scale)
        for t in range(len(part) - 1, -1, -1):
            f = f_part[t]
            over = x >= top[t]
            words[first + t] = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            x = (q << scale) + (x - q * f) + b_part[t]
        states.append(x)
    sizes = np.append(0, np.cumsum([len(w) for w in words]))
    own = ids.astype("<i4")
    sums = [zlib.crc32(own[a : a + every * lanes].tobytes()) for a in range(0, len(ids), every * lanes)]
    return (np.concatenate(words) if words else np.zeros(0, np.uint32)).astype("<u4").tobytes(), (np.stack(states[::-1]) if states else np.zeros(0)).astype("<u8").tobytes(), sizes[:-1:every].tolist() if steps else [], sums


def decode_part(part: int, n: int, stream: bytes, states: bytes, starts: list[int], checksums: list[int], freq: np.ndarray, lanes: int = LANES, every: int = EVERY) -> np.ndarray:
    """The ids of one part of a block of n tokens, alone; raises ValueError on damage."""
    scale = int(freq.sum()).bit_length() - 1
    base = np.append(0, np.cumsum(freq[:-1])).astype(np.uint64)
    symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    freq = freq.astype(np.uint64)
    x = np.frombuffer(states, "<u8").reshape(-1, lanes)[part].astype(np.uint64)
    words = np.frombuffer(stream, "<u4")
    at = starts[part]
    first = part * every
    out = []
    try:
        for _ in range(first, min(first + every, -(-n // lanes))):
            slot = x & np.uint64((1 << scale) - 1)
            s = symbol[slot]
            out.append(s)
            x = freq[s] * (x >> np.uint64(scale)) + slot - base[s]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << np.uint64(32) | words[at : at + len(low)]
            at += len(low)
    except (ValueError, IndexError) as e:
        raise ValueError("damaged stream") from e
    ids = np.concatenate(out)[: min(n - first * lanes, every * lanes)]
    if zlib.crc32(ids.astype("<i4").tobytes()) != checksums[part]:
        raise ValueError("damaged stream")
    return ids


def decode_block(n: int, stream: bytes, states: bytes, starts: list[int], checksums: list[int], freq: np.ndarray, lanes: int = LANES, every: int = EVERY) -> np.ndarray:
    parts = [decode_part(p, n, stream, states, starts, checksums, freq, lanes, every) for p in range(len(starts))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def compress(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """All documents' tokens as blocks, and one row of kind 'table' whose stream holds the shared frequencies (uint32).

    doc_ids and doc_tokens list a block's documents in the order of their tokens; a null text has -1 tokens, an empty one 0.
    Null ids and repeated rows are kept as they are; a document longer than a block makes a longer block. Ids must be
    integers. Other columns, whatever their names, are ignored. An empty table gives the table row alone, with equal frequencies."""
    spark = docs.sparkSession
    common.ready(spark)
    path = path or default_path()
    size = len(ranks(path))
    width = "<u2" if size <= 1 << 16 else "<u4"  # of an id between the two passes

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(path)
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for part in common.steps(batch, "text"):
                text = part.column("text")
                ids, n = own.encode(text)
                seen += np.bincount(ids, minlength=size)
                null = pc.is_null(text).to_numpy(zero_copy_only=False)
                edge = np.append(0, np.cumsum(n)).astype(np.int32) * np.dtype(width).itemsize
                held = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge), pa.py_buffer(ids.astype(width))])
                yield pa.record_batch([part.column("doc_id"), pa.array(np.where(null, -1, n).astype(np.int32)), held, pa.nulls(len(n), pa.list_(pa.int32())), pa.nulls(len(n), pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "symbols", "counts"])
        some = np.flatnonzero(seen)
        if len(some):
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([some.astype(np.int32)]), pa.array([seen[some]])], names=["doc_id", "n", "ids", "symbols", "counts"])

    kept = docs.select(common.integer(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table, _ = common.scratch(kept.mapInArrow(tokens, "doc_id bigint, n int, ids binary, symbols array<int>, counts array<bigint>"), "tokens")
    pairs = table.filter("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("z"))
    counts = np.zeros(size, np.int64)
    for r in pairs.groupBy("z.symbols").agg(F.sum("z.counts").alias("c")).collect():  # at most the vocabulary
        counts[r[0]] = r[1]
    freq = table_of(counts, max(SCALE, size.bit_length() + 3))
    table_sum = zlib.crc32(freq.tobytes())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = np.concatenate([np.frombuffer(x or b"", width) for x in t.column("ids").to_pylist()]).astype(np.int64)
            stream, states, starts, sums = encode_block(ids, freq)
            row = {"kind": "block", "doc_ids": t.column("doc_id").to_pylist(), "doc_tokens": t.column("n").to_pylist(), "n_tokens": len(ids), "stream": stream, "states": states, "starts": starts, "checksums": sums, "checksum": zlib.crc32(stream), "table_checksum": table_sum}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            n = np.maximum(batch.column("n").to_numpy(), 0)
            at = 0
            while at < len(n):
                room = np.cumsum(n[at:]) + total
                end = at + int(np.searchsorted(room, block)) + 1
                held.append(batch.slice(at, end - at))
                total = int(room[min(end - at, len(room)) - 1])
                at = end
                if total >= block:
                    yield done()
                    held.clear()
                    total = 0
        if held:
            yield done()

    first = spark.createDataFrame([("table", None, None, int(counts.sum()), freq.astype("<u4").tobytes(), None, None, None, zlib.crc32(freq.tobytes()), table_sum)], SCHEMA)
    return table.filter("n is not null").select("doc_id", "n", "ids").mapInArrow(blocks, SCHEMA).unionByName(first)


ARROW = pa.schema(
    [("kind", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("stream", pa.binary()), ("states", pa.binary()), ("starts", pa.list_(pa.int32())), ("checksums", pa.list_(pa.int64())), ("checksum", pa.int64()), ("table_checksum", pa.int64())]
)


def expand(blocks: DataFrame) -> DataFrame:
    """(doc_id, token_ids) of every document of compress()'s blocks: its inverse. Damage is an error. token_ids is null for a
    null text."""
    spark = blocks.sparkSession
    common.ready(spark)
    row = blocks.filter("kind = 'table'").select("stream", "table_checksum").first()
    freq, table_sum = np.frombuffer(row[0], "<u4"), row[1]
    if zlib.crc32(row[0]) != table_sum:
        raise ValueError("damaged table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                if zlib.crc32(b["stream"]) != b["checksum"]:
                    raise ValueError("damaged stream")
                if b["table_checksum"] != table_sum:
                    raise ValueError("a block of another table")
                ids = decode_block(b["n_tokens"], b["stream"], b["states"], b["starts"], b["checksums"], freq)
                n = np.array(b["doc_tokens"])
                yield pa.record_batch([pa.array(b["doc_ids"], pa.int64()), common.ragged(pa.array(ids.astype(np.int32)), np.maximum(n, 0), n < 0)], names=["doc_id", "token_ids"])

    return blocks.filter("kind = 'block'").mapInArrow(run, "doc_id bigint, token_ids array<int>")
