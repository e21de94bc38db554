"""Byte-level BPE with a sentencepiece model that is made directly from a vocabulary.

The model is serialised here: each token's bytes are mapped to printable characters, one for each byte value, and the
piece's score is its negative rank, so that sentencepiece merges in the order of the ranks; normalisation is the identity.
Pre-tokens are encoded by it, each distinct one once in a while (see pretok); ids are the ranks, of which sentencepiece's are
one more (its piece 0 is the unknown piece). Decoding joins the bytes of the ids' tokens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import Encoder, default_path, ranks


@lru_cache(1)
def byte_chars() -> str:
    """256 distinct characters for the byte values: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model of a vocabulary whose ranks are 0, 1, ... without gaps."""
    chars = byte_chars()
    tokens = sorted(vocabulary, key=vocabulary.__getitem__)
    if [vocabulary[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, ... without gaps")
    score = lambda x: b"\x15" + struct.pack("<f", x)  # noqa: E731 - field 2, a float
    out = [_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + score(-float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0)  # BPE; no begin, end or pad piece below
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """Pre-tokens by sentencepiece, kept for the worker's life."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks(path)))
    table = {b: c for b, c in enumerate(byte_chars())}

    def pieces(words: list[str]) -> list[list[int]]:
        mapped = [w.encode().decode("latin-1").translate(table) for w in words]
        return [[i - 1 for i in ids] for ids in model.encode(mapped, num_threads=1)]

    return Encoder(pieces)


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, their starts and their lengths, by id."""
    by = sorted(ranks(path).items(), key=lambda x: x[1])
    num = np.array([len(t) for t, _ in by], np.int64)
    return np.frombuffer(b"".join(t for t, _ in by), np.uint8), np.cumsum(num) - num, num


def decode_flat(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another and how many each has, from all ids and the texts' counts of them."""
    flat, start, num = token_bytes(path)
    out = flat[common.ranges(start[ids], num[ids])]
    total = np.append(0, np.cumsum(num[ids]))
    edge = np.append(0, np.cumsum(counts))
    return out, np.diff(total[edge])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, decodes) of every row; decodes: whether the ids decode to exactly the text's bytes.

    A null text has null token_ids, n_tokens and decodes; an empty one has no ids and decodes. Rows that repeat, and
    null ids, are kept as they are. Other columns, whatever their names, are ignored. Texts of any length are encoded
    whole: long ones are cut only where no pre-token crosses."""
    spark = docs.sparkSession
    common.ready(spark)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in common.steps(batch, "text"):
                text = part.column("text")
                ids, n = own.encode(text)
                raw, offsets = common.flat_bytes(text)
                back, sizes = decode_flat(ids, n, path)
                null = pc.is_null(text).to_numpy(zero_copy_only=False)
                good = sizes == np.diff(offsets)
                if len(back) == len(raw):
                    differs = np.append(0, np.cumsum(back != raw))
                    good &= differs[offsets[1:]] == differs[offsets[:-1]]
                else:
                    edge = np.append(0, np.cumsum(sizes))
                    good = np.array([np.array_equal(back[edge[k] : edge[k + 1]], raw[offsets[k] : offsets[k + 1]]) for k in range(len(n))])
                yield pa.record_batch([part.column("doc_id"), common.ragged(pa.array(ids), n, null), pa.array(n.astype(np.int32), mask=null), pa.array(good, mask=null)], names=["doc_id", "token_ids", "n_tokens", "decodes"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, token_ids array<int>, n_tokens int, decodes boolean")


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of every row: the inverse of encode. Null ids give a null text; an id that isn't in the vocabulary is
    an error; bytes that aren't UTF-8 (ids cut inside a character) become U+FFFD."""
    common.ready(tokens.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, sizes = decode_flat(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, path)
            edge = np.append(0, np.cumsum(sizes)).tolist()
            null = pc.is_null(ids).to_pylist()
            data = raw.tobytes()
            yield pa.record_batch([batch.column("doc_id"), pa.array([None if z else data[a:b].decode(errors="replace") for z, a, b in zip(null, edge, edge[1:], strict=False)], pa.string())], names=["doc_id", "text"])

    kept = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, text string")
