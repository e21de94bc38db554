"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come back.

A batch holds texts of about BATCH bytes together, whatever their number, and is encoded by one call; a text longer than that is cut
where the tokenizer never joins what it cuts, and its pieces are spread over batches, so no batch is much larger than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import default_path, pieces_of, tiktoken_of

BATCH = 1 << 18


def balanced(texts: list[str], limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts of batches of about limit bytes of UTF-8; long texts come in pieces."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        n = len(text) if text.isascii() else len(text.encode())
        # as many characters as have about limit bytes
        for piece in [text] if n <= limit else pieces_of(text, max(1, limit * len(text) // n)):
            n = len(piece) if piece.isascii() else len(piece.encode())
            if held and size + n > limit:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(piece)
            size += n
    if held:
        yield rows, held


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH) -> DataFrame:
    """(doc_id, n_tokens, n_bytes) of every row, by the rank file's tokenizer.

    A null text has null counts, an empty one 0. Repeated rows and null ids are kept as they are; other columns, whatever
    their names, are ignored. An empty table gives an empty result. Texts of any length are counted whole."""
    common.ready(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken_of(path).encode_ordinary_batch
        for batch in batches:
            text = batch.column("text")
            n = np.zeros(len(text), np.int64)
            for rows, held in balanced(pc.fill_null(text, "").to_pylist(), batch_bytes):
                np.add.at(n, np.array(rows), list(map(len, encode(held, num_threads=1))))
            null = pc.is_null(text).to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, mask=null), pa.array(common.lens_of(text), mask=null)], names=["doc_id", "n_tokens", "n_bytes"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, n_tokens bigint, n_bytes bigint")
