"""Near duplicates by SimHash.

A document's fingerprint has WORDS words of 64 bits, each a SimHash of its distinct words (runs of letters and digits, in lower
case) by other hashes. Two documents are copies if some word of their fingerprints lies within Hamming distance DISTANCE and
all together within TOTAL: one word alone is close by chance in a large table, all of them aren't. Groups are the connected
components of these pairs.

A word's segment-popcount embedding holds the number of ones in each two-bit segment; the Manhattan distance of two
embeddings never exceeds the Hamming distance of the words. It is kept with each count in unary, two bits for 0, 1 or 2, so that
the Manhattan distance is the number of bits in which two embeddings differ. The range join is over a grid: the segments make up
DISTANCE + s blocks, and words in range agree in all counts of at least s of them, so the grid has a cell for each s blocks
and their counts, and every pair in range meets in a cell. There the Manhattan distance drops most pairs, then the Hamming
distance of the word and of the whole fingerprint decides exactly.

The grid follows the table: s is chosen from the number of distinct fingerprints (fineness), by what a row of a cell costs and how
many pairs meet in cells, so the part of all pairs that meets falls as the table grows. Cells that are still large are split into
square tiles, equal fingerprints are joined before the search, and each tile returns a spanning forest of its pairs, so neither
the tasks nor what they return grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import LETTER, NUMBER, TOP, hashes, tables
from satchel.llm.words import mix

BITS, SEGMENT, DISTANCE = 64, 2, 7
#: Words of a fingerprint, bits of it all that may differ.
WORDS, TOTAL = 4, 40
#: Rows of a tile's side; a row of a cell costs as much as so many pairs.
TILE, ROW = 1 << 15, 800
LAST = (1 << 63) - 1
WORD = [f"w{k}" for k in range(WORDS)]


@lru_cache(1)
def lower() -> np.ndarray:
    """The lower case of each code point, 0 for what isn't a letter or digit."""
    out = np.arange(TOP, dtype=np.uint32)
    for i in range(TOP):
        if not 0xD800 <= i < 0xE000 and len(s := chr(i).lower()) == 1:
            out[i] = ord(s)
    kinds = tables()[0]
    out[(kinds != LETTER) & (kinds != NUMBER)] = 0
    return out


def word_keys(col: pa.Array) -> np.ndarray:
    """The distinct words of each text, as its number and 44 bits of a word's hash, sorted. Long texts are taken in windows."""
    chars = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(col) == 1 and chars[0] > common.STEP_BYTES:
        return np.unique(np.concatenate([word_keys(pa.array([w])) for w in common.windows(col[0].as_py())]))
    cps = lower()[np.frombuffer("".join(col.to_pylist()).encode("utf-32-le"), np.uint32)]
    n = len(cps)
    if not n:
        return np.zeros(0, np.uint64)
    first = np.zeros(n + 1, bool)
    offsets = np.zeros(len(col) + 1, np.int64)
    np.cumsum(chars, out=offsets[1:])
    first[offsets] = True
    word = cps != 0
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes(cps, starts, ends) >> np.uint64(20)))
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def signatures(arr: pa.Array, count: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each text and whether it has one (a text without letters and digits has none)."""
    keys = word_keys(pc.fill_null(arr, ""))
    out, has = np.zeros((len(arr), count), np.uint64), np.zeros(len(arr), bool)
    if not len(keys):
        return out, has
    doc = (keys >> np.uint64(44)).astype(np.int64)
    keys &= np.uint64((1 << 44) - 1)
    bits = np.stack([mix(keys | np.uint64(k << 44)) for k in range(count)], 1).view(np.uint8)
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(doc)], strict=True):
        ones = np.zeros(BITS * count, np.int64)
        for c in range(a, b, 1 << 15):
            ones += np.unpackbits(bits[c : min(b, c + (1 << 15))], axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[doc[a]] = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)
    has[doc[at]] = True
    return out, has


def counts(words: np.ndarray) -> np.ndarray:
    """The embedding: ones in each segment."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(words), BITS // SEGMENT, SEGMENT).sum(2, dtype=np.int32)


def embed(words: np.ndarray) -> np.ndarray:
    """The embedding with its counts in unary: 00, 01 or 11 for each segment."""
    odd = np.uint64(0x5555555555555555)
    low, high = words & odd, (words >> np.uint64(1)) & odd
    return (low | high) | ((low & high) << np.uint64(1))


def fineness(n: int, distance: int = DISTANCE) -> int:
    """How many blocks must agree, for n fingerprints: what costs least, in pairs for each fingerprint. Two random segments have
    equal counts with a probability of 3/8."""
    cost = lambda s: comb(distance + s, s) * (ROW + n / 2 * 0.375 ** (BITS // SEGMENT * s / (distance + s)))
    return min(range(1, 9), key=cost)


@lru_cache(16)
def masks(distance: int, s: int) -> np.ndarray:
    """For each s of distance + s blocks, the bits of an embedding that they hold."""
    parts = np.array_split(np.arange(BITS // SEGMENT), distance + s)
    block = [sum(3 << (SEGMENT * int(i)) for i in p) for p in parts]
    return np.array([sum(block[i] for i in c) for c in combinations(range(distance + s), s)], np.uint64)


def cells(e: np.ndarray, word: int, distance: int, s: int) -> np.ndarray:
    """The cells of each embedding of a word of the fingerprint, a row for each; what two cells have in common by chance is
    sorted out with all other pairs."""
    m = masks(distance, s)
    salt = mix(np.arange(len(m), dtype=np.uint64) + np.uint64(1 + word * len(m)))
    return mix((e[:, None] & m) ^ salt).view(np.int64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, of n, given pairs."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        live = la != lb
        if not live.any():
            return label
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def close(x: np.ndarray, y: np.ndarray | None, distance: int = DISTANCE, total: int = TOTAL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints, of x with itself or of x with y, of which the first words lie within the distance and all together
    within the total."""
    same = y is None
    y = x if same else y
    ex, ey = embed(x[:, 0]), embed(y[:, 0])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(x), 512):
        b = min(a + 512, len(x))
        for c in range(a if same else 0, len(y), 2048):
            d = min(c + 2048, len(y))
            # the Manhattan distance of the embeddings is a lower bound
            p, q = np.nonzero(np.bitwise_count(ex[a:b, None] ^ ey[None, c:d]) <= distance)
            p, q = p + a, q + c
            if same:
                p, q = p[p < q], q[p < q]
            gap = np.bitwise_count(x[p] ^ y[q])
            hit = (gap[:, 0] <= distance) & (gap.sum(1, dtype=np.int64) <= total)
            out.append((p[hit], q[hit]))
    return tuple(np.concatenate([z[k] for z in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def near(nodes: np.ndarray, x: np.ndarray, y: np.ndarray | None, distance: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that close() finds, as nodes (of x, then y): (larger, smaller)."""
    p, q = close(x, y, distance, total)
    if y is not None:
        q = q + len(x)
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    label = roots(len(nodes), rank[p], rank[q])
    far = np.flatnonzero(label != np.arange(len(nodes)))
    values = nodes[order]
    return values[far], values[label[far]]


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, txt, w0, ...) of every row: its id (the greatest bigint for a null), a hash of its text, its fingerprint; null where
    there is nothing to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.steps(batch, "text"):
                own, has = signatures(part.column("text"))
                words = [pa.array(np.ascontiguousarray(own[:, k]).view(np.int64), mask=~has) for k in range(WORDS)]
                yield pa.record_batch([part.column("doc"), part.column("txt"), *words], names=["doc", "txt", *WORD])

    kept = docs.select(F.coalesce(common.integer(docs, id_col), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, ", ".join(["doc bigint, txt bigint", *(f"{c} bigint" for c in WORD)]))


def edges(distinct: DataFrame, distance: int = DISTANCE, total: int = TOTAL, tile: int = TILE, s: int | None = None) -> DataFrame:
    """Pairs (a, b) of nodes whose components are those of all copies. distinct: (node, w0, ...), each fingerprint once."""
    s = s or fineness(distinct.count(), distance)
    distinct = distinct.select("node", *WORD)

    def all_cells(batch: pa.RecordBatch, at: int, end: int) -> np.ndarray:
        return np.concatenate([cells(embed(batch.column(1 + k).to_numpy()[at:end].view(np.uint64)), k, distance, s) for k in range(WORDS)], 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(all_cells(batch, 0, len(batch)), return_counts=True)
            yield pa.record_batch([cell, n], names=["cell", "n"])

    many = distinct.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > tile)
    size = {r.cell: -(-r.n // tile) for r in many.collect()}  # only cells of more than a tile, which fineness makes few
    known = np.array(sorted(size), np.int64)
    tiles = np.array([size[c] for c in known.tolist()], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                cell = all_cells(batch, at, at + 2048)
                each = cell.shape[1] // WORDS
                row = np.repeat(np.arange(len(part)), cell.shape[1])
                word = np.tile(np.repeat(np.arange(WORDS), each), len(part))
                cell = cell.ravel()
                t = np.ones(len(cell), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, cell), len(known) - 1)
                    t = np.where(known[k] == cell, tiles[k], 1)
                node, *words = (c.to_numpy() for c in part.columns)
                mine = (mix(node.view(np.uint64)[row]) % t.astype(np.uint64)).astype(np.int64)
                other = common.ranges(np.zeros(len(t), np.int64), t)
                cell, row, word, mine = (np.repeat(x, t) for x in (cell, row, word, mine))
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                words = np.stack(words, 1)
                # the cell's own word first
                turned = [words[row, (word + j) % WORDS] for j in range(WORDS)]
                yield pa.record_batch([cell, (lo << 32) | hi, mine == hi, node[row], *turned], names=["cell", "tile", "high", "node", *WORD])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, 2):
            cell, tile_no, high, node, *words = (c.to_numpy() for c in t.columns)
            words = np.stack(words, 1).view(np.uint64)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (tile_no[1:] != tile_no[:-1])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if b - a > 1:
                    own, up = words[a:b], high[a:b]
                    if tile_no[a] >> 32 == tile_no[a] & 0xFFFFFFFF:
                        found.append(near(node[a:b], own, None, distance, total))
                    else:
                        found.append(near(np.append(node[a:b][up], node[a:b][~up]), own[up], own[~up], distance, total))
            p, q = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            if len(p):
                yield pa.record_batch([p, q], names=["a", "b"])

    placed = distinct.mapInArrow(spread, ", ".join(["cell bigint, tile bigint, high boolean, node bigint", *(f"{c} bigint" for c in WORD)]))
    placed = placed.repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    return placed.mapInArrow(search, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in pairs (a, b); root is the least node of its component. Alternates the two star
    operations until nothing changes; each round's edges are written out, so its plan stays small."""
    spark = pairs.sparkSession
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, path = common.scratch(pairs.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h")).first()
        if new == mark:
            break
        mark = new
        # large star: what is above a node goes to the least of its neighbours and itself
        e = both(now)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = e.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and those below it go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after, next_path = common.scratch(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        common.drop(spark, path)
        now, path = after, next_path
    roots_ = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots_)


def rooted(docs: DataFrame, id_col: str, text_col: str, distance: int, total: int) -> tuple[DataFrame, list[str]]:
    """(doc, txt, root) of every row that has a fingerprint, root the same for copies alone; and the tables that it reads."""
    common.ready(docs.sparkSession)
    table, path = common.scratch(fingerprint_table(docs, id_col, text_col).filter("w0 is not null"), "fingerprints")
    # the node numbers are written, so they stay what they are
    distinct, distinct_path = common.scratch(table.select(*WORD).distinct().withColumn("node", F.monotonically_increasing_id()), "distinct")
    links = components(edges(distinct, distance, total))
    named = distinct.join(links, "node", "left").select(*WORD, F.coalesce("root", "node").alias("root"))
    return table.join(named, WORD).select("doc", "txt", "root"), [path, distinct_path]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, total: int = TOTAL) -> DataFrame:
    """(doc_id, kept_doc_id, group_size): one row for each row that isn't the first of its group.

    The first is the one with the least id. Rows of null ids come last in a group and are returned with a null doc_id;
    a repeated row counts as a copy of itself, so all but one of it are returned. Texts that are null, empty or without
    letters and digits are nobody's duplicates. Ids must be integers; the greatest bigint stands for null. Other columns of
    docs, whatever their names, are ignored. An empty table gives an empty result. Very long texts are compared whole."""
    t = rooted(docs, id_col, text_col, distance, total)[0]
    # rows of one id in one group are counted before they are brought together: no group comes to one task
    same = t.groupBy("root", "doc").agg(F.count("*").alias("n"))
    whole = same.groupBy("root").agg(F.min("doc").alias("kept"), F.sum("n").alias("group_size")).filter("group_size > 1")
    rest = same.join(whole, "root").withColumn("n", F.col("n") - F.when(F.col("doc") == F.col("kept"), 1).otherwise(0)).filter("n > 0")
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return rest.select(null("doc").alias("doc_id"), null("kept").alias("kept_doc_id"), "group_size", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("col")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, total: int = TOTAL) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least id, then of the least hash of its text; null ids
    come last. Of a row that is given twice one stays. Texts that are null, empty or without letters and digits all stay.
    All columns stay as they are, whatever their names."""
    spark = docs.sparkSession
    t, paths = rooted(docs, id_col, text_col, distance, total)
    same = t.groupBy("root", "doc", "txt").agg(F.count("*").alias("n"))
    first = same.groupBy("root").agg(F.min(F.struct("doc", "txt")).alias("first"), F.sum("n").alias("size")).filter("size > 1")
    # a row for each (doc, txt) of a group: whether it goes, and whether it is given more than once
    marks = same.join(first, "root").select("doc", "txt", (~F.struct("doc", "txt").eqNullSafe(F.col("first"))).alias("goes"), (F.col("n") > 1).alias("again"))
    marks, _ = common.scratch(marks.filter("goes or again"), "marks")
    for path in paths:
        common.drop(spark, path)
    keyed = docs.select(common.whole(docs), F.coalesce(common.integer(docs, id_col), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("txt"))
    # the marks grow with docs: never broadcast them, whatever the size
    marked = keyed.join(marks.hint("merge"), ["doc", "txt"], "left")
    once = marked.filter("goes is null").select("row")
    if not marks.filter("again and not goes").isEmpty():
        once = once.unionByName(marked.filter("not goes").dropDuplicates(["doc", "txt"]).select("row"))
    return once.select("row.*")
