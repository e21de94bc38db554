"""Exact top-k by inner product, for all rows or a set of queries among them.

Vectors are laid out in shards by their nearest pivot (the pivots only lay out the data: the result doesn't depend on them).
Each shard has a ball tree, and a ball about its pivot. A query first searches its own shard, then the NEXT shards of the
greatest upper bounds, then all others that could still hold a better one: from round to round its current kth score goes with
it, decides which shards it is sent to, and bounds the search there from the start. A search takes the nodes in the order of their
upper bound, q.c + |q| r for a ball of centre c and radius r, for a block of queries at once: of a block, only those go into
a node whose bound reaches their kth score.

Shards number about sqrt(rows) / 8, so neither the pivots that are shipped nor a shard grow in proportion to the table. A
cell that is much larger than the rest is divided by hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm import common

K = 10
#: Vectors of a leaf at most, queries of a block at most.
LEAF, BLOCK = 256, 512
#: Shards of a query's second round.
NEXT = 4
#: Scores are ranked after rounding to this many places, so that equal vectors tie; bounds get this much more.
PLACES, SLACK = 9, 1e-8
SCHEMA = "vec_id bigint, own bigint, neighbor_id bigint, other bigint, score double"


class Tree:
    """A ball tree: node i has the rows order[lo[i]:hi[i]] and children left[i] and left[i] + 1, or none (-1)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.left, centres, radii = [0], [len(x)], [-1], [], []
        at = 0
        while at < len(self.lo):
            a, b = self.lo[at], self.hi[at]
            own = x[self.order[a:b]]
            centre = own.mean(0)
            far = np.sqrt(((own - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(float(far.max()) * (1 + 1e-12))
            if b - a > leaf and radii[-1] > 0:
                # split at the median along the line through two far points
                p = own[far.argmax()]
                d = own[((own - p) ** 2).sum(1).argmax()] - p
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own @ d, mid)]
                self.left[at] = len(self.lo)
                self.lo += [a, a + mid]
                self.hi += [a + mid, b]
                self.left += [-1, -1]
            at += 1
        self.centres, self.radii = np.array(centres), np.array(radii)


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's best k rows among those that reach kth; a query doesn't find its own row."""
    norm = np.sqrt((q * q).sum(1))
    kth = kth.copy()
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bound = lambda node, r: q[r] @ tree.centres[node] + norm[r] * tree.radii[node] + SLACK
    every = np.arange(len(q))
    b = bound(0, every)
    heap = [(-float(b.max()), 0, every, b)] if len(q) else []
    while heap:
        _, node, rows, b = heapq.heappop(heap)
        live = b >= kth[rows]
        rows = rows[live]
        if not len(rows):
            continue
        if tree.left[node] >= 0:
            for child in (tree.left[node], tree.left[node] + 1):
                b = bound(child, rows)
                live = b >= kth[rows]
                if live.any():
                    heapq.heappush(heap, (-float(b[live].max()), child, rows[live], b[live]))
            continue
        part = tree.order[tree.lo[node] : tree.hi[node]]
        for s in range(0, len(part), 4 * LEAF):  # a leaf of equal vectors may be long
            some = part[s : s + 4 * LEAF]
            scores = np.round(q[rows] @ x[some].T, PLACES)
            r, c = np.nonzero(scores >= kth[rows][:, None])
            v, r, c = scores[r, c], rows[r], some[c]
            fine = (ids[c] != q_ids[r]) | (own[c] != q_own[r])
            r, c, v = r[fine], c[fine], v[fine]
            if not len(r):
                continue
            touched = np.zeros(len(q), bool)
            touched[r] = True
            mine = touched[held[0]]
            r, c, v = np.concatenate([held[0][mine], r]), np.concatenate([held[1][mine], c]), np.concatenate([held[2][mine], v])
            by = np.lexsort((own[c], ids[c], -v, r))
            r, c, v = r[by], c[by], v[by]
            first = np.append(True, r[1:] != r[:-1])
            place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
            keep = place < k
            last = place == k - 1
            kth[r[last]] = np.maximum(kth[r[last]], v[last])
            held = tuple(np.concatenate([h[~mine], new[keep]]) for h, new in zip(held, (r, c, v), strict=True))
    return held


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _visit(k: int):
    """Rows sorted by shard, a shard's vectors (kind 0) before the queries (kind 1) that search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree, x, ids, own = None, [], None, None, None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_pylist(), batch.column("kind").to_numpy()
            edges = [0, *(i for i in range(1, len(shard)) if shard[i] != shard[i - 1] or kind[i] != kind[i - 1]), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, held, tree = shard[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if tree is None:
                    t = pa.Table.from_batches(held)
                    x = np.concatenate([_matrix(p.column("v")) for p in held])
                    ids, own = t.column("vec_id").to_numpy(), t.column("own").to_numpy()
                    tree, held = Tree(x), []
                for s in range(0, len(part), BLOCK):
                    block = part.slice(s, BLOCK)
                    q_ids, q_own = block.column("vec_id").to_numpy(), block.column("own").to_numpy()
                    q, c, v = search(tree, x, ids, own, _matrix(block.column("v")), q_ids, q_own, block.column("kth").to_numpy(), k)
                    yield pa.record_batch([q_ids[q], q_own[q], ids[c], own[c], v], names=["vec_id", "own", "neighbor_id", "other", "score"])

    return run


def _pivots(clean: DataFrame, many: dict[int, int]) -> dict[int, np.ndarray]:
    """So many vectors of each length, those of the least hashes."""
    out = {}
    for d, n in sorted(many.items()):
        rows = clean.filter(F.size("v") == d).orderBy(F.xxhash64("own"), "vec_id", "own").select("v").limit(n).collect()
        out[d] = np.array(sorted(list(r.v) for r in rows), float)
    return out


def _send(pivots: dict[int, np.ndarray], radii: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], home: bool | None):
    """Queries to shards. home: True for their own, False for the NEXT others by the bound, None for all beyond these, as far as the
    bound reaches the kth score. The order of the shards is that of the bounds, which don't change from round to round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            for size in np.unique(d).tolist():
                part = batch.filter(pa.array(d == size))
                names, at, r = radii[size]
                c = pivots[size][at]
                for s in range(0, len(part), 1024):
                    some = part.slice(s, 1024)
                    mine = names == some.column("shard").to_numpy(zero_copy_only=False)[:, None]
                    if home:
                        hit = mine
                    else:
                        x = _matrix(some.column("v"))
                        bound = np.where(mine, -np.inf, x @ c.T + np.sqrt((x**2).sum(1))[:, None] * r + SLACK)
                        place = np.empty(bound.shape, np.int64)
                        np.put_along_axis(place, np.argsort(-bound, 1, kind="stable"), np.arange(bound.shape[1])[None], 1)
                        hit = ~mine & (bound >= some.column("kth").to_numpy()[:, None]) & ((place < NEXT) if home is False else (place >= NEXT))
                    row, to = np.nonzero(hit)
                    own = some.take(pa.array(row))
                    yield pa.record_batch([pa.array(names[to], pa.string()), pa.array(np.ones(len(row), np.int32)), *(own.column(k) for k in ("vec_id", "own", "v", "kth"))], names=["shard", "kind", "vec_id", "own", "v", "kth"])

    return run


def top_k(table: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k rows of the greatest inner product with each query, itself left out, the score
    rounded to six places. Ties go to the lesser id. Queries are the rows whose id is divisible by `every`, and with 1 all rows,
    those of a null id too.

    Vectors that are null or empty, or hold a null, NaN or infinity, neither search nor are found; vectors are compared with
    those of the same length. A row given twice counts once; rows of one id with different vectors are different rows. A
    null id counts as the greatest number, and is null in the result; ids must be integers. Other columns, whatever their
    names, are ignored. An empty table gives an empty result, and a row with fewer than k others finds all of them."""
    spark = table.sparkSession
    common.ready(spark)
    top = (1 << 63) - 1
    v = F.col("v")
    kind = table.select(F.col(vector_col)).dtypes[0][1]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    clean = table.select(F.coalesce(common.integer(table, id_col), F.lit(top)).alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    clean = clean.filter(v.isNotNull() & (F.size(v) > 0)).filter(~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    clean = clean.select("vec_id", F.xxhash64("v").alias("own"), "v").dropDuplicates(["vec_id", "own"])
    clean, clean_path = common.scratch(clean, "vectors")
    sizes = {r.d: r.n for r in clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    number = {d: shards or max(1, -(-int(n**0.5) // 8)) for d, n in sizes.items()}
    pivots = _pivots(clean, number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest pivot and its distance."""
        for batch in batches:
            col = batch.column("v")
            d = col.value_lengths().to_numpy()
            cell, far = np.zeros(len(d), np.int64), np.zeros(len(d))
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                x, p = _matrix(col.take(pa.array(at))), pivots[size]
                cell[at] = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
                far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1)) * (1 + 1e-12)
            yield pa.record_batch([*batch.columns, pa.array(d.astype(np.int32)), pa.array(cell), pa.array(far)], names=[*batch.schema.names, "d", "cell", "far"])

    placed, _ = common.scratch(clean.mapInArrow(place, f"vec_id bigint, own bigint, v {kind}, d int, cell bigint, far double"), "placed")
    common.drop(spark, clean_path)
    counted = {(r.d, r.cell): r.n for r in placed.groupBy("d", "cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    parts = {c: max(1, -(-n // (2 * -(-sizes[c[0]] // number[c[0]])))) for c, n in counted.items()}
    split = {f"{d}/{c}": m for (d, c), m in parts.items() if m > 1}
    name = F.concat_ws("/", "d", "cell")
    salt = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in split.items() for x in p)), name), F.lit(1)) if split else F.lit(1)
    sharded = placed.select("vec_id", "own", "v", "d", "cell", "far", F.concat_ws("/", name, F.pmod(F.xxhash64("own", "vec_id"), salt)).alias("shard"))
    radii: dict[int, list] = {}
    for r in sharded.groupBy("d", "shard").agg(F.min("cell").alias("cell"), F.max("far").alias("far")).orderBy("shard").collect():  # a row for each shard
        radii.setdefault(r.d, []).append((r.shard, r.cell, r.far))
    balls = {d: (np.array([x[0] for x in own], object), np.array([x[1] for x in own]), np.array([x[2] for x in own])) for d, own in radii.items()}
    data = sharded.select("shard", F.lit(0).alias("kind"), "vec_id", "own", "v", F.lit(float("-inf")).alias("kth"))
    asked = sharded.select("vec_id", "own", "v", "d", "shard")
    if every != 1:
        asked = asked.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != top))
    found = None
    for home in (True, False, None):
        if found is None:
            now = asked.withColumn("kth", F.lit(float("-inf")))
        else:
            bar = found.groupBy("vec_id", "own").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            now = asked.join(bar, ["vec_id", "own"], "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        sent = now.mapInArrow(_send(pivots, balls, home), f"shard string, kind int, vec_id bigint, own bigint, v {kind}, kth double")
        got = data.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_visit(k), SCHEMA)
        by = Window.partitionBy("vec_id", "own").orderBy(F.desc("score"), "neighbor_id", "other")
        best = (got if found is None else found.unionByName(got)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if home is not None:
            found, _ = common.scratch(best.drop("rank"), "found")
    null = lambda c: F.when(F.col(c) != top, F.col(c))
    return best.select(null("vec_id").alias("vec_id"), "rank", null("neighbor_id").alias("neighbor_id"), F.round("score", 6).alias("score"))
