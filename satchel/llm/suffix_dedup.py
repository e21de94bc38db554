"""Repeated passages, found with suffix arrays.

A run of WORDS words that occurs earlier, in the order of (doc_id, place), is a repeat; a document's spans are the unions of
its repeats. Words are runs of bytes other than ASCII white space.

Every run of WORDS words belongs to its minimizer, the least hash of GRAM words in a row in it. Neighbouring runs with one
minimizer make up a piece of text, so each run lies in exactly one piece and equal runs lie in pieces of equal minimizers:
pieces can be sharded by minimizer, whatever the documents are. A piece alone with its minimizer, which it holds once, needs no
more work. Equal pieces repeat one another throughout; they are told by their numbers of words and two hashes that have nothing in
common, of 64 and 31 bits, over 64-bit hashes of the words that aren't linear in their bytes. What differs within a minimizer
(the edges of passages and of edits) goes to the suffix arrays of its shard, where words are compared by their bytes:
induced sorting, permuted common prefixes, and groups of suffixes that share WORDS words.

Minimizers may be hot: a passage that a third of all documents share is one. Pieces meet in a stream sorted by minimizer and
content, of which a worker holds one batch. Minimizers that a frequent-items sketch finds HOT don't go there at all: their
distinct pieces are counted with partial aggregates before the shuffle, and the copies join the first ones, which adaptive
execution splits where they are skewed. The distinct pieces of a hot minimizer, and those of one with more than CROWD distinct
ones, are divided into their runs, whose first ones are found in the same way; a suffix array would show the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.suffix_array import common_prefixes, suffix_array
from satchel.llm.words import bounds, grams, hash_words, mix, prime_sums, windows, word_ids

WORDS, GRAM = 50, 16
#: Runs of a piece at most: longer ones are divided (they keep their minimizer).
RUNS = 256
#: Pieces of one minimizer that make it hot, and distinct ones that make it crowded.
HOT, CROWD = 1 << 14, 4096
#: The sketch of minimizers: parts, items that a part tracks, items that a part reports at most. A minimizer of more than about
#: 1 / (PARTS * TRACKED) of all pieces is found; one of fewer can be streamed through one task.
PARTS, TRACKED, REPORTED = 128, 1024, 64
#: Words that one suffix array takes, about.
SHARD = 1 << 20
LAST = (1 << 63) - 1
PIECE = "mini bigint, content bigint, more int, doc bigint, txt bigint, pos int, n int"
KIND = ["mini", "content", "more"]


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    n = len(h) - w + 1
    pad = np.full(-(-len(h) // w) * w, np.uint64((1 << 64) - 1))
    pad[: len(h)] = h
    rows = pad.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def pieces(h: np.ndarray, firsts: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first word, runs, minimizer, two hashes of the content) of the pieces of texts with hashed words h. Runs are
    negative for a piece that may repeat itself."""
    if len(h) < words:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    grams_, width = grams(h, gram), words - gram + 1
    low = least(grams_, width)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[: len(low)]
    ok = np.arange(len(low)) + words <= firsts[text + 1]
    new = ok.copy()
    new[1:] &= (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return pieces(h[:0], firsts, words, gram)
    stop = np.minimum(np.append(start[1:], len(low)), firsts[text[start] + 1] - words + 1)
    many = -(-(stop - start) // RUNS)
    if (many > 1).any():
        k = common.ranges(np.zeros(len(start), np.int64), many)
        start, stop = np.repeat(start, many) + k * RUNS, np.repeat(stop, many)
        stop = np.minimum(stop, start + RUNS)
    from satchel.llm.pretok import powers

    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    content = mix((sums[stop + words - 1] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    # a piece that holds its minimizer more than once may repeat itself: its number of runs is given below 0
    span = stop - start + width - 1
    hits = np.add.reduceat(grams_[common.ranges(start, span)] == np.repeat(low[start], span), np.cumsum(span) - span)
    return text[start], start - firsts[text[start]], np.where(hits > 1, start - stop, stop - start), low[start], content, prime_sums(h, start, stop + words - 1)


def scan(part: pa.RecordBatch, overlap: int) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first word, how many are its own, bytes, starts, ends, texts' first words) of a step's texts: all at once, or
    a long text alone by windows. The number of own words is None for the last, or only, window."""
    raw, offsets = common.flat_bytes(part.column("text"))
    if len(part) > 1 or len(raw) <= common.STEP_BYTES:
        starts, ends, firsts = bounds(raw, offsets)
        yield 0, None, raw, starts, ends, firsts
        return
    for first, own, starts, ends in windows(raw, common.STEP_BYTES, overlap):
        yield first, own if own < len(starts) else None, raw, starts, ends, np.array([0, len(starts)])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by all their columns but n: what repeats outright (mini null, first_doc set), and one of each of the pieces
    that still have to be compared. Held from batch to batch: the last row, the first of its kind, and its minimizer's only kind
    so far, of which it isn't known yet whether there is another."""
    last = first = only = None
    kinds = 0
    for batch in batches:
        if not len(batch):
            continue
        mini, content, more, doc, txt, pos, n = (c.to_numpy() for c in batch.columns)
        lead = last is None or mini[0] != last[0]
        group = np.append(lead, mini[1:] != mini[:-1])
        kind = group | np.append(last is None or (content[0], more[0]) != last[1:3], (content[1:] != content[:-1]) | (more[1:] != more[:-1]))
        again = np.append(last is not None and not kind[0] and (doc[0], txt[0], pos[0]) == last[3:6], (doc[1:] == doc[:-1]) & (txt[1:] == txt[:-1]) & (pos[1:] == pos[:-1]))
        # a row that is given twice is one document
        copy = np.flatnonzero(~kind & ~again)
        at = np.maximum.accumulate(np.where(kind, np.arange(len(kind)), -1))
        source = doc[np.maximum(at, 0)]
        source[at < 0] = first if first is not None else 0
        # a minimizer's kinds so far, with those of earlier batches for the first one
        begin = np.flatnonzero(group) if group[0] else np.append(0, np.flatnonzero(group))
        seen = np.add.reduceat(kind.astype(np.int64), begin)
        seen[0] += 0 if lead else kinds
        number = np.repeat(seen, np.diff(np.append(begin, len(kind))))
        cand = np.flatnonzero(kind & ((number > 1) | (n < 0)))
        rows = [np.concatenate([x[copy], x[cand]]) for x in (mini, doc, txt, pos, np.abs(n))]
        if only is not None and not lead and seen[0] > 1:
            rows = [np.append(x, np.array(o, x.dtype)) for x, o in zip(rows, only, strict=True)]
        null = np.arange(len(rows[0])) < len(copy)
        came = np.zeros(len(null), np.int64)
        came[null] = source[copy]
        yield pa.record_batch([pa.array(rows[0], mask=null), *rows[1:], pa.array(came, mask=~null)], names=["mini", "doc", "txt", "pos", "n", "first_doc"])
        last, first = (mini[-1], content[-1], more[-1], doc[-1], txt[-1], pos[-1]), source[-1]
        if len(begin) > 1 or lead:  # another minimizer than the held one is the last
            only = None
            if seen[-1] == 1:
                k = int(np.flatnonzero(kind)[-1])
                only = (mini[k], doc[k], txt[k], pos[k], n[k]) if n[k] > 0 else None
        elif seen[-1] > 1:
            only = None
        kinds = int(seen[-1])


def first_ones(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the first (doc, txt, pos, n) of each as `f`, and how many there are: counted before the shuffle."""
    return table.groupBy(*keys).agg(F.min(F.struct("doc", "txt", "pos", "n")).alias("f"), F.count("*").alias("many"))


def copies_of(table: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, txt, pos, n, first_doc) of all rows that aren't the first of their keys."""
    several = kinds.filter("many > 1").select(*keys, F.struct("f.doc", "f.txt", "f.pos").alias("f"))
    other = ~F.struct("doc", "txt", "pos").eqNullSafe(F.col("f"))
    return table.join(several.hint("merge"), keys).filter(other).select("doc", "txt", "pos", F.abs("n").alias("n"), F.col("f.doc").alias("first_doc"))


def spans_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """(doc, txt, start, stop, first_doc): words [start, stop) of a row that are repeats; txt is xxhash64 of the text."""
    spark = docs.sparkSession
    common.ready(spark)
    table = docs.select(F.coalesce(common.integer(docs, id_col), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text")).filter("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.steps(batch, "text"):
                for at, _, raw, starts, ends, firsts in scan(part, words - 1):
                    t, pos, n, mini, content, more = pieces(hash_words(raw, starts, ends), firsts, words, gram)
                    doc, txt = (part.column(k).to_numpy()[t] for k in (0, 1))
                    yield pa.record_batch([mini.view(np.int64), content.view(np.int64), more.astype(np.int32), doc, txt, (pos + at).astype(np.int32), n.astype(np.int32)], names=[c.split()[0] for c in PIECE.split(", ")])

    every, path = common.scratch(table.mapInArrow(cut, PIECE), "cut")
    found = every.groupBy(F.pmod("mini", F.lit(PARTS)).alias("part")).agg(F.expr(f"approx_top_k(mini, {REPORTED}, {TRACKED})").alias("top"))
    busy = [r[0] for r in found.select(F.explode("top").alias("t")).filter(F.col("t.count") >= hot).select("t.item").collect()]  # PARTS * REPORTED at most
    calm = every.filter(~F.col("mini").isin(busy)) if busy else every
    met, _ = common.scratch(calm.repartition("mini").sortWithinPartitions(*KIND, "doc", "txt", "pos").mapInArrow(meet, "mini bigint, doc bigint, txt bigint, pos int, n int, first_doc bigint"), "pieces")
    candidates = met.filter("mini is not null").drop("first_doc").withColumn("crowded", F.count("*").over(Window.partitionBy("mini")) > crowd)
    repeats = met.filter("mini is null").select("doc", "txt", "pos", "n", "first_doc")
    lone = None
    if busy:
        own = every.filter(F.col("mini").isin(busy))
        kinds, _ = common.scratch(first_ones(own, KIND), "kinds")
        again, _ = common.scratch(copies_of(own, kinds, KIND), "copies")
        repeats = repeats.unionByName(again)
        lone = kinds.select("mini", "f.doc", "f.txt", "f.pos", F.abs("f.n").alias("n"), F.lit(True).alias("crowded"))
    common.drop(spark, path)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The pieces to look up in each text or window: (batch, text's row, minimizer, place in the window, runs, the window)."""
        for batch in batches:
            for part in common.steps(batch, "text"):
                want = part.column("want")
                row_ = np.repeat(np.arange(len(part)), want.value_lengths().to_numpy())
                mini_, pos_, n_ = (want.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
                for at, own, *window in scan(part, RUNS + words):
                    mine = np.flatnonzero((pos_ >= at) & (pos_ < at + own)) if own is not None else np.flatnonzero(pos_ >= at)
                    yield part, row_[mine], mini_[mine], pos_[mine].astype(np.int64) - at, n_[mine].astype(np.int64), at, *window

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of each piece to compare."""
        for part, row, mini, pos, n, at, raw, starts, ends, firsts in wanted(batches):
            a = starts[firsts[row] + pos]
            b = ends[firsts[row] + pos + n + words - 2]
            doc, txt = (part.column(k).to_numpy()[row] for k in ("doc", "txt"))
            for s in range(0, len(a), 4096):
                e = min(s + 4096, len(a))
                out = np.append(0, np.cumsum(b[s:e] - a[s:e]))
                held = raw[common.ranges(a[s:e], b[s:e] - a[s:e])]
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), e - s, [None, pa.py_buffer(out), pa.py_buffer(held)]).cast(pa.binary())
                yield pa.record_batch([mini[s:e], doc[s:e], txt[s:e], (pos[s:e] + at).astype(np.int32), text], names=["mini", "doc", "txt", "pos", "piece"])

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of each piece, with two hashes of what they hold."""
        for part, row, _, pos, n, at, raw, starts, ends, firsts in wanted(batches):
            h = hash_words(raw, starts, ends)
            run, row = common.ranges(firsts[row] + pos, n), np.repeat(row, n)
            doc, txt = (part.column(k).to_numpy()[row] for k in ("doc", "txt"))
            if len(run):
                yield pa.record_batch([grams(h, words)[run].view(np.int64), prime_sums(h, run, run + words).astype(np.int32), doc, txt, (run - firsts[row] + at).astype(np.int32), np.ones(len(run), np.int32)], names=["mini", "more", "doc", "txt", "pos", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, 1, SHARD // (2 * words)):
            doc, txt, pos = (t.column(k).to_numpy() for k in (1, 2, 3))
            raw, offsets = common.flat_bytes(t.column("piece").combine_chunks().cast(pa.string()))
            yield shard(raw, offsets, doc, txt, pos.astype(np.int64), words)

    def texts(of: DataFrame) -> DataFrame:
        """Each text with the list of its pieces that are looked up."""
        want = of.groupBy("doc", "txt").agg(F.collect_list(F.struct("mini", "pos", "n")).alias("want"))
        # a row that is given twice has its pieces taken twice; equal places count once
        return table.join(want.hint("merge"), ["doc", "txt"]).select("doc", "txt", "text", "want")

    marked, _ = common.scratch(candidates, "candidates")
    taken = texts(marked.filter("not crowded")).mapInArrow(take, "mini bigint, doc bigint, txt bigint, pos int, piece binary")
    repeats = repeats.unionByName(taken.repartition("mini").sortWithinPartitions("mini").mapInArrow(sort, "doc bigint, txt bigint, pos int, n int, first_doc bigint"))
    many = marked.filter("crowded")
    if lone is not None or not many.isEmpty():
        runs, _ = common.scratch(texts(many if lone is None else many.unionByName(lone)).mapInArrow(divide, "mini bigint, more int, doc bigint, txt bigint, pos int, n int"), "runs")
        repeats = repeats.unionByName(copies_of(runs, first_ones(runs, ["mini", "more"]), ["mini", "more"]))
    repeats = repeats.select("doc", "txt", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + (words - 1)).alias("stop"), "first_doc")
    by = Window.partitionBy("doc", "txt").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return repeats.withColumn("island", island).groupBy("doc", "txt", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc").alias("first_doc")).drop("island")


def shard(raw: np.ndarray, offsets: np.ndarray, doc: np.ndarray, txt: np.ndarray, pos: np.ndarray, words: int) -> pa.RecordBatch:
    """Runs of words that occur earlier in the shard's pieces, by its suffix array."""
    starts, ends, firsts = bounds(raw, offsets)
    ids = word_ids(raw, starts, ends)
    num = np.diff(firsts)
    # each piece, a separator 1 after it, and 0 at the end
    piece = np.repeat(np.arange(len(num)), num + 1)
    within = common.ranges(np.zeros(len(num), np.int64), num + 1)
    text = np.ones(len(piece) + 1, np.int64)
    text[-1] = 0
    text[:-1][within < num[piece]] = ids + 2
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)[1:]
    sa = sa[1:]
    left = num[piece[sa]] - within[sa]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    new = np.append(True, lcp[1:] < words)
    size = np.diff(np.append(np.flatnonzero(new), len(sa)))
    live = np.flatnonzero(np.repeat(size, size) > 1)
    group = (np.cumsum(new) - 1)[live]
    p, at = piece[sa[live]], within[sa[live]]
    at = pos[p] + at
    order = np.lexsort((at, txt[p], doc[p], group))
    group, p, at = group[order], p[order], at[order]
    head = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    # the first one's own copies are rows that are given twice
    copy = (doc[p] != doc[p[first]]) | (txt[p] != txt[p[first]]) | (at != at[first])
    p, at, first = p[copy], at[copy], p[first][copy]
    order = np.lexsort((at, txt[p], doc[p]))
    p, at, first = p[order], at[order], first[order]
    d, t, f = doc[p], txt[p], doc[first]
    # neighbouring runs with one source become one row
    run = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (f[1:] != f[:-1]) | (at[1:] > at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    a = np.flatnonzero(run)
    b = np.append(a[1:], len(at))[: len(a)] - 1
    return pa.record_batch([d[a], t[a], at[a].astype(np.int32), (at[b] - at[a] + 1).astype(np.int32), f[a]], names=["doc", "txt", "pos", "n", "first_doc"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): one row for each span of a document that repeats an earlier passage
    of at least `words` words; first_doc_id is a document that has a part of it earlier (the document itself may be).

    Null texts, and texts of fewer words, have no spans. Rows with a null id count as last; their doc_id is null. A row given
    twice (same id and text) is one document and doesn't repeat itself. Rows of one id with different texts are different
    documents, in the order of their texts' hashes. Ids must be integers; the greatest bigint stands for null. Other columns,
    whatever their names, are ignored. An empty table gives an empty result."""
    t = spans_table(docs, id_col, text_col, words)
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return t.select(null("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("end_word"), null("first_doc").alias("first_doc_id"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", words: int = WORDS) -> DataFrame:
    """docs with repeated passages cut from their texts, and chars_col, if there is such a column, counted anew.

    A text's bytes from a span's first word up to the next word kept, or the end, go. A document of which no word is left
    goes; one that had no spans stays as it is, whatever it holds. Nulls, ties and repeated rows as in repeated_passages;
    all other columns are kept."""
    cuts = spans_table(docs, id_col, text_col, words).groupBy("doc", "txt").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    keyed = docs.select(common.whole(docs), F.coalesce(common.integer(docs, id_col), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("txt"))
    # the cuts grow with docs: never broadcast them, whatever the size
    joined = keyed.join(cuts.hint("merge"), ["doc", "txt"], "left").select("row", "spans")
    chars = chars_col if chars_col in docs.columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, held = batch.columns
            hit = held.is_valid()
            rows = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if len(rows):
                names = [f.name for f in row.type]
                cols = dict(zip(names, row.flatten(), strict=True))
                left = [cut_out(t.as_py().encode(), [(s["start"], s["stop"]) for s in held[r].as_py()]) for r, t in zip(rows.tolist(), cols[text_col].filter(hit), strict=True)]
                text = [t.decode() for t, _ in left]
                cols[text_col] = pc.replace_with_mask(cols[text_col], hit, pa.array(text, cols[text_col].type))
                if chars:
                    cols[chars] = pc.replace_with_mask(cols[chars], hit, pa.array(list(map(len, text)), cols[chars].type))
                keep = np.ones(len(row), bool)
                keep[rows] = [any_left for _, any_left in left]
                row = pa.StructArray.from_arrays([cols[n] for n in names], fields=list(row.type)).filter(pa.array(keep))
            yield pa.record_batch([row], names=["row"])

    return joined.mapInArrow(apply, joined.select("row").schema).select("row.*")


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, bool]:
    """The text without words [start, stop) of each span, and whether any word is left."""
    data = np.frombuffer(raw, np.uint8)
    starts, _, firsts = bounds(data, np.array([0, len(data)]))
    edge = np.append(starts, len(raw))
    keep = np.ones(len(raw), bool)
    left = len(starts)
    for a, b in spans:
        keep[edge[a] : edge[b]] = False
        left -= b - a
    return data[keep].tobytes(), left > 0
