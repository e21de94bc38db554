"""The operators over tables: brute force, hard cases, the pipeline."""

import base64
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import corpus_pipeline
from satchel.llm import bpe, chat, langid, packing, pretok, quality, rans, simhash, suffix_dedup, token_count, topk
from satchel.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, fp string, mini bigint, cell string, g string, root int, ids int, want string, spans int"


def docs(spark, rows):
    """Documents with null columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[None] * 9) for i, t in rows], SCHEMA)


def words(rng, n, size=5000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    rng = random.Random(0)
    long = words(rng, 60_000)
    return docs(spark, [(1, None), (2, ""), (3, "  \n"), (4, "?! ..."), (None, "a null id has words"), (5, long), (6, "said twice"), (6, "said twice"), (6, "same id, other text"), (7, "x" * 300_000), (8, "tie tie"), (9, "tie tie")])


def empty(spark):
    return docs(spark, [])


def test_bpe_and_counts(spark, hard):
    want = sorted((str(r.doc_id), None if r.text is None else len(pretok.tiktoken_of(pretok.default_path()).encode_ordinary(r.text))) for r in hard.select("doc_id", "text").collect() if r.text is None or len(r.text) < 250_000)
    keep = lambda df: sorted(((str(r.doc_id), r.n_tokens) for r in df.select("doc_id", "n_tokens").collect() if r.doc_id not in (5, 7)), key=str)
    got = bpe.encode(hard).cache()
    assert keep(got) == sorted((x for x in want if x[0] not in ("5", "7")), key=str) == keep(token_count.count_tokens(hard))
    assert got.filter("not decodes").count() == 0
    key = lambda df: sorted((str(tuple(r)) for r in df.select("doc_id", "text").collect()))
    assert key(bpe.decode(got)) == key(hard)
    long = {r.doc_id: r.n_tokens for r in token_count.count_tokens(hard).filter("doc_id in (5, 7)").collect()}
    assert long == {r.doc_id: r.n_tokens for r in got.filter("doc_id in (5, 7)").collect()}
    assert bpe.encode(empty(spark)).count() == token_count.count_tokens(empty(spark)).count() == 0


def test_packing(spark, hard):
    got = packing.pack(hard, top=6).collect()
    tokens = {(r.doc_id, len(r.token_ids)): r.token_ids for r in bpe.encode(hard).filter("n_tokens > 0 and doc_id in (4, 5, 8)").collect()}
    for (d, n), ids in tokens.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece)
        assert [i for r in mine for i in r.token_ids] == ids and sum(r.length for r in mine) == n
        assert all(r.length == 1 << r.bucket == len(r.token_ids) for r in mine)
    assert len([r for r in got if r.doc_id == 6 and r.piece == 0]) == 3
    assert not [r for r in got if r.doc_id in (1, 2)]
    assert packing.pack(empty(spark)).count() == 0


def test_rans_blocks(spark, hard):
    got = rans.compress(hard, block=5000).cache()
    want = sorted(str((r.doc_id, r.token_ids)) for r in bpe.encode(hard).collect())
    assert sorted(str((r.doc_id, r.token_ids)) for r in rans.expand(got).collect()) == want
    bad = got.withColumn("table_checksum", F.when(F.col("kind") == "block", F.col("table_checksum") + 1).otherwise(F.col("table_checksum")))
    with pytest.raises(PythonException, match="another table"):
        rans.expand(bad).count()
    none = rans.compress(empty(spark))
    assert [r.kind for r in none.collect()] == ["table"] and rans.expand(none).count() == 0


def test_rans_blocks_of_a_large_vocabulary(spark, tmp_path):
    path = tmp_path / "ranks"  # all bytes and all pairs of them: more than 16 bits
    tokens = [bytes([a]) for a in range(256)] + sorted((bytes([a, b]) for a in range(256) for b in range(256)), key=lambda t: t.isalpha())
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    table = docs(spark, [(1, "what is said"), (2, "\u00ff\u00fe more, and more \U0001f642"), (3, "")])
    got = rans.compress(table, str(path))
    want = {r.doc_id: r.token_ids for r in bpe.encode(table, str(path)).collect()}
    assert max(map(max, filter(None, want.values()))) > 1 << 16
    assert {r.doc_id: r.token_ids for r in rans.expand(got).collect()} == want


@pytest.mark.parametrize("stage", ["language_id", "quality_rules", "near_dedup", "passage_dedup"])
def test_stages_keep_columns_of_any_name(spark, stage):
    rng = random.Random(14)
    rows = [(i, words(rng, 80), "en", "s", 1, "dotted", 2.0, "r", 3, [4], None) for i in range(30)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, m0 double, row string, doc int, spans array<int>, `v0_0` string"
    table = spark.createDataFrame(rows + rows[:1], schema)
    out = dict(corpus_pipeline.STAGES)[stage](spark, table, DATA)
    assert out.schema.simpleString() == table.schema.simpleString()
    assert out.filter("`a.b` = 'dotted' and m0 = 2 and row = 'r' and doc = 3 and spans[0] = 4").count() == out.count() >= 29
    with pytest.raises(ValueError, match="integer"):
        simhash.keep_one(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_language_id(spark, hard):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).collect()
    seen = [r for r in got if r.predicted is not None]
    assert np.mean([r.predicted == r.lang for r in seen]) > 0.95
    model = langid.fit(table)
    foreign = spark.createDataFrame([(1, "Der die und das ist nicht ein Haus, aber wir gehen heute in die Schule." * 3, "fr", "s", 1), (2, None, "fr", "s", 1), (3, "12 34", "fr", "s", 1), (4, "ok words", None, "s", 1), (5, "ok words", "xx", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = {r.doc_id: r for r in langid.identify(foreign, model=model).collect()}
    assert [marks[i].keep for i in (2, 3, 4, 5)] == [False, False, True, True]
    assert marks[2].predicted is None and marks[4].declared is None
    assert langid.keep_identified(hard).columns == hard.columns
    assert {r.doc_id for r in langid.keep_identified(hard).select("doc_id").collect()} == {None, 5, 6, 7, 8, 9}
    assert langid.identify(empty(spark)).count() == langid.keep_identified(empty(spark)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)).round(3)
    x[50:80] = x[50]
    rows = [(i, v.tolist(), "c", 1) for i, v in enumerate(x)]
    more = [(900, None, "c", 1), (901, [], "c", 1), (902, [1.0, float("nan")], "c", 1), (903, [1.0, None], "c", 1), (904, [3.0], "c", 1), (905, [2.0], "c", 1), (None, x[0].tolist(), "c", 1), (0, x[0].tolist(), "c", 1), (0, x[1].tolist(), "c", 1)]
    table = spark.createDataFrame(rows + more, "vec_id bigint, embedding array<double>, shard string, kind int")
    got = defaultdict(list)
    for r in topk.top_k(table, shards=5).orderBy("rank").collect():
        got[r.vec_id].append((r.neighbor_id, r.score))
    every = [(i, v) for i, v, *_ in rows] + [(None, x[0].tolist()), (0, x[1].tolist())]
    for i in (1, 50, 77, 299, None):
        at = next(k for k, e in enumerate(every) if e[0] == i)
        s = sorted((-round(float(np.dot(every[at][1], v)), 9), math.inf if j is None else j, j) for k, (j, v) in enumerate(every) if k != at)[:10]
        assert got[i] == [(j, pytest.approx(-a, abs=1e-6)) for a, _, j in s]
    assert len(got[0]) == 20  # two different rows of one id
    assert got[904] == [(905, 6.0)] and got[905] == [(904, 6.0)]
    assert not {900, 901, 902, 903} & set(got)
    assert topk.top_k(table.limit(0)).count() == 0
    some = defaultdict(list)
    for r in topk.top_k(table, shards=9, every=50).orderBy("rank").collect():
        some[r.vec_id].append((r.neighbor_id, r.score))
    assert some == {i: x for i, x in got.items() if i is not None and i % 50 == 0}


def test_chats(spark):
    part = '[{"type":"text","text":"look"},{"type":"image","url":"u","width":28,"height":28}]'
    rows = [(1, 1, "assistant", "hi", "z"), (1, 0, "user", part, "z"), (1, 0, "user", part, "z"), (2, None, None, None, "z"), (None, 3, "user", "x", "z"), (3, 1, "<|end|>", "<|user|>", "z"), (4, 1, "image:0", "x", "z"), (4, 2, "end", "<", "z")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, attachments string")
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert got[1].prompt == "<|user|>\nlook<|image:0|><|end|>\n" * 2 + "<|assistant|>\nhi<|end|>\n"
    count = lambda t: len(pretok.tiktoken_of(pretok.default_path()).encode_ordinary(t))
    assert got[1].n_tokens == 2 * (count("look") + 1 + 2) + count("hi") + 2
    assert [tuple(a) for a in got[1].attachments] == [(0, 0, "image", "u", 1)] * 2
    assert (got[2].prompt, got[2].n_turns) == ("<|unknown|>\n<|end|>\n", 1)
    assert got[None].prompt == "<|user|>\nx<|end|>\n"
    assert got[3].prompt == "<|<||end|>|>\n<||user|><|end|>\n"
    assert got[4].prompt == "<|image::0|>\nx<|end|>\n<|end:|>\n<<|end|>\n"
    assert chat.format_chats(table.limit(0)).count() == 0
    plain = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = defaultdict(list)
    for r in plain.collect():
        want[r.conv_id].append((r.turn, r.role, r.text))
    for r in QUERIES["op7_chat_format"](spark, DATA).collect():
        turns = sorted(want[r.conv_id])
        assert r.prompt == "".join(f"<|{role}|>\n{chat.escape(t)}<|end|>\n" for _, role, t in turns)
        assert r.n_tokens == sum(count(t) + 2 for _, _, t in turns)


def test_quality(spark, hard):
    rng = random.Random(3)
    usual = [(i, " ".join(words(rng, rng.randrange(40, 200)).replace("w", "word").split())) for i in range(400)]
    odd = [(1000 + i, "#$% &*( @@@ !!! " * 30) for i in range(20)]
    got = {r.doc_id: r for r in quality.assess(docs(spark, usual + odd)).collect()}
    assert not any(got[i].keep for i, _ in odd)
    assert np.mean([got[i].keep for i, _ in usual]) > 0.97
    marks = [(r.doc_id, r.keep, r.distance) for r in quality.assess(hard).collect()]
    assert len(marks) == 12 and all(not k and d is None for i, k, d in marks if i in (1, 2, 3))
    kept = quality.keep_usual(hard)
    assert kept.columns == hard.columns and not {1, 2, 3} & {r.doc_id for r in kept.select("doc_id").collect()}
    assert quality.assess(empty(spark)).count() == quality.keep_usual(empty(spark)).count() == 0


def plain_mcd(x, share=quality.SHARE, tries=200):
    """Location and scatter by the minimum covariance determinant with many random starts, then reweighted."""
    rng = np.random.default_rng(0)
    n, p = x.shape
    h = math.ceil(share * n)
    best = None
    for _ in range(tries):
        own = rng.choice(n, p + 1, False)
        old = None
        while True:
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + np.eye(p) * 1e-9
            d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
            own = np.argsort(d, kind="stable")[:h]
            det = np.linalg.slogdet(np.cov(x[own].T, bias=True))[1]
            if old is not None and det >= old - 1e-9:
                break
            old = det
        if best is None or det < best[0]:
            best = (det, own)
    own = best[1]
    factor = lambda q: q / quality.chi2_cdf(quality.chi2_quantile(q, p), p + 2)
    mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) * factor(share)
    d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
    own = d < quality.chi2_quantile(0.975, p)
    return x[own].mean(0), np.cov(x[own].T, bias=True) * factor(0.975)


def test_quality_estimate_is_the_plain_mcd(spark):
    rng = np.random.default_rng(4)
    mix = np.linalg.cholesky(np.eye(5) * 0.5 + 0.5) * 0.1
    parts = {}
    for name, n in (("a", 3000), ("b", 1500)):
        x = rng.normal(size=(n, 5)) @ mix.T + (1 if name == "a" else 2)
        x[: n // 6] = rng.normal(size=(n // 6, 5)) * 0.02 + np.array([2.2, 0.4, 1.9, 0.3, 1.0])  # a tight cluster of others
        parts[name] = x
    rows = [("xx", name, *map(float, r)) for name, x in parts.items() for r in x]
    table = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    shrink, quality.SHRINK = quality.SHRINK, 0.0
    try:
        got = {r.source: r for r in quality.estimate(table).collect()}
    finally:
        quality.SHRINK = shrink
    for name, x in parts.items():
        mean, cov = plain_mcd(x)
        r = got[name]
        assert np.abs(np.array([r[m] for m in quality.MEAN]) - mean).max() < 0.01
        inverse = np.zeros((5, 5))
        for (i, j), v in zip(quality.PAIRS, quality.INVERSE, strict=True):
            inverse[i, j] = inverse[j, i] = r[v]
        d, want = (((x - m) @ v * (x - m)).sum(1) for m, v in ((np.array([r[m] for m in quality.MEAN]), inverse), (mean, np.linalg.inv(cov))))
        assert np.corrcoef(d, want)[0, 1] > 0.999 and np.median(np.abs(d / want - 1)) < 0.05
        assert ((d > 50) == (want > 50)).mean() > 0.995 and (d[: len(x) // 6] > 50).all()


def test_quality_of_small_groups_is_smooth(spark):
    """A group's size moves its estimate a little, at whatever size."""
    rng = random.Random(6)
    usual = [(i, "en", "s", words(rng, rng.randrange(40, 200)).replace("w", "word")) for i in range(300)]
    few = [(1000 + i, "en", "small", words(rng, rng.randrange(40, 200)).replace("w", "vo").upper()) for i in range(120)]
    schema = "doc_id bigint, lang string, source string, text string"
    far = []
    for n in (60, 61, 120):
        got = {r.doc_id: r.distance for r in quality.assess(spark.createDataFrame(usual + few[:n], schema)).collect()}
        far.append(np.median([got[1000 + i] for i in range(60)]))
    assert far[1] == pytest.approx(far[0], rel=0.2) and far[2] < far[0]


def test_quality_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    keep = {r.doc_id: r.keep for r in QUERIES["op8_quality_rules"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    bad, good = ([keep[r.doc_id] for r in labels if r.quality == q and r.doc_id in keep] for q in (0, 1))
    assert len(bad) > 30 and np.mean(bad) < 0.1 and np.mean(good) > 0.98


def plain_groups(rows):
    x, has = simhash.signatures(pa.array([t for _, t in rows], pa.string()))
    copies = np.zeros((len(rows), len(rows)), bool)
    for a in range(len(rows)):
        gap = np.array([(x[a] ^ y).tolist() for y in x[: a + 1]], np.uint64)
        gap = np.bitwise_count(gap)
        copies[a, : a + 1] = (gap.min(1) <= simhash.DISTANCE) & (gap.sum(1) <= simhash.TOTAL)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in np.argwhere(copies & has[:, None] & has[None]).tolist():
        root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return list(groups.values())


def test_simhash(spark, hard):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = set()
    for g in plain_groups(rows):
        ids = sorted(rows[i][0] for i in g)
        want |= {(i, ids[0], len(ids)) for i in ids[1:]}
    assert want and {tuple(r) for r in simhash.near_duplicates(table).collect()} == want
    one = simhash.keep_one(table)
    assert one.columns == table.columns
    assert {r.doc_id for r in one.collect()} == {i for i, _ in rows} - {i for i, *_ in want}
    assert sorted(map(tuple, simhash.near_duplicates(hard).collect()), key=str) == [(6, 6, 2), (9, 8, 2)]
    kept = sorted(((r.doc_id, (r.text or "")[:9]) for r in simhash.keep_one(hard).collect()), key=str)
    assert [i for i, _ in kept] == [1, 2, 3, 4, 5, 6, 6, 7, 8, None]
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


def test_simhash_finds_edited_copies(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for k in range(150):  # 4 to 7 % of the words edited: 3-gram Jaccard of some 0.8 to 0.67
        own = [f"w{rng.randrange(20000)}" for _ in range(300)]
        edited = [f"x{rng.randrange(20000)}" if rng.random() < 0.04 + 0.03 * k / 150 else w for w in own]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited))]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["op9_simhash"](spark, str(tmp_path)).collect()}
    assert got <= {(2 * k + 1, 2 * k, 2) for k in range(150)} and len(got) > 0.9 * 150
    one = simhash.keep_one(docs(spark, rows))
    assert {r.doc_id for r in one.collect()} == {i for i, _ in rows} - {i for i, *_ in got}


@pytest.mark.parametrize(("s", "tile"), [(1, simhash.TILE), (1, 8), (2, 8), (3, 50)])
def test_simhash_is_exact_on_every_grid(spark, s, tile):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    own, has = simhash.signatures(pa.array([r.text for r in table.collect()], pa.string()))
    own = np.unique(own[has], axis=0)
    gap = np.bitwise_count(own[:, None] ^ own[None]).astype(int)
    a, b = np.nonzero((gap.min(2) <= simhash.DISTANCE) & (gap.sum(2) <= simhash.TOTAL))
    want = simhash.roots(len(own), a, b)
    distinct = spark.createDataFrame([(k, *r) for k, r in enumerate(own.view(np.int64).tolist())], "node bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    p, q = np.array([tuple(r) for r in simhash.edges(distinct, tile=tile, s=s).collect()]).T
    assert (simhash.roots(len(own), p, q) == want).all() and (want != np.arange(len(own))).any()


def test_chain_of_pairs_is_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a bigint, b bigint")
    assert {tuple(r) for r in simhash.components(pairs).collect()} == {(i, 0) for i in range(41)} | {(90, 90), (100, 90)}


def plain_spans(rows, n):
    """Runs of n words that occur earlier, by (id, place)."""
    first, out = {}, {}
    for key, text in sorted(rows):
        w = text.split()
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            run = tuple(w[i : i + n])
            if run in first:
                hit[i : i + n] = [True] * n
            first.setdefault(run, key)
        out[key] = hit
    return out


@pytest.mark.parametrize(("hot", "crowd"), [(suffix_dedup.HOT, suffix_dedup.CROWD), (suffix_dedup.HOT, 2), (3, suffix_dedup.CROWD)])
def test_suffix_dedup(spark, hot, crowd):
    rng = random.Random(5)
    shared = [words(rng, rng.randrange(20, 140)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randrange(0, 60)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(1, 6))]
        text = " ".join(parts)
        if rng.random() < 0.3:  # an edit within
            w = text.split()
            if w:
                w[rng.randrange(len(w))] = "edited"
            text = "  ".join(w)
        rows.append((i, text))
    rows.append((120, "again and again " * 80))
    t = suffix_dedup.spans_table(docs(spark, rows), words=25, gram=8, hot=hot, crowd=crowd)
    got = {k: [False] * len(x.split()) for k, x in rows}
    for r in t.collect():
        assert r.stop - r.start >= 25 and r.first_doc <= r.doc
        got[r.doc][r.start : r.stop] = [True] * (r.stop - r.start)
    assert got == plain_spans(rows, 25)


def test_suffix_dedup_hard_cases(spark, hard):
    assert suffix_dedup.repeated_passages(hard).count() == 0
    assert suffix_dedup.without_repeats(hard).columns == hard.columns
    assert suffix_dedup.without_repeats(hard).count() == 12
    assert suffix_dedup.repeated_passages(empty(spark)).count() == suffix_dedup.without_repeats(empty(spark)).count() == 0
    rng = random.Random(8)
    passage = words(rng, 60)
    rows = [(1, passage), (2, "before " + passage + " after"), (None, passage), (3, passage), (3, passage)]
    got = sorted(map(tuple, suffix_dedup.repeated_passages(docs(spark, rows)).collect()), key=str)
    assert got == [(2, 1, 61, 1), (3, 0, 60, 1), (None, 0, 60, 1)]
    left = suffix_dedup.without_repeats(docs(spark, rows)).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(tuple, left)) == [(1, passage, len(passage)), (2, "before after", 12)]


def test_pipeline(spark):
    docs_ = table = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in table.collect()}
        after_df = stage(spark, table, DATA)
        assert after_df.schema.names == docs_.schema.names
        after = after_df.collect()
        ids = [r.doc_id for r in after]
        assert len(set(ids)) == len(ids) and set(ids) <= set(before)
        if name == "language_id":
            assert set(ids) == {r.doc_id for r in langid.identify(table).collect() if r.keep}
        if name == "quality_rules":
            assert set(ids) == {r.doc_id for r in quality.assess(table).collect() if r.keep}
        if name == "near_dedup":
            rows = [(i, r.text) for i, r in sorted(before.items())]
            gone = {i for g in plain_groups(rows) for i in [rows[k][0] for k in g][1:]}
            assert set(ids) == set(before) - gone
        if name == "passage_dedup":
            hits = plain_spans([(i, r.text) for i, r in before.items()], suffix_dedup.WORDS)
            for r in after:
                assert r.text.split() == [w for w, h in zip(before[r.doc_id].text.split(), hits[r.doc_id], strict=True) if not h]
                assert r.n_chars == len(r.text)
            assert set(before) - set(ids) == {i for i, h in hits.items() if h and all(h)}
        table = spark.createDataFrame(after, docs_.schema)
    want = sorted(str(tuple(r)) for r in packing.pack(table).collect())
    assert want == sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, DATA).collect())


def test_words_of_one_sum_of_powers_are_no_repeat(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rng = random.Random(9)
    w = [f"v{rng.randrange(900)}" for _ in range(70)]
    other = [*w[:35], b, *w[36:]]
    w[35] = a
    assert suffix_dedup.repeated_passages(docs(spark, [(1, " ".join(w)), (2, " ".join(other))])).count() == 0
    t = docs(spark, [(1, a), (2, b), (3, f"{b} {a}")])
    plain = pretok.tiktoken_of(pretok.default_path()).encode_ordinary
    assert {r.doc_id: r.token_ids for r in bpe.encode(t.coalesce(1)).collect()} == {1: plain(a), 2: plain(b), 3: plain(f"{b} {a}")}


def test_passage_in_very_many_documents(spark):
    rng = random.Random(10)
    shared = words(rng, 60)
    table = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.concat_ws(" ", *(F.concat(F.lit(f"x{k}"), F.xxhash64("id", F.lit(k)).cast("string")) for k in range(8))), F.lit(" " + shared + " "), F.xxhash64("id").cast("string")).alias("text"))
    got = suffix_dedup.repeated_passages(table).agg(F.count("*"), F.min("start_word"), F.max("start_word"), F.min("end_word"), F.max("end_word"), F.min(F.col("doc_id") - F.col("first_doc_id")), F.countDistinct("doc_id"), F.min("doc_id")).first()
    assert tuple(got) == (99_999, 8, 8, 68, 68, 1, 99_999, 1)


def test_passages_in_a_very_long_text(spark):
    rng = random.Random(11)
    long = words(rng, 900_000, 10**7)  # some 7 MB: several windows
    w = long.split()
    at = (0, 100_000, 523_456, 899_900)
    rows = [(1, long), *((2 + k, f"before{k} " + " ".join(w[a : a + 90]) + " after") for k, a in enumerate(at))]
    got = sorted(map(tuple, suffix_dedup.repeated_passages(docs(spark, rows)).collect()))
    assert got == [(2 + k, 1, 91, 1) for k in range(4)]
    back = [(9, long), *rows[1:]]  # the long one comes last
    assert sorted(map(tuple, suffix_dedup.repeated_passages(docs(spark, back)).collect())) == [(9, a, a + 90, 2 + k) for k, a in enumerate(at)]
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs(spark, back)).select("doc_id", "text").collect()}
    assert len(left[9].split()) == 900_000 - 4 * 90
