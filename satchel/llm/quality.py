"""Quality by robust multivariate outliers.

Each document has a vector of transformed statistics. For each language and source the minimum covariance determinant
gives their location and scatter: of the subsets of three quarters of the documents that of the least determinant is
sought from several deterministic starts (diagonal median deviations, the correlations of squashed coordinates, the
spatial signs). From each, concentration steps take the three quarters nearest by Mahalanobis distance and estimate from
these alone, until no determinant falls any more; the start that ends at the least determinant is taken, and one reweighted
step takes all within the 97.5 % quantile. Documents beyond FAR of the final distance are rejected.

A step is one aggregation of moments by group, start and bin of the logarithm of the squared distance: the nearest three quarters
are whole bins, so nothing but moments is moved, however large a group is. A group's estimate is drawn towards that of its
language, and this towards that of all documents, by weights n / (n + SHRINK): smoothly, so no group is too small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import LETTER, NUMBER, SPACE, tables
from satchel.llm.words import bounds, hash_words, windows

NAMES = ("word_length", "symbols", "digits", "capitals", "variety")
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Part of a group that a concentration step takes, bins for each doubling of the squared distance.
SHARE, BINS = 0.75, 16
#: Steps end when no logarithm of a determinant falls by more than this (1 % of a coordinate's variance), or after so many.
FALL, STEPS = 0.05, 12
#: Documents as which the estimate of the language counts in that of a group, and that of all in that of a language.
SHRINK = 100.0
STARTS = 3
#: Squared distance beyond which a document is rejected: ten spreads. Usual documents have far heavier tails than a normal
#: distribution, of which hardly any quantile lies as far.
FAR = 100.0
#: Added in quadrature to each coordinate's spread, which is five times as large and more, so that no scatter is singular.
FLOOR = 0.002
#: Bins of one unit for medians.
FINE = 512


def chi2_cdf(x: float, k: float) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16 and n < 10000:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * exp(-h + a * log(h) - lgamma(a)))


@lru_cache(64)
def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


@lru_cache(1)
def upper() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i).isupper():
            out[i] = True
    return out


def _characters(text: str, chars: np.ndarray) -> np.ndarray:
    """Characters, blanks, digits, letters and capitals of texts that follow one another, a column for each text."""
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edge = np.append(0, np.cumsum(chars))
    kind = tables()[0][cps]
    count = lambda mask: np.diff(np.append(0, np.cumsum(mask))[edge])
    return np.stack([chars, count(kind == SPACE), count(kind == NUMBER), count(kind == LETTER), count(upper()[cps])])


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the distinct ones as the text's number and 44 bits of a hash."""
    words = np.diff(firsts)
    doc = np.repeat(np.arange(len(words), dtype=np.uint64), words)
    keys = np.sort((doc << np.uint64(44)) | (hash_words(raw, starts, ends) >> np.uint64(20)))
    return words, keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def statistics(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has words. Shares are of whole texts, drawn towards a usual share so that short
    texts aren't far from it by chance, and transformed by the arcsine of the root. Digits come in clumps (a telephone or card
    number) and most texts have none, so a usual share of as many as a few clumps have is added: else the scatter of their
    share would be that of the texts' lengths. Long texts are counted in windows."""
    col = pc.fill_null(arr, "")
    rows = len(arr)
    chars = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, offsets = common.flat_bytes(arr)
    if rows == 1 and len(raw) > common.STEP_BYTES:
        text, size = col[0].as_py(), common.STEP_BYTES // 4
        parts = [text[k : k + size] for k in range(0, len(text), size)]
        counted = sum(_characters(p, np.array([len(p)])) for p in parts)
        found = [(own, _words(raw, a[:own], b[:own], np.array([0, own]))[1]) for _, own, a, b in windows(raw, common.STEP_BYTES, 0)]
        words, keys = np.array([sum(n for n, _ in found)]), np.unique(np.concatenate([k for _, k in found]))
    else:
        counted = _characters("".join(col.to_pylist()), chars)
        words, keys = _words(raw, *bounds(raw, offsets))
    total, space, digit, letter, capital = counted
    distinct = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=rows)
    solid = total - space
    symbol = solid - digit - letter
    share = lambda k, n, usual, weight: np.arcsin(np.sqrt((k + usual * weight) / (n + weight)))
    out = np.stack(
        [
            np.log((solid + 5 * 5.0) / (words + 5.0)),
            share(symbol, solid, 0.03, 200),
            share(digit, solid, 0.05, 1000),
            share(capital, letter, 0.02, 200),
            np.log1p(distinct + 5) / np.log1p(words + 5),
        ],
        1,
    )
    return out, words > 0


def vectors(table: DataFrame, text: str, field: str | None = None) -> DataFrame:
    """The table's columns but the text, and the statistics, null for texts without words. With a field, the text is that field of
    the column `text`, which stays."""
    from pyspark.sql.types import DoubleType, StructType

    keep = [f for f in table.schema if field or f.name != text]
    schema = StructType(list(keep))
    for name in NAMES:
        schema = schema.add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(text)
            own = own.field(field) if field else own
            for part in common.steps_of(batch, common.lens_of(own)):
                some = part.column(text)
                x, has = statistics(some.field(field) if field else some)
                yield pa.record_batch([*(part.column(f.name) for f in keep), *(pa.array(x[:, k], mask=~has) for k in range(P))], names=schema.names)

    return table.mapInArrow(run, schema)


def _by_group(table: DataFrame, keys: list[str], function, names: list[str]) -> DataFrame:
    """Few rows for each group (keys, then numbers; sorted by the first of them) to what the function makes of them: rows of numbers."""
    schema = ", ".join([f"{k} {dict(table.dtypes)[k]}" for k in keys] + [f"{n} double" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, len(keys)):
            own = [t.column(k).to_numpy() for k in range(len(keys))]
            differs = np.zeros(len(own[0]) - 1, bool)
            for k in own:
                differs |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), len(own[0])]
            cols = np.stack([c.to_numpy() for c in t.columns[len(keys) :]], 1).astype(float)
            got = [([k[a] for k in own], row) for a, b in zip(cuts, cuts[1:], strict=False) for row in function(cols[a:b])]
            yield pa.record_batch([*(pa.array([k[i] for k, _ in got]) for i in range(len(keys))), *(pa.array([float(r[i]) for _, r in got]) for i in range(len(names)))], names=[*keys, *names])

    return table.repartition(*keys).sortWithinPartitions(*table.columns[: len(keys) + 1]).mapInArrow(run, schema)


MEAN, SCATTER, INVERSE = [f"m{i}" for i in range(P)], [f"c{i}_{j}" for i, j in PAIRS], [f"v{i}_{j}" for i, j in PAIRS]
MODEL = ["start", "n", "det", "old", *MEAN, *SCATTER, *INVERSE]


def _full(values: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        out[i, j] = out[j, i] = values[k]
    return out


def _model(start: float, n: float, old: float, mean: np.ndarray, cov: np.ndarray) -> list[float]:
    """A row of MODEL; det is the logarithm of the determinant."""
    wide = cov + np.eye(P) * FLOOR**2
    inverse = np.linalg.inv(wide)
    return [start, n, float(np.linalg.slogdet(wide)[1]), old, *mean.tolist(), *(float(cov[i, j]) for i, j in PAIRS), *(float(inverse[i, j]) for i, j in PAIRS)]


def _medians(rows: np.ndarray) -> list[list[float]]:
    """From (coordinate, bin, count): medians, and median deviations as a diagonal scatter."""
    mean, var = np.zeros(P), np.zeros(P)
    total = rows[rows[:, 0] == 0][:, 2].sum()
    for i in range(P):
        own = rows[rows[:, 0] == i]
        x, n = (own[:, 1] + 0.5) / FINE, own[:, 2]

        def median(x: np.ndarray, n: np.ndarray) -> float:
            by = np.argsort(x, kind="stable")
            total = np.cumsum(n[by])
            return float(x[by][np.searchsorted(total, total[-1] / 2)])

        mean[i] = median(x, n)
        var[i] = (1.4826 * median(np.abs(x - mean[i]), n)) ** 2
    return [_model(0, total, 0, mean, np.diag(var))]


def _starts(rows: np.ndarray) -> list[list[float]]:
    """All starts of a group, from one row: count, medians, spreads, sums and products of squashed coordinates, products of signs."""
    row = rows[0]
    n, mean, spread = row[1], row[2 : 2 + P], row[2 + P : 2 + 2 * P]
    sums, products, signs = np.split(row[2 + 2 * P :], [P, P + len(PAIRS)])
    out = [_model(0, n, np.inf, mean, np.diag(spread**2))]
    centre = sums / n
    squashed = _full(products / n) - np.outer(centre, centre)
    for k, shape in enumerate((squashed, _full(signs / n)), 1):
        by = np.sqrt(np.maximum(np.diag(shape), 1e-9))
        correlation = shape / np.outer(by, by)
        np.fill_diagonal(correlation, 1.0)
        out.append(_model(k, n, np.inf, mean, correlation * np.outer(spread, spread)))
    return out


def _concentrate(share: float):
    """From (bin, count, old determinant, sums, sums of products) to the estimate from the nearest bins that hold the share of a group."""

    def step(rows: np.ndarray) -> list[list[float]]:
        total = np.cumsum(rows[:, 2])
        take = rows[: int(np.searchsorted(total, share * total[-1] - 1e-9)) + 1]
        return [_moments(take, take[:, 2].sum() / total[-1], total[-1])]

    return step


def _moments(rows: np.ndarray, part: float, every: float) -> list[float]:
    n = rows[:, 2].sum()
    mean = rows[:, 4 : 4 + P].sum(0) / n
    cov = _full(rows[:, 4 + P :].sum(0) / n) - np.outer(mean, mean)
    if part < 1:  # what is cut off from a normal distribution
        cov *= part / max(chi2_cdf(chi2_quantile(round(part, 6), P), P + 2), 1e-6)
    return _model(rows[0, 1], every, rows[0, 3], mean, cov)


def _reweight(rows: np.ndarray) -> list[list[float]]:
    near = rows[rows[:, 0] < BINS * np.log2(chi2_quantile(0.975, P))]
    if near[:, 2].sum() < P + 1:
        near = rows
    return [_moments(near, 0.975, rows[:, 2].sum())]


def distance(x: list[str]) -> F.Column:
    d = [F.col(n) - F.col(m) for n, m in zip(x, MEAN, strict=True)]
    return sum((d[i] * d[j] * F.col(v) * (1 if i == j else 2) for (i, j), v in zip(PAIRS, INVERSE, strict=True)), F.lit(0.0))


def estimate(numbers: DataFrame) -> DataFrame:
    """The estimates of (lang, source, word_length, ...), null statistics aside: (lang, source, m0, ..., v0_0, ...), a row for each
    language and source."""
    spark = numbers.sparkSession
    label = lambda *c: F.to_json(F.array(*c), {"ignoreNullFields": "false"})
    # every document counts in its group, its language, and all
    own = numbers.filter(F.col(NAMES[0]).isNotNull()).select(F.explode(F.array(label("lang", "source"), label("lang"), F.lit("[]"))).alias("g"), *NAMES)
    fine = own.select("g", F.posexplode(F.array(*NAMES)).alias("i", "x")).groupBy("g", "i", F.floor(F.col("x") * FINE).alias("b")).count()
    middle, middle_path = common.scratch(_by_group(fine, ["g"], _medians, MODEL), "middle")
    scaled = own.join(middle.select("g", *MEAN, *(F.sqrt(F.greatest(F.col(f"c{i}_{i}"), F.lit(FLOOR**2))).alias(f"s{i}") for i in range(P))), "g")
    z = [(F.col(x) - F.col(m)) / F.col(f"s{i}") for i, (x, m) in enumerate(zip(NAMES, MEAN, strict=True))]
    norm = F.greatest(F.sqrt(sum((c * c for c in z), F.lit(0.0))), F.lit(1e-9))
    h, u = [F.tanh(c) for c in z], [c / norm for c in z]
    first = lambda c: F.min(c).alias(c)
    sums = scaled.groupBy("g").agg(
        F.lit(0.0).alias("zero"), F.count("*").alias("n"), *(first(m) for m in MEAN), *(first(f"s{i}") for i in range(P)),
        *(F.sum(c).alias(f"h{i}") for i, c in enumerate(h)), *(F.sum(h[i] * h[j]).alias(f"h{i}_{j}") for i, j in PAIRS), *(F.sum(u[i] * u[j]).alias(f"u{i}_{j}") for i, j in PAIRS),
    )
    model, path = common.scratch(_by_group(sums, ["g"], _starts, MODEL), "model")
    common.drop(spark, middle_path)

    def step(model: DataFrame, path: str, function) -> tuple[DataFrame, str]:
        measured = own.join(model, "g").select("g", "start", "det", *NAMES, F.floor(F.log2(F.greatest(distance(list(NAMES)), F.lit(1e-6))) * BINS).alias("b"))
        sums = measured.groupBy("g", "start", "b").agg(F.count("*").alias("n"), F.max("det").alias("old"), *(F.sum(x).alias(f"s{k}") for k, x in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in PAIRS))
        sums = sums.select(F.concat_ws("#", "g", F.col("start").cast("int")).alias("key"), "b", "start", "n", "old", *sums.columns[5:], "g")
        new = _by_group(sums.drop("g"), ["key"], function, MODEL).withColumn("g", F.regexp_extract("key", "(?s)^(.*)#", 1)).select("g", *MODEL)
        after, next_path = common.scratch(new, "model")
        common.drop(spark, path)
        return after, next_path

    for done in range(STEPS):
        model, path = step(model, path, _concentrate(SHARE))
        if done < 2:
            continue
        fall = model.agg(F.max(F.col("old") - F.col("det"))).first()[0]
        if fall is None or fall < FALL:
            break
    best = model.groupBy("g").agg(F.min(F.struct("det", *(c for c in MODEL if c != "det"))).alias("b")).select("g", "b.*")
    model, path = step(best.select("g", *MODEL), path, _reweight)
    # each drawn towards the wider one
    groups = numbers.select("lang", "source").distinct()
    wide = groups.withColumns({"own_g": label("lang", "source"), "lang_g": label("lang"), "all_g": F.lit("[]")})
    for name in ("own", "lang", "all"):
        of = model.select(F.col("g").alias(f"{name}_g"), F.struct("n", F.array(*MEAN).alias("m"), F.array(*SCATTER).alias("c")).alias(f"of_{name}"))
        wide = wide.join(of, f"{name}_g", "left")
    # written, so that its size is known: small enough, it is broadcast to the join with the documents
    return common.scratch(_drawn(wide), "estimates")[0]


def _drawn(wide: DataFrame) -> DataFrame:
    """(lang, source, m0, ..., v0_0, ...) from each group's own estimate, its language's and that of all."""
    schema = wide.select("lang", "source").schema
    from pyspark.sql.types import DoubleType

    for name in (*MEAN, *INVERSE):
        schema = schema.add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, lang, every in zip(*(batch.column(c).to_pylist() for c in ("of_own", "of_lang", "of_all")), strict=True):
                if own is None:
                    out.append([None] * (P + len(PAIRS)))
                    continue
                mean, cov = np.array(every["m"]), np.array(every["c"])
                for x in (lang, own):
                    w = x["n"] / (x["n"] + SHRINK)
                    mean, cov = w * np.array(x["m"]) + (1 - w) * mean, w * np.array(x["c"]) + (1 - w) * cov
                inverse = np.linalg.inv(_full(cov) + np.eye(P) * FLOOR**2)
                out.append([*mean.tolist(), *(float(inverse[i, j]) for i, j in PAIRS)])
            yield pa.record_batch([batch.column("lang"), batch.column("source"), *(pa.array([r[k] for r in out], pa.float64()) for k in range(P + len(PAIRS)))], names=schema.names)

    return wide.select("lang", "source", "of_own", "of_lang", "of_all").mapInArrow(run, schema)


def judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (lang, source, word_length, ...) with the squared distance and whether it is kept."""
    own = model.select(F.col("lang").alias("model_lang"), F.col("source").alias("model_source"), *MEAN, *INVERSE)
    joined = rows.join(own, rows["lang"].eqNullSafe(own["model_lang"]) & rows["source"].eqNullSafe(own["model_source"]), "left")
    d = F.when(F.col(NAMES[0]).isNotNull(), F.round(distance(list(NAMES)), 6))
    return joined.select(*rows.columns, d.alias("distance"), F.coalesce(d <= FAR, F.lit(False)).alias("keep"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, word_length, symbols, digits, capitals, variety, distance, keep) of every row.

    A text without words (null, empty, blank) has null statistics and isn't kept. A null lang or source is a group of its own.
    Repeated rows count as often as they are given; null ids are kept as they are. Other columns, whatever their names, are
    ignored. An empty table gives an empty result. Each text is read once."""
    common.ready(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    numbers, _ = common.scratch(vectors(kept, "text"), "statistics")
    return judged(numbers, estimate(numbers))


def keep_usual(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without the rows that assess() doesn't keep; all columns stay, whatever their names. The statistics are computed
    twice, for the estimates and for the decisions: cheaper than writing or shuffling whole texts."""
    common.ready(docs.sparkSession)
    lang, source = F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")
    numbers, _ = common.scratch(vectors(docs.select(lang, source, F.col(text_col).alias("text")), "text"), "statistics")
    wide = vectors(docs.select(common.whole(docs), lang, source), "row", text_col)
    return judged(wide, estimate(numbers)).filter("keep").select("row.*")
