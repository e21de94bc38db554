"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters (letters in lower case; all else counts as a blank), hashed to 2**13 places;
a feature's weight is log(1 + count) times its inverse document frequency, which is counted over all documents, and a
document's weights have length 1. The weights are trained by follow-the-regularised-leader with l1 and l2 penalties on at
most PER_LANGUAGE documents of each language, those of the least hash; a fifth of them is held out to fit the temperature
that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import LETTER, tables
from satchel.llm.words import mix

PLACES = 13
#: Documents of each language that the classifier is trained and calibrated on, at most.
PER_LANGUAGE = 400
#: A document goes if the calibrated probability of its declared language is below this.
LEAST = 0.01
#: Documents that one step takes.
ROWS = 256


@lru_cache(1)
def letters() -> np.ndarray:
    """The lower-case letter of each code point; a blank for what isn't a letter."""
    from satchel.llm.simhash import lower

    out = lower().copy()
    out[tables()[0] != LETTER] = 32
    return out


def gram_counts(c: np.ndarray, row: np.ndarray, rows: int, own: int | None = None) -> np.ndarray:
    """How often each text has each place's grams, texts one after another: those that begin within the first `own` characters."""
    counts = np.zeros(rows << PLACES, np.int64)
    seed = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    h, live = np.zeros(len(c), np.uint64), np.zeros(len(c), bool)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        m = len(c) - n + 1
        h = h[:m] * seed[0] + (c[n - 1 :] + seed[n - 1])
        live = live[:m] | (c[n - 1 :] != 32)
        ok = live if n == 1 else live & (row[:m] == row[n - 1 :])
        if own is not None and own < m:
            ok = ok & (np.arange(m) < own)
        counts += np.bincount((row[:m][ok] << PLACES) | (mix(h[ok]) >> np.uint64(64 - PLACES)).astype(np.int64), minlength=len(counts))
    return counts


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, log(1 + count)) of a column of texts, in order of the rows. A long text is counted in windows."""
    col = pc.fill_null(arr, "")
    chars = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    size = common.STEP_BYTES // 4
    points = lambda text: letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    if len(col) == 1 and chars[0] > 4 * size:
        text = col[0].as_py()
        counts = np.zeros(1 << PLACES, np.int64)
        for k in range(0, len(text), size):
            c = points(text[k : k + size + 2])
            counts += gram_counts(c, np.zeros(len(c), np.int64), 1, size)
    else:
        counts = gram_counts(points("".join(col.to_pylist())), np.repeat(np.arange(len(arr)), chars), len(arr))
    at = np.flatnonzero(counts)
    return at >> PLACES, at & ((1 << PLACES) - 1), np.log1p(counts[at])


def weighted(arr: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, place, v = features(arr)
    v = v * idf[place]
    norm = np.sqrt(np.bincount(row, v * v, len(arr)))
    return row, place, v / np.where(norm > 0, norm, 1)[row]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits, a row for each text, and whether a text has features at all."""
        row, place, v = weighted(arr, self.idf)
        out = np.stack([np.bincount(row, v * self.weights[place, k], len(arr)) for k in range(len(self.languages))], 1) + self.bias
        return out / self.temperature, np.bincount(row, minlength=len(arr)) > 0


def train(row: np.ndarray, place: np.ndarray, v: np.ndarray, label: np.ndarray, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader over the rows, in a fixed shuffled order."""
    size = (1 << PLACES) + 1  # the last place is the bias, which has no penalty
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    edge = np.searchsorted(row, np.arange(len(label) + 1))
    penalty1, penalty2 = np.full((size, 1), l1), np.full((size, 1), l2)
    penalty1[-1] = penalty2[-1] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= penalty1[i], 0, -(zi - np.sign(zi) * penalty1[i]) / ((beta + np.sqrt(n[i])) / alpha + penalty2[i]))

    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for r in rng.permutation(len(label)):
            i = np.append(place[edge[r] : edge[r + 1]], size - 1)
            x = np.append(v[edge[r] : edge[r + 1]], 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden section; 1 without data."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(label)), label]))

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the languages that docs declare; None if there are no labelled texts."""
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    common.ready(docs.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << PLACES) + 1, np.int64)
        for batch in batches:
            for part in common.steps(batch, "text"):
                for s in range(0, len(part), ROWS):
                    own = part.column("text").slice(s, ROWS)
                    seen[:-1] += np.bincount(features(own)[1], minlength=1 << PLACES)
                    seen[-1] += len(own)
        yield pa.record_batch([pa.array([seen])], names=["df"])

    counts = table.select("text").mapInArrow(frequencies, "df array<bigint>").select(F.posexplode("df").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
    seen = np.zeros((1 << PLACES) + 1)
    for r in counts.collect():  # one row for each place
        seen[r.place] = r.n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    h = F.xxhash64("id", "text")
    labelled = table.filter("lang is not null and text is not null")
    first = labelled.select("lang", h.alias("h")).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= per_language)
    chosen = [r.h for r in first.select("h").distinct().collect()]
    rows = labelled.filter(h.isin(chosen)).select("lang", "text", h.alias("h")).distinct().collect() if chosen else []
    rows = sorted(rows, key=lambda r: (r.h, r.lang))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    label = np.array([languages.index(r.lang) for r in rows])
    parts = []
    for s in range(0, len(rows), ROWS):
        row, place, v = weighted(pa.array([r.text for r in rows[s : s + ROWS]], pa.string()), idf)
        parts.append((row + s, place, v))
    row, place, v = (np.concatenate([p[k] for p in parts]) for k in range(3))
    held = np.arange(len(rows)) % 5 == 4
    of_train = ~held[row]
    new = np.cumsum(~held) - 1
    w, bias = train(new[row[of_train]], place[of_train], v[of_train], label[~held], len(languages))
    model = Model(languages, idf, w, bias, 1.0)
    if held.any():
        kept = [r.text for r, x in zip(rows, held, strict=True) if x]
        model.temperature = calibrate(np.concatenate([model.logits(pa.array(kept[s : s + ROWS], pa.string()))[0] for s in range(0, len(kept), ROWS)]), label[held])
    return model


def score(table: DataFrame, model: Model | None, text: str | None = None) -> DataFrame:
    """table's columns but `text`, and predicted, confidence, declared (the declared language's probability), keep. The table has
    `lang`, and the text as its column `text`, or as the field of that name of its column `row`, which stays."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    keep = [f for f in table.schema if f.name != "text"]
    schema = StructType(list(keep))
    for name, kind in (("predicted", StringType()), ("confidence", DoubleType()), ("declared", DoubleType()), ("keep", BooleanType())):
        schema = schema.add(name, kind)
    find = lambda part: part.column("row").field(text) if text else part.column("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {x: k for k, x in enumerate(model.languages)} if model else {}
        for batch in batches:
            for part in common.steps_of(batch, common.lens_of(find(batch))):
                for s in range(0, len(part), ROWS):
                    own = part.slice(s, ROWS)
                    n = len(own)
                    if model:
                        logits, has = model.logits(find(own))
                        p = np.exp(logits - logits.max(1, keepdims=True))
                        p /= p.sum(1, keepdims=True)
                    else:
                        p, has = np.ones((n, 1)), np.zeros(n, bool)
                    at = np.array([known.get(x, -1) for x in own.column("lang").to_pylist()])
                    best = p.argmax(1)
                    declared = np.where(at >= 0, p[np.arange(n), np.maximum(at, 0)], 0.0)
                    names = np.array([*(model.languages if model else []), ""], object)[best]
                    yield pa.record_batch(
                        [
                            *(own.column(f.name) for f in keep),
                            pa.array([x if y else None for x, y in zip(names, has, strict=True)], pa.string()),
                            pa.array(p.max(1), mask=~has),
                            pa.array(declared, mask=~has | (at < 0)),
                            pa.array(has & ((at < 0) | (declared >= LEAST))),
                        ],
                        names=schema.names,
                    )

    return table.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, lang, predicted, confidence, declared, keep) of every row.

    A document is kept if it has a letter and its declared language isn't all but excluded (probability under LEAST). One
    whose lang is null, or a language of which there is no text, is kept by its letters alone. Null and empty texts, and
    texts without letters, have null predicted and confidence and aren't kept. Repeated rows and null ids are scored as they
    are; other columns, whatever their names, are ignored. An empty table gives an empty result."""
    common.ready(docs.sparkSession)
    model = model or fit(docs, id_col, text_col, lang_col)
    return score(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), model)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that identify() doesn't keep; all columns stay, whatever their names."""
    common.ready(docs.sparkSession)
    model = fit(docs, id_col, text_col, lang_col)
    return score(docs.select(common.whole(docs), F.col(lang_col).alias("lang")), model, text_col).filter("keep").select("row.*")
