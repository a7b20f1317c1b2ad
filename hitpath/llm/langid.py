"""Language identification by sparse multinomial logistic regression on character n-grams.

Texts become hashed n-grams of letters with TF-IDF weights: relative frequency
times the inverse document frequency over all training documents. Weights are
trained with follow-the-regularised-leader and elastic-net penalties, which
leaves most of them zero, on a bounded sample per language, and a temperature
is then fitted on a part of the sample kept for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitpath.llm.common import portions, slices, training

FEATURES = 1 << 15
MOST_PER_LANGUAGE = 500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
LEAST_SCORE = 0.5
#: Ranges of hashed ids that are counted apart, as a power of two.
PARTS_BITS = 10

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-case code of every letter, 0 for all else."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three letters with word ends, the text of each, and each text's number of letters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = _letter_table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(doc, code > 0, len(texts)).astype(np.int64)
    # A gap between words is one zero, and texts begin and end with one.
    kept = code > 0
    if len(kept):
        kept[1:] |= code[:-1] > 0
    code, doc = code[kept], doc[kept]
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    if len(code):
        before[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
        after[np.concatenate([doc[1:] != doc[:-1], [True]])] = 0
    real = code > 0
    a, b, c, doc = before[real], code[real], after[real], doc[real]
    mix = np.uint32(2654435761)
    one = b * mix
    two = (a + np.uint32(0x9E37)) * np.uint32(2246822519) ^ one
    three = (c + np.uint32(0x85EB)) * np.uint32(3266489917) ^ (two * mix + np.uint32(1))
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    found = [(x * mix) >> shift for x in (one ^ np.uint32(0xABCD), two, three)]
    return np.stack(found, axis=1).astype(np.int64), doc, letters


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # inverse document frequency times weight, feature by language
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text; ``und`` and 0 without a letter or without a learned language."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    logits = np.zeros((len(texts), len(model.languages)))
    letters = np.zeros(len(texts), np.int64)
    for i, j in portions(map(len, texts), 500_000):
        ids, doc, n = grams(texts[i:j])
        letters[i:j] = n
        here = np.flatnonzero(n)
        if len(here):
            starts = np.searchsorted(doc, here)
            each = model.table[ids[:, 0]] + model.table[ids[:, 1]] + model.table[ids[:, 2]]
            logits[i + here] = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / (3.0 * n[here, None])
    p = _softmax((logits + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    known = letters > 0
    return (
        [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())],
        np.where(known, p[np.arange(len(p)), best], 0.0),
    )


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents with each feature, over all rows; sent to the driver as one sum per feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "").to_pylist()
            total += len(texts)
            for i, j in portions(map(len, texts), 500_000):
                ids, doc, _ = grams(texts[i:j])
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    there = np.zeros(FEATURES, bool)
                    there[ids[a:b].ravel()] = True
                    seen += there
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1), "n": np.append(seen[at], total)})

    rows = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequency, total = np.zeros(FEATURES, np.int64), 0
    for feature, n in rows.collect():
        if feature < 0:
            total = n
        else:
            frequency[feature] = n
    return total, frequency


def _train(samples: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader: weights (the last row is the bias) from ``(class, features, values)``."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    l1 = np.full((FEATURES + 1, 1), L1)
    l1[-1] = 0

    def weights(at) -> np.ndarray:
        return np.where(
            np.abs(z[at]) <= l1[at], 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        )

    for _ in range(EPOCHS):
        for label, at, x in samples:
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows ``(doc_id, lang, h)`` of each language with the smallest ``h``, then id.

    Counts by language and range of ``h`` tell how far one has to look, so
    that few more rows than are wanted meet in the window of a language. There
    is one such bound per language, as there is one class in the model.
    """
    part = F.shiftright("h", 64 - PARTS_BITS)
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        rows.groupBy(F.col("lang").alias("lang"), part.alias("part")).agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("before") < most)
        .groupBy(F.col("lang").alias("_lang")).agg(F.max("part").alias("_last"))
    )
    near = rows.join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).where(part <= F.col("_last"))
    draw = Window.partitionBy("lang").orderBy("h", "doc_id")
    return near.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= most).select(*rows.columns)


def fit(docs: DataFrame, most: int = MOST_PER_LANGUAGE) -> Model:
    """A model from the rows with a text, and a language, that ``docs`` has.

    Document frequencies cover all rows. The classifier is fitted on the
    ``most`` rows of each language with the smallest hashed ids, in one task;
    every fifth of them is kept for the temperature.
    """
    total, frequency = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    picks = _smallest(rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")), most).select(
        F.col("doc_id").alias("_d"), F.col("lang").alias("_l")
    ).distinct()
    # At most ``most`` rows per language.
    chosen = rows.join(
        F.broadcast(picks), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("lang") == F.col("_l")), "left_semi"
    ).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns)):
                ids, _, letters = grams([text])
                if letters[0]:
                    at, n = np.unique(ids, return_counts=True)
                    out.append((lang, h, at, n / (3.0 * letters[0]) * idf[at]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.float64()))],
                names=["lang", "h", "at", "x"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (lang, np.append(np.array(at), FEATURES), np.append(np.array(x), 1.0))
            for batch in batches
            for lang, at, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))
        ]
        if not rows:
            return
        languages = sorted({r[0] for r in rows})
        number = {lang: i for i, lang in enumerate(languages)}
        samples = [(number[lang], at, x) for lang, at, x in rows]
        w, bias = _train([s for i, s in enumerate(samples) if i % 5] or samples, len(languages))
        kept = [s for i, s in enumerate(samples) if i % 5 == 0]
        full = np.vstack([w, bias])
        logits = np.array([x @ full[at] for _, at, x in kept])
        t = _temperature(logits, np.array([label for label, _, _ in kept]))
        at = np.flatnonzero(w.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([languages]), pa.array([at.tolist()]), pa.array([w[at].ravel().tolist()]),
             pa.array([bias.tolist()]), pa.array([t])],
            names=["languages", "at", "w", "bias", "temperature"],
        )

    sampled = chosen.mapInArrow(sample, "lang string, h long, at array<long>, x array<double>")
    found = (
        sampled.repartition(1).sortWithinPartitions("h", "lang")
        .mapInArrow(train, "languages array<string>, at array<long>, w array<double>, bias array<double>, temperature double")
        .collect()
    )
    if not found:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    r = found[0]
    table = np.zeros((FEATURES, len(r["languages"])), np.float32)
    at = np.array(r["at"], np.int64)
    table[at] = np.array(r["w"]).reshape(len(at), len(r["languages"])) * idf[at, None]
    return Model(list(r["languages"]), table, np.array(r["bias"]), r["temperature"])


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Predict the language of every row from its text, learning from the rows outside the held-out part.

    A null id counts as the empty text when parts are drawn; rows that repeat
    an id fall into the same part, and each is predicted by itself. A null or
    empty text, and one without a letter, is ``und`` with score 0, as is every
    text if nothing could be learned. Of languages with the same probability the
    first by code point is predicted. Texts are read whole. An empty table
    gives an empty one; columns other than id, text and language are not read,
    whatever they are called.
    """
    model = fit(docs.where(training(F.col("doc_id"), modulus, held_out)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predict(model, pc.fill_null(batch.column(2), "").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    part = ~training(F.col("doc_id"), modulus, held_out)
    return docs.select("doc_id", part.alias("held_out"), "text").mapInArrow(
        work, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language that is as likely as ``least``, columns unchanged.

    A null or empty text, and one without a letter, has none and goes. Rows
    that repeat stay or go alike; columns may have any names.
    """
    model = fit(docs)
    field = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, field, 500_000):
                languages, scores = predict(model, pc.fill_null(cut.column(field), "").to_pylist())
                yield cut.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(languages, scores)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
