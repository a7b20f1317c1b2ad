"""Scores from hierarchical Pitman-Yor language models.

``score`` has one restaurant per context and lies in ``contextlm``. The rest of
this module is ``score_by_class``, a coarser model for where that is too much.
Here a token is predicted through three levels of restaurants: one per ending
class of the token before it, their parents by last byte, and the root, over a
uniform base of all known tokens and one unknown. The customers of a restaurant
are its tokens, the tables it opens are customers of its parent. Seating is sampled by Gibbs: each dish of each restaurant in turn
gets a number of tables given all the rest. The predictive probabilities are
averaged over several samples.

All restaurants' counts of one token lie in one bucket, by the hash of the
token, because a dish's tables only concern the same dish of the parent. What
buckets share are the sums of each restaurant, a few hundred numbers. Texts are
read once and kept as batches of token numbers; a batch asks the buckets for
its different tokens and pairs, so a token that every text has is asked for
once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import partitions, portions, ranges, training, written
from hitpath.llm.contextlm import BATCH_TOKENS, END, _bucket_of, _pack, _unpack, score, seat, stirling

__all__ = ["perplexity", "score", "score_by_class", "seat", "stirling"]

FINE, COARSE = 256, 16
DISCOUNT = (0.65, 0.7, 0.75)
STRENGTH = (1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 3, 3


def _classes(words: list[bytes]) -> np.ndarray:
    """The restaurant that each token is the context of: the end has 0, others go by their last two bytes."""
    last = np.fromiter((w[-1] for w in words), np.int64, len(words))
    other = np.fromiter((w[-2] if len(w) > 1 else 0 for w in words), np.int64, len(words))
    coarse = 1 + (last * 2654435761 >> 7) % (COARSE - 1)
    fine = coarse * (FINE // COARSE) + (other * 2654435761 >> 7) % (FINE // COARSE)
    return np.where(np.fromiter((w == END for w in words), bool, len(words)), 0, fine)


_TEXTS = pa.schema(
    [("batch", pa.int64()), ("hashes", pa.binary()), ("classes", pa.binary()), ("tokens", pa.binary()),
     ("pairs", pa.binary()), ("fines", pa.binary()), ("counts", pa.binary()), ("sums", pa.list_(pa.int64())),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("held_out", pa.binary())]
)
_TEXTS_SQL = (
    "batch long, hashes binary, classes binary, tokens binary, pairs binary, fines binary, counts binary, "
    "sums array<long>, doc_ids array<long>, lengths binary, held_out binary"
)


class _Batch:
    """Documents gathered until they have ``BATCH_TOKENS`` tokens."""

    def __init__(self):
        self.number: dict[bytes, int] = {END: 0}
        self.codes: list[np.ndarray] = []
        self.doc_ids, self.lengths, self.held_out, self.size = [], [], [], 0

    def add(self, doc_ids: list, texts: list[str], held_out: list[bool]) -> None:
        docs = [[*t.encode("utf-8", "surrogatepass").lower().split(), END] for t in texts]
        new = set().union(*docs).difference(self.number)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        lengths = list(map(len, docs))
        total = sum(lengths)
        self.codes.append(np.fromiter(map(self.number.__getitem__, chain.from_iterable(docs)), np.int32, total))
        self.doc_ids += doc_ids
        self.lengths += lengths
        self.held_out += held_out
        self.size += total

    def row(self, batch: int) -> pa.RecordBatch:
        """Tokens numbered by falling frequency; each token's pairs are the classes before it, with training counts."""
        codes, words = np.concatenate(self.codes), list(self.number)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        codes, words = rank[codes], [words[i] for i in order]
        classes = _classes(words)
        lengths = np.array(self.lengths)
        keys = codes * FINE + _before(codes, classes)
        trains = np.repeat(~np.array(self.held_out), lengths)
        found, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, trains, len(found)).astype(np.int64)
        fines = found % FINE
        row = {
            "batch": batch,
            "hashes": np.array([xxhash.xxh64_intdigest(w) for w in words], "<u8").tobytes(),
            "classes": _pack(classes), "tokens": _pack(codes), "pairs": _pack(np.bincount(found // FINE, minlength=len(words))),
            "fines": _pack(fines), "counts": _pack(counts),
            "sums": np.bincount(fines, counts, FINE).astype(np.int64).tolist(),
            "doc_ids": self.doc_ids, "lengths": _pack(lengths), "held_out": _pack(np.array(self.held_out, np.int64)),
        }
        return pa.RecordBatch.from_pylist([row], schema=_TEXTS)


def _before(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the token before each; the first follows an end, as every text's last token is one."""
    return np.concatenate([[0], classes[codes[:-1]]])


def encoded(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """The texts as batches of token numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, held = TaskContext.get().partitionId(), 0, _Batch()
        for batch in batches:
            texts = batch.column(1)
            for i, j in portions(pc.binary_length(texts).to_pylist(), 2_000_000):
                held.add(*(batch.column(c).slice(i, j - i).to_pylist() for c in range(3)))
                if held.size >= BATCH_TOKENS:
                    yield held.row(place << 24 | n)
                    n, held = n + 1, _Batch()
        if held.size:
            yield held.row(place << 24 | n)

    part = ~training(F.col("doc_id"), modulus, held_out)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("held_out"))
    return rows.mapInArrow(work, _TEXTS_SQL)


def _requests(texts: DataFrame, buckets: int) -> DataFrame:
    """What each batch asks of each bucket: its tokens there, with the classes before them and training counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = np.frombuffer(row["hashes"], "<u8")
                pairs, fines, counts = (_unpack(row[c]) for c in ("pairs", "fines", "counts"))
                starts = np.cumsum(pairs) - pairs
                bucket = _bucket_of(hashes, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[b] : cuts[b + 1]]
                    at = ranges(starts[mine], pairs[mine])
                    one = (b, row["batch"], hashes[mine].tobytes(), _pack(pairs[mine]), _pack(fines[at]), _pack(counts[at]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x]) for x in one], names=["bucket", "batch", "hashes", "pairs", "fines", "counts"]
                    )

    return texts.select("batch", "hashes", "pairs", "fines", "counts").mapInArrow(
        work, "bucket long, batch long, hashes binary, pairs binary, fines binary, counts binary"
    )


class _Sums(NamedTuple):
    """Customers and tables of every restaurant, per sample: root, coarse, fine; and the numbers of all tokens."""

    c0: np.ndarray
    t0: np.ndarray
    c1: np.ndarray
    t1: np.ndarray
    c2: np.ndarray
    t2: np.ndarray
    known: int
    tokens: int


def _sample(word: np.ndarray, fine: np.ndarray, c2: np.ndarray, n_words: int, sums: np.ndarray, buckets: int, seed: int):
    """Seatings of one bucket's tokens: the samples' tables at the three levels.

    The sums of other buckets are not known here; they are taken to be like the
    bucket's own, which only affects how readily tables are opened.
    """
    rng = np.random.default_rng(seed)
    logs = [stirling(d) for d in DISCOUNT]
    coarse = fine // (FINE // COARSE)
    dish = word * COARSE + coarse
    dishes, up = np.unique(dish, return_inverse=True)
    dish_word, dish_coarse = dishes // COARSE, dishes % COARSE
    own = np.bincount(fine, c2, FINE)
    share = np.where(own > 0, sums / np.maximum(own, 1), 0.0)
    own1 = np.bincount(coarse, c2, COARSE)
    share1 = np.where(own1 > 0, sums.reshape(COARSE, -1).sum(axis=1) / np.maximum(own1, 1), 0.0)
    share0 = sums.sum() / max(1, c2.sum())
    base = 1 / (n_words * buckets + 1)
    t2, t1, t0 = np.minimum(c2, 1), None, None
    t1 = np.ones(len(dishes), np.int64)
    t0 = np.ones(n_words, np.int64)
    kept = []
    for sweep in range(BURN_IN + SAMPLES):
        c1 = np.bincount(up, t2, len(dishes)).astype(np.int64)
        c0 = np.bincount(dish_word, t1, n_words).astype(np.int64)
        all_c0, all_t0 = c0.sum() * share0, t0.sum() * share0
        p0 = (c0 - DISCOUNT[0] * t0 + (STRENGTH[0] + DISCOUNT[0] * all_t0) * base) / (STRENGTH[0] + all_c0)
        all_c1, all_t1 = np.bincount(dish_coarse, c1, COARSE) * share1, np.bincount(dish_coarse, t1, COARSE) * share1
        p1 = (c1 - DISCOUNT[1] * t1 + (STRENGTH[1] + DISCOUNT[1] * all_t1[dish_coarse]) * p0[dish_word]) / (
            STRENGTH[1] + all_c1[dish_coarse]
        )
        all_t2 = np.bincount(fine, t2, FINE) * share
        t2 = seat(c2, np.log((STRENGTH[2] + DISCOUNT[2] * all_t2[fine]) * p1[up]), logs[2], DISCOUNT[2], rng)
        c1 = np.bincount(up, t2, len(dishes)).astype(np.int64)
        t1 = seat(c1, np.log((STRENGTH[1] + DISCOUNT[1] * all_t1[dish_coarse]) * p0[dish_word]), logs[1], DISCOUNT[1], rng)
        c0 = np.bincount(dish_word, t1, n_words).astype(np.int64)
        t0 = seat(c0, np.full(n_words, np.log((STRENGTH[0] + DISCOUNT[0] * all_t0) * base)), logs[0], DISCOUNT[0], rng)
        if sweep >= BURN_IN:
            kept.append((t2, t1, t0))
    return dishes, kept


_SUMS = SAMPLES * (2 + 2 * COARSE + FINE) + FINE + 2


def _train(sums: np.ndarray, buckets: int):
    schema = pa.schema(
        [("bucket", pa.int64()), ("hashes", pa.binary()), ("keys", pa.binary()), ("c2", pa.binary()),
         ("t2", pa.binary()), ("t1", pa.binary()), ("t0", pa.binary()), ("sums", pa.list_(pa.int64()))]
    )

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, keys, counts = [], [], []
        for row in sorted(table.to_pylist(), key=lambda r: r["batch"]):
            own = np.frombuffer(row["hashes"], "<u8")
            n = _unpack(row["counts"])
            hashes.append(np.repeat(own, _unpack(row["pairs"]))[n > 0])
            keys.append(_unpack(row["fines"])[n > 0])
            counts.append(n[n > 0])
        words, word = np.unique(np.concatenate(hashes), return_inverse=True)
        pairs, where = np.unique(word * FINE + np.concatenate(keys), return_inverse=True)
        c2 = np.bincount(where, np.concatenate(counts), len(pairs)).astype(np.int64)
        bucket = key[0].as_py()
        dishes, kept = _sample(pairs // FINE, pairs % FINE, c2, len(words), sums, buckets, bucket)
        fine, coarse = pairs % FINE, dishes % COARSE
        up = np.searchsorted(dishes, pairs // FINE * COARSE + fine // (FINE // COARSE))
        out = []
        for t2, t1, t0 in kept:
            c1 = np.bincount(up, t2, len(dishes))
            out += [[t1.sum(), t0.sum()], np.bincount(coarse, c1, COARSE), np.bincount(coarse, t1, COARSE),
                    np.bincount(fine, t2, FINE)]
        out += [np.bincount(fine, c2, FINE), [len(words), c2.sum()]]
        joined = [np.concatenate([k[i] for k in kept]) for i in range(3)]
        row = {"bucket": bucket, "hashes": words.tobytes(), "keys": _pack(np.diff(pairs, prepend=0)), "c2": _pack(c2),
               "t2": _pack(joined[0]), "t1": _pack(joined[1]), "t0": _pack(joined[2]),
               "sums": np.concatenate(out).astype(np.int64).tolist()}
        return pa.Table.from_pylist([row], schema=schema)

    return work, (
        "bucket long, hashes binary, keys binary, c2 binary, t2 binary, t1 binary, t0 binary, sums array<long>"
    )


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of arrays position by position, first in each task; ``size`` numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += x.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

    rows = rows.select("sums").mapInArrow(add, "sums array<long>")
    out = np.zeros(size, np.int64)
    for r in rows.select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def _as_sums(flat: np.ndarray) -> _Sums:
    each = flat[: SAMPLES * (2 + 2 * COARSE + FINE)].reshape(SAMPLES, -1)
    rest = flat[each.size :]
    return _Sums(
        each[:, 0], each[:, 1], each[:, 2 : 2 + COARSE], each[:, 2 + COARSE : 2 + 2 * COARSE],
        rest[:FINE], each[:, 2 + 2 * COARSE :], int(rest[FINE]), int(rest[FINE + 1]),
    )


class _Model:
    """One bucket of the model, ready to predict."""

    def __init__(self, row: dict | None, sums: _Sums):
        self.sums = sums
        if row is None:
            row = {"hashes": b""} | dict.fromkeys(("keys", "c2", "t2", "t1", "t0"), _pack(np.zeros(0, np.int64)))
        self.words = np.frombuffer(row["hashes"], "<u8")
        n = len(self.words)
        self.keys = np.cumsum(_unpack(row["keys"]))
        self.c2 = _unpack(row["c2"])
        self.t2 = _unpack(row["t2"]).reshape(SAMPLES, -1)
        dish = self.keys // FINE * COARSE + self.keys % FINE // (FINE // COARSE)
        dishes, up = np.unique(dish, return_inverse=True)
        t1, t0 = _unpack(row["t1"]).reshape(SAMPLES, -1), _unpack(row["t0"]).reshape(SAMPLES, -1)
        self.count = np.bincount(self.keys // FINE, self.c2, n).astype(np.int64)
        # Probabilities at the coarse level for every token and class; the last row is the unknown token.
        self.p1 = np.empty((SAMPLES, n + 1, COARSE))
        for s in range(SAMPLES):
            c0, c1 = np.bincount(dishes // COARSE, t1[s], n), np.bincount(up, self.t2[s], len(dishes))
            own = np.append(c0 - DISCOUNT[0] * t0[s], 0.0)
            opens = (STRENGTH[0] + DISCOUNT[0] * sums.t0[s]) / (sums.known + 1)
            p0 = (own + opens) / (STRENGTH[0] + sums.c0[s])
            own = np.zeros((n + 1) * COARSE)
            own[dishes] = c1 - DISCOUNT[1] * t1[s]
            opens = p0[:, None] * (STRENGTH[1] + DISCOUNT[1] * sums.t1[s])[None, :]
            self.p1[s] = (own.reshape(-1, COARSE) + opens) / (STRENGTH[1] + sums.c1[s])[None, :]

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each token, one past the last for an unknown one."""
        at = np.searchsorted(self.words, hashes)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == hashes[known]
        return np.where(known, at, len(self.words))

    def predict(self, word: np.ndarray, fine: np.ndarray) -> np.ndarray:
        """Probability of each token after its class, averaged over the samples."""
        key = word * FINE + fine
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        coarse = fine // (FINE // COARSE)
        total = np.zeros(len(key))
        for s in range(SAMPLES):
            own = np.zeros(len(key))
            own[hit] = self.c2[at[hit]] - DISCOUNT[2] * self.t2[s][at[hit]]
            opens = (STRENGTH[2] + DISCOUNT[2] * self.sums.t2[s][fine]) * self.p1[s][word, coarse]
            total += (own + opens) / (STRENGTH[2] + self.sums.c2[fine])
        return total / SAMPLES


def score_by_class(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """As ``score``, from a coarser model: tokens that end alike are one context.

    It shares a few hundred sums whatever the corpus, where ``score`` keeps a
    restaurant for each token, and predicts much worse.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = 4 * parts
    texts = written(encoded(docs, modulus, held_out), "lm-texts")
    asked = _requests(texts, buckets)
    work, schema = _train(_added(texts, FINE), buckets)
    model = written(asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(work, schema), "lm-model")
    sums = _as_sums(_added(model, _SUMS))

    def answer(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = _Model(right.to_pylist()[0] if right.num_rows else None, sums)
        out = []
        for row in left.to_pylist():
            place = bucket.place(np.frombuffer(row["hashes"], "<u8"))
            p = bucket.predict(np.repeat(place, _unpack(row["pairs"])), _unpack(row["fines"]))
            out.append(
                {"batch": row["batch"], "bucket": row["bucket"], "counts": _pack(np.append(bucket.count, 0)[place]),
                 "logs": np.log10(p).astype("<f4").tobytes()}
            )
        return pa.Table.from_pylist(
            out, pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("logs", pa.binary())])
        )

    answers = (
        asked.repartition(parts, "bucket")
        .groupBy("bucket")
        .cogroup(model.drop("sums").groupBy("bucket"))
        .applyInArrow(answer, "batch long, bucket long, counts binary, logs binary")
    )

    def total(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        hashes, pairs, fines = np.frombuffer(row["hashes"], "<u8"), _unpack(row["pairs"]), _unpack(row["fines"])
        starts = np.cumsum(pairs) - pairs
        bucket = _bucket_of(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        count, logs = np.zeros(len(hashes), np.int64), np.zeros(len(fines))
        for r in right.to_pylist():
            mine = order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]
            count[mine] = _unpack(r["counts"])
            logs[ranges(starts[mine], pairs[mine])] = np.frombuffer(r["logs"], "<f4")
        codes = _unpack(row["tokens"])
        keys = np.repeat(np.arange(len(hashes)), pairs) * FINE + fines
        at = np.searchsorted(keys, codes * FINE + _before(codes, _unpack(row["classes"])))
        lengths = _unpack(row["lengths"])
        begins = np.cumsum(lengths) - lengths
        per = lambda x: np.add.reduceat(x, begins)
        base = np.log10((count + 1) / (sums.tokens + sums.known + 1))
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(_unpack(row["held_out"]) > 0),
                "n_tokens": lengths,
                "n_known": per((count > 0)[codes].astype(np.int64)),
                "train_tokens": np.full(len(lengths), sums.tokens),
                "base_score": per(base[codes]),
                "score": per(logs[at]),
            }
        )

    needed = texts.select("batch", "hashes", "classes", "tokens", "pairs", "fines", "doc_ids", "lengths", "held_out")
    return (
        needed.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(
            total,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity per token of the held-out and the other rows."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens")
    )
