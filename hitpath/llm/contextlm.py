"""Scores from a hierarchical Pitman-Yor language model.

A token is predicted from the token before it: every token of the training
part is a context with a restaurant of its own, and all of these have the root
as parent, over a uniform base of all known tokens and one unknown. The
customers of a restaurant are the tokens that follow its context, the tables it
opens are customers of the root. Seating is sampled by Gibbs: each dish of each
restaurant in turn gets a number of tables given all the rest. The predictive
probabilities are averaged over several samples.

All counts of one token, behind whatever context, lie in one bucket, by the
hash of the token. The tables of a context lie in many: between two sweeps
every bucket sends what it has of each context to the context's group, and gets
the sum over all buckets back. Dishes with one customer have one table, so only
those with more are sampled and sent. Two sums of the root are shared.

Tokens are numbered within their bucket by falling count, so that a context is
a small number and not a hash. Texts are read once and kept as batches of token
numbers; a batch asks the buckets for its different tokens and pairs, so a
token that every text has is asked for once a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import partitions, portions, ranges, shared_path, training, written

#: Of the root, and of the contexts.
DISCOUNT = (0.65, 0.75)
STRENGTH = (1.0, 1.0)
BURN_IN, SAMPLES = 3, 3
BATCH_TOKENS = 2_000_000
MERGED = 4_000_000
#: Buckets are one for this many tokens, at most four for each shuffle partition; rows between batches, buckets and groups
#: are as many as their products, so there is a most for both.
BUCKET_TOKENS, MOST_BUCKETS, MOST_GROUPS = 500_000, 1024, 64
END = b"\n"
_EXACT = 48


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, without planes that are all zero, compressed."""
    width = 1
    while len(x) and int(x.max()) >> (8 * width):
        width += 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bucket(prefixes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of tokens by the first 16 bits of their hashes."""
    return prefixes * buckets >> 16


_TEXTS = pa.schema(
    [("batch", pa.int64()), ("hashes", pa.binary()), ("prefixes", pa.binary()), ("trained", pa.binary()), ("tokens", pa.binary()),
     ("end", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("held_out", pa.binary())]
)
_TEXTS_SQL = (
    "batch long, hashes binary, prefixes binary, trained binary, tokens binary, end long, size long, doc_ids array<long>, "
    "lengths binary, held_out binary"
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
        """Tokens numbered by falling frequency, with their hashes and training counts."""
        codes, words = np.concatenate(self.codes), list(self.number)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        codes, words = rank[codes], [words[i] for i in order]
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], "<u8")
        trains = np.repeat(~np.array(self.held_out, bool), self.lengths)
        row = {
            "batch": batch, "hashes": hashes.tobytes(), "prefixes": _pack((hashes >> np.uint64(48)).astype(np.int64)),
            "trained": _pack(np.bincount(codes, trains, len(words)).astype(np.int64)), "tokens": _pack(codes), "end": int(rank[0]),
            "size": self.size, "doc_ids": self.doc_ids, "lengths": _pack(np.array(self.lengths)),
            "held_out": _pack(np.array(self.held_out, np.int64)),
        }
        return pa.RecordBatch.from_pylist([row], schema=_TEXTS)


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


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, with the places of its tokens."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]))


_WORDS = "bucket long, batch long, ranks binary, known long, tokens long"


def _vocabulary(texts: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Numbers of the tokens: a row for every batch with one more than each token's number in the bucket, 0 if
    unknown, and a row without batch for every bucket, with the training counts by number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], "<u8"), _unpack(row["trained"])
                rows = [
                    {"bucket": b, "batch": row["batch"], "hashes": hashes[mine].tobytes(), "counts": _pack(counts[mine])}
                    for b, mine in _by_bucket(_bucket(_unpack(row["prefixes"]), buckets), buckets)
                ]
                yield from _table(rows, "bucket long, batch long, hashes binary, counts binary").to_batches()

    def number(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [np.frombuffer(r["hashes"], "<u8") for r in rows]
        words, where = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(where, np.concatenate([_unpack(r["counts"]) for r in rows]), len(words)).astype(np.int64)
        order = np.lexsort((words, -counts))
        known = int((counts > 0).sum())
        ranks = np.zeros(len(words), np.int64)
        ranks[order[:known]] = np.arange(1, known + 1)
        out = [{"bucket": key[0].as_py(), "ranks": _pack(counts[order[:known]]), "known": known, "tokens": int(counts.sum())}]
        for r, own in zip(rows, np.split(ranks[where], np.cumsum([len(a) for a in asked])[:-1])):
            out.append({"bucket": r["bucket"], "batch": r["batch"], "ranks": _pack(own)})
        return _table(out, _WORDS)

    asks = texts.select("batch", "hashes", "prefixes", "trained").mapInArrow(
        ask, "bucket long, batch long, hashes binary, counts binary"
    )
    return asks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(number, _WORDS)


def _before(codes: np.ndarray, end: int) -> np.ndarray:
    """The token before each; the first follows an end, as every text's last token is one."""
    return np.concatenate([[end], codes[:-1]])


_ASKED = "bucket long, batch long, ranks binary, pairs binary, contexts binary, counts binary"


def _ask(buckets: int):
    """What a batch asks of each bucket: its tokens there, with the known contexts before the known ones and the
    training counts of these pairs."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            bucket, codes = _bucket(_unpack(row["prefixes"]), buckets), _unpack(row["tokens"])
            ranks, size, places = np.zeros(len(bucket), np.int64), len(bucket), dict(_by_bucket(bucket, buckets))
            for r in right.to_pylist():
                ranks[places[r["bucket"]]] = _unpack(r["ranks"])
            number = (ranks - 1) * buckets + bucket
            before = _before(codes, row["end"])
            both = (ranks[codes] > 0) & (ranks[before] > 0)
            trains = np.repeat(_unpack(row["held_out"]) == 0, _unpack(row["lengths"]))[both]
            found, where = np.unique(codes[both] * size + before[both], return_inverse=True)
            counts = np.bincount(where, trains, len(found)).astype(np.int64)
            pairs = np.bincount(found // size, minlength=size)
            contexts, starts = number[found % size], np.cumsum(pairs) - pairs
            for b, mine in places.items():
                at = ranges(starts[mine], pairs[mine])
                out.append(
                    {"bucket": b, "batch": row["batch"], "ranks": _pack(ranks[mine]), "pairs": _pack(pairs[mine]),
                     "contexts": _pack(contexts[at]), "counts": _pack(counts[at])}
                )
        return _table(out, _ASKED)

    return work


def _merged(rows: Iterable[dict], span: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one bucket that training has, as number of the token times ``span`` plus context, and their counts."""
    keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([keys, *(k for k, _ in held)])
        found, where = np.unique(both, return_inverse=True)
        return found, np.bincount(where, np.concatenate([counts, *(n for _, n in held)]), len(found)).astype(np.int64)

    for row in rows:
        n = _unpack(row["counts"])
        held.append((_keys(row, span)[n > 0], n[n > 0]))
        size += len(held[-1][0])
        if size > max(MERGED, len(keys)):
            keys, counts = merge()
            held, size = [], 0
    return merge()


def _keys(row: dict, span: int) -> np.ndarray:
    return np.repeat(_unpack(row["ranks"]) - 1, _unpack(row["pairs"])) * span + _unpack(row["contexts"])


def stirling(discount: float, most: int = _EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weights of seating c customers at t tables."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0
    for c in range(most):
        t = np.arange(1, most + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = table[c, 1:] + np.log(np.maximum(c - t * discount, 0))
        table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


def seat(c: np.ndarray, log_open: np.ndarray, table: np.ndarray, discount: float, rng) -> np.ndarray:
    """A Gibbs draw of each dish's number of tables, given how readily its restaurant opens one.

    Of the first ``_EXACT`` customers the draw is from the exact distribution.
    Later ones are seated one after the other in blocks of an eighth of those
    seated, for which that readiness is held.
    """
    tables = np.minimum(c, 1)
    steps = np.arange(1, _EXACT + 1)
    for size in np.unique(np.minimum(c, _EXACT)).tolist():
        if size < 2:
            continue
        at = np.flatnonzero(np.minimum(c, _EXACT) == size)
        for i in range(0, len(at), 1 << 15):
            some = at[i : i + (1 << 15)]
            weight = table[size, 1 : size + 1] + log_open[some, None] * steps[:size]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            draw = rng.random(len(some)) * weight[:, -1]
            tables[some] = 1 + np.minimum((weight <= draw[:, None]).sum(axis=1), size - 1)
    rest = np.flatnonzero(c > _EXACT)
    if len(rest):
        n, t, opens = np.full(len(rest), _EXACT), tables[rest], np.exp(log_open[rest])
        while (n < c[rest]).any():
            block = np.minimum(c[rest] - n, n // 8)
            t = t + rng.binomial(block, opens / (n - discount * t + opens))
            n = n + block
        tables[rest] = t
    return tables


FIXED, STATE, DENSE = -1, -2, -3
_ROWS = "bucket long, part int, a binary, b binary, c binary, d binary, c0 long, t0 long"


def _messages(bucket: int, contexts: np.ndarray, saved: np.ndarray, groups: int, keys: bool) -> list[dict]:
    """For the group of each context, its customers at shared tables in this bucket; with ``keys`` also which contexts."""
    found, where = np.unique(contexts, return_inverse=True)
    sums = np.bincount(where, saved, len(found)).astype(np.int64)
    return [
        {"bucket": bucket, "part": g, "a": _pack(sums[mine])} | ({"b": _pack(np.diff(found[mine], prepend=0))} if keys else {})
        for g, mine in _by_bucket(found % groups, groups)
    ]


def _state(bucket: int, t: np.ndarray, t0: np.ndarray, c0: np.ndarray) -> dict:
    return {"bucket": bucket, "part": STATE, "a": _pack(t), "b": _pack(t0), "c0": int(c0.sum()), "t0": int(t0.sum())}


def _start(span: int, groups: int):
    """One table for each dish. What stays the same for all sweeps, the first state and the first messages."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys, c = _merged(table.to_pylist(), span)
        words = keys // span
        n = int(words[-1]) + 1 if len(words) else 0
        more = c > 1
        contexts = keys[more] % span
        fixed = {
            "bucket": bucket, "part": FIXED, "a": _pack(np.bincount(words[~more], minlength=n)),
            "b": _pack(np.bincount(words[more], minlength=n)), "c": _pack(contexts), "d": _pack(c[more]),
        }
        ones = np.ones(len(contexts), np.int64)
        state = _state(bucket, ones, np.ones(n, np.int64), np.bincount(words, minlength=n))
        return _table([fixed, state, *_messages(bucket, contexts, c[more] - 1, groups, True)], _ROWS)

    return work


def _answers(buckets: int, dense: bool):
    """Tables of the contexts of one group over all buckets, to each bucket for the contexts it has sent; if ``dense``,
    for every token by its number in its own bucket."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        counts, asked = {}, {}
        for r in left.to_pylist():
            if r["part"] == FIXED:
                counts[r["bucket"]] = _unpack(r["a"])
            else:
                asked[r["bucket"]] = np.cumsum(_unpack(r["b"]))
        start = np.zeros(buckets, np.int64)
        own = sorted(counts)
        start[own] = np.cumsum([0, *(len(counts[b]) for b in own)])[:-1]
        tables = np.concatenate([np.zeros(0, np.int64), *(counts[b] for b in own)])
        places = {b: start[k % buckets] + k // buckets for b, k in asked.items()}
        for r in right.to_pylist():
            tables[places[r["bucket"]]] -= _unpack(r["a"])
        if dense:
            out = [{"bucket": b, "part": DENSE, "a": _pack(tables[start[b] : start[b] + len(counts[b])])} for b in own]
        else:
            out = [{"bucket": b, "part": key[0].as_py(), "a": _pack(tables[at])} for b, at in places.items()]
        return _table(out, _ROWS)

    return work


def resample(word, c, t, singles, t0, tables, all_c0: int, all_t0: int, known: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Gibbs sweep over the dishes of one bucket that have more than one customer, then over those of the root.

    ``tables`` are those of each dish's context. A dish is drawn given all other
    tables and its first. Returns the tables of the dishes, of the root, and the
    customers of the root.
    """
    c0 = singles + np.bincount(word, t, len(singles)).astype(np.int64)
    rest = c0[word] - t + 1
    rest_t0 = np.minimum(t0[word], rest)
    new = (STRENGTH[0] + DISCOUNT[0] * (all_t0 - t0[word] + rest_t0)) / (known + 1)
    p0 = (rest - DISCOUNT[0] * rest_t0 + new) / (STRENGTH[0] + all_c0 - t + 1)
    opens = (STRENGTH[1] + DISCOUNT[1] * (tables - t + 1)) * p0
    t = seat(c, np.log(opens), stirling(DISCOUNT[1]), DISCOUNT[1], rng)
    c0 = singles + np.bincount(word, t, len(singles)).astype(np.int64)
    new = (STRENGTH[0] + DISCOUNT[0] * (all_t0 - t0 + 1)) / (known + 1)
    t0 = seat(c0, np.log(new), stirling(DISCOUNT[0]), DISCOUNT[0], rng)
    return t, t0, c0


def _sweep(sweep: int, all_c0: int, all_t0: int, known: int, groups: int):
    """The next state of a bucket and its messages, from the true sums of the sweep before."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _ROWS)
        bucket, fixed = key[0].as_py(), left.to_pylist()[0]
        singles, more, contexts, c = (_unpack(fixed[x]) for x in "abcd")
        rows = {r["part"]: r for r in right.to_pylist()}
        t, t0 = _unpack(rows[STATE]["a"]), _unpack(rows[STATE]["b"])
        found, where = np.unique(contexts, return_inverse=True)
        tables = np.zeros(len(found), np.int64)
        for g, mine in _by_bucket(found % groups, groups):
            tables[mine] = _unpack(rows[g]["a"])
        word = np.repeat(np.arange(len(singles)), more)
        rng = np.random.default_rng((bucket, sweep))
        t, t0, c0 = resample(word, c, t, singles, t0, tables[where], all_c0, all_t0, known, rng)
        return _table([_state(bucket, t, t0, c0), *_messages(bucket, contexts, c - t, groups, False)], _ROWS)

    return work


_FOUND = "bucket long, batch long, words binary, pairs binary"


def _answer(span: int):
    """What each batch has asked for, of all samples: of known tokens the training count, customers and tables at the
    root and tables as a context; of pairs the count, and the tables of those with more than one customer."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.to_pylist()
        keys, c = _merged(asked, span)
        words, more = keys // span, c > 1
        parts = {(r["part"], r["sample"]): r for r in right.to_pylist()}
        t = np.ones((SAMPLES, len(keys)), np.int64)
        each = []
        for s in range(SAMPLES if (STATE, 0) in parts else 0):
            t[s, more] = _unpack(parts[STATE, s]["a"])
            t0, tables = _unpack(parts[STATE, s]["b"]), _unpack(parts[DENSE, s]["a"])
            each += [np.bincount(words, t[s], len(t0)).astype(np.int64), t0, tables]
        count = np.bincount(words, c).astype(np.int64)
        out = []
        for row in asked:
            ranks, own = _unpack(row["ranks"]), _keys(row, span)
            mine = ranks[ranks > 0] - 1
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            n = np.where(keys[at] == own, c[at], 0) if len(keys) else np.zeros(len(own), np.int64)
            out.append(
                {"bucket": row["bucket"], "batch": row["batch"],
                 "words": _join([(ranks > 0).astype(np.int64), *(x[mine] for x in ([count, *each] if len(mine) else []))]),
                 "pairs": _join([n, *(x[at[n > 1]] for x in t)])}
            )
        return _table(out, _FOUND)

    return work


def _join(arrays: list[np.ndarray]) -> bytes:
    """Several packed arrays, each after its length in bytes."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in map(_pack, arrays))


def _parts(data: bytes) -> list[np.ndarray]:
    out, i = [], 0
    while i < len(data):
        n = int.from_bytes(data[i : i + 4], "little")
        out.append(_unpack(data[i + 4 : i + 4 + n]))
        i += 4 + n
    return out


def predictive(c, t, count, tables, c0, t0, all_c0: int, all_t0: int, known: int) -> np.ndarray:
    """Probability of each dish: ``c`` of the context's ``count`` customers are there, at ``t`` of its ``tables``."""
    p0 = (c0 - DISCOUNT[0] * t0 + (STRENGTH[0] + DISCOUNT[0] * all_t0) / (known + 1)) / (STRENGTH[0] + all_c0)
    return (c - DISCOUNT[1] * t + (STRENGTH[1] + DISCOUNT[1] * tables) * p0) / (STRENGTH[1] + count)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _total(roots: list[tuple[int, int]], known: int, tokens: int, buckets: int):
    """The scores of a batch's documents."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        bucket, codes = _bucket(_unpack(row["prefixes"]), buckets), _unpack(row["tokens"])
        size, places = len(bucket), dict(_by_bucket(bucket, buckets))
        # Training count; then customers, tables at the root and tables as a context of each sample.
        words = np.zeros((1 + 3 * SAMPLES, size), np.int64)
        found, where = np.unique(codes * size + _before(codes, row["end"]), return_inverse=True)
        word, context = found // size, found % size
        rows = []
        for r in right.select(["bucket", "words", "pairs"]).to_pylist():
            mine = places[r["bucket"]]
            seen, *values = _parts(r["words"])
            if values:
                words[:, mine[seen > 0]] = values
            rows.append((mine, r["pairs"]))
        asked = np.flatnonzero((words[0][word] > 0) & (words[0][context] > 0))
        pairs = np.bincount(word[asked], minlength=size)
        starts = np.cumsum(pairs) - pairs
        c, t = np.zeros(len(found), np.int64), np.zeros((SAMPLES, len(found)), np.int64)
        for mine, data in rows:
            at = asked[ranges(starts[mine], pairs[mine])]
            n, *more = _parts(data)
            c[at], t[:, at] = n, np.minimum(n, 1)
            t[:, at[n > 1]] = more
        p = np.zeros(len(found))
        for s, (all_c0, all_t0) in enumerate(roots):
            c0, t0, tables = words[1 + 3 * s : 4 + 3 * s]
            p += predictive(c, t[s], words[0][context], tables[context], c0[word], t0[word], all_c0, all_t0, known)
        logs = np.log10(p / len(roots))
        lengths = _unpack(row["lengths"])
        begins = np.cumsum(lengths) - lengths
        per = lambda x: np.add.reduceat(x, begins)
        base = np.log10((words[0] + 1) / (tokens + known + 1))
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(_unpack(row["held_out"]) > 0),
                "n_tokens": lengths,
                "n_known": per((words[0] > 0)[codes].astype(np.int64)),
                "train_tokens": np.full(len(lengths), tokens),
                "base_score": per(base[codes]),
                "score": per(logs[where]),
            }
        )

    return work


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Scores of every row from a model of the rows outside the held-out part.

    A-Z are lower-cased, tokens are the words between ASCII white space and one
    end per text; a null text has the end only. ``base_score`` adds one to the
    counts of single tokens, ``score`` is the model's log10 probability, in
    which all tokens without a count in training are one unknown token. Rows
    that repeat an id fall into the same part, and each counts; a null id counts
    as the empty text when parts are drawn. Texts are read whole. An empty
    table gives an empty one; columns other than id and text are not read,
    whatever they are called. Scores are computed when this is called.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    # Dealt by batch on disk, so that the texts are never shuffled.
    path = shared_path(spark, "lm-texts")
    name = "lm_texts_" + path[-32:]
    encoded(docs, modulus, held_out).write.format("parquet").bucketBy(parts, "batch").option("path", path).saveAsTable(name)
    kept: list[DataFrame] = []

    def dealt(df: DataFrame, key: str) -> DataFrame:
        """``df`` shuffled by a column once for all that group by it."""
        kept.append(df.repartition(parts, key).persist(StorageLevel.DISK_ONLY))
        return kept[-1]

    try:
        texts = spark.read.table(name)
        size = texts.agg(F.sum("size")).first()[0] or 0
        buckets = max(1, min(4 * parts, MOST_BUCKETS, size // BUCKET_TOKENS))
        groups = max(1, min(MOST_GROUPS, buckets // 4))
        # A multiple, so that a context and the bucket that counts it have the same remainder.
        buckets -= buckets % groups
        words = written(_vocabulary(texts, parts, buckets), "lm-words")
        # One row a bucket, with the counts by number.
        vocabulary = words.where("batch is null")
        known, tokens, most = vocabulary.agg(F.sum("known"), F.sum("tokens"), F.max("known")).first()
        known, tokens, span = known or 0, tokens or 0, max(1, most or 0) * buckets
        left = texts.select("batch", "prefixes", "tokens", "end", "doc_ids", "lengths", "held_out").groupBy("batch")
        numbers = words.where("batch is not null").select("bucket", "batch", "ranks").groupBy("batch")
        asked = dealt(left.cogroup(numbers).applyInArrow(_ask(buckets), _ASKED), "bucket")
        state = written(asked.groupBy("bucket").applyInArrow(_start(span, groups), _ROWS), "lm-start")
        fixed = dealt(state.where(f"part = {FIXED}"), "bucket")
        counts = vocabulary.select(
            "bucket", F.lit(FIXED).alias("part"), F.col("ranks").alias("a"), F.lit(None).cast("binary").alias("b"),
            F.pmod("bucket", F.lit(groups)).cast("int").alias("group"),
        )
        sent = state.where("part >= 0").select("bucket", "part", F.lit(None).cast("binary").alias("a"), "b", F.col("part").alias("group"))
        sums_by_group = dealt(counts.unionByName(sent), "group")

        def answers(state: DataFrame, dense: bool = False) -> DataFrame:
            messages = state.where("part >= 0").select("bucket", "part", "a")
            return sums_by_group.groupBy("group").cogroup(messages.groupBy("part")).applyInArrow(_answers(buckets, dense), _ROWS)

        def root(state: DataFrame) -> tuple[int, int]:
            c0, t0 = state.where(f"part = {STATE}").agg(F.sum("c0"), F.sum("t0")).first()
            return c0 or 0, t0 or 0

        roots, samples = [], []
        sums = root(state)
        for i in range(BURN_IN + SAMPLES):
            now = state.where(f"part = {STATE}").unionByName(answers(state))
            work = _sweep(i, *sums, known, groups)
            state = written(fixed.groupBy("bucket").cogroup(now.groupBy("bucket")).applyInArrow(work, _ROWS), f"lm-sweep-{i}")
            sums = root(state)
            if i >= BURN_IN:
                roots.append(sums)
                sample = state.where(f"part = {STATE}").unionByName(answers(state, dense=True))
                samples.append(sample.select("bucket", "part", "a", "b", F.lit(i - BURN_IN).alias("sample")))
        model = samples[0]
        for sample in samples[1:]:
            model = model.unionByName(sample)
        found = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_answer(span), _FOUND)
        total = _total(roots, known, tokens, buckets)
        return written(left.cogroup(found.groupBy("batch")).applyInArrow(total, _SCORES), "lm-scores")
    finally:
        for df in kept:
            df.unpersist()
        spark.sql(f"drop table if exists {name}")
