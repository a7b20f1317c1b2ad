"""Language-model scores: base scores against a plain program, the model by its properties."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hitpath.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def check(docs):
    rows = docs.collect()
    out = {r.doc_id for r in rows if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2}
    count = Counter(t for r in rows if r.doc_id not in out for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        ts = tokens(r.text)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)
        want.append((r.doc_id, r.doc_id in out, len(ts), sum(count[t] > 0 for t in ts), n, round(base, 5)))
    got = lm.score(docs).collect()
    assert sorted(((*r[:5], round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    return got


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_scores(request, table, monkeypatch):
    got = check(request.getfixturevalue(table))
    if table == "documents":
        unseen = [r for r in got if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
        again = {r.doc_id: r.score for r in lm.score(request.getfixturevalue(table)).collect()}
        assert all(abs(again[r.doc_id] - r.score) < 1e-3 for r in got)


def test_no_rows(empty):
    assert lm.score(empty).count() == 0


def test_probabilities_add_up():
    """Over all known tokens and the unknown one, after every class."""
    rng = np.random.default_rng(0)
    word, fine = rng.zipf(1.4, 5000) % 300, rng.integers(0, 256, 5000)
    keys, c2 = np.unique(word * 256 + fine, return_counts=True)
    words, index = np.unique(keys // 256, return_inverse=True)
    keys = index * 256 + keys % 256
    total = np.bincount(keys % 256, c2, 256)
    rows = {"bucket": 0, "batch": 0, "hashes": words.astype("<u8").tobytes(), "pairs": lm._pack(np.bincount(index)),
            "fines": lm._pack(keys % 256), "counts": lm._pack(c2)}
    import pyarrow as pa

    work, _ = lm._train(total, 1)
    row = work((pa.scalar(0),), pa.Table.from_pylist([rows])).to_pylist()[0]
    sums = lm._as_sums(np.array(row["sums"]))
    assert sums.known == len(words) and sums.tokens == 5000
    model = lm._Model(row, sums)
    for f in (0, 7, 255):
        p = model.predict(np.arange(len(words) + 1), np.full(len(words) + 1, f))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_seating_follows_its_distribution():
    """Tables of many dishes against one customer after the other, weighted by the exact recursion."""
    rng = np.random.default_rng(1)
    d, opens = 0.7, 2.5
    table = lm.stirling(d)
    for c in (2, 5, 30):
        weight = table[c, 1 : c + 1] + np.log(opens) * np.arange(1, c + 1)
        weight = np.exp(weight - weight.max())
        mean = (weight * np.arange(1, c + 1)).sum() / weight.sum()
        drawn = lm.seat(np.full(20000, c), np.full(20000, np.log(opens)), table, d, rng)
        assert drawn.min() >= 1 and drawn.max() <= c and abs(drawn.mean() - mean) < 0.05
    many = lm.seat(np.full(500, 5000), np.full(500, np.log(opens)), table, d, rng)
    assert (many >= 1).all() and (many <= 5000).all()


def test_packing():
    for x in ([], [0], [255, 256], [2**40, 1]):
        assert lm._unpack(lm._pack(np.array(x, np.int64))).tolist() == x
