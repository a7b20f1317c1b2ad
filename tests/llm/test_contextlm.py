"""The language model's contexts: a restaurant for each token, one model however it is dealt."""

import zlib

import numpy as np
import pytest

from hitpath.llm import contextlm, lm


def test_contexts_that_end_alike_are_apart(make_docs):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2][:80]
    unseen = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "nation red" if k % 2 else "station blue") for k, i in enumerate(ids)]
    rows += [(unseen[0], "nation red"), (unseen[1], "station red")]
    got = {r.doc_id: r for r in lm.score(make_docs(rows)).collect()}
    assert got[unseen[0]].held_out and got[unseen[1]].held_out
    # Both words are as frequent, so only their own contexts tell the texts apart.
    assert abs(got[unseen[0]].base_score - got[unseen[1]].base_score) < 1e-9
    assert got[unseen[0]].score > got[unseen[1]].score + 1


@pytest.mark.parametrize("buckets", [11, 16])
def test_buckets_share_their_sums(documents, monkeypatch, buckets):
    """With many buckets, in groups, the scores are those of one bucket, up to the draws."""
    one = {r.doc_id: r for r in lm.score(documents).collect()}
    monkeypatch.setattr(contextlm, "BUCKET_TOKENS", sum(r.n_tokens for r in one.values()) // buckets)
    many = {r.doc_id: r for r in lm.score(documents).collect()}
    assert one.keys() == many.keys()
    assert sum(r.score for r in one.values()) == pytest.approx(sum(r.score for r in many.values()), rel=0.002)
    for i, r in one.items():
        assert many[i][:5] == r[:5] and abs(many[i].base_score - r.base_score) < 1e-6
        assert abs(many[i].score - r.score) < 0.02 * abs(r.score) + 0.3


def test_predictions_add_up():
    """Over all known tokens and the unknown one, behind known and unknown contexts, with seatings of many sweeps."""
    rng = np.random.default_rng(3)
    pairs, c = np.unique(rng.zipf(1.3, 20000) % 50 * 40 + rng.integers(0, 40, 20000), return_counts=True)
    words, word = np.unique(pairs // 40, return_inverse=True)
    context, more, n = pairs % 40, c > 1, len(words)
    singles, t, t0 = np.bincount(word[~more], minlength=n), np.ones(more.sum(), np.int64), np.ones(n, np.int64)
    c0 = np.bincount(word, minlength=n)
    for _ in range(6):
        whole = np.ones(len(c), np.int64)
        whole[more] = t
        tables = np.bincount(context, whole, 40)
        t, t0, c0 = contextlm.resample(word[more], c[more], t, singles, t0, tables[context[more]], c0.sum(), t0.sum(), n, rng)
        assert (t >= 1).all() and (t <= c[more]).all() and (t0 >= 1).all() and (t0 <= c0).all()
    whole[more] = t
    tables, count = np.bincount(context, whole, 41), np.bincount(context, c, 41)
    for u in range(41):
        own_c, own_t = np.zeros(n + 1), np.zeros(n + 1)
        own_c[word[context == u]], own_t[word[context == u]] = c[context == u], whole[context == u]
        p = contextlm.predictive(own_c, own_t, count[u], tables[u], np.append(c0, 0), np.append(t0, 0), c0.sum(), t0.sum(), n)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_counts_of_a_bucket_merge_in_steps(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(contextlm, "MERGED", 50)
    want, rows = {}, []
    for _ in range(12):
        keys, n = np.unique(rng.integers(0, 900, 60)), rng.integers(0, 3, 60)
        n = n[: len(keys)]
        rows.append({"ranks": contextlm._pack(np.arange(1, 31)), "pairs": contextlm._pack(np.bincount(keys // 30, minlength=30)),
                     "contexts": contextlm._pack(keys % 30), "counts": contextlm._pack(n)})
        for k, x in zip(keys.tolist(), n.tolist()):
            want[k] = want.get(k, 0) + x
    keys, c = contextlm._merged(rows, 30)
    assert dict(zip(keys.tolist(), c.tolist())) == {k: x for k, x in want.items() if x}
