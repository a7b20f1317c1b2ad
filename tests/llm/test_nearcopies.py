"""Near copies by shingle similarity: kept rows against brute force over planted copies, and measured recall."""

import numpy as np
import pytest
from test_models import groups

import corpus_pipeline
from hitpath.llm import common, nearcopies, simhash

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Rows kept: the smallest id of each group, a null one only where no other is."""
    sets = [shingles(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    roots = groups(range(len(rows)), near)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[roots[i]] = min(key, least.get(roots[i], key))
    return sorted(least.values())


def planted(seed=5):
    """Texts of random words with copies in which one word in so many is new."""
    rng = np.random.default_rng(seed)
    rows, word = [], lambda: f"w{rng.integers(50_000)}"
    for i in range(60):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        rows.append((1000 * i, " ".join(base)))
        for j, changes in enumerate((0, 1, 2, 3, 4, 6, 8, 12)):
            new = list(base)
            for at in rng.integers(0, len(base), changes * len(base) // 200 + (changes > 0)):
                new[at] = word()
            rows.append((1000 * i + 1 + j, " ".join(new)))
    return rows


@pytest.mark.parametrize("cut", [64, 4])
def test_planted_copies(spark, make_docs, monkeypatch, cut):
    monkeypatch.setattr(nearcopies, "SLICE", cut)
    rows = planted()
    got = corpus_pipeline.near_duplicates(spark, make_docs(rows), SF).collect()
    assert sorted((False, r.doc_id) for r in got) == brute(rows)


def test_one_large_group(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nearcopies, "SLICE", 4)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(90)] + [(90 + i, " ".join([*words[:30], *(f"y{i}-{j}" for j in range(70))])) for i in range(20)]
    got = corpus_pipeline.near_duplicates(spark, make_docs(rows), SF).collect()
    assert sorted((False, r.doc_id) for r in got) == brute(rows)


def test_table(spark, documents, odd):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == brute(rows)
    assert corpus_pipeline.near_duplicates(spark, documents.limit(0), SF).count() == 0


def test_similarity_is_exact():
    base = np.arange(90, dtype=np.uint64)
    assert nearcopies.similar([base, base[:72]], 0.8).tolist() == [0, 0]
    assert nearcopies.similar([base, base[:71]], 0.8).tolist() == [0, 1]
    assert nearcopies.similar([base[:72], base[40:], base], 0.8).tolist() == [0, 1, 0]


def test_each_group_keeps_one_row(spark, make_docs):
    """An id with two texts: the unique one stays, whichever text comes first; null ids are grouped like others."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    c = " ".join(f"c{i}" for i in range(40))
    for unique, copied in ((a, b), (b, a)):
        rows = [(7, unique), (7, copied), (3, copied), (None, c), (None, c), (None, copied)]
        for stage in (lambda docs: corpus_pipeline.near_duplicates(spark, docs, SF), simhash.deduplicated):
            got = stage(make_docs(rows)).collect()
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(7, unique), (3, copied), (None, c)], key=str)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_by_number(spark, monkeypatch, most):
    """By masks of 64 numbers, and by a join where those are too many."""
    monkeypatch.setattr(common, "MOST_MASKS", most)
    rng = np.random.default_rng(3)
    numbers = np.unique(np.concatenate([rng.integers(0, 500, 200), (7 << 36) + rng.integers(0, 500, 200), np.arange(63, 66)])).tolist()
    wanted = [x for x in numbers if rng.random() < 0.5]
    rows = spark.createDataFrame([(x, f"t{x}", 1, 2) for x in numbers], "_row long, text string, _at int, _mask int")
    got = common.picked(rows, "_row", spark.createDataFrame([(x,) for x in wanted], "_row long"))
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect())) == [(x, f"t{x}", 1, 2) for x in wanted]
