"""Near duplicates and language: against brute force and held-out labels."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hitpath.llm import langid, simhash, vectors
from hitpath.llm.common import components

SF = "/root/testdata/sf0.01"


def groups(nodes, linked):
    """Smallest reachable node of each node, by repeated merging."""
    name = {x: x for x in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, i) for i in range(1900, 2000)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = groups({x for e in real for x in e}, real)
    assert got == {node: name for node, name in want.items() if node != name}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(docs, **more):
    rows = docs.collect()
    fp = [plain_fingerprint(r.text) for r in rows]
    arr = np.array(fp, np.uint64)
    near = np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4)
    roots = groups(range(len(rows)), [(a, b) for a, b in near.tolist() if a < b])
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[roots[i]] = min(r.doc_id, least.get(roots[i], r.doc_id))
    want = [(r.doc_id, f"{f:016x}", least.get(roots[i])) for i, (r, f) in enumerate(zip(rows, fp))]
    got = [tuple(r) for r in simhash.near_duplicates(docs, **more).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


@pytest.mark.parametrize("tile", [4, 1024])
@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_simhash(request, table, tile):
    check_simhash(request.getfixturevalue(table), tile=tile)


def test_simhash_on_crowded_values(spark):
    """Fingerprints that differ in few bits, in tiles of all sizes."""
    rng = np.random.default_rng(9)
    seeds = rng.integers(-(2**63), 2**63 - 1, 30)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(60):
            x = int(s)
            for b in rng.integers(0, 60, rng.integers(1, 14)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    arr = np.array(fps, np.int64).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4, 1)).tolist()
    want = groups(range(len(fps)), near)
    points = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long")
    for tile in (3, 50, 10**6):
        found = {r.node: r.component for r in components(simhash.links(points, tile=tile)).collect()}
        assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_one_of_each_group_stays(odd, documents):
    got = simhash.deduplicated(documents)
    assert got.columns == documents.columns
    want = {c for _, _, c in check_simhash(documents)}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert set(rows) <= set(documents.collect())
    odd = odd.withColumnRenamed("n_chars", "_kept").withColumn("_KEPT_", F.lit(7)).withColumn("_row", F.lit(8))
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and {(r["_KEPT_"], r["_row"]) for r in kept.collect()} == {(7, 8)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["-9", "1", "4", "6", "7", "8", "None"]


def check_vectors(df, threshold=0.95, **more):
    rows = df.collect()
    ids = sorted(r.vec_id for r in rows)
    ok = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding and None not in r.embedding}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items() if np.isfinite(v).all() and v.any()}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    count = {i: 0 for i in ids}
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    name = groups(ids, pairs)
    got = vectors.near_duplicates(df, threshold, **more).collect()
    assert sorted(map(tuple, got)) == [(i, count[i], name[i], i == name[i]) for i in ids]
    return pairs


@pytest.mark.parametrize("block", [37, 8192])
def test_vectors(spark, block):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(4)
    more = [(10000 + i, (np.array(rows[i % 90][1]) + rng.normal(size=64) * 0.04).tolist()) for i in range(400)]
    assert check_vectors(spark.createDataFrame(rows + more, "vec_id long, embedding array<float>"), block=block)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * 0.15).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [1.0] * 7)]
    rows += [(2004, [None] + [1.0] * 7), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, (base[0] * 1e-30).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    for block in (16, 100):
        assert check_vectors(df, block=block)
        assert check_vectors(df, threshold=0.8, block=block)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_or_with_repeated_ids(spark):
    """Links run through rows with a null id, and rows that repeat an id stay apart."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(5, at(0)), (None, at(15)), (3, at(30)), (8, at(120)), (8, at(240)), (None, at(180)), (9, at(120))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(5, 1, 3, False), (None, 2, 3, False), (3, 1, 3, True), (8, 1, 8, True), (8, 0, 8, True), (None, 0, None, True),
         (9, 1, 8, False)], key=str
    )


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 48))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = vectors.quantised(u)
    gap = np.abs(u @ u.T - (q * s[:, None]) @ (q * s[:, None]).T)
    assert (gap <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()
    assert (vectors._product(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert 0.2 < len(unseen) / len(got) < 0.3
    assert np.mean([r.lang_pred == r.lang for r in unseen]) > 0.97
    again = {r.doc_id: r for r in langid.identify(docs.repartition(5)).collect()}
    assert all(again[r.doc_id].lang_pred == r.lang_pred and abs(again[r.doc_id].score - r.score) < 1e-6 for r in got)


def test_language_of_odd_rows(spark, odd, empty, make_docs):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    blank = {1, 2, 3}
    assert all((r.lang_pred == "und") == (r.doc_id in blank) and (r.score == 0) == (r.doc_id in blank) for r in got)
    assert langid.identify(empty).count() == 0
    none = make_docs([(i, "some text", None, "s") for i in range(9)])
    assert {(r.lang_pred, r.score) for r in langid.identify(none).collect()} == {("und", 0.0)}
    kept = langid.accepted(odd.withColumns({"_d": F.lit(1), "_l": F.lit(2), "score": F.lit(1)}))
    assert kept.columns[-1] == "score" and {r.doc_id for r in kept.collect()}.isdisjoint(blank)


def test_labels_outside_training_are_not_used(make_docs):
    docs = [(i, "hello world this is it" if i % 2 else "la maison est belle", "en" if i % 2 else "fr", "s") for i in range(200)]
    a = {r.doc_id: r.lang_pred for r in langid.identify(make_docs(docs)).collect()}
    part = {r.doc_id for r in langid.identify(make_docs(docs)).where("held_out").collect()}
    changed = make_docs([(d, t, "xx" if d in part else lang, s) for d, t, lang, s in docs])
    assert a == {r.doc_id: r.lang_pred for r in langid.identify(changed).collect()}
    assert all(a[d] == lang for d, _, lang, _ in docs)


def test_letters_and_grams():
    ids, doc, letters = langid.grams(["Ab 1", "", "é", "AB"])
    assert letters.tolist() == [2, 0, 1, 2] and doc.tolist() == [0, 0, 2, 3, 3]
    assert ids[0].tolist() == ids[3].tolist() and ids.max() < langid.FEATURES
