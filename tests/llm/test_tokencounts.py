"""Token counts: against the libraries on whole texts."""

import random

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitpath.llm import queries, tokencounts
from hitpath.llm.tokencounts import Counter, balanced, count_tokens, pieces_of

FILES = ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"]


def whole(name):
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path(name))
        return lambda text: len(model.encode(text))
    tokenizer = Tokenizer.from_file(path(name))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def odd_texts(n=300):
    rng = random.Random(4)
    bits = ["a", "the", " ", "  ", "\n", "é", "é", "́", "中", "▁", "<|endoftext|>", "<s>", "'s", "9", "_", "😀", "ß", ".", "\t", " "]
    return ["", " ", "a", "a b"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_counts_of_cut_texts(name):
    one, texts = whole(name), odd_texts()
    for chunk in (1, 7, 40):
        assert Counter(path(name), chunk, 50).counts(texts).tolist() == [one(t) for t in texts]


def test_pieces_keep_the_text():
    for text in odd_texts():
        for most in (1, 5, 20):
            assert "".join(pieces_of(text, most, True)) == text
            assert " ".join(pieces_of(text, most, False)) == text
    long = "word " * 1000
    assert max(map(len, pieces_of(long, 64, True))) <= 64
    assert pieces_of("a" * 500, 64, True) == ["a" * 500]
    assert pieces_of("a" * 500 + " b", 64, False) == ["a" * 500, "b"]


def test_batches_are_balanced():
    sizes = np.array([5] * 100 + [300] + [1] * 100)
    cut = balanced(sizes, 100)
    assert [i for i, _ in cut][1:] == [j for _, j in cut][:-1] and cut[0][0] == 0 and cut[-1][1] == len(sizes)
    assert max(sizes[i:j].sum() for i, j in cut) <= 100 + 300
    assert balanced(np.zeros(0, int), 10) == []


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_op11(request, table, tmp_path):
    docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_tokencounts(docs.sparkSession, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    one = whole("piece_bpe_32k.model")
    want = []
    for r in docs.collect():
        text = r.text or ""
        want.append((r.doc_id, len(text.encode()), one(text), one(text) > 4096))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "a b", 7, "x"), (1, None, 8, "y")], "doc_id long, body string, n_tokens int, lengths string")
    got = count_tokens(rows, path("byte_bpe_50k.json"), text="body", limit=1)
    assert sorted(map(tuple, got.select("doc_id", "body", "lengths", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == [
        (1, "a b", "x", 3, 2, True), (1, None, "y", 0, 0, False),
    ]
    with pytest.raises(ValueError):
        count_tokens(rows.withColumn("n_bytes", F.lit("")), path("byte_bpe_50k.json"), text="n_bytes")


def test_long_text_is_counted_whole(spark):
    text = "lorem ipsum dolor sit amet " * 60000
    rows = spark.createDataFrame([(1, text), (2, "a" * 100000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(rows, path("piece_bpe_32k.model")).collect()}
    one = whole("piece_bpe_32k.model")
    assert got == {1: one(text), 2: one("a" * 100000)}


def test_only_lengths_come_back(spark, documents):
    plan = count_tokens(documents.select("doc_id", "text"), path("piece_bpe_32k.model")).drop("text")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan
    assert tokencounts.BATCH_BYTES == 1 << 20
