"""Stages of the pipeline pass texts on in small batches: a large one is held by Python and by Spark at once."""

import types

import pyarrow as pa
import pytest
from public_tokenizers import path

import corpus_pipeline
from hitpath.llm import langid, nearcopies, pieces
from hitpath.llm.common import slices

TEXTS = [None, "", "x " * 700_000, *(f"one two three four five six {i} " * 40 for i in range(3000))]


def batch():
    n = len(TEXTS)
    columns = [range(n), TEXTS, ["en"] * n, ["s"] * n, [0] * n]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def small(part, most):
    """A text longer than that is passed on whole, with no more than empty ones."""
    lengths = [len(t or "") for t in part.column(1).to_pylist()]
    return max(lengths) > most and sum(lengths) == max(lengths) or sum(lengths) <= most


def test_slices():
    cut = list(slices(batch(), 1, 100_000))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch()]))
    assert all(small(c, 100_000) for c in cut)
    assert list(slices(batch().slice(0, 0), 1, 100_000)) == []


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "tokens"])
def test_stages(make_docs, monkeypatch, stage):
    docs, caught = make_docs([(1, "one")]), []
    model = langid.fit(make_docs([(i, f"one two {i}") for i in range(40)])) if stage == "language" else None
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: caught.append(work) or self)
    if stage == "language":
        monkeypatch.setattr(langid, "fit", lambda docs: model)
        langid.accepted(docs, 0.0)
    elif stage == "near_duplicates":
        monkeypatch.setattr(nearcopies, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
        nearcopies._prepared(docs, 5)
    else:
        pieces.encode_texts(docs, path("piece_bpe_32k.model"))
    out = list(caught[-1](iter([batch()])))
    ids = [x for b in out for x in b.column(0).to_pylist()]
    assert ids == (ids if stage == "language" else list(range(len(TEXTS)))) and len(ids) > 3000
    assert all(small(b, 500_000) for b in out if b.num_rows)
    if stage == "near_duplicates":
        assert [x for b in out for x in b.column(5).to_pylist()] == [(3 << 36) + i for i in range(len(TEXTS))]


@pytest.mark.parametrize("own, want", [("10000", "1000"), ("300", "300")])
def test_rows_of_a_batch(spark, make_docs, own, want):
    before = spark.conf.get(corpus_pipeline.BATCH_ROWS)
    spark.conf.set(corpus_pipeline.BATCH_ROWS, own)
    try:
        corpus_pipeline.tokens(spark, make_docs([(1, "one")]), "")
        assert spark.conf.get(corpus_pipeline.BATCH_ROWS) == want
    finally:
        spark.conf.set(corpus_pipeline.BATCH_ROWS, before)
