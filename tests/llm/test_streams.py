"""Tokenizing, files, fingerprints: against the libraries and plain programs, row by row."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from hitpath.llm import pieces, sketch, tokenfile
from hitpath.llm.common import WordCache, shared_path

PIECE, WORD = path("piece_bpe_32k.model"), path("word_bpe_49k.json")
sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
tok = Tokenizer.from_file(WORD)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_pieces(request, table):
    docs = request.getfixturevalue(table)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in texts_of(docs):
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())))
    assert order(map(tuple, pieces.digests(docs, PIECE).collect())) == order(want)


_CHARS = st.sampled_from([*"abceth .,'Ab\n\t▁é中\x00", "  ", "\U0001f600", "<s>", "<0x0A>", " the", "ing", "    "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(_CHARS, max_size=40).map("".join), min_size=1, max_size=5))
def test_pieces_of_any_text(texts):
    model = pieces.model_of(PIECE)
    ids, counts = model.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == sp.encode(texts, add_bos=True, add_eos=True)
    decoded = [sp.decode(x) for x in sp.encode(texts, add_bos=True, add_eos=True)]
    assert [d.decode() for d in model.decode(ids, counts)] == decoded


def test_encoded_rows_keep_their_columns(make_docs):
    docs = make_docs([(1, "Hello  world"), (2, None)]).selectExpr("doc_id AS ids", "text", "lang AS decoded", "source")
    rows = pieces.encode_texts(docs, PIECE).orderBy("text").collect()
    assert rows[1].asDict() == {"text": "Hello  world", "source": "s", "decoded": "Hello  world",
                                "ids": sp.encode("Hello  world", add_bos=True, add_eos=True)}
    assert rows[0].ids == [1, 2] and rows[0].decoded == ""


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_token_files(request, table):
    docs = request.getfixturevalue(table)
    rows = order(map(tuple, tokenfile.encode(docs, WORD).select("doc_id", "n_tokens", "ids_crc32", "start").collect()))
    want = []
    for d, t in texts_of(docs):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert order(r[:3] for r in rows) == order(want)
    rows.sort(key=lambda r: r[3])
    assert [r[0] or -(2**63) for r in rows] == sorted(r[0] or -(2**63) for r in rows)
    assert [r[3] for r in rows] == [sum(x[1] for x in rows[:i]) for i in range(len(rows))]


def test_one_document_of_a_file(spark, documents, tmp_path):
    folder = shared_path(spark, "one")
    tokenfile.write(documents, WORD, 2, folder)
    text = documents.where("doc_id = 60").first().text
    (ids,) = tokenfile.read_document(spark, folder, 60)
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids + [2]
    assert tokenfile.read_document(spark, folder, 10**6) == []
    with pytest.raises(ValueError, match="another dictionary"):
        list(tokenfile.documents_of(spark.read.parquet(f"{folder}/shards").first().asDict(), b"x" * 9))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAé,'\n\t\x1c\xa0", " ", "<|endoftext|>", "H̱", "Σ", "12", "'LL", ", ", ". ", "İ", "é", "ß", "_", "²"])).map("".join)))
def test_cached_words_of_any_text(texts):
    ids, counts = tokenfile.word_cache(WORD).ids([tokenfile.split_words(t) for t in texts])
    ends = np.cumsum(counts)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == want


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_fingerprints(request, table):
    docs = request.getfixturevalue(table)
    rows = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        new = t[: len(t) - k] + after[:k]
        a, b, c = sketch.sketches([t, new, after])
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), sketch.as_text(a), sketch.as_text(b),
                     sketch.containment(a, b), sketch.containment(a, c)))
    assert order(map(tuple, sketch.fingerprints(docs).collect())) == order(want)


def test_sketch_estimates_containment():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 20000)]
    whole, part, other = sketch.sketches([" ".join(words), " ".join(words[3000:8000]), " ".join(words[::-1])])
    assert sketch.containment(whole, part) == 1 and sketch.containment(whole, other) < 0.01
    half = sketch.sketches([" ".join(words[:5000] + words[:5000][::-1])])[0]
    assert abs(sketch.containment(half, sketch.sketches([" ".join(words[:5000])])[0]) - 1) < 1e-9
    assert sketch.from_text(sketch.as_text(part)).tolist() == part.tolist()
    a, b = sketch.sketches([" ".join(words[:9000]), " ".join(words[8996:])])
    assert sketch.merged(a, b).tolist() == whole.tolist()
    assert sketch.sketches(["", "x"])[0].size == 0 and sketch.sketches(["", "x"])[1].size == 1


def test_what_a_cache_remembers():
    """New words, words beyond those remembered, and what an encoder that fails leaves behind."""
    asked = []

    def encode(words):
        asked.append(list(words))
        if "bad" in words:
            raise ValueError("bad")
        lengths = np.array([len(w) for w in words])
        return np.concatenate([np.full(len(w), ord(w[0]), np.uint16) for w in words]), lengths

    cache = WordCache(encode, most=3)

    def ids(*documents):
        flat, counts = cache.ids([d.split() for d in documents])
        assert flat.tolist() == [ord(w[0]) for d in documents for w in d.split() for _ in w]
        assert counts.tolist() == [sum(map(len, d.split())) for d in documents]

    ids("a bb a", "", "bb")
    assert asked == [["a", "bb"]] and dict(cache.codes) == {"a": 0, "bb": 1}
    with pytest.raises(ValueError):
        ids("a bad")
    assert dict(cache.codes) == {"a": 0, "bb": 1}
    ids("ccc d a", "d")
    assert asked[-1] == ["ccc", "d"] and dict(cache.codes) == {"a": 0, "bb": 1}
    ids("ccc a")
    assert asked[-1] == ["ccc"] and dict(cache.codes) == {"a": 0, "bb": 1, "ccc": 2}
    ids("bb ccc", "")
    ids()
    assert asked[-1] == ["ccc"]


def test_stops_are_set_apart_where_each_follows_a_letter_or_digit():
    def plain(text):
        text = text.lower()
        for stop in (", ", ". "):
            parts = text.split(stop)
            if all(p[-1:].isalnum() and p[-1] != "İ" for p in parts[:-1]):
                text = f" {stop}".join(parts)
        return text.split(" ")

    rng, split = random.Random(4), 0
    for _ in range(20000):
        text = "".join(rng.choice(["a", "é", "7", "²", "_", "-", ",", ".", " ", ", ", ". ", "aa", "X"]) for _ in range(rng.randrange(9)))
        assert tokenfile.split_words(text) == plain(text), text
        split += plain(text) != text.lower().split(" ")
    assert split > 1000
