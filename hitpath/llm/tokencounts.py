"""Token counts of whole texts, without the tokens ever leaving the task.

Arrow functions hand texts to the tokenizer's library in batches of equal
bytes and return lengths only. A long text is cut at safe boundaries first, so
that no call holds more than ``CHUNK`` characters of it (save a run without
any boundary), and the counts of its pieces add up.

A boundary is one space between two letters or digits. There both libraries
part texts whatever follows: no token of the files goes on behind a space, the
piece behind it is encoded with the space before it, and normalisation joins
nothing across it. ``Counter`` refuses files for which that does not hold.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import portions

#: Characters of a piece of a long text, and UTF-8 bytes of texts given to the library at once.
CHUNK, BATCH_BYTES = 1 << 16, 1 << 20
LIMIT = 4096
_SPACE = "▁"
_BOUNDARY = re.compile(r"(?<=\w) (?=\w)")


def pieces_of(text: str, most: int, keep_space: bool) -> list[str]:
    """``text`` cut at boundaries into pieces of at most ``most`` characters; a run without one stays whole.

    With ``keep_space`` the space begins the next piece, otherwise it goes, as
    the library puts one before each text.
    """
    found, start = [], 0
    while len(text) - start > most:
        # The last boundary that fits, else the next one.
        cut = text.rfind(" ", start + 1, start + most)
        while cut > start and not _BOUNDARY.match(text, cut):
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            later = _BOUNDARY.search(text, start + most)
            if later is None:
                break
            cut = later.start()
        found.append(text[start:cut])
        start = cut if keep_space else cut + 1
    found.append(text[start:])
    return found


def balanced(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Slices of a sequence of sizes, as few as keep to ``most`` on average and of about equal sums."""
    if not len(sizes):
        return []
    ends = np.cumsum(sizes)
    n = max(1, -(-int(ends[-1]) // most))
    cuts = np.searchsorted(ends, np.arange(1, n) * (ends[-1] / n), side="left") + 1
    bounds = np.unique(np.concatenate([[0], cuts, [len(ends)]])).tolist()
    return list(zip(bounds[:-1], bounds[1:]))


class Counter:
    """Numbers of tokens by a tokenizer file: ``.model`` by sentencepiece, ``.json`` by tokenizers.

    No begin, end or other special tokens are added; special strings inside a
    text are what the library takes them for by default; nothing is truncated
    or padded.
    """

    def __init__(self, path: str, chunk: int = CHUNK, batch_bytes: int = BATCH_BYTES):
        self.chunk, self.batch_bytes = chunk, batch_bytes
        self.keep_space = not path.endswith(".model")
        self._lengths = self._json(path) if self.keep_space else self._model(path)

    @staticmethod
    def _model(path: str) -> Callable[[list[str]], list[int]]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(_SPACE in name.lstrip(_SPACE) for name in names) or model.encode("a b", out_type=str)[0][0] != _SPACE:
            raise ValueError("a piece goes on behind a space, or texts get no space before them: no boundary is safe")
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]

    @staticmethod
    def _json(path: str) -> Callable[[list[str]], list[int]]:
        # Tasks are the parallel work; threads of every task would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        odd = [t for t in added if t["lstrip"] or t["rstrip"] or " " in t["content"]]
        probe = ["ab cd", "ab", " cd"]
        ids = [e.ids for e in tokenizer.encode_batch(probe, add_special_tokens=False)]
        if odd or ids[0] != ids[1] + ids[2]:
            raise ValueError("a special token takes spaces in, or tokens cross a space: no boundary is safe")
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            cut = pieces_of(text, self.chunk, self.keep_space)
            pieces += cut
            owner += [i] * len(cut)
        sizes = np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
        lengths = np.zeros(len(pieces), np.int64)
        for i, j in balanced(sizes, self.batch_bytes):
            lengths[i:j] = self._lengths(pieces[i:j])
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owner, lengths)
        return total


_counters: dict[tuple[str, int, int], Counter] = {}


def counter_of(path: str, chunk: int = CHUNK, batch_bytes: int = BATCH_BYTES) -> Counter:
    """The counter of a file, loaded once in each worker."""
    key = path, chunk, batch_bytes
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_count(text: Column, path: str, chunk: int = CHUNK, batch_bytes: int = BATCH_BYTES) -> Column:
    """The number of tokens of a text column; a null text is empty."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = counter_of(path, chunk, batch_bytes)
        for texts in batches:
            sizes = pc.binary_length(texts).to_pylist()
            parts = [counter.counts(texts.slice(i, j - i).to_pylist()) for i, j in portions(sizes, 8 * batch_bytes)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return lengths(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``), row by row.

    A null text is empty and has no tokens. Rows that repeat are counted as
    often as they occur, rows with null ids too, and an empty table gives an
    empty one. Columns of these three names are replaced (unless one is the
    text itself, which is refused); all others are kept. A text of any length
    is counted whole: one without a boundary goes to the library in one piece.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    if text in added:
        raise ValueError(f"the text column cannot be called {text}")
    rows = docs.select(*(c for c in docs.columns if c not in added))
    counted = rows.withColumns(
        {"n_bytes": F.octet_length(F.coalesce(text, F.lit(""))).cast("long"), "n_tokens": token_count(F.col(text), path)}
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
