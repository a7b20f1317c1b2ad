"""Sentence-piece BPE in vectorised merge rounds.

A text becomes segments, each a run of spaces with the word after it, because
no piece of the vocabulary has a space after another character. The symbols of
all segments lie in one flat array. In each round every segment finds its pair
of least rank, merges its leftmost occurrence, and further occurrences where no
merge could have been preferred in between; finished segments leave.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from hitpath.llm.common import WordCache, portions, ranges, slices

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_SEGMENT = re.compile(" *[^ ]+| +$")


class Pieces:
    """The tables of a model file, which is read with the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        usual = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        if any(SPACE in names[i].lstrip(SPACE) for i in usual) or size > 1 << 16:
            raise ValueError("a piece has a space after another character, or there are too many pieces")
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.first_byte = next(i for i in range(size) if model.is_byte(i))
        # Symbols are pieces by id, then characters that are only parts of pieces, then other characters.
        symbol = {names[i]: i for i in usual}
        for char in sorted({c for i in usual for c in names[i]}):
            symbol.setdefault(char, max(size, len(symbol) + size))
        self.other = max(symbol.values()) + 1
        self.size = size
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(self.other)
        self.parts = {}
        for text, i in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
                self.parts[i] = ord(text)
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]

        scores = np.array([model.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1]
        merges, best = {}, {}
        for i in usual:
            text = names[i]
            for cut in range(1, len(text)):
                left, right = symbol.get(text[:cut]), symbol.get(text[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = i
                    for part in (left, right):
                        best[part] = min(best.get(part, rank[i]), rank[i])
        self.keys = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in sorted(merges)], np.int32)
        self.rank = rank[self.merged].astype(np.int32)
        # A piece that starts no merge as good as its own can be made in several places at once.
        self.alone = np.array([best.get(i, rank.max() + 1) > rank[i] for i in range(size)])

        surface = [b""] * size
        for i in usual:
            surface[i] = names[i].replace(SPACE, " ").encode()
        for i in range(size):
            if model.is_byte(i):
                surface[i] = bytes([int(names[i][3:-1], 16)])
        self.surface_length = np.fromiter(map(len, surface), np.int64, size)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.cache = WordCache(self.encode_segments)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the word of each."""
        rank, to = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside], to[inside] = self._pairs(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            if (least == _NONE).any():
                ended = np.repeat(least == _NONE, lengths)
                done.append((symbols[ended], word[ended]))
                going = ~ended
                symbols, word, rank, to = symbols[going], word[going], rank[going], to[going]
                lengths, least = lengths[least != _NONE], least[least != _NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
            at = at[first | (even & self.alone[to[at]])]
            symbols[at] = to[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            moved = (np.cumsum(stays) - 1)[at]
            symbols, word, rank, to = symbols[stays], word[stays], rank[stays], to[stays]
            changed = np.zeros(len(symbols), bool)
            changed[moved] = changed[moved[moved > 0] - 1] = True
            near = np.flatnonzero(changed)
            rank[near] = _NONE
            near = near[near < len(symbols) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near], to[near] = self._pairs(symbols[near], symbols[near + 1])
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after the other, with their number; one without leading spaces has one implied."""
        whole = [s if s[0] == " " else " " + s for s in segments]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, word = self._merge(self.of_char[codes], np.repeat(np.arange(len(whole)), sizes))
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols.astype(np.uint16), np.bincount(word, minlength=len(whole))
        spelled = {
            s: np.frombuffer(chr(self.parts.get(s, s - self.other)).encode(), np.uint8) + np.int32(self.first_byte)
            for s in np.unique(symbols[odd]).tolist()
        }
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(spelled[s]) for s in symbols[odd].tolist()]
        out = np.repeat(symbols, width)
        ends = np.cumsum(width)
        out[ranges(ends[odd] - width[odd], width[odd])] = np.concatenate([spelled[s] for s in symbols[odd].tolist()])
        return out.astype(np.uint16), np.bincount(np.repeat(word, width), minlength=len(whole))

    @staticmethod
    def segments(text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        found = _SEGMENT.findall(" " + text)
        return [s[1:] if len(s) > 1 and s[1] != " " else s for s in found]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, one after the other, and how many each has."""
        flat, counts = self.cache.ids([self.segments(t) for t in texts])
        ends = np.cumsum(counts + 2)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint16)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = inner[ends - counts - 2] = False
        out[ends - 1], out[ends - counts - 2] = self.eos, self.bos
        out[inner] = flat
        return out, counts + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of all ids; the space that encoding puts first is left out."""
        lengths = self.surface_length[ids]
        data = self.surface[ranges(self.surface_start[ids], lengths)].tobytes()
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return [
            data[a:b].removeprefix(b" ").decode("utf-8", "replace").encode()
            for a, b in zip(total[ends - counts].tolist(), total[ends].tolist())
        ]


_models: dict[str, Pieces] = {}


def model_of(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>, begin and end ids included) and ``decoded``, row by row.

    A null text is empty. Columns called ``ids`` or ``decoded`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    rows = docs.select(*kept)
    field = kept.index(text)
    wanted = StructType([*rows.schema, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for cut in slices(batch, field, 300_000):
                ids, counts = model.encode(pc.fill_null(cut.column(field), "").to_pylist())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32))
                )
                decoded = pa.array([b.decode() for b in model.decode(ids, counts)], pa.string())
                yield pa.RecordBatch.from_arrays([*cut.columns, lists, decoded], names=[*kept, "ids", "decoded"])

    return rows.mapInArrow(work, wanted)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and the hashes of ids and of decoded text.

    A null or empty text has the begin and the end id only. Rows are
    independent of each other, so repeated and null ids stay as they are; texts
    are encoded whole, however long. An empty table gives an empty one; columns
    other than id and text are not read, whatever they are called.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            texts = batch.column(1)
            for i, j in portions(pc.binary_length(texts).to_pylist(), 1_500_000):
                ids, counts = model.encode(texts.slice(i, j - i).to_pylist())
                raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_sha256": [sha(raw[b - 4 * n : b]) for b, n in zip(ends.tolist(), counts.tolist())],
                        "decoded_sha256": [sha(data) for data in model.decode(ids, counts)],
                    }
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
