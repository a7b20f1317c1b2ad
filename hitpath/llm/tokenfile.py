"""Token ids in compressed binary shards, readable document by document.

A shard is one row of a Parquet file: the hash of a zstandard dictionary shared
by all shards, the ids and token counts of its documents in order, the offsets
of their frames, and the frames. Each document is a frame of its own, so that a
single short document is read by its offset without decompressing others; the
dictionary, trained on serialized id arrays, gives short frames the context
they lack. Shards are numbered in ascending order of ``doc_id``.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitpath.llm.common import LOWEST, WordCache, id_bounds, partitions, portions, shared_path

SAMPLE_DOCS = 1000
SAMPLE_BYTES = 1 << 16
DICT_BYTES = 1 << 16
SHARD_BYTES = 8 << 20
LEVEL = 3

#: The vocabulary's characters for the 256 bytes: printable ones stand for themselves, others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_cache: dict[str, WordCache] = {}


def _byte_characters() -> dict[int, int]:
    others = [b for b in range(256) if b not in _PLAIN]
    return {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(others)}


def word_cache(path: str) -> WordCache:
    """A cached encoder of the tokenizer file, whose pre-tokenizer never joins what a space or newline parts.

    Words of lower-case letters below U+0130 pass its normalizer and
    pre-tokenizer unchanged, so they go to its BPE model directly. The library's
    own threads are off: tasks are the parallel work, and threads of every task
    would only hold memory.
    """
    if path not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, table = tokenizer.model, _byte_characters()

        def simple(word: str) -> list[int]:
            return [t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(table))]

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            flat, lengths = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
            for i, j in portions(map(len, words), 50_000):
                found = [simple(w) if w.isalpha() and w.islower() and (w.isascii() or not _beyond.search(w)) else None for w in words[i:j]]
                rest = [k for k, ids in enumerate(found) if ids is None]
                for k, e in zip(rest, tokenizer.encode_batch_fast([words[i + k] for k in rest], add_special_tokens=False)):
                    found[k] = e.ids
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                flat.append(np.fromiter(chain.from_iterable(found), np.uint16, lengths[-1].sum()))
            return np.concatenate(flat), np.concatenate(lengths)

        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        _cache[path] = WordCache(encode)
    return _cache[path]


#: Characters whose lower case, one to one, cannot change how others are composed.
_beyond = re.compile("[^\x00-\u012f]")


#: Stops, and where one follows something else than a letter or digit whose lower case is one character.
_STOPS = [(stop, re.compile(f"{re.escape(stop)}(?<![^\\W_\u0130]{re.escape(stop)})")) for stop in (", ", ". ")]


def split_words(text: str) -> list[str]:
    """The pieces between spaces and newlines, with commas and stops after letters apart.

    That makes fewer different pieces and changes no id: the tokenizer splits
    there, and it ignores case. Case is kept where a special token may be, as
    it is known by it, and where lower-casing first might compose differently.
    """
    text = text.replace("\n", " ")
    if "<|" not in text:
        if text.isascii() or not _beyond.search(text):
            text = text.lower()
        for stop, other in _STOPS:
            if not other.search(text):
                text = text.replace(stop, f" {stop}")
    return text.split(" ")


def _serialize(path: str, end_id: int) -> Callable[[list[str]], list[bytes]]:
    def serialize(texts: list[str]) -> list[bytes]:
        flat, counts = word_cache(path).ids([split_words(t) for t in texts])
        end = np.array([end_id], np.uint16).tobytes()
        data, ends = flat.astype("<u2").tobytes(), 2 * np.cumsum(counts)
        return [data[b - 2 * n : b] + end for b, n in zip(ends, counts)]

    return serialize


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from the first ``SAMPLE_BYTES`` of the id arrays of ``SAMPLE_DOCS`` documents.

    The sample, the documents of smallest hashed id, is bounded whatever the
    table; zstandard's trainer reads samples only. Too few or too small samples
    to train on become the dictionary themselves.
    """
    serialize = _serialize(path, end_id)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = serialize(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"ids": pa.array([r[:SAMPLE_BYTES] for r in rows], pa.binary())})

    picked = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(SAMPLE_DOCS)
    )
    samples = [bytes(r[0]) for r in picked.select("text").mapInArrow(sample, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:DICT_BYTES]).ljust(8, b"\0")


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _load(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    trained = dictionary[:4] == (0xEC30A437).to_bytes(4, "little")
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(dictionary, dict_type=kind)


_SHARD = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
        ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_sha256", pa.string()), ("doc_ids", pa.binary()),
        ("null_ids", pa.int64()), ("counts", pa.binary()), ("offsets", pa.binary()), ("frames", pa.binary()),
    ]
)
_SHARD_SQL = (
    "part int, shard int, n_docs long, n_tokens long, first_doc long, last_doc long, dict_sha256 string, "
    "doc_ids binary, null_ids long, counts binary, offsets binary, frames binary"
)


def write(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Encode every document and write shards and dictionary under ``folder``.

    Documents are encoded and compressed where they are read, and only their
    frames are shuffled, to ranges of ids that a pass over the id column has
    cut. Nulls count as empty texts; ids that are null come first; rows that
    repeat an id are kept, ordered by their frames.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id)
    digest = dictionary_hash(dictionary)
    serialize = _serialize(path, end_id)
    n = partitions(spark)
    cuts = np.array(id_bounds(docs, "doc_id", 4 * n), np.int64)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _load(dictionary)
        shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(dict_data=shared, write_content_size=True)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            parts = pa.array(np.searchsorted(cuts, pc.fill_null(ids, LOWEST).to_numpy(), side="right"), pa.int32())
            lengths = pc.binary_length(texts).to_numpy()
            for i, j in portions(lengths, 1_000_000):
                rows = serialize(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": parts.slice(i, j - i),
                        "doc_id": ids.slice(i, j - i),
                        "n_tokens": pa.array([len(r) // 2 for r in rows], pa.int64()),
                        "frame": pa.array([packer.compress(r) for r in rows], pa.binary()),
                    }
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, rows, size = None, 0, [], 0

        def packed() -> pa.RecordBatch:
            ids, counts, frames = zip(*rows)
            lengths = np.fromiter(map(len, frames), np.int64, len(frames))
            known = [x for x in ids if x is not None]
            row = {
                "part": part, "shard": shard, "n_docs": len(ids), "n_tokens": sum(counts),
                "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None,
                "dict_sha256": digest, "doc_ids": np.array(known, "<i8").tobytes(), "null_ids": len(ids) - len(known),
                "counts": np.array(counts, "<i8").tobytes(),
                "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes(),
                "frames": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (p != part or size >= SHARD_BYTES):
                    yield packed()
                    shard, rows, size = (shard + 1 if p == part else 0), [], 0
                part = p
                rows.append(row)
                size += len(row[2])
        if rows:
            yield packed()

    frames = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(compress, "part int, doc_id long, n_tokens long, frame binary")
    shards = (
        frames.repartition(n, "part")
        .sortWithinPartitions("part", "doc_id", "n_tokens", "frame")
        .mapInArrow(pack, _SHARD_SQL)
    )
    shards.write.parquet(f"{folder}/shards")
    row = [(digest, bytearray(dictionary))]
    spark.createDataFrame(row, "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")


def dictionary_of(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if dictionary_hash(bytes(row["dictionary"])) != row["dict_sha256"]:
        raise ValueError("the dictionary does not agree with its hash")
    return bytes(row["dictionary"])


def documents_of(shard: dict, dictionary: bytes, only: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """The ``(doc_id, ids)`` of a shard, of all documents or of one id, whose frames alone are decompressed."""
    if shard["dict_sha256"] != dictionary_hash(dictionary):
        raise ValueError("the shard was written with another dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=_load(dictionary))
    ids = [None] * shard["null_ids"] + np.frombuffer(shard["doc_ids"], "<i8").tolist()
    at = np.frombuffer(shard["offsets"], "<i8").tolist()
    frames = memoryview(shard["frames"])
    for i, doc_id in enumerate(ids):
        if only is None or doc_id == only:
            yield doc_id, np.frombuffer(unpack.decompress(frames[at[i] : at[i + 1]]), "<u2").astype("<u4")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, found by the shards' id ranges; several arrays if its id repeats."""
    dictionary = dictionary_of(spark, folder)
    near = spark.read.parquet(f"{folder}/shards").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return [ids for row in near.toLocalIterator() for _, ids in documents_of(row.asDict(), dictionary, doc_id)]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's place in the stream of all ids, their number and checksum, from the files."""
    dictionary = dictionary_of(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards")
    # Places within a part, and before it: there are a few parts for each partition of a shuffle.
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = shards.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("inside"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    ahead = parts.select("part", before(Window.orderBy("part")).alias("ahead"))
    starts = inside.join(ahead, "part").select("part", "shard", (F.col("ahead") + F.col("inside")).alias("before"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One shard at a time, as a batch of them may be large.
            for i in range(batch.num_rows):
                shard = batch.slice(i, 1).to_pylist()[0]
                rows = [(d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in documents_of(shard, dictionary)]
                ids, counts, crc = zip(*rows)
                place = np.cumsum(counts) - np.array(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([shard["part"]] * len(ids), pa.int32()),
                        "shard": pa.array([shard["shard"]] * len(ids), pa.int32()),
                        "doc_id": pa.array(ids, pa.int64()),
                        "place": pa.array(place, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    documents = shards.drop("first_doc", "last_doc").mapInArrow(
        check, "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long"
    )
    return documents.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to the shared folder and return what is read back."""
    folder = shared_path(docs.sparkSession, "tokens")
    write(docs, path, end_id, folder)
    return read(docs.sparkSession, folder)
