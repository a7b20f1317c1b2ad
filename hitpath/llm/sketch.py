"""Document fingerprints by threshold-scaled sketches.

A sketch keeps every hash of a document's shingles that lies below a fixed
fraction of the hash range, so that the sketch of a document grows with it and
sketches can be merged by union. Containment of one document in another is the
share of the smaller sketch found in the larger.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import id_bounds, partitions, portions, range_of

WORDS = 5
FRACTION = 1 / 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _limit(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))


def sketches(texts: list[str], words: int = WORDS, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sorted kept hashes of each text; equal texts have equal ones.

    A-Z are lower-cased, words are separated by ASCII white space. A text of
    fewer words than a shingle has one shingle, its whole sequence. Where no
    hash lies below the fraction the smallest is kept, so that only texts
    without words have an empty sketch; unions still agree, if the hashes above
    the fraction are dropped from a union that has others.
    """
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, counts.sum())
    starts = np.cumsum(counts) - counts
    per = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(texts)), per)
    at = np.repeat(starts - first, per) + np.arange(per.sum())
    left = np.minimum(counts, words)[doc]
    value = left.astype(np.uint64)
    for i in range(words):
        more = _mix(value * _A + flat[np.minimum(at + i, len(flat) - 1)])
        value = np.where(i < left, more, value)
    limit = _limit(fraction)
    kept = value < limit
    for d in np.flatnonzero((np.bincount(doc, kept, len(texts)) == 0) & (per > 0)):
        kept[first[d] + int(np.argmin(value[first[d] : first[d] + per[d]]))] = True
    doc, value = doc[kept], value[kept]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
        doc, value = doc[fresh], value[fresh]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [value[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sketches have in common."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller document's shingles that the larger has; two without words are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return shared(a, b) / min(len(a), len(b))


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two documents' shingles together."""
    union = np.union1d(a, b)
    below = union[union < _limit(fraction)]
    return below if len(below) else union[:1]


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, guest, doc_id, text)`` in order; each own row is compared with the row after it in its part."""
    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for i, j in portions((len(r[3]) for r in rows), 4_000_000):
            held += rows[i:j]
            if len(held) > 1:
                yield _compared(held)
                held = held[-1:]


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    place = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] == b[0] and not a[1]]
    pairs = [(rows[i], rows[i + 1]) for i in place]
    edited = [edited_text(a[3], b[3]) for a, b in pairs]
    own, new = sketches([r[3] for r in rows]), sketches(edited)
    out = [
        [a[2] for a, _ in pairs],
        [len(a[3]) for a, _ in pairs],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [as_text(own[i]) for i in place],
        [as_text(s) for s in new],
        [containment(own[i], s) for i, s in zip(place, new)],
        [containment(own[i], own[i + 1]) for i in place],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text, and compare it with that and with the next document.

    The next document is by ascending id (null lowest, then by text), the first
    one after the last. Texts are shuffled once, to ranges of ids; the first
    document of each range is sent to the range before as well, so that no
    range needs to wait for another. A null text is empty; extra columns are
    left out.
    """
    n = 4 * partitions(docs.sparkSession)
    bounds = id_bounds(docs, "doc_id", n)
    last = len(bounds)
    low = docs.agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(2**63))))).first()[0]
    firsts = F.array(*(F.lit(x) for x in [low, *bounds])) if low is not None else F.array(F.lit(0))
    part, key = F.col("part"), F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), range_of("doc_id", bounds).alias("part"))
    own = F.struct(part.alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.when(part == 0, last).otherwise(part - 1).alias("part"), F.lit(True).alias("guest"))
    sent = F.when(key == F.get(firsts, part), F.array(own, guest)).otherwise(F.array(own))
    return (
        rows.select("doc_id", "text", F.inline(sent))
        .select("part", "guest", "doc_id", "text")
        .repartition(partitions(docs.sparkSession), "part")
        .sortWithinPartitions("part", "guest", "doc_id", "text")
        .mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                    "edited_fingerprint string, near_edited double, near_next double")
    )
