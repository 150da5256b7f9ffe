"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct hashes of a set. Sketches of parts merge into the
sketch of the whole; two sketches estimate resemblance and containment of their sets, and one
the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts
from .shingles import blocks, shingles, words

#: Hashes kept: resemblance has a standard error of at most 0.5 / sqrt(K), 0.031; sets of up to K shingles are exact.
K = 256
_SPACE = 2.0**64


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct hashes, ascending."""
    if len(hashes) > 8 * k:
        near = np.partition(hashes, 4 * k)[: 4 * k]
        if len(low := np.unique(near)) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketches(column: pa.Array, width: int = 5, k: int = K) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in blocks(column):
        hashes, first = shingles(words(data, offsets), width)
        out += [bottom_k(hashes[a:b], k) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def pack(sketch: np.ndarray) -> str:
    """As text: base64 of the ascending big-endian hashes. Empty for a text without words."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below ``k``, else (k - 1) / the k-th smallest hash as a share of the hash space."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity of the sets. Two sets without elements are alike (1), one such set is like no other (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    if len(both) - np.count_nonzero(twice) > k:
        last = both[np.concatenate([[True], ~twice])][k - 1]
        return float(np.count_nonzero(twice & (both[1:] <= last))) / k
    return float(np.count_nonzero(twice)) / (len(both) - np.count_nonzero(twice))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of ``a``'s elements that are in ``b``, from the resemblance and the two sizes."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * (distinct(a, k) + distinct(b, k)) / ((1 + r) * distinct(a, k)))


def edited(text: str, following: str) -> str:
    """``text`` with the last quarter of its code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, k: int = K) -> DataFrame:
    """``key``, n_chars and fingerprint of every document (null text: as if empty); further columns are left out."""
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [pack(s) for s in sketches(batch.column(text), width, k)]
                lengths = [len(t or "") for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lengths, pa.int64()), pa.array(found, pa.string())], [key, "n_chars", "fingerprint"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


#: Rows a range has at least, where there are fewer than ``parts`` such ranges.
RANGE_ROWS = 256


def _cuts(rows: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """Cuts of the keys into ranges of about as many rows, and a number of ranges for rows without a key: ``parts`` in all, a bounded list whatever the table."""
    n, unkeyed = rows.agg(F.count(F.lit(1)), F.count_if(F.col("key").isNull())).first()  # one row
    parts = min(parts, 1 + n // RANGE_ROWS)
    apart = -(-parts * unkeyed // n) if unkeyed else 0
    keyed = max(1, parts - apart)
    at = [i / keyed for i in range(1, keyed)]
    found = rows.agg(F.percentile_approx("key", at, 20 * keyed)).first()[0] if at else None
    return np.unique(np.array(found or [], np.int64)), apart


def _range_of(keys: pa.Array, ties: pa.Array, cuts: np.ndarray, apart: int) -> np.ndarray:
    """Ranges in the order of keys; rows without one come before, by their tie, which is a hash and so falls evenly into ``apart`` ranges."""
    high = (np.asarray(ties).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    unkeyed = (high * np.uint64(max(1, apart)) >> np.uint64(32)).astype(np.int64)
    return np.where(np.asarray(keys.is_null()), unkeyed, apart + np.searchsorted(cuts, np.asarray(keys.fill_null(0)), side="right")).astype(np.int32)


def _with_successors(docs: DataFrame, text: str, key: str, parts: int) -> DataFrame:
    """Rows (part, guest, key, text), sorted by range and key: each row's successor is the next row, the last one's a guest."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    cuts, apart = _cuts(rows, parts)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(b.column(0), b.column(1), cuts, apart)), *b.columns], ["part", "key", "tie"])

    least = rows.select("key", "tie").mapInArrow(ranged, "part int, key long, tie long").groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull(), "key", "tie")).alias("first"))
    heads = {r["part"]: (r["first"]["key"], r["first"]["tie"]) for r in least.collect()}  # a row for each range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "guest", "key", "tie", "text"]
        for b in batches:
            part = _range_of(b.column("key"), b.column("tie"), cuts, apart)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), np.int32)), *b.columns], names)
            keys, ties = b.column("key").to_pylist(), b.column("tie").to_pylist()
            first = [i for i, p in enumerate(part.tolist()) if heads[p] == (keys[i], ties[i])]
            if first:
                heading = b.take(pa.array(first))
                to = pa.array([before[int(part[i])] for i in first], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([1] * len(first), pa.int32()), *heading.columns], names)

    dealt = rows.mapInArrow(placed, "part int, guest int, key long, tie long, text string")
    return dealt.repartitionById(len(cuts) + 1 + apart, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("key"), "tie")


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, k: int = K, parts: int | None = None) -> DataFrame:
    """Fingerprint of every document and of its edited text, and likeness to these and to the next document.

    The next document is the one of the next larger integer ``key`` (after the last: the first); rows
    of one key follow each other by a hash of the text, and null keys come before all others. A null
    text counts as empty, whose fingerprint is empty; a single row is its own successor; an empty
    table gives an empty result. Further columns are left out. Texts are shuffled once, to ranges of
    the key: in its sorted range a document's successor is the next row, and the first row of each
    range is sent to the range before it as well."""
    parts = parts or max(2, 4 * shuffle_parts(docs.sparkSession))
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose successor is still to come

        def told(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
            texts = [edited(a[3], b[3]) for a, b in pairs]
            new = sketches(pa.array(texts, pa.large_string()), width, k)
            lines = [
                (a[2], len(a[3]), hashlib.sha256(t.encode()).hexdigest(), pack(a[4]), pack(e), resemblance(a[4], e, k), resemblance(a[4], b[4], k))
                for (a, b), t, e in zip(pairs, texts, new, strict=True)
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], kind) for i, kind in enumerate(kinds)], names)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = sketches(batch.column("text"), width, k)
                rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "key", "text")), found, strict=True))
                pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1] and a[0] == b[0]]
                held = rows[-1:]
                if pairs:
                    yield told(pairs)

    out = _with_successors(docs, text, key, parts).drop("tie").mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
