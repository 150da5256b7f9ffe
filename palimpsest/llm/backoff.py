"""Stupid-backoff language-model scores against counts over the whole corpus.

``score_rows`` states the scores as tables of rows: n-gram counts by hash, what each n-gram that counts adds to a
score, the exploded n-grams joined to that, and sums per document. ``score``, which the query uses, does the same work on
arrays, since rows of one n-gram each take several times the disk (figures are in the README).

Texts are taken in chunks there. A chunk sends each of its distinct n-grams once, with its count in the
chunk, to the bucket of the n-gram's hash; a bucket adds up what all chunks send, which is its
part of the count table, and joins the sums back to the n-grams each chunk sent. The chunk,
met again as word numbers, then looks every n-gram of its texts up and adds the scores up by
document. Blocks of n-grams travel as arrays: a hash in a block is 40 bits, the bucket tells
the rest, and as the hashes are in order only their gaps are sent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpoint, let, shuffle_parts, stored
from .shingles import blocks, mix64, words

#: Longest n-gram of the query, the factor for each shorter one, and the count from which an n-gram is in the model.
ORDER, ALPHA, LEAST_COUNT = 3, 0.4, 2
#: A chunk ends with the text that brings it to so many words: its arrays take some 100 bytes a word.
CHUNK_WORDS = 400_000

_SCHEMA = "chunk long, n int, bucket int, docs array<long>, lengths binary, vocabulary binary, words binary, hashes binary, counts binary"
_NAMES = [x.split(" ")[0] for x in _SCHEMA.split(", ")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(chunk id, doc ids, words per text, word hashes) of consecutive texts."""
    docs, lengths, hashes, total, number = [], [], [], 0, 0
    part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def out() -> tuple[int, list, np.ndarray, np.ndarray]:
        h, n = np.concatenate(hashes), np.concatenate(lengths)
        name = hashlib.blake2b(h.tobytes() + n.tobytes() + f"{part}:{number}".encode(), digest_size=8).digest()
        return int.from_bytes(name, "big", signed=True), docs, n, h

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for a, b, data, offsets in blocks(batch.column("text")):
            of = words(data, offsets)
            docs, total = docs + ids[a:b], total + len(of.hashes)
            lengths.append(of.counts.astype(np.int32))
            hashes.append(of.hashes)
            if total >= CHUNK_WORDS:
                yield out()
                docs, lengths, hashes, total, number = [], [], [], 0, number + 1
    if docs:
        yield out()


def _ngrams(lengths: np.ndarray, hashes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..order: distinct hashes in order, their counts, and for the words that end an n-gram: their places and the n-gram's number."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram, out = hashes, []
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(gram)
            longer[1:] = mix64(gram[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:] + np.uint64(n))
            gram = longer
        at = np.flatnonzero(place >= n - 1)
        distinct, number, count = np.unique(gram[at], return_inverse=True, return_counts=True)
        out.append((distinct, count, at, number))
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The upper word of hash * buckets, in the order of the hashes."""
    low, n = hashes & np.uint64(0xFFFFFFFF), np.uint64(buckets)
    return (((hashes >> np.uint64(32)) * n + (low * n >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Width, how many, and the length of each plane of bytes; then the planes, each one compressed where that makes it shorter."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    raw = [plane.tobytes() for plane in planes]
    kept = [min(x, pa.compress(x, codec="zstd", asbytes=True), key=len) for x in raw]
    return bytes([width]) + np.array([len(numbers), *map(len, kept)], "<u4").tobytes() + b"".join(kept)


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    n, *lengths = np.frombuffer(raw, "<u4", 1 + width, 1).tolist()
    full, at = np.zeros((n, 8), np.uint8), 5 + 4 * width
    for i, length in enumerate(lengths):
        plane = raw[at : at + length]
        full[:, i] = np.frombuffer(plane if length == n else pa.decompress(plane, n, codec="zstd", asbytes=True), np.uint8)
        at += length
    return full.reshape(-1).view("<u8")


def _low(hashes: np.ndarray, buckets: int) -> bytes:
    """The upper 40 bits of the lower word of hash * buckets: in order within a bucket, so as gaps."""
    return _packed(np.diff((hashes * np.uint64(buckets)) >> np.uint64(24), prepend=np.uint64(0)))


def _from_low(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw), dtype=np.uint64)


def _counts(raw: bytes) -> np.ndarray:
    return _unpacked(raw).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _NAMES)


def _ask(order: int, buckets: int):
    """Each chunk's distinct n-grams, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, lengths, hashes in _chunks(batches):
            for n, (distinct, count, _, _) in enumerate(_ngrams(lengths, hashes, order), 1):
                edge = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
                yield _rows([(chunk, n, b, None, None, None, None, _low(distinct[i:j], buckets), _packed(count[i:j])) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i])

    return run


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk as its vocabulary, most frequent first, and the numbers of its words."""
    for chunk, docs, lengths, hashes in _chunks(batches):
        vocabulary, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        yield _rows([(chunk, 0, len(vocabulary), docs, lengths.astype("<i4").tobytes(), vocabulary[order].astype("<u8").tobytes(), _packed(rank[number]), None, None)])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by n and bucket. For each bucket: the sum of every hash over all chunks, sent back in the order each chunk asked."""
    group: list[tuple] = []

    def told() -> Iterator[pa.RecordBatch]:
        asked = [_from_low(x[3]) for x in group]
        distinct, number = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(number, np.concatenate([_counts(x[4]) for x in group]), len(distinct)).astype(np.int64)[number]
        at = np.cumsum([0, *map(len, asked)])
        yield _rows([(c, n, b, None, None, None, None, None, _packed(sums[i:j])) for (c, n, b, _, _), i, j in zip(group, at[:-1], at[1:], strict=True)])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "bucket", "hashes", "counts")), strict=True):
            if group and group[-1][1:3] != row[1:3]:
                yield from told()
                group = []
            group.append(row)
    if group:
        yield from told()


def score_tokens(lengths: np.ndarray, grams: list, totals: list[np.ndarray], alpha: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: sum of log scores without the division by the corpus size, words scored by unigrams, words scored by the longest n-gram."""
    size = int(lengths.sum())
    count = np.zeros((len(grams) + 1, size))
    for n, ((_, _, at, number), total) in enumerate(zip(grams, totals, strict=True), 1):
        count[n, at] = total[number]
    place = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    reach = np.minimum(place + 1, len(grams))
    score, level = np.log(np.maximum(count[1], 1)) + (reach - 1) * math.log(alpha), np.ones(size, np.int64)
    for n in range(2, len(grams) + 1):
        seen = np.flatnonzero(count[n] >= least)
        score[seen] = np.log(count[n, seen]) - np.log(count[n - 1, seen - 1]) + (reach[seen] - n) * math.log(alpha)
        level[seen] = n
    text = np.repeat(np.arange(len(lengths)), lengths)
    add = lambda x: np.bincount(text, x, len(lengths))
    return add(score), add(level == 1), add(level == len(grams))


def _score(order: int, buckets: int, alpha: float, least: int):
    """Rows come by chunk: its recipe, then the answers by n and bucket."""

    def told(group: list[dict]) -> pa.RecordBatch:
        recipe = group[0]
        if recipe["n"]:
            raise RuntimeError("a chunk's texts are missing: the input was not read with the same partitions twice")
        lengths = np.frombuffer(recipe["lengths"], "<i4")
        vocabulary = np.frombuffer(recipe["vocabulary"], "<u8")
        hashes = vocabulary[_counts(recipe["words"])]
        grams = _ngrams(lengths, hashes, order)
        totals = []
        for n in range(1, order + 1):
            found = [_counts(x["counts"]) for x in group[1:] if x["n"] == n]
            totals.append(np.concatenate([np.zeros(0, np.int64), *found]))
            if len(totals[-1]) != len(grams[n - 1][0]):
                raise RuntimeError("a chunk's counts are missing: the input was not read with the same partitions twice")
        total, low, top = score_tokens(lengths, grams, totals, alpha, least)
        return pa.RecordBatch.from_arrays([pa.array(recipe["docs"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(top.astype(np.int64)), pa.array(low.astype(np.int64)), pa.array(total)], ["doc_id", "n_words", "n_top", "n_unigram", "log_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                for row in whole.slice(at, 512).to_pylist():
                    if group and group[0]["chunk"] != row["chunk"]:
                        yield told(group)
                        group = []
                    group.append(row)
        if group:
            yield told(group)

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, alpha: float = ALPHA, least: int = LEAST_COUNT, buckets: int | None = None) -> DataFrame:
    """Per row: ``key``, n_words, n_top and n_unigram (words scored by the longest n-grams and by unigrams), log_score (natural log, summed) and score (per word).

    A word's score is c(n-gram) / c(its context) for the longest n-gram up to ``order`` that the corpus
    has ``least`` times, times ``alpha`` for each shorter length fallen back to; that of a unigram is
    its count over the corpus's words. Counts are over all rows, this one included (hence ``least``:
    what only one place has is no evidence). A text without words, or null, has n_words 0 and null
    scores; rows that repeat count and are scored each; null keys are kept; an empty table gives
    an empty result; further columns are left out.

    A frequent n-gram is one entry per chunk, not per document, and ``buckets`` (4 per shuffle
    partition) bounds a task's memory. ``docs`` is read twice and must have the same partitions both times,
    as tables and checkpoints do; a difference is noticed and raised."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    buckets = buckets or min(1 << 20, 4 * parts)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = rows.mapInArrow(_ask(order, buckets), _SCHEMA).repartition(parts, "n", "bucket").sortWithinPartitions("n", "bucket")
    answered = asked.select("chunk", "n", "bucket", "docs", "lengths", "vocabulary", "words", "hashes", "counts").mapInArrow(_answer, _SCHEMA)
    whole = rows.mapInArrow(_recipes, _SCHEMA).unionByName(answered).repartition(parts, "chunk").sortWithinPartitions("chunk", "n", "bucket")
    scored = checkpoint(whole.mapInArrow(_score(order, buckets, alpha, least), "doc_id long, n_words long, n_top long, n_unigram long, log_sum double"))
    total = scored.agg(F.sum("n_words")).first()[0] or 1  # one row
    log_score = F.when(F.col("n_words") > 0, F.col("log_sum") - F.col("n_unigram") * F.lit(math.log(total)))
    return scored.select(F.col("doc_id").alias(key), "n_words", "n_top", "n_unigram", log_score.alias("log_score"), (log_score / F.col("n_words")).alias("score"))


def _exploded(words: Column, n: int) -> Column:
    """Structs (h, context, rest, middle) for the n-grams of a word array: hashes of all n words, without the last, without the first, without both."""

    def hashed(w: Column, i: Column, a: int, b: int) -> Column:
        return F.xxhash64(F.lit(b - a), *(F.get(w, i + k) for k in range(a, b)))

    def grams(w: Column) -> Column:
        one = lambda i: F.struct(hashed(w, i, 0, n).alias("h"), hashed(w, i, 0, n - 1).alias("context"), hashed(w, i, 1, n).alias("rest"), hashed(w, i, 1, max(1, n - 1)).alias("middle"))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one))

    return let(words, grams)


def score_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, alpha: float = ALPHA, least: int = LEAST_COUNT) -> DataFrame:
    """``key``, n_words, n_top, n_unigram and log_score as ``score`` gives them, by DataFrame operations on rows of one n-gram each.

    Where an n-gram counts, so do the shorter ones within it; a document's score is then that of its unigrams plus, for each of
    its n-grams that counts, what the longer context changes. That change belongs to the n-gram, so the
    exploded n-grams are joined to one table of changes by hash and summed per document. Counts are partial in each task; adaptive
    execution splits a hot n-gram of the join. Nulls, empty texts, repeated rows and empty tables give what ``score`` gives."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(whole).alias("tie"), F.filter(F.split(whole, WORD_GAP), lambda w: w != "").alias("words"))
    rows = stored(rows.withColumn("n_words", F.size("words").cast("long")))
    once = rows.groupBy("doc_id", "tie").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))  # rows that repeat are scored once
    total = rows.agg(F.sum("n_words")).first()[0] or 1  # one row
    counts: list[DataFrame] = []
    parts = None
    for n in range(1, order + 1):
        grams = once.select("doc_id", "tie", "copies", F.explode(_exploded(F.col("words"), n)).alias("g")).select("doc_id", "tie", "copies", "g.*")
        asked = grams.groupBy("doc_id", "tie", "h").agg(F.count(F.lit(1)).alias("times"))
        counts.append(stored(grams.groupBy("h").agg(F.sum("copies").alias("c"), *(F.first(c).alias(c) for c in ("context", "rest", "middle")))))
        table = counts[-1]
        if n == 1:
            change = table.select("h", (F.log("c") - math.log(total)).alias("change"))
        else:
            of = lambda df, name: df.select(F.col("h").alias(name), F.col("c").alias(f"c_{name}"))
            table = table.filter(F.col("c") >= least).join(of(counts[-2], "context"), "context").join(of(counts[-2], "rest"), "rest")
            table = table.join(of(counts[-3], "middle"), "middle") if n > 2 else table.withColumn("c_middle", F.lit(total))
            change = table.select("h", (F.log("c") - F.log("c_context") - F.log("c_rest") + F.log("c_middle") - math.log(alpha)).alias("change"))
        told = asked.join(change, "h").groupBy("doc_id", "tie").agg(F.sum(F.col("change") * F.col("times")).alias("s"), F.sum("times").alias("t")).withColumn("n", F.lit(n))
        parts = told if parts is None else parts.unionByName(told)
    summed = parts.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.sum("s").alias("s"), F.sum(F.when(F.col("n") == order, F.col("t"))).alias("top"), F.sum(F.when(F.col("n") == 2, F.col("t"))).alias("two"))
    out = rows.select("doc_id", "tie", "n_words").join(summed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    steps = F.greatest(F.lit(0), F.col("n_words") - order) * (order - 1) + F.least(F.col("n_words"), F.lit(order)) * (F.least(F.col("n_words"), F.lit(order)) - 1) / 2
    top, two = F.coalesce("top", F.lit(0)).cast("long"), F.coalesce("two", F.lit(0)).cast("long")
    return out.select(F.col("doc_id").alias(key), "n_words", top.alias("n_top"), (F.col("n_words") - two).alias("n_unigram"), F.when(F.col("n_words") > 0, F.col("s") + steps * math.log(alpha)).alias("log_score"))
