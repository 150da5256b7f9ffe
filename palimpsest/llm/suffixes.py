"""Suffix-array dedup with sparse suffixes.

Of all suffixes of all texts those are retained that begin at a minimiser: the word k-gram of
least hash among each window of consecutive k-grams. Which they are depends on the words
alone, so a passage retains the same suffixes in every text that holds it. The retained
suffixes are sorted by their first words over the whole corpus and neighbours compared; matches are
extended to both sides by the windows of the least length that count, around the matched places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD, shuffle_parts, stored
from .shingles import Words, blocks, words
from .spans import SPAN_NAMES, SPAN_SCHEMA, matched, packed, repeats, run_hasher, spanned

#: Words that a repeated passage has at least, and words by which suffixes are compared.
LEAST, PREFIX = 50, 25


def minimisers(of: Words, least: int = LEAST, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the retained suffixes and the hashes of their first ``prefix`` words.

    Each run of ``least`` words has least - prefix + 1 k-grams; the leftmost least one is retained."""
    n = len(of.hashes)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - prefix + 1)
    grams = run_hasher(of)(at, at + prefix)
    width = least - prefix + 1
    starts = np.arange(n - least + 1)
    ends = of.first[np.searchsorted(of.first, starts, side="right")]
    starts = starts[starts + least <= ends]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    kept = np.zeros(n, bool)
    for a in range(0, len(starts), 1 << 16):
        part = starts[a : a + (1 << 16)]
        kept[part + views[part].argmin(axis=1)] = True
    kept = np.flatnonzero(kept)
    return kept, grams[kept]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, _, data, offsets in blocks(batch.column("text")):
            of = words(data, offsets)
            at, grams = minimisers(of)
            if len(at):
                text = np.searchsorted(of.first, at, side="right") - 1
                own = pa.array(row + text)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *(batch.column(c).take(own) for c in ("doc_id", "tie")), pa.array((at - of.first[text]).astype(np.int64))], SPAN_NAMES)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of LEAST words that hold the first words of a matched suffix."""
    for batch in batches:
        anchors = batch.column("anchors").to_pylist()
        for row, end, data, offsets in blocks(batch.column("text")):
            of = words(data, offsets)
            begin = np.zeros(len(of.hashes) + 1, np.int64)
            for i in range(row, end):
                p, low, high = np.asarray(anchors[i], np.int64), of.first[i - row], of.first[i - row + 1]
                np.add.at(begin, np.maximum(low, low + p - (LEAST - PREFIX)), 1)
                np.add.at(begin, np.maximum(low, np.minimum(low + p, high - LEAST)) + 1, -1)
            a = np.flatnonzero(np.cumsum(begin)[:-1] > 0)
            text = np.searchsorted(of.first, a, side="right") - 1
            a = a[a + LEAST <= of.first[text + 1]]
            if len(a):
                own = pa.array(row + np.searchsorted(of.first, a, side="right") - 1)
                yield pa.RecordBatch.from_arrays([pa.array(run_hasher(of)(a, a + LEAST).view(np.int64)), *(batch.column(c).take(own) for c in ("doc_id", "tie")), pa.array(packed(of, a, a + LEAST))], SPAN_NAMES)


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that occur more than once: (doc_id, tie, span, later) of each copy's words, and (doc_id, tie) of all copies but the first.

    A copy repeats from its first word to its last what the first one has, whatever else does, so only the first
    one's suffixes are needed. Counts are partial in each task: a text of very many copies is a few rows."""
    solid = F.btrim("text", F.lit(GAP_CHARS))
    start = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(GAP_CHARS)))
    named = docs.filter("text IS NOT NULL").select("doc_id", "tie", F.md5("text").alias("m"), F.regexp_count("text", F.lit(WORD)).alias("n"), F.shiftleft(start.cast("long"), 32).bitwiseOR((start + F.length(solid)).cast("long")).alias("span"))
    named = stored(named.filter(F.col("n") >= LEAST).select("doc_id", "tie", "m", "span"))
    ends = F.min(F.struct("doc_id")).alias("first"), F.max(F.struct("doc_id")).alias("last")
    groups = stored(named.groupBy("m").agg(*ends).filter(~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id"))).select("m", "first.doc_id"))
    both = stored(named.join(groups.withColumnRenamed("doc_id", "of"), "m").select("doc_id", "tie", "span", (~F.col("doc_id").eqNullSafe(F.col("of"))).alias("later")))
    return both, both.filter("later").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """``repeats`` of passages of 50 words or more; ``without`` removes them.

    A passage of 50 words in two places retains the same suffix in both, whose windows of 50 words are then
    compared on both sides, so none is missed and none reported that is shorter; longer
    passages are the union of their windows. Words count without the white space between them.
    Rows that repeat key and text are one document; texts that share a key, or have none, are a document
    each, told apart by ``text_hash``. Null and short
    texts have no passages; an empty table gives an empty result; further columns are left out."""
    parts = parts or shuffle_parts(docs.sparkSession)
    rows = spanned(docs, text, key)
    copies, later = _copies(rows)
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    suffixes = stored(rows.mapInArrow(_suffixes, SPAN_SCHEMA))
    anchors = matched(suffixes, parts).select("doc_id", "tie", F.col("span").alias("pos")).join(later, own, "left_anti")
    anchors = anchors.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_list("pos").alias("anchors"))
    near = rows.join(anchors, own).select("doc_id", "tie", "text", "anchors")
    return repeats(near.mapInArrow(_windows, SPAN_SCHEMA), copies, parts).withColumnRenamed("doc_id", key)
