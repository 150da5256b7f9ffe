"""Repeated spans of texts: from hashes of spans to what each document repeats, and its removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, stored
from .shingles import Words, blocks, mix64, words

_STEP = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def run_hasher(of: Words) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of the word runs ``a[i]:b[i]``, by differences of prefix sums; equal runs have equal hashes wherever they stand."""
    n = len(of.hashes)
    up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of.hashes * up[:n])])
    return lambda a, b: mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def packed(of: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code-point offsets, start << 32 | end within its text, of the word runs ``a[i]:b[i]`` (none empty)."""
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((of.data & 0xC0) != 0x80)])
    base = points[of.texts[np.searchsorted(of.first, a, side="right") - 1]]
    return (points[of.starts[a]] - base) << 32 | (points[of.ends[b - 1]] - base)


def span_rows(find: Callable[[Words], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from (doc_id, tie, text) to (h, doc_id, tie, span) for the word runs that ``find`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in blocks(batch.column("text")):
                of = words(data, offsets)
                a, b = find(of)
                if len(a):
                    row = pa.array(at + np.searchsorted(of.first, a, side="right") - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(run_hasher(of)(a, b).view(np.int64)), *(batch.column(c).take(row) for c in ("doc_id", "tie")), pa.array(packed(of, a, b))], SPAN_NAMES)

    return run


SPAN_SCHEMA = "h long, doc_id long, tie long, span long"
SPAN_NAMES = ["h", "doc_id", "tie", "span"]


def spanned(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, tie, text): ``tie`` is a hash of the text, which parts the texts that share a key, or have none."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: all repeated spans and the non-first ones, each merged into disjoint ranges."""
    names = ["doc_id", "text_hash", "n_spans", "repeated_chars", "spans", "removed_chars", "removed"]
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for spans, later in zip(batch.column("spans").to_pylist(), batch.column("later").to_pylist(), strict=True):
            for k, x in enumerate((spans, [s for s, y in zip(spans, later, strict=True) if y])):
                out: list[list[int]] = []
                for s in sorted(x):
                    a, b = s >> 32, s & 0xFFFFFFFF
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                if not k:
                    columns[0].append(len(out))
                columns[1 + 2 * k].append(sum(b - a for a, b in out))
                columns[2 + 2 * k].append(",".join(f"{a}:{b}" for a, b in out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *(pa.array(x, pa.string() if i in (2, 4) else pa.int64()) for i, x in enumerate(columns))], names)


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without rows equal to the one before: those of rows that repeat key and text."""
    columns = [np.asarray(batch.column("h")), np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("doc_id").is_null()), np.asarray(batch.column("tie")), np.asarray(batch.column("span"))]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return batch if new.all() else batch.filter(pa.array(new))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of sorted rows those whose hash is also before (later) or after them, and the range's first and last (edge 1, 2 or both).

    The hash itself is kept for edges only."""
    part, held, held_later, opened = TaskContext.get().partitionId(), None, False, False

    def told(batch: pa.RecordBatch, later: np.ndarray, match: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        keep = match | (edge > 0)
        n, out = int(keep.sum()), batch.filter(pa.array(keep))
        h = pa.array(np.asarray(out.column("h")), mask=edge[keep] == 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), h, out.column("doc_id"), out.column("tie"), out.column("span"), pa.array(later[keep]), pa.array(match[keep]), pa.array(edge[keep])], _TOLD_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        batch = _distinct(batch)
        h = np.asarray(batch.column("h"))
        same = np.concatenate([[held_later], h[1:] == h[:-1], [False]])
        later, match = same[:-1], same[:-1] | same[1:]
        edge = np.zeros(len(h), np.int32)
        edge[0] = 0 if opened else 1
        opened = opened or len(h) > 1
        held, held_later, held_match = batch.slice(len(h) - 1, 1), bool(later[-1]), bool(match[-1])  # its successor is still to come
        held_edge = int(edge[-1])
        yield told(batch.slice(0, len(h) - 1), later[:-1], match[:-1], edge[:-1])
    if held is not None:
        yield told(held, np.array([held_later]), np.array([held_match]), np.array([held_edge + 2], np.int32))


_TOLD = "part int, h long, doc_id long, tie long, span long, later boolean, matched boolean, edge int"
_TOLD_NAMES = [x.split(" ")[0] for x in _TOLD.split(", ")]


def matched(found: DataFrame, parts: int) -> DataFrame:
    """(doc_id, tie, span, later) of the rows (h, doc_id, tie, span) whose hash occurs again; later: not its first, by doc_id, tie and span.

    Rows are sorted over ranges and neighbours compared. The order goes on with document and place, so a
    hash that very many rows share is spread over several ranges. The first and last row of each
    range, two at most, are compared with those of the ranges beside it on the driver."""
    order = [F.col("h"), F.asc_nulls_first("doc_id"), F.col("tie"), F.col("span")]
    told = stored(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _TOLD))
    edges = told.filter("edge > 0").select("part", "edge", "h").collect()
    first, last = {r["part"]: r["h"] for r in edges if r["edge"] & 1}, {r["part"]: r["h"] for r in edges if r["edge"] & 2}
    ranges = sorted(first)
    joined = [(a, b) for a, b in zip(ranges[:-1], ranges[1:], strict=True) if last[a] == first[b]]
    opens = F.col("part").isin([b for _, b in joined]) & F.col("edge").isin(1, 3)
    closes = F.col("part").isin([a for a, _ in joined]) & F.col("edge").isin(2, 3)
    return told.filter(F.col("matched") | opens | closes).select("doc_id", "tie", "span", (F.col("later") | opens).alias("later"))


def repeats(found: DataFrame, more: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """What documents repeat, of spans (h, doc_id, tie, span): a row for each document that has a span whose hash occurs again.

    doc_id, text_hash (the tie), n_spans, repeated_chars, spans: the repeated ranges ('start:end' in code points,
    merged); removed_chars, removed: those ranges whose spans are not the first, by doc_id, tie and place. ``more``
    has further (doc_id, tie, span, later) to count in. Lists are per text, never per hash, nor of all texts without a key."""
    hits = matched(found, parts or shuffle_parts(found.sparkSession))
    if more is not None:
        hits = hits.unionByName(more)
    lists = hits.groupBy("doc_id", "tie").agg(F.collect_list("span").alias("spans"), F.collect_list("later").alias("later"))
    return lists.mapInArrow(_ranges, "doc_id long, text_hash long, n_spans long, repeated_chars long, spans string, removed_chars long, removed string")


def without(docs: DataFrame, removed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the ranges of ``removed`` (``key``, text_hash, removed) cut out of ``text``; other columns and rows stay, whatever their names.

    A text of which nothing is to be removed, and null, stays as it is."""
    ends = F.transform(F.filter(F.split("removed", ","), lambda x: x != ""), lambda r: F.struct(F.split_part(r, F.lit(":"), F.lit(1)).cast("int").alias("a"), F.split_part(r, F.lit(":"), F.lit(2)).cast("int").alias("b")))
    cut = removed.select(F.col(f"`{key}`").alias("_id"), F.col("text_hash").alias("_tie"), ends.alias("_cut"))
    rows = docs.select(F.col(f"`{key}`").alias("_of"), F.col(f"`{text}`").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    before = lambda i: F.when(i > 0, F.get("_cut", i - 1)["b"]).otherwise(0)
    pieces = F.transform("_cut", lambda r, i: F.substring(F.col("_text"), before(i) + 1, r["a"] - before(i)))
    rest = F.substring(F.col("_text"), F.get("_cut", F.size("_cut") - 1)["b"] + 1, F.length("_text"))
    kept = F.when(F.size("_cut") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("_text"))
    out = rows.join(cut, F.col("_of").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_tie")), "left")
    return out.select(*(kept.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))
