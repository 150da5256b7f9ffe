"""Ranked lexical search: a tree of maxima over ranges of documents for each term, descended best first.

The index holds, for each range of documents and each term in it, the documents that hold the term
with the term's count and the document's length. What a term adds to a score depends on these and
on two totals of the corpus; its largest addition within a node of documents bounds what any of
them gets from it, and the sum of an item's bounds bounds their scores. The tree's upper level is
the ranges themselves, whose bounds for all items are a join and a sum. Each item first opens its
most promising range, where its tenth best score is a floor for all others: ranges whose bound is
below it stay shut. Within a range nodes of 512, 64 and 8 documents are opened in the order of
their bounds until none reaches the tenth score; those that equal it are opened, for ties.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents and characters of a range at most (a longer text is a range by itself), and children of a node.
RANGE_DOCS, RANGE_CHARS, FAN = 4096, 1 << 24, 8
#: Items that are searched together: their terms' postings in one range are one task's input.
BLOCK_ITEMS = 128

# Fixed values of the score: a count is worth SCALE * count div (1000 * count + 8 * m), where m is FLOOR for an empty document and FLOOR + SHARE for one of average length.
SCALE, FLOOR, SHARE = 1_000_000_000, 10, 90

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

INDEX = "range long, term string, df int, docs array<int>, counts array<int>, sizes array<int>, ids array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased."""
    return (text or "").encode("utf-8").translate(_TABLE).split()


class _Range:
    """Documents of a range on their way into the index."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.sizes, self.chars = [], [], 0
        self.terms, self.counts, self.held = [], [], []

    def add(self, key: int | None, text: str | None) -> None:
        words = terms_of(text)
        if not words:  # a document without a term is in no list and no total
            return
        counts = Counter(words)
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.held.append(len(counts))
        self.ids.append(key)
        self.sizes.append(len(words))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.ids) >= RANGE_DOCS or self.chars >= RANGE_CHARS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each term, and one without a term for the documents' ids and sizes."""
        term, count = np.concatenate(self.terms), np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.held)
        order = np.argsort(term, kind="stable")
        n = np.bincount(term, minlength=len(self.numbers))
        size = np.array(self.sizes, np.int32)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (doc[order], count[order], size[doc[order]])]
        names = pa.array([t.decode("utf-8") for t in self.numbers])
        none = pa.nulls(len(n), pa.list_(pa.int64()))
        fields = [f.split(" ")[0] for f in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number, np.int64)), names, pa.array(n.astype(np.int32)), *lists, none], fields)
        empty = pa.array([[]], pa.list_(pa.int32()))
        own = [pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([0], pa.int32()), empty, empty, pa.array([self.sizes], pa.list_(pa.int32())), pa.array([self.ids], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(own, fields)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, now = TaskContext.get().partitionId() << 32, _Range()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now.add(key, text)
                if now.full():
                    yield from now.rows(number)
                    number, now = number + 1, _Range()
    if now.ids:
        yield from now.rows(number)


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of all terms of all documents: for each range and term the documents (places in the range), counts and sizes; a range's own
    row has no term and holds its documents' ids and sizes. Ranges are runs of an input partition: texts are not shuffled.

    Null texts and texts without a term are in no row. Each row of ``docs`` is a document of its own, whatever its id."""
    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(_indexed, INDEX)


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int


def totals(indexed: DataFrame) -> Totals:
    own = indexed.filter(F.col("term").isNull()).select(F.size("sizes").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    n, words = own.agg(F.sum("n"), F.sum("words")).first()  # one row
    return Totals(n or 0, words or 0)


def gains(counts: np.ndarray, sizes: np.ndarray, of: Totals) -> np.ndarray:
    """What counts are worth in documents of these sizes."""
    counts, sizes = counts.astype(np.int64), sizes.astype(np.int64)
    return (SCALE * counts) // (1000 * counts + 8 * (FLOOR + (SHARE * sizes * of.documents) // of.terms))


def _top(of: Totals) -> Column:
    """The same in SQL: the largest gain of a list."""
    return F.expr(f"array_max(zip_with(counts, sizes, (t, n) -> ({SCALE}L * t) div (1000L * t + 8L * ({FLOOR} + ({SHARE}L * n * {of.documents}L) div {max(1, of.terms)}L))))")


class Tree:
    """Postings of a range by node, at each level from documents up: (term, largest gain) of each node, and where a node's own begin."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, gain: np.ndarray, documents: int):
        self.levels = []
        order = np.lexsort((term, doc))
        term, node, gain = term[order], doc[order].astype(np.int64), gain[order]
        nodes = documents
        while True:
            self.levels.append((term, gain, np.searchsorted(node, np.arange(nodes + 1))))
            if nodes <= FAN:
                return
            nodes = -(-nodes // FAN)
            node = node // FAN
            order = np.lexsort((term, node))
            term, node, gain = term[order], node[order], gain[order]
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])])) if len(term) else np.zeros(0, np.int64)
            gain = np.maximum.reduceat(gain, first) if len(first) else gain
            term, node = term[first], node[first]

    def bounds(self, level: int, a: int, b: int, weight: np.ndarray) -> np.ndarray:
        """Sums over an item's terms for nodes ``a`` to ``b`` of a level; of single documents they are scores."""
        term, gain, starts = self.levels[level]
        at = starts[a : b + 1]
        sums = np.concatenate([[0], np.cumsum(weight[term[at[0] : at[-1]]] * gain[at[0] : at[-1]])])
        return np.diff(sums[at - at[0]])

    def best(self, weight: np.ndarray, ids: list[int | None], floor: int, k: int) -> list[tuple[int, int | None]]:
        """The ``k`` best (score, id) of at least ``floor`` (equal scores: the smaller id), by the order of bounds."""
        top = len(self.levels) - 1
        nodes = len(self.levels[top][2]) - 1
        waiting = [(-int(x), top, i) for i, x in enumerate(self.bounds(top, 0, nodes, weight)) if x >= floor]
        heapq.heapify(waiting)
        found: list[tuple[int, float]] = []  # a heap: the worst first; a larger id is worse, none the worst
        while waiting and -waiting[0][0] >= floor:
            value, level, i = heapq.heappop(waiting)
            if level == 0:
                row = (-value, float("-inf") if ids[i] is None else -ids[i])
                if len(found) < k:
                    heapq.heappush(found, row)
                else:
                    heapq.heappushpop(found, row)
                if len(found) == k:
                    floor = max(floor, found[0][0])  # what equals it may still have a smaller id
                continue
            a = i * FAN
            b = min(a + FAN, len(self.levels[level - 1][2]) - 1)
            for j, x in enumerate(self.bounds(level - 1, a, b, weight).tolist(), a):
                if x >= floor:
                    heapq.heappush(waiting, (-x, level - 1, j))
        return [(score, None if tie == float("-inf") else -tie) for score, tie in found]


def _opened(chosen: DataFrame, asks: DataFrame, of: Totals, k: int) -> DataFrame:
    """(qid, doc, score) of at most ``k`` documents for each (block, range, qid, floor) of ``asks``, from the postings of ``chosen``."""

    def search(postings: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if postings.num_rows and asked.num_rows:
            lists = [postings[c].combine_chunks() for c in ("docs", "counts", "sizes")]
            held = np.diff(np.asarray(lists[0].offsets))
            docs, counts, sizes = (np.asarray(x.flatten()) for x in lists)
            term = np.repeat(np.arange(postings.num_rows), held)
            ids = asked["ids"][0].as_py()
            tree = Tree(term, docs, gains(counts, sizes, of), len(ids))
            floors = dict(zip(asked["qid"].to_pylist(), asked["floor"].to_pylist(), strict=True))
            weights = postings["weight"].to_numpy()
            own = defaultdict(list)
            for row, qids in enumerate(postings["qids"].to_pylist()):
                for q in qids:
                    own[q].append(row)
            for q, floor in floors.items():
                weight = np.zeros(postings.num_rows, np.int64)
                weight[own[q]] = weights[own[q]]
                out += [(q, doc, score) for score, doc in tree.best(weight, ids, max(1, floor), k)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["qid", "doc", "score"])

    needed = chosen.join(asks.select("block", "range").distinct(), ["block", "range"], "left_semi")
    return needed.groupBy("block", "range").cogroup(asks.groupBy("block", "range")).applyInArrow(search, "qid long, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def items(queries: DataFrame, text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame, int]:
    """Numbered items (qid, item), their terms (block, term, qids) and the number of items. Rows of one item are one query; a null item is one too."""
    named = queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    numbers = stored(named.select("item").distinct().withColumn("qid", F.monotonically_increasing_id()))
    n = numbers.count()
    joined = named.join(numbers.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of"))).select("qid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, t.decode("utf-8")) for q, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["qid", "term"])

    block = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // BLOCK_ITEMS)))).cast("int")
    terms = joined.mapInArrow(run, "qid long, term string").distinct()
    return numbers, stored(terms.groupBy(block.alias("block"), "term").agg(F.collect_list("qid").alias("qids"))), n


def search(indexed: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """``item``, rank (from 1), doc_id and score of the ``k`` documents with the highest scores above 0, fewer if there are not so many;
    equal scores by ascending id, a document without an id last.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))). Items without a term that any document holds have no rows, as
    have those with a null text; rows of one item are taken together; further columns are left out. Items are searched in
    blocks, whose terms are joined to the index: neither items nor index are brought to the driver, and no list of candidates is cut."""
    numbers, terms, _ = items(queries, text, item)
    of = totals(indexed)
    entries = indexed.filter(F.col("term").isNotNull())
    counted = entries.select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(of.documents) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = stored(terms.join(counted.select("term", weight.alias("weight")), "term"))
    chosen = stored(entries.join(weighed, "term").select("block", "range", "weight", "qids", "docs", "counts", "sizes", (F.col("weight") * _top(of)).alias("top")))
    bounds = stored(chosen.select("block", "range", "top", F.explode("qids").alias("qid")).groupBy("block", "range", "qid").agg(F.sum("top").alias("bound")).filter("bound > 0"))
    homes = indexed.filter(F.col("term").isNull()).select("range", "ids")
    first = bounds.groupBy("block", "qid").agg(F.max(F.struct("bound", "range")).alias("best")).select("block", "best.range", "qid", F.lit(1).cast("long").alias("floor"))
    found = stored(_opened(chosen, first.join(homes, "range"), of, k))
    floors = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(1).alias("floor"))
    rest = bounds.join(floors.withColumnRenamed("qid", "of"), F.col("qid") == F.col("of"), "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    rest = rest.filter(F.col("bound") >= F.col("floor")).join(first.select("range", "qid"), ["range", "qid"], "left_anti").select("block", "range", "qid", "floor")
    all_found = found.unionByName(_opened(chosen, rest.join(homes, "range"), of, k))
    named = numbers.withColumnRenamed("qid", "of")
    return _ranked(all_found, k).join(named, F.col("qid") == F.col("of")).select(F.col("item").alias(item), "rank", F.col("doc").alias("doc_id"), "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``index`` of the documents, kept in the shared folder, and ``search`` for the queries in it."""
    return search(stored(index(docs, text, key)), queries, k, text, item)
