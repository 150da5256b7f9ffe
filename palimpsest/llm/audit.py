"""How filters interact: what each removes in every order, part by part.

Four conditions look at a text alone and one at the whole table: whether a smaller id has the
very same text. For that, texts are routed by the xxhash of their bytes to partitions of an RDD;
each keeps, for a fingerprint, a chain of the different texts that share it with the least id of
each, and hands out every id above the least. A copy that its own input partition already knows
for one goes on without its text, so a text that a third of all rows share is sent once from each
partition. What is left of a document is five bits; counts of the 32 masks are vectors, which
``combineByKey`` adds up per part, and every order's figures follow from the vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

#: Bytes of text that a task holds before the shuffle; when there are more, it sends what it has and begins anew.
HELD_BYTES = 64 << 20
#: Bytes of text for which there is a partition of the RDD.
PART_BYTES = 32 << 20

#: A row on its way: text (none if the row is known for a copy), id, mask of the filters that it fails, rows by part.
Row = tuple[bytes | None, int | None, int, dict[str, int]]

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def fails(text: str) -> int:
    """Bits of the conditions A to D that a text alone meets."""
    data = text.encode("utf-8")
    words = data.split()  # of bytes: at space and \\t to \\r only
    n = len(words)
    capitals = len(data) - len(data.translate(None, _UPPER))
    marked = len(data.translate(None, _MARKS)) < len(data)
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * len(text)) << 2 | marked << 3


def _before(a: int | None, b: int | None) -> bool:
    """Whether id ``a`` is smaller; no id is larger than any."""
    return a is not None and (b is None or a < b)


class Chains:
    """Texts by fingerprint, each with the least id met so far. ``add`` hands back the rows that turn out to be copies."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def add(self, mark: int, row: Row) -> Row | None:
        data, key, mask, parts = row
        chain = self.chains.setdefault(mark, [])
        for held in chain:
            if held[0] == data:
                if _before(key, held[1]):
                    out = (None, held[1], held[2] | COPY, held[3])
                    held[1:] = key, mask, dict(parts)
                    return out
                if key == held[1]:
                    for part, n in parts.items():
                        held[3][part] = held[3].get(part, 0) + n
                    return None
                return None, key, mask | COPY, parts
        chain.append([data, key, mask, dict(parts)])
        self.size += len(data)
        return None

    def drain(self) -> Iterator[tuple[int, Row]]:
        for mark, chain in self.chains.items():
            for held in chain:
                yield mark, tuple(held)
        self.chains, self.size = {}, 0


def _judged(index: int, rows: Iterator[tuple]) -> Iterator[tuple[int, Row]]:
    """(route, row) of an input partition: texts by fingerprint, known copies by a running number, which spreads them."""
    held, sent = Chains(), index
    for key, part, text in rows:
        data = (text or "").encode("utf-8")
        copy = held.add(xxhash.xxh64_intdigest(data), (data, key, fails(text or ""), {part: 1}))
        if copy:
            sent += 1
            yield sent, copy
        if held.size > HELD_BYTES:
            yield from held.drain()
    yield from held.drain()


def _resolved(rows: Iterator[tuple[int, Row]]) -> Iterator[tuple]:
    """(id, part, mask, rows) with the last filter decided."""
    held = Chains()
    for mark, row in rows:
        done = row if row[0] is None else held.add(mark, row)
        if done:
            yield from ((done[1], part, done[2], n) for part, n in done[3].items())
    for _, (_, key, mask, parts) in held.drain():
        yield from ((key, part, mask, n) for part, n in parts.items())


def masks(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """``key``, part, mask (bit k: fails the k-th filter of FILTERS) and n, the number of such rows.

    A null text is an empty one; a null part is the empty string; a row without an id comes after all that have one, and is a copy if
    any of these has its text; rows that share the least id of a text are none of them copies. Further columns are left out, whatever
    their names; an empty table gives an empty result. Texts go whole and are compared whole. There are as many partitions as the
    texts' bytes, summed beforehand, are worth."""
    rows = docs.select(F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")), F.col(f"`{text}`")).rdd
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0  # one row
    parts = max(shuffle_parts(docs.sparkSession), -(-size // PART_BYTES))
    routed = rows.mapPartitionsWithIndex(_judged).partitionBy(parts, lambda mark: mark)
    found = docs.sparkSession.createDataFrame(routed.mapPartitions(_resolved), "key long, part string, mask int, n long", verifySchema=False)
    return found.withColumnRenamed("key", key)


def vectors(judged: DataFrame, labels: DataFrame, key: str = "doc_id") -> RDD:
    """(part, counts of all, good and toxic documents by mask).

    Rows are summed by id before labels are joined to them, so that what repeats an id, or has none, is a few rows. Several labels of
    one id count as good or toxic if any of them says so; a document without a label is neither."""
    named = F.col(f"`{key}`").cast("long").alias("key")
    rows = judged.groupBy(named, "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col(f"`{key}`").cast("long").alias("of")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("bad"))
    joined = rows.join(marks, F.col("key") == F.col("of"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))

    def added(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, bad = row
        vector[:, mask] += (n, n * good, n * bad)
        return vector

    pairs = joined.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: added(np.zeros((3, 1 << len(FILTERS)), np.int64), row), added, lambda a, b: a + b, shuffle_parts(judged.sparkSession))


def report(counted: tuple[str, np.ndarray]) -> Iterator[tuple]:
    """All orders' rows of one part."""
    part, (n, good, bad) = counted
    every = np.arange(1 << len(FILTERS))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows, shares = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            failing = every & bit[f] > 0
            here = failing & (every & before == 0)
            before |= bit[f]
            removed = int(n[here].sum())
            shares[f] += removed
            rows.append((f, "".join(order), step, int(n[every & before == 0].sum()), removed, int(n[failing].sum()) - removed, int(n[bit[f]]), int(good[here].sum()), int(bad[here].sum())))
    for f, *row in rows:
        yield (part, *row, shares[f])


def interactions(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """For every part, order of the five filters and step: documents kept, removed here, failing but removed earlier (redundant), failing
    this filter only (unique_fails), good and toxic ones lost here, and the filter's removals over all orders (shapley).

    Parts are those that occur; a part in which nothing fails has rows of zeros. Nulls, ties, repeated rows and empty tables are as
    in ``masks`` and ``vectors``; empty labels lose nothing good or toxic."""
    rows = vectors(masks(docs, text, key, part), labels, key).flatMap(report)
    return docs.sparkSession.createDataFrame(rows, SCHEMA, verifySchema=False)
