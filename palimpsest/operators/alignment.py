"""Sequence alignment, voting and fusion of token streams.

The dynamic programmes are numpy or plain Python in Arrow-batched functions over rows; what follows them
(votes, rates, joins) is built of columns. Ties are broken the same way everywhere: match or
substitution, then deletion, then insertion.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

OPS = "array<struct<op:string,i:int,j:int>>"


#: Rows of an Arrow batch that are Python objects at a time; a batch has up to 10,000, of hundreds of words each.
SLICE = 256


def vector(kind: str) -> Callable:
    """A function of pandas series as one of columns. The function is made a UDF where it is called, so that the module loads without a session.

    It gets the rows of a batch in slices, so that memory is that of SLICE rows as objects, and of a batch in Arrow's form."""

    def wrap(f: Callable) -> Callable:
        def call(*columns: Column | str) -> Column:
            form = to_arrow_type(DataType.fromDDL(kind))

            def sliced(*arrays: pa.Array) -> pa.Array:
                parts = []
                for at in range(0, len(arrays[0]), SLICE):
                    out = f(*(a.slice(at, SLICE).to_pandas() for a in arrays))
                    parts.append(pa.array(out.to_dict("records") if isinstance(out, pd.DataFrame) else out.tolist(), form))
                return pa.concat_arrays(parts) if parts else pa.array([], form)

            return F.arrow_udf(sliced, kind)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


#: Cells of a table that is kept whole; of a larger one, rows at even steps are kept and the rest are made again.
WHOLE_CELLS = 1 << 22


class Rows:
    """Rows 0 to n of a dynamic programme of ``width`` columns, each made of the one before by ``step(i, row)``, to be read from the last to the first.

    A large table keeps about the root of its rows, and the rows between two of these while they are read: memory grows with
    the root of the table, time is twice that of one pass."""

    def __init__(self, n: int, first: np.ndarray, step: Callable[[int, np.ndarray], np.ndarray]):
        self.step, self.every = step, 1 if (n + 1) * len(first) <= WHOLE_CELLS else max(1, math.isqrt(n + 1))
        self.kept, row = [first], first
        for i in range(1, n + 1):
            row = step(i, row)
            if i % self.every == 0:
                self.kept.append(row)
        self.last, self.n, self.block, self.start = row, n, [], -1

    def __getitem__(self, i: int) -> np.ndarray:
        if self.every == 1:
            return self.kept[i]
        if i == self.n:
            return self.last
        k = i // self.every
        if k != self.start:
            self.block, self.start = [self.kept[k]], k
            for x in range(k * self.every + 1, min((k + 1) * self.every, self.n + 1)):
                self.block.append(self.step(x, self.block[-1]))
        return self.block[i - k * self.every]


def _codes(*streams: list[str]) -> list[np.ndarray]:
    known: dict[str, int] = {}
    return [np.array([known.setdefault(t, len(known)) for t in s], np.int64) for s in streams]


def distances(a: np.ndarray, b: np.ndarray, free_start: bool = False) -> Rows:
    """Edit distances of all prefixes. A row's insertions are one running minimum."""
    steps = np.arange(len(b) + 1, dtype=np.int32)

    def step(i: int, row: np.ndarray) -> np.ndarray:
        new = np.empty(len(b) + 1, np.int32)
        new[0] = i
        np.minimum(row[:-1] + (b != a[i - 1]), row[1:] + 1, out=new[1:])
        return np.minimum.accumulate(new - steps) + steps

    return Rows(len(a), np.zeros(len(b) + 1, np.int32) if free_start else steps, step)


def align(ref: list[str], hyp: list[str], free_ends: bool = False) -> list[tuple[str, int, int]]:
    """Operations (M, S, D, I) with places in both, -1 for none. ``free_ends``: hypothesis before and after the match costs nothing.

    Streams may be long: of a large table only some rows are held (``Rows``)."""
    n, m = len(ref), len(hyp)
    a, b = _codes(ref, hyp)
    cost = distances(a, b, free_ends)
    i, j, out = n, m, []
    if free_ends:
        j = m - int(np.argmin(cost[n][::-1]))
    here = cost[n]
    while i or (j and not free_ends):
        above = cost[i - 1] if i else None
        if i and j and here[j] == above[j - 1] + (a[i - 1] != b[j - 1]):
            i, j, here = i - 1, j - 1, above
            out.append(("M" if a[i] == b[j] else "S", i, j))
        elif i and here[j] == above[j] + 1:
            i, here = i - 1, above
            out.append(("D", i, -1))
        else:
            j -= 1
            out.append(("I", -1, j))
    return out[::-1]


def _pairs(columns: tuple[pd.Series, ...]) -> Iterator[tuple[list[str], ...]]:
    for row in zip(*columns, strict=True):
        yield tuple([] if x is None else list(x) for x in row)


@vector(OPS)
def align_ops(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "i": i, "j": j} for o, i, j in align(r, h)] for r, h in _pairs((ref, hyp))])


@vector(OPS)
def fitting_ops(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Alignment of a reference within a longer hypothesis."""
    return pd.Series([[{"op": o, "i": i, "j": j} for o, i, j in align(r, h, True)] for r, h in _pairs((ref, hyp))])


def op_counts(ops: Column) -> Column:
    """struct(s, d, i, n) of an operation array."""
    count = lambda *kinds: F.size(F.filter(ops, lambda x: x["op"].isin(*kinds))).cast("long")
    return F.struct(count("S").alias("s"), count("D").alias("d"), count("I").alias("i"), count("M", "S", "D").alias("n"))


def deleted_places(ops: Column) -> Column:
    return F.transform(F.filter(ops, lambda x: x["op"] == "D"), lambda x: x["i"])


def edge_flags(ops: Column) -> Column:
    """struct(first, last): whether the first and the last reference token are unmatched."""
    ref = F.filter(ops, lambda x: x["op"] != "I")
    return F.struct((F.get(ref, F.lit(0))["op"] != "M").alias("first"), (F.element_at(ref, -1)["op"] != "M").alias("last"))


class _Runs:
    """Automaton of all runs of b[low:high]: a state is a set of runs that end at the same places, the first of which is kept."""

    def __init__(self, b, low: int, high: int):
        self.next, self.link, self.length, self.end = [{}], [-1], [0], [-1]
        last = 0
        for at in range(low, high):
            x, new = b[at], self._state(self.length[last] + 1, at)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.length[q := self.next[p][x]] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(self.length[p] + 1, self.end[q])
                self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
                while p >= 0 and self.next[p].get(x) == q:
                    self.next[p][x] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
            last = new

    def _state(self, length: int, end: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, a, low: int, high: int) -> tuple[int, int, int]:
        """(place in a, place in b, length) of the longest run that both have; of equals the first in a, then in b."""
        state = size = 0
        best = (low, 0, 0)
        for at in range(low, high):
            x = a[at]
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state, size = self.next[state][x], size + 1
                if size > best[2]:
                    best = (at + 1 - size, self.end[state] + 1 - size, size)
        return best


def blocks(a, b) -> list[tuple[int, int, int]]:
    """Longest common runs, recursively: the matching blocks that difference tools show, and (ends of both, 0). Not a minimal edit.

    The longest common run (the first in ``a`` of equals, then in ``b``) is a block; so are those of what lies before it in both, and after
    it. Blocks that touch in both are one."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a_low, a_high, b_low, b_high = open_.pop()
        if a_low == a_high or b_low == b_high:
            continue
        i, j, n = _Runs(b, b_low, b_high).longest(a, a_low, a_high)
        if n:
            found.append((i, j, n))
            open_ += [(a_low, i, b_low, j), (i + n, a_high, j + n, b_high)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return [*out, (len(a), len(b), 0)]


def changed_runs(a, b) -> list[tuple[str, int, int, int, int]]:
    """(kind, from, to in a, from, to in b) of what lies between the blocks: replace, delete or insert."""
    i = j = 0
    out = []
    for x, y, n in blocks(a, b):
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + n, y + n
    return out


@vector("array<struct<place:int,ref:string,hyp:string>>")
def charged_pairs_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Words of both sides of what lies between the blocks, in pairs as far as they go; ``place`` is that in the reference."""
    out = []
    for a, b in _pairs((ref, hyp)):
        rows = []
        for _, i, i2, j, j2 in changed_runs(a, b):
            for k in range(max(i2 - i, j2 - j)):
                rows.append({"place": i if i == i2 else i + k, "ref": a[i + k] if i + k < i2 else None, "hyp": b[j + k] if j + k < j2 else None})
        out.append(rows)
    return pd.Series(out)


#: Letters of either side that a signature shows.
SHOWN = 24


def edit_signature(before: list[str], after: list[str]) -> tuple[str, str]:
    """(operation, change) of an edit: its one kind of run, mixed or equal; and the first replacement, else the first run, cut to SHOWN letters a side."""
    runs = changed_runs(before, after)
    kinds = {k for k, *_ in runs}
    said = lambda words, low, high: " ".join(words[low:high])[:SHOWN]
    shown = next((x for x in runs if x[0] == "replace"), runs[0] if runs else None)
    if shown is None:
        return "equal", ""
    kind, i, i2, j, j2 = shown
    text = {"replace": f"{said(before, i, i2)}->{said(after, j, j2)}", "delete": f"-{said(before, i, i2)}", "insert": f"+{said(after, j, j2)}"}[kind]
    return kinds.pop() if len(kinds) == 1 else "mixed", text


@vector("struct<operation:string,change:string>")
def edit_signature_udf(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_signature(x, y) for x, y in _pairs((before, after))], columns=["operation", "change"])


def signatures(before: Column, after: Column, category: Column) -> Column:
    """struct(category, operation, change): a category alone, with the operation and with the change, by which edits are told apart."""
    known = edit_signature_udf(before, after)
    return F.struct(category.alias("category"), F.concat_ws(":", category, known["operation"]).alias("operation"), F.concat_ws(":", category, known["change"]).alias("change"))


@vector("double")
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matched / total over matching blocks of characters; 1 for two empty texts."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        total = len(x) + len(y)
        out.append(2 * sum(k for _, _, k in blocks(x, y)) / total if total else 1.0)
    return pd.Series(out)


def _lcs(x: str, y: str) -> int:
    """Longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


@vector("double")
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - (insertions + deletions) / total: twice the longest common subsequence over the lengths. Not a Levenshtein ratio."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        total = len(x) + len(y)
        out.append(2 * _lcs(x, y) / total if total else 1.0)
    return pd.Series(out)


@vector("double")
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ``indel_ratio`` of the shorter text with any window of its length, or a shorter one at an end, of the longer."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if not x:
            out.append(float(not y))
            continue
        n, m, best = len(x), len(y), 0.0
        for at in range(1 - n, m):
            part = y[max(0, at) : at + n]
            best = max(best, 2 * _lcs(x, part) / (n + len(part)))
            if best == 1:
                break
        out.append(best)
    return pd.Series(out)


@vector("int")
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which neighbouring letters may be swapped once (optimal string alignment)."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        before, now = None, list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            after = [i]
            for j, d in enumerate(y, 1):
                low = min(now[j] + 1, after[j - 1] + 1, now[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    low = min(low, before[j - 2] + 1)
                after.append(low)
            before, now = now, after
        out.append(now[-1])
    return pd.Series(out)


# Which of the three streams a column takes a token of, in the order ties are broken.
_MOVES = ((1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1))
_FAR = np.int64(1) << 60


class _Layers:
    """Cheapest ways to the cells (i, j, s - i - j) of a three-way alignment, layer s by layer: all cells of a layer depend on the three before.

    Cells keep within ``band`` of the mean diagonal, so a layer is a square of some 4 * band cells a side, whose corner moves
    along with s. A way's value is (sum of pair costs, columns) in one number."""

    def __init__(self, streams: list[np.ndarray], band: int):
        self.streams, self.band = streams, band
        self.size = min(4 * band + 3, max(map(len, streams)) + 1)
        self.layers: list[tuple[tuple[int, int], np.ndarray]] = []
        self.moves: list[np.ndarray] = []

    def corner(self, s: int) -> tuple[int, int]:
        low = max(0, s // 3 - 2 * self.band - 1)
        return tuple(min(low, max(0, len(x) + 1 - self.size)) for x in self.streams[:2])

    def _before(self, back: int, at: tuple[int, int], move: tuple[int, int, int], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if back > len(self.layers):
            return np.full(i.shape, _FAR)
        corner, values = self.layers[-back]
        x, y = i - move[0] - corner[0], j - move[1] - corner[1]
        inside = (x >= 0) & (x < self.size) & (y >= 0) & (y < self.size)
        return np.where(inside, values[np.where(inside, x, 0), np.where(inside, y, 0)], _FAR)

    def run(self) -> None:
        a, b, c = self.streams
        for s in range(len(a) + len(b) + len(c) + 1):
            at = self.corner(s)
            i, j = np.meshgrid(np.arange(at[0], at[0] + self.size), np.arange(at[1], at[1] + self.size), indexing="ij")
            k = s - i - j
            cell = (i <= len(a)) & (j <= len(b)) & (k >= 0) & (k <= len(c)) & (np.abs(i - j) <= self.band) & (np.abs(i - k) <= self.band) & (np.abs(j - k) <= self.band)
            token = [np.where((n > 0) & (n <= len(x)), np.append(x, -1)[np.clip(n - 1, 0, len(x))], -1) for x, n in ((a, i), (b, j), (c, k))]
            values, moves = np.full(i.shape, _FAR), np.full(i.shape, -1, np.int8)
            if s == 0:
                values[(i == 0) & (j == 0)] = 0
            for number, move in enumerate(_MOVES if s else ()):
                taken = [np.where(bool(m), t, -2) for m, t in zip(move, token, strict=True)]
                cost = sum((taken[x] != taken[y]).astype(np.int64) for x, y in ((0, 1), (0, 2), (1, 2)))
                value = self._before(sum(move), at, move, i, j) + (cost << 20) + 1
                value = np.where((i >= move[0]) & (j >= move[1]) & (k >= move[2]), value, _FAR)
                better = cell & (value < values) & (value < _FAR)
                values, moves = np.where(better, value, values), np.where(better, number, moves).astype(np.int8)
            self.layers = [*self.layers[-2:], (at, values)]
            self.moves.append(moves)

    def way(self) -> tuple[list[tuple[int, int, int]], bool]:
        """The moves of the cheapest way, and whether it is whole and keeps off the band's edge."""
        at, out, free = [len(x) for x in self.streams], [], True
        while any(at):
            corner = self.corner(sum(at))
            x, y = at[0] - corner[0], at[1] - corner[1]
            number = self.moves[sum(at)][x, y] if 0 <= x < self.size and 0 <= y < self.size else -1
            if number < 0:
                return [], False
            free = free and max(at) - min(at) < self.band
            out.append(_MOVES[number])
            at = [n - m for n, m in zip(at, _MOVES[number], strict=True)]
        return out[::-1], free


def align_three(a: list[str], b: list[str], c: list[str], band: int = 40) -> list[list[str | None]]:
    """Columns (null is a gap) of least sum of pair costs, then fewest columns, then by the order of moves.

    A way that touches the edge of its band may not be the cheapest: the band is widened then, until it holds all cells."""
    words = {t: n for n, t in enumerate(dict.fromkeys([*a, *b, *c]))}
    streams = [np.array([words[t] for t in x], np.int64) for x in (a, b, c)]
    while True:
        layers = _Layers(streams, band)
        layers.run()
        moves, free = layers.way()
        if (free or band > max(map(len, streams))) and (moves or not any(map(len, streams))):
            break
        band *= 2
    rest = [iter(x) for x in (a, b, c)]
    return [[next(r) if m else None for m, r in zip(move, rest, strict=True)] for move in moves]


@vector("array<array<string>>")
def align_three_udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([align_three(*row) for row in _pairs((a, b, c))])


def between_anchors(streams: list[list[str]], anchors: list[tuple[int, ...]], whole: Callable = align_three) -> list[list[str | None]]:
    """Columns of three streams that are known to meet at ``anchors`` (their places, rising): a column for each, and what lies between aligned on its own."""
    edges = [(-1,) * 3, *anchors, tuple(map(len, streams))]
    out: list[list[str | None]] = []
    for before, after in zip(edges[:-1], edges[1:], strict=True):
        out += whole(*(x[p + 1 : q] for x, p, q in zip(streams, before, after, strict=True)))
        if after is not edges[-1]:
            out.append([x[q] for x, q in zip(streams, after, strict=True)])
    return out


@vector("string")
def letter_vote(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """The word that three spellings vote for letter by letter, aligned exactly; ties go to the first."""
    out = []
    for row in zip(a.fillna(""), b.fillna(""), c.fillna(""), strict=True):
        word = ""
        for x in align_three(*map(list, row)):
            present = [t for t in x if t is not None]
            if len(present) > 1:
                word += max(present, key=lambda t: (present.count(t), t == x[0], -present.index(t)))
        out.append(word)
    return pd.Series(out)


def _through(before: np.ndarray, hyp: list[int], ref: np.ndarray) -> np.ndarray:
    """Edit costs to each prefix of ``ref`` after further hypothesis tokens, from those before them."""
    steps = np.arange(len(before))
    for t in hyp:
        row = np.minimum(before + 1, np.concatenate([[before[0] + 1], before[:-1] + (ref != t)]))
        before = np.minimum.accumulate(row - steps) + steps
    return before


def nbest_errors(chunks: list[list[list[str]]], ref: list[str]) -> int:
    """Least edit distance to the reference of any text made of one hypothesis from each chunk's list, in order.

    Costs to all prefixes pass through every hypothesis of a chunk, and the least of each goes on: no combination is spelled out."""
    codes: dict[str, int] = {}
    number = lambda ts: [codes.setdefault(t, len(codes)) for t in ts]
    goal = np.array(number(ref), np.int64)
    cost = np.arange(len(goal) + 1)
    for hypotheses in chunks:
        if hypotheses:
            cost = np.min([_through(cost, number(h), goal) for h in hypotheses], axis=0)
    return int(cost[-1])


@vector("int")
def nbest_errors_udf(chunks: pd.Series, ref: pd.Series) -> pd.Series:
    """Arrays (chunks) of arrays (hypotheses) of tokens."""
    return pd.Series([nbest_errors([[list(h) for h in c] for c in cs], list(r)) for cs, r in zip(chunks, ref, strict=True)])


def progressive(streams: list[list[str]], order: tuple[int, ...]) -> list[list[str | None]]:
    """Columns built around the first stream of ``order``: each next one is aligned with the columns' words so far."""
    columns = [[None] * len(streams) for _ in streams[order[0]]]
    for column, token in zip(columns, streams[order[0]], strict=True):
        column[order[0]] = token
    for s in order[1:]:
        heads = [next(c[o] for o in order if c[o] is not None) for c in columns]
        merged = []
        for op, i, j in align(heads, streams[s]):
            column = columns[i] if op != "I" else [None] * len(streams)
            if op != "D":
                column[s] = streams[s][j]
            merged.append(column)
        columns = merged
    return columns


@vector("array<array<string>>")
def progressive_udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([progressive(list(row), (0, 1, 2)) for row in _pairs((a, b, c))])


def vote(column: Column, pivot: Column | int, priority: tuple[int, ...] = (0, 1, 2)) -> Column:
    """struct(token, reason) of an aligned column of three (null is a gap).

    A word needs two streams; then the most frequent one wins, ties go to the pivot's, else to the first
    stream in order of priority that has one of the tied words."""
    pivot = F.lit(pivot) if isinstance(pivot, int) else pivot
    words = F.array_compact(column)
    kinds = F.size(F.array_distinct(words))
    entry = lambda i: F.get(column, F.lit(i))
    pair = F.when(entry(0) == entry(1), entry(0)).when(entry(0) == entry(2), entry(0)).when(entry(1) == entry(2), entry(1))
    of_pivot = F.get(column, pivot)
    first = F.coalesce(*(entry(p) for p in priority))
    none = F.struct(F.lit(None).cast("string").alias("token"), F.lit("epsilon").alias("reason"))
    said = lambda token, reason: F.struct(token.alias("token"), F.lit(reason).alias("reason"))
    return (
        F.when(F.size(words) < 2, none)
        .when((F.size(words) == 3) & (kinds == 1), said(entry(0), "unanimous"))
        .when(pair.isNotNull(), said(pair, "majority"))
        .when(of_pivot.isNotNull(), said(of_pivot, "tie_pivot"))
        .otherwise(said(first, "tie_priority"))
    )


def compose(columns: Column, pivot: Column | int, priority: tuple[int, ...] = (0, 1, 2)) -> Column:
    """The voted words of all columns."""
    return F.array_compact(F.transform(columns, lambda c: vote(c, pivot, priority)["token"]))


def columns_cost(columns: Column) -> Column:
    """Sum over columns of the pairs that differ."""
    pair = lambda x, y: (~x.eqNullSafe(y)).cast("long")
    of = lambda c: pair(F.get(c, F.lit(0)), F.get(c, F.lit(1))) + pair(F.get(c, F.lit(0)), F.get(c, F.lit(2))) + pair(F.get(c, F.lit(1)), F.get(c, F.lit(2)))
    return F.aggregate(columns, F.lit(0).cast("long"), lambda acc, c: acc + of(c))


def _options(column: list[str | None]) -> list[str | None]:
    """The different entries of a column in order, a gap first."""
    return ([None] if None in column else []) + list(dict.fromkeys(x for x in column if x is not None))


def _lattice(options: list[list[str | None]], ref: list[str]) -> Rows:
    """Edit distances of the first j reference words from what the first i columns can say, the best of all choices."""
    steps = np.arange(len(ref) + 1, dtype=np.int32)
    known = {w: k for k, w in enumerate(dict.fromkeys(ref))}
    codes = np.array([known[w] for w in ref], np.int64)

    def step(i: int, row: np.ndarray) -> np.ndarray:
        words = options[i - 1]
        gap, said = None in words, [known[w] for w in words if w in known]
        new = row + (0 if gap else 1)
        if len(words) > gap:  # a word stands for a reference word, or for none
            hit = np.isin(codes, said) if said else np.zeros(len(codes), bool)
            new[1:] = np.minimum(new[1:], row[:-1] + ~hit)
        return np.minimum.accumulate(new - steps) + steps

    return Rows(len(options), steps, step)


def best_choice(columns: list[list[str | None]], ref: list[str]) -> list[str | None]:
    """For each column the entry, or a gap where it has one, that together come closest to the reference.

    Ways back are tried in this order: a reference word that no column says, then the entries in order, each as a reference word before as
    none."""
    options = [_options(c) for c in columns]
    cost = _lattice(options, ref)
    out: list[str | None] = [None] * len(columns)
    i, j = len(columns), len(ref)
    here = cost[i]
    while i or j:
        if j and here[j] == here[j - 1] + 1:
            j -= 1
            continue
        above = cost[i - 1]
        for word in options[i - 1]:
            if word is None:
                if here[j] == above[j]:
                    break
            elif j and here[j] == above[j - 1] + (word != ref[j - 1]):
                out[i - 1], j = word, j - 1
                break
            elif here[j] == above[j] + 1:
                out[i - 1] = word
                break
        i, here = i - 1, above
    return out


def lattice_support(columns: list[list[str | None]], ref: list[str]) -> tuple[int, list[list[dict]]]:
    """The least distance of all choices from the reference, and for each entry of each column where it lies on a best way:
    ``exact`` and ``sub`` (reference places that it says, or stands for wrongly), ``extra`` (it stands for none) and ``any``.

    Distances from the start meet distances to the end, of which some rows are held at a time. A gap is on a best way where it costs
    nothing, which shows in ``any`` alone."""
    options = [_options(c) for c in columns]
    n, m = len(columns), len(ref)
    onward = _lattice(options[::-1], ref[::-1])  # row n - i: what is left after i columns
    forward = _lattice(options, ref)
    best, out = int(forward[n][m]), []
    for i in range(n, 0, -1):
        before, after = forward[i - 1], None
        after = onward[n - i][::-1]
        rows = []
        for word in options[i - 1]:
            if word is None:
                rows.append({"entry": None, "exact": [], "sub": [], "extra": False, "any": bool((before + after == best).any())})
                continue
            same = np.array([w == word for w in ref], bool)
            says = before[:-1] + after[1:] + ~same == best
            extra = bool((before + 1 + after == best).any())
            rows.append({"entry": word, "exact": np.flatnonzero(says & same).tolist(), "sub": np.flatnonzero(says & ~same).tolist(), "extra": extra, "any": bool(says.any()) or extra})
        out.append(rows)
    return best, out[::-1]


@vector("struct<distance:int,columns:array<array<struct<entry:string,exact:array<int>,sub:array<int>,extra:boolean,any:boolean>>>>")
def lattice_support_udf(columns: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lattice_support([list(c) for c in cs], list(r)) for cs, r in _pairs((columns, ref))], columns=["distance", "columns"])


@vector("array<string>")
def best_choice_udf(columns: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([best_choice([list(c) for c in cs], list(r)) for cs, r in _pairs((columns, ref))])


@vector("int")
def consensus(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """The stream that is most like the other two by matching blocks of words; the first on a tie."""
    out = []
    for row in _pairs((a, b, c)):
        like = [[2 * sum(k for _, _, k in blocks(x, y)) / (len(x) + len(y) or 1) for y in row] for x in row]
        out.append(int(np.argmax([sum(x) - x[i] for i, x in enumerate(like)])))
    return pd.Series(out)


def transfer_times(tokens: list[str], timed: list[str], times: list[float], end: float) -> list[float]:
    """Times for ``tokens`` from a timed stream: shared words are anchors; between them linear, outside at the mean rate."""
    known = {i: times[j] for op, i, j in align(tokens, timed) if op == "M"}
    rate = end / max(1, len(tokens))
    if not known:
        return [i * rate for i in range(len(tokens))]
    at = sorted(known)
    inner = np.interp(range(len(tokens)), at, [known[i] for i in at])
    return [float(known[at[0]] - (at[0] - i) * rate if i < at[0] else known[at[-1]] + (i - at[-1]) * rate if i > at[-1] else inner[i]) for i in range(len(tokens))]


@vector("array<double>")
def transfer_times_udf(tokens: pd.Series, timed: pd.Series, times: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([transfer_times(list(t), list(w), list(s), float(e)) for t, w, s, e in zip(tokens, timed, times, end, strict=True)])


# Shortest and longest phrase, and the copies in a row from which it counts as a loop.
_LOOPS = ((1, 4, 6), (5, 11, 3), (12, 10**9, 2))


@vector("int")
def tandem_excess(words: pd.Series) -> pd.Series:
    """Words beyond the first copy where a phrase follows itself often enough, over all phrase lengths together."""
    out = []
    for (tokens,) in _pairs((words,)):
        codes = pd.factorize(np.array(tokens, object))[0] if tokens else np.zeros(0, np.int64)
        marked = np.zeros(len(codes), bool)
        for low, high, copies in _LOOPS:
            for size in range(low, min(high, len(codes) // copies) + 1):
                same = np.concatenate([[False], codes[size:] == codes[:-size], [False]]).astype(np.int8)
                step = np.diff(same)
                for start, end in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                    times = (end - start) // size + 1
                    if times >= copies:
                        marked[start + size : start + times * size] = True
        out.append(int(marked.sum()))
    return pd.Series(out)


def transfer_marks(plain: list[str], marked: list[str]) -> list[str]:
    """Words of ``plain`` in the case and with the punctuation of the words of ``marked`` that match them; the words stay."""
    import re

    bare = [re.sub(r"[^\w]+", "", w).lower() for w in marked]
    out = list(plain)
    for op, i, j in align([w.lower() for w in plain], bare):
        if op == "M":
            out[i] = marked[j]
    return out


@vector("array<string>")
def transfer_marks_udf(plain: pd.Series, marked: pd.Series) -> pd.Series:
    return pd.Series([transfer_marks(*row) for row in _pairs((plain, marked))])
