"""Matching that depends on order or on a whole assignment: speakers, terms, fuzzy correction, cuts, choices with ceilings."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import _codes, align, distances, vector

# --- speakers ------------------------------------------------------------------------------------------------------

def _within(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def _squared_miss(own: Column, word: Column) -> Column:
    """How far a speaker's segment misses a word: squares of both ends' distances, nothing where it holds the word.

    Of ``own`` segments in order the last one that holds the word opens the choice (else the first), and of that and
    the later ones the one whose ends are nearest in sum is taken, the earliest of equals."""
    holding = F.array_max(F.transform(own, lambda s, i: F.when(_within(s, word), i).otherwise(0)))
    near = F.transform(own, lambda s, i: F.when(i >= holding, F.struct((F.abs(s["start"] - word["start"]) + F.abs(s["end"] - word["end"])).alias("gap"), i.alias("i"))))
    best = F.get(own, F.array_min(F.array_compact(near))["i"])
    return F.when(_within(best, word), 0.0).otherwise(F.pow(best["start"] - word["start"], F.lit(2)) + F.pow(best["end"] - word["end"], F.lit(2)))


def best_speaker(segments: Column, start: Column, end: Column, words: Column, most: float = math.inf) -> Column:
    """struct(speaker, drift, branch) of an utterance; ``segments``: array of struct(speaker, start, end), ``words``: of struct(start, end).

    direct: one segment alone touches the utterance. Else the speakers count who have a segment that holds one of its words, by the
    root of their summed misses over all words: single if there is one of them, guess if it is the nearest of several (the
    one met first on a tie), drop if there is none or the nearest drifts beyond ``most``."""
    touching = F.filter(segments, lambda s: s["start"].between(start, end) | s["end"].between(start, end) | _within(s, F.struct(start.alias("start"), end.alias("end"))))
    holders = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.filter(segments, lambda s: _within(s, w)), lambda s: s["speaker"]))))

    def drift(name: Column, i: Column) -> Column:
        own = F.filter(segments, lambda s: s["speaker"] == name)
        return F.struct(F.sqrt(F.aggregate(F.transform(words, lambda w: _squared_miss(own, w)), F.lit(0.0), lambda acc, x: acc + x)).alias("drift"), i.alias("i"), name.alias("speaker"))

    said = lambda speaker, far, branch: F.struct(speaker.cast("string").alias("speaker"), far.cast("double").alias("drift"), branch.alias("branch"))
    none = said(F.lit(None), F.lit(None), F.lit("drop"))
    near = F.array_min(F.transform(holders, drift))
    alone = F.size(holders) == 1
    return (
        F.when(F.size(touching) == 1, said(F.get(touching, F.lit(0))["speaker"], F.lit(0.0), F.lit("direct")))
        .when(F.size(holders) == 0, none)
        .when(alone | (near["drift"] <= most), said(near["speaker"], near["drift"], F.when(alone, "single").otherwise("guess")))
        .otherwise(none)
    )


def assignment(cost: list[list[int]]) -> list[int]:
    """The column of each row in a cheapest one-to-one assignment of a square table: rows enter one after the other, each along a cheapest
    way of changes (with prices that keep all costs non-negative), so that n rows take the cube of n steps."""
    n = len(cost)
    table = np.asarray(cost, dtype=float).reshape(n, n)
    row_price, column_price = np.zeros(n), np.zeros(n + 1)
    held = np.full(n + 1, -1)  # the row of each column; the column n stands for the row that enters
    for entering in range(n):
        held[n] = entering
        at, far, came = n, np.full(n, np.inf), np.full(n, n)
        done = np.zeros(n + 1, bool)
        while held[at] >= 0:
            done[at] = True
            row = held[at]
            open_ = ~done[:n]
            way = table[row] - row_price[row] - column_price[:n]
            nearer = open_ & (way < far)
            far[nearer], came[nearer] = way[nearer], at
            nearest = int(np.argmin(np.where(open_, far, np.inf)))
            step = far[nearest]
            row_price[held[done]] += step
            column_price[done] -= step
            far[open_] -= step
            at = nearest
        while at != n:
            held[at], at = held[came[at]], came[at]
    out = [0] * n
    for j in range(n):
        out[held[j]] = j
    return out


def speaker_errors(ref: dict[str, list[str]], hyp: dict[str, list[str]]) -> tuple[int, int, dict[str, str]]:
    """(errors, reference words, speaker map) under the best one-to-one assignment of speakers; missing ones are empty."""
    r, h = sorted(ref), sorted(hyp)
    k = max(len(r), len(h))
    table = [[sum(o != "M" for o, _, _ in align(ref[r[i]] if i < len(r) else [], hyp[h[j]] if j < len(h) else [])) for j in range(k)] for i in range(k)]
    picks = assignment(table)
    return sum(table[i][j] for i, j in enumerate(picks)), sum(map(len, ref.values())), {r[i]: h[j] for i, j in enumerate(picks) if i < len(r) and j < len(h)}


@vector("struct<errors:int,n:int>")
def speaker_errors_udf(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Maps speaker -> tokens."""
    return pd.DataFrame([speaker_errors({k: list(v) for k, v in dict(a).items()}, {k: list(v) for k, v in dict(b).items()})[:2] for a, b in zip(ref, hyp, strict=True)], columns=["errors", "n"])


def supported(units: list[tuple[str, float]], gold: list[tuple[str, float]], tolerance: float) -> int:
    """The largest one-to-one matching of equal words whose times differ by ``tolerance`` at most."""
    free: dict[int, int] = {}
    near = [[j for j, (w, t) in enumerate(gold) if w == word and abs(t - at) <= tolerance] for word, at in units]

    def grow(i: int, seen: set[int]) -> bool:
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in free or grow(free[j], seen):
                    free[j] = i
                    return True
        return False

    return sum(grow(i, set()) for i in range(len(units)))


# --- alignments in all their optimal forms -------------------------------------------------------------------------

def certain_pairs(a: list[str], b: list[str]) -> list[int | None]:
    """For each token of ``a`` its partner in ``b`` if every cheapest alignment has that one, else None.

    Distances from the start meet distances to the end; both are read from the last token to the first, the latter row by row as
    it is made."""
    x, y = _codes(a, b)
    before = distances(x, y)
    steps = np.arange(len(y) + 1, dtype=np.int32)
    best, out, after = before[len(x)][-1], [], steps[::-1]
    for i in range(len(x) - 1, -1, -1):
        row = before[i]
        partners = np.flatnonzero(row[:-1] + (y != x[i]) + after[1:] == best)
        alone = (row + 1 + after == best).any()
        out.append(int(partners[0]) if len(partners) == 1 and not alone else None)
        new = after + 1
        new[:-1] = np.minimum(new[:-1], after[1:] + (y != x[i]))
        after = (np.minimum.accumulate((new - steps[::-1])[::-1]) + steps)[::-1]
    return out[::-1]


@vector("array<int>")
def certain_pairs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([certain_pairs(list(x), list(y)) for x, y in zip(a, b, strict=True)])


# --- terms ---------------------------------------------------------------------------------------------------------

def tag_terms(tokens: list[str], terms: dict[tuple[str, ...], str]) -> list[str]:
    """Tokens with each longest leftmost term as one symbol."""
    longest, out, i = max(map(len, terms), default=0), [], 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 0, -1):
            if (name := terms.get(tuple(tokens[i : i + n]))) is not None:
                out.append(f"<{name}>")
                i += n
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def term_errors(terms: dict[str, list[str]]) -> Callable[..., Column]:
    """A column function (ref tokens, hyp tokens) -> struct(s, d, i, n) over the places of terms; ``terms``: id -> spellings."""
    table = {tuple(alias.split(" ")): name for name, aliases in terms.items() for alias in aliases}

    @vector("struct<s:int,d:int,i:int,n:int>")
    def count(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(ref, hyp, strict=True):
            a, b = tag_terms(list(r), table), tag_terms(list(h), table)
            ops = align(a, b)
            is_term = lambda t: t.startswith("<")
            n = sum(map(is_term, a))
            rows.append((sum(o == "S" and is_term(a[i]) for o, i, _ in ops), sum(o == "D" and is_term(a[i]) for o, i, _ in ops), sum(o == "I" and is_term(b[j]) for o, _, j in ops), n))
        return pd.DataFrame(rows, columns=list("sdin"))

    return count


def merge_lanes(lanes: dict[str, DataFrame], key: str, count: str, meeting: str) -> DataFrame:
    """One row per key over several sources: total, distinct meetings, and the count of each source."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b), [df.select(key, count, meeting, F.lit(name).alias("lane")) for name, df in lanes.items()])
    return both.groupBy(key).agg(F.sum(count).alias("total"), F.count_distinct(meeting).alias("meetings"), *(F.sum(F.when(F.col("lane") == n, F.col(count)).otherwise(0)).alias(n) for n in lanes))


def fuzzy_correct(corrections: DataFrame, texts: DataFrame, key: str, tokens: str, margin: int = 1) -> DataFrame:
    """Token arrays with each token replaced by its nearest term (``language.fuzzy_nearest``: token, term, distance, second).

    A token of fewer than 4 letters keeps its form, one of up to 5 may change by one edit, of up to 9 by two, a longer one by
    three (fixed values); the second nearest term must be ``margin`` further off."""
    limit = F.when(F.length("token") < 4, 0).when(F.length("token") <= 5, 1).when(F.length("token") <= 9, 2).otherwise(3)
    good = corrections.filter((F.col("distance") > 0) & (F.col("distance") <= limit) & (F.coalesce("second", F.lit(99)) - F.col("distance") >= margin)).select("token", "term")
    rows = texts.select(key, F.posexplode(tokens).alias("pos", "token")).join(good, "token", "left").withColumn("token", F.coalesce("term", "token"))
    fixed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("_fixed"))
    return texts.join(fixed, key, "left").withColumn(tokens, F.coalesce("_fixed", tokens)).drop("_fixed")


def everyone_named(tokens: Column, people: Column) -> Column:
    """Whether one person's name tokens have a near match (one edit) for every token."""
    return F.exists(people, lambda p: F.forall(tokens, lambda t: F.exists(p["tokens"], lambda n: F.levenshtein(t, n, 1) >= 0)))


# --- cuts ----------------------------------------------------------------------------------------------------------

def cut_accumulating(duration: Column, silences: Column, most: float = 29.5, least: float = 5.0, speech: float = 2.5, silence: float = 0.5) -> Column:
    """Pieces, array of struct(start, end), that tile 0..``duration``; ``silences``: array of struct(start, end), disjoint or not.

    While more than ``most`` is left, the next cut is the last candidate in reach: the middle of a silence of ``silence`` or more
    which leaves a piece of ``least`` at least with ``speech`` in it; without one, of any speech; without a silence in reach, the
    limit itself. A last piece that is too short is joined to the one before where both fit the limit, else their common cut
    moves to the candidate nearest the middle of where both keep their lengths, or to that middle."""
    middles = F.transform(F.filter(silences, lambda s: s["end"] - s["start"] >= silence), lambda s: (s["start"] + s["end"]) / 2)
    quiet = lambda a, b: F.aggregate(F.transform(silences, lambda s: F.greatest(F.lit(0.0), F.least(b, s["end"]) - F.greatest(a, s["start"]))), F.lit(0.0), lambda acc, x: acc + x)

    def next_cut(at: Column) -> Column:
        reach = F.filter(middles, lambda c: c.between(at + least, at + most))
        return F.coalesce(F.array_max(F.filter(reach, lambda c: c - at - quiet(at, c) >= speech)), F.array_max(reach), at + most)

    steps = F.sequence(F.lit(0), F.ceil(duration / least).cast("int"))
    open_ = lambda edges: duration - F.element_at(edges, -1) > most + 1e-7
    edges = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, _: F.when(open_(acc), F.concat(acc, F.array(next_cut(F.element_at(acc, -1))))).otherwise(acc))

    def repaired(e: Column) -> Column:
        n, last = F.size(e), F.element_at(e, -1)
        before = F.get(e, n - 2)
        low, high = F.greatest(before + least, duration - most), F.least(before + most, duration - least)
        centre = (low + high) / 2
        moved = F.array_min(F.transform(F.filter(middles, lambda c: c.between(low, high)), lambda c, i: F.struct(F.abs(c - centre).alias("far"), i.alias("i"), c.alias("c"))))["c"]
        short = (n > 1) & (duration - last < least)
        return F.when(short & (duration - before <= most), F.slice(e, F.lit(1), n - 1)).when(short & (low <= high), F.concat(F.slice(e, F.lit(1), n - 1), F.array(F.coalesce(moved, centre)))).otherwise(e)

    cuts = F.get(F.transform(F.array(edges), repaired), F.lit(0))
    pieces = lambda e: F.transform(e, lambda x, i: F.struct(x.alias("start"), F.coalesce(F.get(e, i + 1), duration).alias("end")))
    return F.get(F.transform(F.array(cuts), pieces), F.lit(0))


def cut_longest(duration: Column, silences: Column, most: float = 30.0, preferred: float = 5.0, least: float = 0.5, whole: bool = True) -> Column:
    """Pieces, array of struct(start, end), that tile 0..``duration``, each cut within the longest silence in reach.

    While more than ``most`` is left: of the silences that begin within reach after the last cut those of ``preferred``
    seconds count, else those of ``least``; the longest is taken, the earliest of equals, and cut in its middle, at the limit at
    latest. A silence serves one cut: halving what is left of it again and again would give pieces without
    speech. Without a silence the rest stays ``whole``, or the piece ends at the limit."""

    def inside(s: Column, at: Column, limit: Column) -> Column:
        cut = F.least((s["start"] + s["end"]) / 2, limit)
        good = (s["start"] >= at) & (s["start"] <= limit) & (cut > at)
        return F.when(good, F.struct(F.round(s["end"] - s["start"], 6).alias("long"), (-s["start"]).alias("early"), cut.alias("cut")))  # lengths that differ by rounding alone are equal

    def next_cut(at: Column) -> Column:
        limit = F.least(duration, at + most)
        reach = F.array_compact(F.transform(silences, lambda s: inside(s, at, limit)))
        best = F.coalesce(F.array_max(F.filter(reach, lambda c: c["long"] >= preferred)), F.array_max(F.filter(reach, lambda c: c["long"] >= least)))
        return F.coalesce(best["cut"], duration if whole else limit)

    steps = F.sequence(F.lit(0), (F.size(silences) + F.ceil(duration / most)).cast("int"))  # a cut uses up a silence, or a whole reach
    open_ = lambda e: duration - F.element_at(e, -1) > most + 1e-7
    edges = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, _: F.when(open_(acc), F.concat(acc, F.array(next_cut(F.element_at(acc, -1))))).otherwise(acc))

    def pieces(e: Column) -> Column:
        ends = F.when((duration - F.element_at(e, -1) > 1e-7) | (F.size(e) == 1), F.concat(e, F.array(duration))).otherwise(e)
        return F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end")))

    return F.get(F.transform(F.array(edges), pieces), F.lit(0))


# --- choices -------------------------------------------------------------------------------------------------------

def ceiling_top(rows: DataFrame, key: str, score: str, category: str, features: dict[str, float], k: int, ceilings: dict[str, float], default: float = 0.15) -> DataFrame:
    """The k rows of a greedy choice: score / (1 + 8 * what the category's share exceeds its ceiling by) / sqrt(1 + weight * rows taken with the same value) over the features.

    Shares fall as well as rise, so every step looks at all rows left: on the driver, over ``selection.heads``,
    the only rows that can be taken."""
    from .selection import heads

    few = heads(rows, key, score, list(dict.fromkeys([category, *features])), k)
    base = np.array([r[score] for r in few], float)
    codes = {f: pd.factorize(pd.Series([r[f] for r in few], dtype=object), use_na_sentinel=False)[0] for f in [category, *features]}
    seen = {f: np.zeros(len(few) + 1) for f in codes}
    limit = np.array([ceilings.get(r[category], default) for r in few])
    free, out = np.ones(len(few), bool), []
    while len(out) < min(k, len(few)):
        gain = base / (1 + 8 * np.maximum(0, seen[category][codes[category]] / max(1, len(out)) - limit))
        for f, weight in features.items():
            gain = gain / np.sqrt(1 + weight * seen[f][codes[f]])
        i = int(np.argmax(np.where(free, gain, -np.inf)))
        free[i] = False
        out.append((few[i][key], len(out) + 1))
        for f in codes:
            seen[f][codes[f][i]] += 1
    return rows.sparkSession.createDataFrame(out, f"`{key}` {dict(rows.dtypes)[key]}, final_rank long")


def lcg_interval(values: list[float], draws: int = 2000) -> tuple[float, float]:
    """Percentile interval of the mean over rows resampled by the 31-bit generator x -> 1103515245 x + 12345, started at rows * 2654435761 (fixed values)."""
    m, state, means = len(values), (len(values) * 2654435761) & 0xFFFFFFFF, []
    if not m:
        return 0.0, 0.0
    for _ in range(draws):
        total = 0.0
        for _ in range(m):
            state = (1103515245 * state + 12345) & 0x7FFFFFFF
            total += values[state % m]
        means.append(total / m)
    means.sort()
    return round(means[int(0.025 * draws)], 4), round(means[int(0.975 * draws)], 4)
