"""Fuzzy joins that lose no pair: words by indel ratio, phrases within texts, names by edits with swaps, the worst collision of a term.

Two strings that few edits part share a piece unchanged: of more even segments than there are edits one
at least survives, and edits move it by few letters. So strings meet by an equality join on segments,
with their lengths in the key, and the exact likeness is worked out for those that met. Names meet by what
a few deletions leave of them, block by block. A
ratio is twice the longest common subsequence over both lengths, times 100.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut

from .alignment import _lcs, vector

# --- keys ----------------------------------------------------------------------------------------------------------


def _indels(n: str, m: str, cutoff: int) -> str:
    """SQL: the insertions and deletions that lengths n and m may need at a ratio of ``cutoff`` or more; as odd or even as the lengths' difference."""
    most = f"cast(floor((100 - {cutoff}) * ({n} + {m}) / 100) as int)"
    return f"({most} - abs({most} - ({n} - {m})) % 2)"


def _lengths(n: str, cutoff: int, near: int | None) -> str:
    """SQL: lengths of what can be as like a string of length n, and differ from it by ``near`` at most."""
    low, high = f"cast(ceil({n} * {cutoff} / {200 - cutoff}) as int)", f"cast(floor({n} * {200 - cutoff} / {cutoff}) as int)"
    if near is not None:
        low, high = f"greatest({low}, {n} - {near})", f"least({high}, {n} + {near})"
    return f"sequence(greatest(1, {low}), {high})"


def _start(n: str, i: str, parts: str) -> str:
    return f"cast(floor({n} * {i} / {parts}) as int)"


def _own_keys(s: str, cutoff: int, near: int | None) -> Column:
    """For each length that can be as like it, the segments of ``s``: one more than edits, or its letters."""
    n = f"length({s})"
    d, parts = _indels(n, "m", cutoff), f"least({_indels(n, 'm', cutoff)} + 1, {n})"
    piece = f"substring({s}, {_start(n, 'i', parts)} + 1, {_start(n, '(i + 1)', parts)} - {_start(n, 'i', parts)})"
    return F.expr(f"flatten(transform({_lengths(n, cutoff, near)}, m -> if({d} < abs({n} - m), array(), transform(sequence(0, {parts} - 1), i -> concat_ws('|', {n}, m, i, {piece})))))")


def _met_keys(s: str, cutoff: int, near: int | None) -> Column:
    """What segments of a string as like it can be in ``s``, for each length, segment and shift; more deletions move it left, insertions right."""
    m = f"length({s})"
    d, parts = _indels("n", m, cutoff), f"least({_indels('n', m, cutoff)} + 1, n)"
    start, end = _start("n", "i", parts), _start("n", "(i + 1)", parts)
    left, right = f"cast(({d} + n - {m}) / 2 as int)", f"cast(({d} - n + {m}) / 2 as int)"
    at = f"if({start} + h < 0 or {end} + h > {m}, null, concat_ws('|', n, {m}, i, substring({s}, {start} + h + 1, {end} - {start})))"
    each = f"flatten(transform(sequence(0, {parts} - 1), i -> transform(sequence(-{left}, {right}), h -> {at})))"
    return F.expr(f"array_distinct(array_compact(flatten(transform({_lengths(m, cutoff, near)}, n -> if({d} < abs(n - {m}), array(), {each})))))")


def _apart(keys: DataFrame) -> DataFrame:
    """A side of a join on exploded keys is sorted, never broadcast: Spark takes it to be as large as what was exploded, and would send hundreds of keys a row through the driver."""
    return keys.hint("merge")


@vector("int")
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings."""
    return pd.Series([_lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def similar(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: int, near: int | None = None) -> DataFrame:
    """All pairs of different strings of ``left[a]`` and ``right[b]`` with a ratio of ``cutoff`` (1 to 100) or more, and lengths that differ by ``near`` at most: a, b, score.

    Equal strings are pairs too. Nulls and empty strings match nothing; rows that repeat count once. No pair is lost, and none is looked
    at that shares no segment at its place."""
    x = left.select(F.col(a).alias("_a")).filter("length(_a) > 0").distinct().withColumn("_key", F.explode(_own_keys("_a", cutoff, near)))
    y = right.select(F.col(b).alias("_b")).filter("length(_b) > 0").distinct().withColumn("_key", F.explode(_met_keys("_b", cutoff, near)))
    met = _apart(x).join(_apart(y), "_key").select("_a", "_b").distinct().withColumn("_l", lcs_length("_a", "_b"))
    total = F.length("_a") + F.length("_b")
    return met.filter(200 * F.col("_l") >= cutoff * total).select(F.col("_a").alias(a), F.col("_b").alias(b), (200.0 * F.col("_l") / total).alias("score"))


# --- phrases within texts ------------------------------------------------------------------------------------------


def _best_window(needle: str, text: str, starts: list[int], edits: int) -> float:
    """The best ratio of ``needle`` with a window of its length (cut at the text's ends) that begins within ``edits`` of one of ``starts``."""
    n, best, seen = len(needle), 0.0, set()
    for s in starts:
        seen.update(range(s - edits, s + edits + 1))
    for s in seen:
        window = text[max(0, s) : max(0, s + n)]
        if window:
            best = max(best, 200.0 * _lcs(needle, window) / (n + len(window)))
    return best


@vector("double")
def best_window(needle: pd.Series, text: pd.Series, starts: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([_best_window(p, t, list(s), int(e)) for p, t, s, e in zip(needle, text, starts, edits, strict=True)], dtype="float64")


def _within(needles: DataFrame, texts: DataFrame, cutoff: int) -> DataFrame:
    """(_p, _t, score) of needles (_p) no longer than the text (_t)."""
    n, edits = F.length("_p"), F.floor((100 - cutoff) * 2 * F.length("_p") / 100).cast("int")
    parts = F.least(edits + 1, n)
    segment = lambda i: F.struct((F.floor(n * i / parts)).cast("int").alias("start"), (F.floor(n * (i + 1) / parts) - F.floor(n * i / parts)).cast("int").alias("size"))
    cut_up = needles.select("_p", edits.alias("_e"), F.explode(F.transform(F.sequence(F.lit(0), parts - 1), segment)).alias("_s"))
    cut_up = cut_up.select("_p", "_e", F.col("_s.start").alias("_from"), F.substring("_p", F.col("_s.start") + 1, F.col("_s.size")).alias("_piece"))
    sizes = cut_up.select(F.length("_piece").alias("_size")).distinct()  # a few: they grow with the cutoff, not with the needles
    places = texts.join(F.broadcast(sizes), F.col("_size") <= F.length("_t")).select("_t", "_size", F.explode(F.sequence(F.lit(1), F.length("_t") - F.col("_size") + 1)).alias("_at"))
    grams = places.select("_t", (F.col("_at") - 1).alias("_at"), F.expr("substring(_t, _at, _size)").alias("_piece"))
    met = _apart(cut_up).join(_apart(grams), "_piece").filter(F.length("_p") <= F.length("_t"))
    pairs = met.groupBy("_p", "_t", "_e").agg(F.collect_set(F.col("_at") - F.col("_from")).alias("_starts"))  # places in one text
    return pairs.select("_p", "_t", best_window("_p", "_t", "_starts", "_e").alias("score")).filter(F.col("score") >= cutoff)


def contained(needles: DataFrame, texts: DataFrame, a: str, b: str, cutoff: int) -> DataFrame:
    """All pairs of ``needles[a]`` and ``texts[b]`` whose partial ratio is ``cutoff`` or more: a, b, score.

    The partial ratio is the best one of the shorter string with a window of its length, or a shorter one at an end, of the longer.
    Nulls and empty strings match nothing; rows that repeat count once; windows are tried where a segment of the shorter string
    stands in the longer one, and nowhere else."""
    p = needles.select(F.col(a).alias("_p")).filter("length(_p) > 0").distinct()
    t = texts.select(F.col(b).alias("_t")).filter("length(_t) > 0").distinct()
    usual = _within(p, t, cutoff)
    turned = _within(t.withColumnRenamed("_t", "_p"), p.withColumnRenamed("_p", "_t"), cutoff).filter(F.length("_p") < F.length("_t"))
    return usual.unionByName(turned.select(F.col("_t").alias("_p"), F.col("_p").alias("_t"), "score")).select(F.col("_p").alias(a), F.col("_t").alias(b), "score")


# --- retrieval of terms --------------------------------------------------------------------------------------------


def retrieve(texts: DataFrame, pool: DataFrame, key: str, norm: str, scope: str | None = None, most: int = 20, word_cutoff: int = 88, phrase_cutoff: int = 90, least: int = 4) -> DataFrame:
    """The terms of ``pool`` (term, its ``norm``, and ``scope``, null for all) that a text may mean but misspells: key, rank, term, score.

    A word counts by its best ratio with one of the text's words of ``least`` letters or more, unless the text has it as it is; a phrase by its
    partial ratio with the whole text. Best first, equal ones by term, ``most`` for a text. Texts that repeat a key are taken together; empty
    and null ones retrieve nothing; a term that stands in the pool for all and for the scope counts once."""
    own = [F.col(scope).alias("_scope")] if scope else [F.lit(None).cast("string").alias("_scope")]
    said = texts.select(F.col(key).alias("_id"), F.col(norm).alias("_text"), *own)
    terms = pool.select("term", F.col(norm).alias("_norm"), *own)
    fits = F.col("_for").isNull() | (F.col("_for") == F.col("_scope"))
    is_phrase = F.col("term").contains(" ")
    words = said.select("_id", "_scope", F.explode(F.array_distinct(F.split("_text", " "))).alias("_token")).filter("_token <> ''")
    single = terms.filter(~is_phrase & (F.length("_norm") >= least)).withColumnRenamed("_scope", "_for")
    near = similar(single, words.filter(F.length("_token") >= least), "_norm", "_token", word_cutoff)
    hits = words.join(near, "_token").join(single, "_norm").filter(fits)
    hits = hits.join(words.select("_id", F.col("_token").alias("_norm")).distinct(), ["_id", "_norm"], "left_anti")
    phrases = terms.filter(is_phrase).withColumnRenamed("_scope", "_for")
    within = said.join(contained(phrases, said, "_norm", "_text", phrase_cutoff), "_text").join(phrases, "_norm").filter(fits)
    every = hits.select("_id", "term", "score").unionByName(within.select("_id", "term", "score")).groupBy("_id", "term").agg(F.max("score").alias("score"))
    order = Window.partitionBy("_id").orderBy(F.desc("score"), "term")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(F.col("_id").alias(key), "rank", "term", "score")


# --- worst collisions ----------------------------------------------------------------------------------------------

#: Ratios down to which rounds look, one after the other: a term that has met a form is settled, for all pairs above the ratio have met.
ROUNDS = (90, 80, 70, 60, 45, 30, 15, 1)


#: Terms and forms of a block of each side, and pairs of blocks (some 50 KB each) for a task at most.
TERMS, FORMS, PAIRS = 256, 4096, 64
#: Letters of a term that fit the bits of a long.
_WIDE = 63


def _worst(terms: list[str], forms: list[str], near: int) -> list[dict]:
    """For each term that shares a letter with another form, lengths ``near`` apart at most: the form it is most like (the least of equals) and the ratio.

    The longest common subsequence is that of ``alignment._lcs``, its row held as the bits of a long for all forms at once."""
    forms = sorted(forms, key=len)
    sizes = np.array([len(f) for f in forms])
    short = forms[: int(np.searchsorted(sizes, _WIDE + near, side="right"))]
    letters, codes = np.unique(np.array(short, dtype=str).view(np.uint32).reshape(len(short), -1), return_inverse=True) if short else (np.zeros(0, np.uint32), np.zeros((0, 0), np.int64))
    codes, out = codes.reshape(len(short), -1), []
    for term in terms:
        n = len(term)
        low, high = int(np.searchsorted(sizes, n - near)), int(np.searchsorted(sizes, n + near, side="right"))
        if low == high:
            continue
        if n <= _WIDE:
            places = {c: 0 for c in term}
            for i, c in enumerate(term):
                places[c] |= 1 << i
            masks = np.array([places.get(chr(c), 0) for c in letters], np.uint64)
            row = np.full(high - low, (1 << n) - 1, np.uint64)
            for column in codes[low:high, : sizes[high - 1]].T:
                hit = row & masks[column]
                row = (row + hit) | (row - hit)
            common = n - np.bitwise_count(row & np.uint64((1 << n) - 1)).astype(np.int64)
        else:
            common = np.array([_lcs(term, f) for f in forms[low:high]])
        common[(common == n) & (sizes[low:high] == n)] = 0  # the term itself
        score = 200.0 * common / (n + sizes[low:high])
        best = score.max()
        if best > 0:
            out.append({"term": term, "form": min(forms[low + int(i)] for i in np.flatnonzero(score == best)), "score": float(best)})
    return out


def _nearest(terms: DataFrame, forms: DataFrame, near: int) -> DataFrame:
    """(_term, _form, score) of ``_worst`` over all pairs of blocks of ``terms`` (_term) and ``forms`` (_form), each of distinct words: a task holds one block of either."""
    worst = vector("array<struct<term:string,form:string,score:double>>")(lambda t, f: pd.Series([_worst(list(x), list(y), near) for x, y in zip(t, f, strict=True)], dtype=object))

    def dealt(words: DataFrame, word: str, size: int) -> tuple[DataFrame, int]:
        blocks = -(-words.count() // size) or 1
        return cut(words.groupBy(F.pmod(F.xxhash64(word), F.lit(blocks)).alias("_block")).agg(F.collect_list(word).alias(f"{word}s")).drop("_block")), blocks

    (many, n), (few, k) = dealt(forms, "_form", FORMS), dealt(terms, "_term", TERMS)
    parts = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * k // PAIRS)
    each = many.crossJoin(few).repartition(parts).select(F.explode(worst("_terms", "_forms")).alias("x"))
    best = each.groupBy(F.col("x.term").alias("_term")).agg(F.min(F.struct((-F.col("x.score")).alias("minus"), F.col("x.form").alias("form"))).alias("b"))
    return best.select("_term", F.col("b.form").alias("_form"), (-F.col("b.minus")).alias("score"))


def worst_collision(terms: DataFrame, forms: DataFrame, term: str, form: str, phrases: bool = False, near: int = 3, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """For each term the form other than itself that it is most like: term, form, score (null and 0 without any); the least form of equals.

    Words are compared with forms whose lengths differ by ``near`` at most, by ratio: all of them, block by block, for without a threshold
    most words share some short segment, and a join on these makes hundreds of keys a form in every round. ``phrases`` are compared with all forms, by
    partial ratio, in rounds: each looks at the pairs above a ratio only, for terms that are not settled, so that the join tightens
    where it pays, and the wide last rounds are left to the few terms that are like nothing. Null and empty terms have no row."""
    every = cut(terms.select(F.col(term).alias("_term")).filter("length(_term) > 0").distinct())
    others = cut(forms.select(F.col(form).alias("_form")).filter("length(_form) > 0").distinct())  # made once, not in every round
    if not phrases:
        found = _nearest(every, others, near)
        return every.join(found, "_term", "left").select(F.col("_term").alias(term), F.col("_form").alias(form), F.coalesce("score", F.lit(0.0)).alias("score"))
    open_, found = every, None
    for low in rounds:
        met = contained(open_, others, "_term", "_form", low)
        best = met.filter("_term <> _form").groupBy("_term").agg(F.min(F.struct((-F.col("score")).alias("minus"), "_form")).alias("best"))
        best = cut(best.select("_term", F.col("best._form").alias("_form"), (-F.col("best.minus")).alias("score")))
        found = best if found is None else found.unionByName(best)
        open_ = cut(open_.join(best.select("_term"), "_term", "left_anti"))
        if open_.isEmpty():
            break
    out = every.join(found, "_term", "left")
    return out.select(F.col("_term").alias(term), F.col("_form").alias(form), F.coalesce("score", F.lit(0.0)).alias("score"))


def collision_verdict(score: Column, reject: float, review: float) -> Column:
    return F.when(score >= reject, "reject").when(score >= review, "review").otherwise("clear")


# --- names: edits with swaps ---------------------------------------------------------------------------------------


def swap_distance(a: str, b: str) -> int:
    """Edits between two strings where a swap of neighbouring letters is one edit too, and no letter is edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _swaps_within(a: str, b: str, most: int) -> int:
    """``swap_distance`` if it is ``most`` or less, else a larger number: only cells as near the diagonal are worked out."""
    far, m = most + 1, len(b)
    if abs(len(a) - m) > most:
        return far
    before, last = {}, {j: j for j in range(min(m, most) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(m, i + most) + 1):
            best = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and b[j - 1] == a[i - 2]:
                best = min(best, before.get(j - 2, far) + 1)
            row[j] = best
        before, last = last, row
    return last.get(m, far)


def _swaps_of_pairs(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``_swaps_within`` of the rows of two matrices of letters, all pairs at once."""
    (pairs, n), m, far = a.shape, b.shape[1], most + 1
    none = np.full(pairs, far, np.int16)
    before, last = {}, {j: np.full(pairs, j, np.int16) for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        row = {0: np.full(pairs, i, np.int16)} if i <= most else {}
        for j in range(max(1, i - most), min(m, i + most) + 1):
            best = np.minimum(np.minimum(last.get(j, none), row.get(j - 1, none)) + 1, last.get(j - 1, none) + (a[:, i - 1] != b[:, j - 1]))
            if i > 1 and j > 1:
                swap = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swap, np.minimum(best, before.get(j - 2, none) + 1), best)
            row[j] = best
        before, last = last, row
    return last.get(m, none)


#: Words of a block of either side, pairs of blocks (some 200 KB each) for a task at most, and the letters from which on words meet by pieces instead of by what deletions leave.
NAMES, MEETINGS, LONG = 8192, 16, 25
#: Keys of a slice, and pairs looked at together.
_KEYS, _TRIED = 1 << 18, 1 << 19
_STEP = 0x9E3779B97F4A7C15


@cache
def _left(n: int, gone: int) -> np.ndarray:
    """Which of n letters are left, one row for each way to take ``gone`` away."""
    ways = list(combinations(range(n), n - gone))
    return np.array(ways, np.int64).reshape(len(ways), n - gone)


def _hashes(letters: np.ndarray, gone: int) -> np.ndarray:
    """Of each row of letters the hashes of what is left after ``gone`` deletions, one column for each way to delete."""
    kept = _left(letters.shape[1], gone)
    mixed = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros((len(letters), len(kept)), np.uint64)
    for column in kept.T:
        out = out * np.uint64(_STEP) + mixed[:, column]
    return out


def _by_deletions(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Rows (of x, of y, distance) of all words within ``most`` edits, of two matrices of letters: each edit takes one letter away from either word at most,
    so what is left of the longer one without ``most`` letters is also what is left of the shorter one."""
    n, m = x.shape[1], y.shape[1]
    common = max(0, max(n, m) - most)
    wide, high = len(_left(n, n - common)), len(_left(m, m - common))
    out = []
    for at in range(0, len(x), step := max(1, 4 * _KEYS // wide)):
        keys = _hashes(x[at : at + step], n - common).ravel()
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], at + order // wide
        for to in range(0, len(y), leap := max(1, _KEYS // high)):
            theirs = _hashes(y[to : to + leap], m - common).ravel()
            low = np.searchsorted(keys, theirs)
            times = np.searchsorted(keys, theirs, side="right") - low
            hit = np.flatnonzero(times)
            low, times, whose = low[hit], times[hit], to + hit // high
            ends = np.cumsum(times)
            first = 0
            while first < len(ends):  # keys of many words are gone through in parts
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + _TRIED, side="right")))
                t, pairs = times[first:last], int(ends[last - 1]) - done
                place = np.repeat(low[first:last] - (ends[first:last] - t - done), t) + np.arange(pairs)
                met = np.unique(owner[place] * len(y) + np.repeat(whose[first:last], t))
                i, j = met // len(y), met % len(y)
                d = _swaps_of_pairs(x[i], y[j], most)
                out.append(np.stack([i, j, d], 1)[d <= most])
                first = last
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def _gapped(n: int, most: int) -> list[tuple[int, int]]:
    """Start and end of ``most`` + 1 segments with a letter between any two, so that a swap touches one of them at most."""
    room = max(0, n - most)
    return [(room * i // (most + 1) + i, room * (i + 1) // (most + 1) + i) for i in range(most + 1)]


def _by_pieces(x: list[str], y: list[str], most: int) -> list[tuple[str, str, int]]:
    """The same of words of which one has ``LONG`` letters or more: a segment of the one stands near its place in the other."""
    held = defaultdict(set)
    for b in y:
        for i, (s, e) in enumerate(_gapped(len(b), most)):
            held[len(b), i, b[s:e]].add(b)
    out = []
    for a in x:
        met = set()
        for n in range(max(1, len(a) - most, 0 if len(a) >= LONG else LONG), len(a) + most + 1):
            for i, (s, e) in enumerate(_gapped(n, most)):
                for h in range(-most, most + 1):
                    if s + h >= 0 and e + h <= len(a):
                        met |= held.get((n, i, a[s + h : e + h]), set())
        out += [(a, b, d) for b in met if (d := _swaps_within(a, b, most)) <= most]
    return out


def _close(left: list[str], right: list[str], most: int) -> list[dict]:
    """All pairs of two lists of different words within ``most`` edits with swaps."""
    sizes = []
    for words in (left, right):
        by = defaultdict(list)
        for w in words:
            by[len(w)].append(w)
        sizes.append({n: (ws, np.array(ws, dtype=f"U{n}").view(np.uint32).reshape(len(ws), n)) for n, ws in by.items() if n < LONG})
    found = [(a[i], b[j], d) for n, (a, x) in sizes[0].items() for m, (b, y) in sizes[1].items() if abs(n - m) <= most for i, j, d in _by_deletions(x, y, most).tolist()]
    near = lambda words: [w for w in words if len(w) >= LONG - most]
    if any(len(w) >= LONG for w in (*left, *right)):
        found += _by_pieces(near(left), near(right), most)
    return [{"a": a, "b": b, "d": d} for a, b, d in found]


_swaps = vector("array<struct<a:string,b:string,d:int>>")(lambda x, y, most: pd.Series([_close(list(p), list(q), int(k)) for p, q, k in zip(x, y, most, strict=True)], dtype=object))


def name_blocks(rows: DataFrame, scope: str, word: str, most: Column | None = None) -> DataFrame:
    """The different words of a scope in blocks of some ``NAMES``: _in, _most, _block, _words. ``rows`` are read twice."""
    words = rows.select(F.col(scope).alias("_in"), F.col(word).alias("_w"), (F.lit(0) if most is None else most).alias("_most")).filter("length(_w) > 0 AND _in IS NOT NULL").distinct()
    sizes = words.groupBy("_in", "_most").agg(F.count(F.lit(1)).alias("_n"))
    block = F.pmod(F.xxhash64("_w"), F.ceil(F.col("_n") / NAMES))
    return cut(words.join(sizes, ["_in", "_most"]).groupBy("_in", "_most", block.alias("_block")).agg(F.collect_list("_w").alias("_words")))


def swap_pairs(left: DataFrame, right: DataFrame, scope: str, a: str, b: str) -> DataFrame:
    """All pairs of words of two ``name_blocks`` of one scope within the edits that the left one's block allows: scope, a, b, distance."""
    x, y = left.select("_in", "_most", F.col("_block").alias("_x"), F.col("_words").alias("_xs")), right.select("_in", F.col("_block").alias("_y"), F.col("_words").alias("_ys"))
    blocks = x.groupBy("_in").agg(F.count(F.lit(1)).alias("n")).join(y.groupBy("_in").agg(F.count(F.lit(1)).alias("m")), "_in").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // MEETINGS)
    met = x.join(_apart(y), "_in").repartition(parts, "_in", "_most", "_x", "_y").select("_in", F.explode(_swaps("_xs", "_ys", "_most")).alias("p"))
    return met.select(F.col("_in").alias(scope), F.col("p.a").alias(a), F.col("p.b").alias(b), F.col("p.d").alias("distance"))


def swap_neighbours(left: DataFrame, right: DataFrame, scope: str, a: str, b: str, most: int = 3) -> DataFrame:
    """All pairs of ``left[a]`` and ``right[b]`` of one ``scope`` within ``most`` edits with swaps: scope, a, b, distance. Rows that repeat count once.

    Words of a scope meet block by block: a task holds one block of either side and the hashes of what deletions leave of their words, so
    that words travel and not their keys, of which a word has dozens."""
    return swap_pairs(name_blocks(left, scope, a, F.lit(most)), name_blocks(right, scope, b), scope, a, b)
