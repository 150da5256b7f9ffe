"""Edit distances and set similarities. Token distances run in the JVM: tokens become code points, then ``levenshtein``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.operators.alignment import vector

from .text import canonical, canonical_tokens

#: Code points of token numbers: those from _FIRST to the surrogates, then those beyond the first plane.
_FIRST, _PLAIN, _BEYOND = 0x8000, 0xD800 - 0x8000, 1 << 20


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code(number: Column) -> Column:
    """A character for each number from 0: one UTF-16 unit, or two that make a character beyond the first plane."""
    hexed = lambda n: F.lpad(F.hex(n), 4, "0")
    more = number - _PLAIN
    pair = F.concat(hexed(0xD800 + F.shiftright(more, 10)), hexed(0xDC00 + more.bitwiseAND(0x3FF)))
    return F.decode(F.unhex(F.when(number < _PLAIN, hexed(_FIRST + number)).otherwise(pair)), "UTF-16BE")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays: tokens become characters. More than a million different tokens in one pair are an error, not a null."""

    def coded(v: Column) -> Column:
        code = lambda t: _code((F.array_position(v["all"], t) - 1).cast("int"))
        distance = F.levenshtein(F.array_join(F.transform(v["a"], code), ""), F.array_join(F.transform(v["b"], code), ""))
        return F.when(F.size(v["all"]) > _PLAIN + _BEYOND, F.raise_error(F.lit("too many different tokens in a pair"))).otherwise(distance)

    return _let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("all")), coded)


def _rate(errors: Column, size: Column, other: Column) -> Column:
    """Errors by reference size; 0 if both are empty, 1 if the reference alone is."""
    return F.when(size > 0, errors / size).when(other > 0, 1.0).otherwise(0.0)


def cer(hyp: Column, ref: Column) -> Column:
    h, r = canonical(hyp), canonical(ref)
    return _rate(F.levenshtein(h, r), F.length(r), F.length(h))


def wer(hyp: Column, ref: Column) -> Column:
    h, r = canonical_tokens(hyp), canonical_tokens(ref)
    return _rate(token_distance(h, r), F.size(r), F.size(h))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def transposed_or_near(a: Column, b: Column) -> Column:
    """Damerau distance of at most 1: one edit, or two neighbouring letters swapped."""
    n = F.length(a)
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    at = F.get(differs, F.lit(0))
    swap = (n == F.length(b)) & (F.size(differs) == 2) & (F.get(differs, F.lit(1)) == at + 1) & (F.substring(a, at, F.lit(1)) == F.substring(b, at + 1, F.lit(1))) & (F.substring(a, at + 1, F.lit(1)) == F.substring(b, at, F.lit(1)))
    return (F.levenshtein(a, b, 1) >= 0) | F.coalesce(swap, F.lit(False))


def multiset_minus(a: Column, b: Column) -> Column:
    """Elements of ``a`` in order, each as often as it occurs there more than in ``b`` (its later occurrences).

    Sorted, an element's occurrences stand together: where runs begin tells each one's number, and (number, element) as one string is
    compared by hash, so that the work is that of sorting."""

    def numbered(xs: Column) -> Column:
        placed = F.array_sort(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        begins = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: (k == 0) | (F.get(p, k)["x"] != F.get(p, k - 1)["x"]))
        lengths = lambda v: F.transform(v["starts"], lambda s, k: F.coalesce(F.get(v["starts"], k + 1), F.size(v["p"])) - s)
        numbers = lambda v: F.flatten(F.transform(lengths(v), lambda n: F.sequence(F.lit(1), n)))
        known = lambda v: F.array_sort(F.zip_with(v["p"], numbers(v), lambda e, n: F.struct(e["i"].alias("i"), F.concat_ws("|", n.cast("string"), e["x"]).alias("t"))))
        named = _let(placed, lambda p: _let(F.struct(p.alias("p"), begins(p).alias("starts")), lambda v: F.transform(known(v), lambda e: e["t"])))
        return F.when(F.size(xs) > 0, named).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array_except(numbered(a), numbered(b)), lambda s: F.substring(s, F.instr(s, "|") + 1, F.length(s)))


@vector("array<string>")
def multiset_minus_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``multiset_minus`` counted in Python, in a hundredth of the time; functions within array functions need the other."""
    return pd.Series([None if x is None or y is None else _minus(x, Counter(y)) for x, y in zip(a, b, strict=True)], dtype=object)


def _minus(xs: Iterable[str], left: Counter) -> list[str]:
    out = []
    for x in xs:
        if left[x] > 0:
            left[x] -= 1
        else:
            out.append(x)
    return out


def multiset_common(a: Column, b: Column) -> Column:
    """How many elements two arrays share as multisets."""
    return F.size(a) - F.size(multiset_minus(a, b))


def _edit_counts(s: Counter, m: Counter, g: Counter) -> tuple[int, int, int]:
    """Edits that gold needs, those of them that the output achieves, and those it makes beyond them."""
    adds, removes, added, dropped = g - s, s - g, m - s, s - m
    return (adds + removes).total(), (adds & m).total() + (removes & dropped).total(), (added - adds).total() + (dropped - removes).total()


@vector("struct<normalized_exact:boolean,edit_application:double,overcorrection:double>")
def _token_scores(source: pd.Series, output: pd.Series, gold: pd.Series) -> pd.DataFrame:
    rows = []
    for s, m, g in zip(source, output, gold, strict=True):
        needed, achieved, harm = _edit_counts(Counter(s), Counter(m), Counter(g))
        rows.append((list(m) == list(g), achieved / needed if needed else 1.0, harm / max(1, len(s))))
    return pd.DataFrame(rows, columns=["normalized_exact", "edit_application", "overcorrection"])


def token_edit_scores(source: Column, output: Column, gold: Column) -> Column:
    """``edit_scores`` of token arrays."""
    x = _token_scores(source, output, gold)
    return F.struct(x["normalized_exact"].alias("normalized_exact"), x["edit_application"].alias("edit_application"), x["overcorrection"].alias("overcorrection"), _rate(token_distance(output, gold), F.size(gold), F.size(output)).alias("wer"))


def edit_scores(source: Column, output: Column, gold: Column) -> Column:
    """struct(normalized_exact, edit_application, overcorrection, wer) of a correction, on canonical tokens as multisets.

    The gold edit is what gold adds to and removes from the source. The application is the share of it that
    the output achieves (1 if there is none); overcorrection is what the output adds or removes
    beyond it, by source token. Words are counted in Python: array functions take a hundred times as long for it."""
    return token_edit_scores(canonical_tokens(source), canonical_tokens(output), canonical_tokens(gold))
