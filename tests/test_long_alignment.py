"""Alignment of long streams, matching blocks, lattices and assignments against brute force and other ways to the same result."""

import difflib
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import alignment, matching

words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=120, deadline=None)
@given(words, words, st.booleans())
def test_few_rows_give_the_same_operations(a, b, free):
    whole, kept = alignment.align(a, b, free), alignment.WHOLE_CELLS
    alignment.WHOLE_CELLS = 0
    try:
        assert alignment.align(a, b, free) == whole
        pairs = matching.certain_pairs(a, b)
        choice = alignment.lattice_support([[x, None] for x in a], b)
    finally:
        alignment.WHOLE_CELLS = kept
    assert pairs == matching.certain_pairs(a, b)
    assert choice == alignment.lattice_support([[x, None] for x in a], b)


def test_long_streams_take_little_memory():
    rng = random.Random(1)
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [f"w{rng.randrange(3000)}" if rng.random() < 0.1 else w for w in ref if rng.random() > 0.05]
    tracemalloc.start()
    ops = alignment.align(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert [i for o, i, _ in ops if o != "I"] == list(range(len(ref))) and [j for o, _, j in ops if o != "D"] == list(range(len(hyp)))
    assert all((ref[i] == hyp[j]) == (o == "M") for o, i, j in ops if o in "MS")
    errors = sum(o != "M" for o, _, _ in ops)
    a, b = alignment._codes(ref, hyp)
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for x in a:
        row = np.minimum.accumulate(np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (b != x), row[1:] + 1)]) - steps) + steps
    assert errors == row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=16), st.lists(st.sampled_from("abc"), max_size=16))
def test_blocks_equal_a_difference_tool(a, b):
    tool = difflib.SequenceMatcher(None, a, b, autojunk=False)
    assert alignment.blocks(a, b) == [tuple(x) for x in tool.get_matching_blocks()]
    assert alignment.changed_runs(a, b) == [x for x in tool.get_opcodes() if x[0] != "equal"]


def runs(a, b):
    """Blocks by trying all pairs of places."""
    best = (0, 0, 0)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if n > best[2]:
            best = (i, j, n)
    i, j, n = best
    if not n:
        return []
    return runs(a[:i], b[:j]) + [best] + [(i + n + x, j + n + y, k) for x, y, k in runs(a[i + n :], b[j + n :])]


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_blocks_equal_brute_force(a, b):
    merged = []
    for i, j, n in runs(a, b):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    assert alignment.blocks(a, b) == [*merged, (len(a), len(b), 0)]


def test_signatures(spark):
    cases = [("a b c", "a x c", "replace", "b->x"), ("a b", "a b", "equal", ""), ("a b", "a", "delete", "-b"), ("a", "a b c", "insert", "+b c"), ("a b c d", "b c x", "mixed", "d->x"), ("", "", "equal", ""), ("a b", "b c", "mixed", "-a"), ("y" * 30, "z", "replace", f"{'y' * 24}->z")]
    rows = spark.createDataFrame([(x, y) for x, y, _, _ in cases], "x string, y string")
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = rows.select("x", "y", alignment.signatures(tokens("x"), tokens("y"), F.lit("name")).alias("s")).collect()
    assert {(r["x"], r["y"]): tuple(r["s"]) for r in got} == {(x, y): ("name", f"name:{op}", f"name:{text}") for x, y, op, text in cases}


# --- lattices ------------------------------------------------------------------------------------------------------


def distance(a, b):
    return sum(o != "M" for o, _, _ in alignment.align(list(a), list(b)))


columns = st.lists(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=3), max_size=5)


@settings(max_examples=150, deadline=None)
@given(columns, st.lists(st.sampled_from("abc"), max_size=5))
def test_lattice_equals_all_choices(cs, ref):
    options = [list(dict.fromkeys(([None] if None in c else []) + [x for x in c if x is not None])) for c in cs]
    every = {choice: distance([w for w in choice if w is not None], ref) for choice in itertools.product(*options)}
    best, found = alignment.lattice_support(cs, ref)
    assert best == min(every.values())
    for i, entries in enumerate(found):
        assert [e["entry"] for e in entries] == options[i]
        for e in entries:
            assert e["any"] == (min(d for c, d in every.items() if c[i] == e["entry"]) == best)
            for j in range(len(ref)):  # a word says a reference place if both sides of it can be had at what is left
                left = min((distance([w for w in c if w is not None], ref[:j]) for c in itertools.product(*options[:i])))
                right = min((distance([w for w in c if w is not None], ref[j + 1 :]) for c in itertools.product(*options[i + 1 :])))
                if e["entry"] is not None:
                    assert (j in e["exact"] or j in e["sub"]) == (left + (e["entry"] != ref[j]) + right == best)
    chosen = alignment.best_choice(cs, ref)
    assert distance([w for w in chosen if w is not None], ref) == best
    assert all(w in options[i] and next(e for e in found[i] if e["entry"] == w)["any"] for i, w in enumerate(chosen))


# --- assignments ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 5, 7])
def test_assignment_equals_permutations(n):
    rng = random.Random(n)
    for _ in range(30):
        cost = [[rng.randrange(12) for _ in range(n)] for _ in range(n)]
        picks = matching.assignment(cost)
        assert sorted(picks) == list(range(n))
        assert sum(cost[i][j] for i, j in enumerate(picks)) == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_assignment_of_many():
    rng = np.random.default_rng(2)
    n = 60
    hidden = rng.permutation(n)
    cost = rng.integers(5, 50, (n, n))
    cost[np.arange(n), hidden] = rng.integers(0, 3, n)
    assert matching.assignment(cost.tolist()) == hidden.tolist()
