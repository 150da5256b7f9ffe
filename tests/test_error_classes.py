"""Classes of charged words, their pairs, and folds by sums."""

import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import alignment, classify
from palimpsest.plans import experiments

CASES = {
    ("λόγος", None): "deletion", (None, "λόγος"): "insertion", ("Λόγος", "λόγος"): "identical", ("λόγοσ", "λόγος"): "final_sigma", ("λόγος", "λογος"): "accent_tonos", ("λόγος", "λογοσ"): "final_sigma",
    ("καλή", "καλοί"): "homophone", ("πέντε", "έξι"): "number_date", ("2024", "χρόνος"): "number_date", ("της", "τους"): "article_pronoun", ("αβ", "γδεζ"): "acronym_abbreviation",
    ("δρόμου", "δρόμος"): "inflection_or_nearmiss", ("ανθρωπος", "νθρωποσα"): "inflection_or_nearmiss", ("σπίτι", "δέντρο"): "substitution_phonetic_or_word",
}


def test_error_classes(spark):
    rows = spark.createDataFrame(list(CASES), "r string, h string")
    assert {(x["r"], x["h"]): x["c"] for x in rows.select("r", "h", classify.error_class(F.col("r"), F.col("h")).alias("c")).collect()} == CASES


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_runs_are_those_of_a_difference_tool(a, b):
    assert alignment.changed_runs(a, b) == [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]


def test_charged_words(spark):
    rows = spark.createDataFrame([(1, "a b c d".split(), "a x y z d e".split()), (2, ["a"], ["a"]), (3, "p q r".split(), ["z"])], "k int, r array<string>, h array<string>")
    got = {tuple(x) for x in classify.charged_words(rows, ["k"], "r", "h").collect()}
    assert got == {(1, 1, "b", "x"), (1, 2, "c", "y"), (1, 3, None, "z"), (1, 4, None, "e"), (3, 0, "p", "z"), (3, 1, "q", None), (3, 2, "r", None)}


def test_folds_by_sums(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, float(i)) for i in range(40)]
    out = experiments.leave_one_group_out_by_sums(spark.createDataFrame(rows, "id int, g string, x double"), {"s": F.col("x"), "n": F.lit(1)}, lambda v: v["s"] / v["n"], "g")
    for r in out.collect():
        others = [x for _, g, x in rows if g != r["g"]]
        assert abs(r["out"] - sum(others) / len(others)) < 1e-9
