"""What large tables cost is made once: forms of collisions, names of gazetteers, words of edits."""

import contextlib
import io
import random
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.functions import distance
from palimpsest.operators import fuzzy
from palimpsest.plans import catalogue, further, lookups, placements  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


def test_collisions_make_forms_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def form(i):
        seen.add(1)
        return f"{'abcdefghij'[i % 10]}{i * 7919 % 1000:03d}"

    terms = spark.createDataFrame([("a001",), ("qqqq",), ("zz12",)], "t string")
    # Spark may ask twice a row, for a filter and for the value.
    got = fuzzy.worst_collision(terms, spark.range(200).select(form("id").alias("f")), "t", "f").collect()
    assert seen.value <= 2 * 200 and {r["t"] for r in got} == {"a001", "qqqq", "zz12"}


def test_collisions_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "TERMS", 7)
    monkeypatch.setattr(fuzzy, "FORMS", 11)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeλ") for _ in range(n))
    terms, forms = ({word(rng.choice([1, 2, 4, 5, 6, 62, 63, 64, 65, 70])) for _ in range(60)} for _ in range(2))
    forms |= set(list(terms)[:9])
    ratio = lambda a, b: 200.0 * fuzzy._lcs(a, b) / (len(a) + len(b))
    got = {r["t"]: (r["f"], r["score"]) for r in fuzzy.worst_collision(spark.createDataFrame([(t,) for t in terms], "t string"), spark.createDataFrame([(f,) for f in forms], "f string"), "t", "f").collect()}
    want = {t: min(((-ratio(t, f), f) for f in forms if f != t and abs(len(f) - len(t)) <= 3 and ratio(t, f) > 0), default=(0.0, None)) for t in terms}
    assert got == {t: (f, -s) for t, (s, f) in want.items()}


def test_scores_count_words_without_sorts(spark):
    rng = random.Random(8)
    rows = [tuple([rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 9]))] for _ in range(3)) for _ in range(60)]
    out = spark.createDataFrame(rows, "s array<string>, m array<string>, g array<string>").select("*", distance.token_edit_scores(F.col("s"), F.col("m"), F.col("g")).alias("x"), distance.multiset_minus("s", "m").alias("a"), distance.multiset_minus_udf("s", "m").alias("b"))
    for r in out.collect():
        s, m, g = (Counter(r[c]) for c in "smg")
        needed = sum(((g - s) + (s - g)).values())
        achieved = sum(min(max(g[w] - s[w], 0), m[w]) + min(max(s[w] - g[w], 0), max(s[w] - m[w], 0)) for w in "abcd")
        beyond = sum(max(max(m[w] - s[w], 0) - max(g[w] - s[w], 0), 0) + max(max(s[w] - m[w], 0) - max(s[w] - g[w], 0), 0) for w in "abcd")
        assert (r.x.normalized_exact, r.x.edit_application, r.x.overcorrection) == (r.m == r.g, achieved / needed if needed else 1.0, beyond / max(1, len(r.s)))
        assert r.a == r.b
    for name in ("correction_scores", "token_multisets", "word_changes"):
        assert "array_sort" not in plan(catalogue.QUERIES[name](spark, SF))


def test_edit_kinds_clean_each_word_once(spark):
    assert plan(catalogue.QUERIES["edit_kinds"](spark, SF)).split("== Physical Plan ==")[0].count("[^a-z0-9_ ]") == 2


def test_gazetteer_names_are_made_once(spark):
    made = plan(catalogue.QUERIES["gazetteer_hits"](spark, SF))
    assert "conversations.parquet" in made and "documents.parquet" not in made
