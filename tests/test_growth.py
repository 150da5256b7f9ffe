"""What keeps memory and shuffles in proportion: slices of batches, n-grams of the terms' lengths, draws by cells."""

import hashlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import alignment, language, statistics


def test_functions_of_series_get_slices_of_a_batch(spark):
    @alignment.vector("struct<rows:int,words:array<string>>")
    def seen(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(words)] * len(words), "words": [None if w is None else list(w)[::-1] for w in words]})

    rows = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.array(F.col("id").cast("string"), F.lit("x"))).alias("w")).withColumn("s", seen("w"))
    got = rows.select("id", "s.*").collect()
    assert len(got) == 1500 and max(r.rows for r in got) <= alignment.SLICE
    assert all(r.words == (["x", str(r.id)] if r.id % 7 else None) for r in got)
    assert rows.filter("id < 0").select("s").count() == 0


def test_attested_terms_travel_once_a_meeting(spark):
    rows = spark.createDataFrame([("a", "x y z x"), ("a", "x y"), ("b", "y z"), ("c", None), (None, "x")], "m string, t string")
    terms = spark.createDataFrame([("x",), ("y z",), ("q",), ("x y z x w",), (None,)], "term string")
    out = language.attested(rows, F.split("t", " "), terms, "m")
    assert {r.term: r.meetings for r in out.collect()} == {"x": 1, "y z": 2, "q": 0, "x y z x w": 0, None: 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert plan[join:].count("Aggregate") == 2 and plan[join:].count("array_join") == 2  # terms and n-grams, of one word and of two


@pytest.mark.parametrize("draws", [1, 40])
def test_label_shuffles_equal_brute_force(spark, draws):
    """Clusters without positive labels, with nothing else, of one row, and of more rows than there are cells."""
    rows = [("none", i % 5, False) for i in range(6)] + [("all", i, True) for i in range(9)] + [("one", 3, True)] + [("many", i % 37, i % 3 == 0) for i in range(700)] + [("many", None, True)]
    out = statistics.permutation_null(spark.createDataFrame(rows, "c string, s int, y boolean"), "c", "s", "y", draws).first()
    known = [r for r in rows if r[1] is not None]
    scores = sorted(r[1] for r in known)
    rank = {s: scores.index(s) + (scores.count(s) + 1) / 2 for s in set(scores)}
    pos = sum(r[2] for r in known)
    area = lambda total: (total - pos * (pos + 1) / 2) / (pos * (len(known) - pos))
    by = defaultdict(list)
    for c, s, y in known:
        by[c].append((s, y))
    areas = []
    for d in range(1, draws + 1):
        total = 0
        for c, xs in by.items():
            order = sorted((hashlib.md5(f"3|{d}|{c}|{i}".encode()).hexdigest(), i, s) for i, (s, _) in enumerate(sorted(xs), 1))
            total += sum(rank[s] for _, _, s in order[: sum(y for _, y in xs)])
        areas.append(area(total))
    seen = area(sum(rank[s] for _, s, y in known if y))
    assert (out.auroc, out.null_mean, out.p) == pytest.approx((seen, sum(areas) / draws, sum(a >= seen - 1e-12 for a in areas) / draws))
