"""Greedy choices in rounds on Spark against the same choices one by one, and distances of many tokens."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import distance
from palimpsest.operators import selection


def one_by_one(rows, room, enough=float("inf")):
    now, out = 0.0, set()
    for key, amount in rows:
        if now >= enough:
            break
        if amount is not None and now + amount <= room:
            out.add(key)
            now += amount
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fitting_equals_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_ROWS", 20)
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, 3, 5, 8, 40, 100]) * 1.0) for i in range(90)] + [(90, None)]
    frame = spark.createDataFrame(rows, "id int, size double")
    for room, enough in ((60.0, float("inf")), (250.0, 100.0), (0.5, float("inf")), (1e9, float("inf")), (90.0, 89.0)):
        got = {r["id"] for r in selection.fitting(frame, "id", [F.col("id")], "size", room, enough).collect()}
        assert got == one_by_one(rows, room, enough)
    assert selection.fitting(frame.limit(0), "id", [F.col("id")], "size", 5.0).count() == 0


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(9))) for i in range(60)]
    rng.shuffle(rows)
    got = sorted((r["id"], r["_at"], r["_upto"]) for r in selection.running(spark.createDataFrame(rows, "id int, size double"), [F.desc("id")], "size").collect())
    total, want = 0.0, []
    for place, (i, size) in enumerate(sorted(rows, reverse=True), 1):
        total += size
        want.append((i, place, total))
    assert got == sorted(want)


def test_balanced_groups(spark):
    rows = [("a", 50.0), ("b", 30.0), ("c", 30.0), ("d", 9.0), ("e", 1.0)]
    got = {r["k"] for r in selection.balanced_groups(spark.createDataFrame(rows, "k string, n double"), "k", "n", 0.34).collect()}
    assert got == {"b", "d", "e"}


def test_distance_of_many_tokens(spark):
    words = [f"w{i}" for i in range(24_000)]
    changed = [w for i, w in enumerate(words) if i not in (5, 23_000)] + ["new"]
    rows = spark.createDataFrame([(words, changed)], "a array<string>, b array<string>")
    assert rows.select(distance.token_distance(F.col("a"), F.col("b"))).first()[0] == 3
