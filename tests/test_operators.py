"""Intervals, chains, guards, alignment, selection, statistics and labels against plain Python."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import alignment, chains, classify, fusion, guards, intervals, labels, language, selection, statistics
from palimpsest.plans import experiments


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, m string, start double, end double")


def covered(rows, t):
    return {m for _, m, a, b in rows if a <= t < b}


def test_interval_algebra(spark):
    rng = random.Random(1)
    rows = [("x", rng.choice("abc"), float(a := rng.randrange(60)), float(a + rng.randrange(6))) for _ in range(40)]
    other = [("x", "z", float(a := rng.randrange(60)), float(a + rng.randrange(9))) for _ in range(8)]
    df, more = spans(spark, rows), spans(spark, other)
    inside = lambda out, t: any(r.start <= t < r.end for r in out)
    merged, gaps = intervals.merge(df, ["k"]).collect(), intervals.gaps(df, ["k"]).collect()
    both, less = intervals.intersect(df, more, ["k"], 5.0).collect(), intervals.subtract(df, more, ["k"]).collect()
    sweep, twice = intervals.sweep(df, ["k"], "m").collect(), intervals.overlaps(df, ["k"], "m").collect()
    for t in (i + 0.5 for i in range(70)):
        mine, its = covered(rows, t), covered(other, t)
        assert inside(merged, t) == bool(mine)
        assert inside(both, t) == bool(mine and its) and inside(less, t) == bool(mine and not its)
        assert sum(r.n_members for r in sweep if r.start <= t < r.end) == len(mine)
        assert inside(twice, t) == (len(mine) > 1)
        assert not (inside(gaps, t) and mine)


def test_interval_joins(spark):
    rng = random.Random(2)
    left = [("x", i, float(a := rng.randrange(100)), float(a + 1 + rng.randrange(20))) for i in range(30)]
    right = [("x", -i, float(a := rng.randrange(100)), float(a + 1 + rng.randrange(20))) for i in range(30)]
    a = spark.createDataFrame(left, "k string, i int, start double, end double")
    b = spark.createDataFrame(right, "k string, j int, r_start double, r_end double")
    for how, test in (("overlap", lambda p, q: p[2] < q[3] and q[2] < p[3]), ("within", lambda p, q: q[2] <= p[2] and p[3] <= q[3])):
        got = sorted((r.i, r.j) for r in intervals.interval_join(a, b, ["k"], 7.0, how=how).collect())
        assert got == sorted((p[1], q[1]) for p, q in product(left, right) if test(p, q))
    points = a.select("k", "i", F.col("start").alias("t"))
    got = sorted((r.i, r.j) for r in intervals.point_join(points, b, ["k"], 7.0, span=("r_start", "r_end")).collect())
    assert got == sorted((p[1], q[1]) for p, q in product(left, right) if q[2] <= p[2] < q[3])
    near = {r.i: r.other_t for r in intervals.nearest(points, b.select("k", F.col("r_start").alias("other_t")), ["k"]).collect()}
    for p in left:
        assert abs(near[p[1]] - p[2]) == min(abs(q[2] - p[2]) for q in right)


def test_windows_cover_exactly(spark):
    rows = spark.createDataFrame([("a", 0.0, 95.0), ("b", 0.0, 10.0)], "k string, start double, end double")
    tiles = intervals.windows(rows, 30, 20)
    assert intervals.uncovered(tiles, ["k"]).isEmpty()
    ends = tiles.groupBy("k").agg(F.min("own_start").alias("a"), F.max("own_end").alias("b")).orderBy("k").collect()
    assert [(r.a, r.b) for r in ends] == [(0.0, 95.0), (0.0, 10.0)]


def test_chains(spark):
    rows = [("u1", 1, "καλος", "καλός", "task"), ("u1", 2, "καλος!", "κακός", "user"), ("u2", 1, "a", "b", "user"), ("u2", 2, "c", "d", "task")]
    out = {r.utterance_id: r for r in chains.reconstruct(spark.createDataFrame(rows, "utterance_id string, edit_timestamp int, before_text string, after_text string, edited_by string")).collect()}
    assert out["u1"].links_ok and out["u1"].task_then_user and out["u1"].edited_by_seq == ["task", "user"]
    assert not out["u2"].links_ok and not out["u2"].task_then_user and out["u2"].gold_final == "d"


def test_guards(spark):
    rows = spark.range(10)
    counts = {r.reason: r.n for r in guards.drop_counts(rows, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 4, "null": F.lit(None)}).collect()}
    assert counts == {"even": 5, "small": 2, "kept": 3}
    assert guards.kept(rows, {"even": F.col("id") % 2 == 0}).count() == 5
    with pytest.raises(ValueError):
        guards.require_empty(guards.duplicates(rows.union(rows), ["id"]), "duplicate")
    assert guards.difference(rows, rows).isEmpty()


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_align_is_minimal_and_consistent():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        ops = alignment.align(a, b)
        assert sum(o != "M" for o, _, _ in ops) == dp(a, b)
        assert [i for o, i, _ in ops if o != "I"] == list(range(len(a))) and [j for o, _, j in ops if o != "D"] == list(range(len(b)))
        free = alignment.align(a, b, True)
        best = min(dp(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert sum(o != "M" for o, _, _ in free) == best


def three_cost(a, b, c, memo):
    key = (len(a), len(b), len(c))
    if key not in memo:
        if key == (0, 0, 0):
            memo[key] = 0
        else:
            tries = []
            for m in range(1, 8):
                if (m & 1 and not a) or (m & 2 and not b) or (m & 4 and not c):
                    continue
                e = [x[-1] if m >> s & 1 else None for s, x in enumerate((a, b, c))]
                cost = (e[0] != e[1]) + (e[0] != e[2]) + (e[1] != e[2])
                tries.append(cost + three_cost(a[: len(a) - (m & 1)], b[: len(b) - (m >> 1 & 1)], c[: len(c) - (m >> 2)], memo))
            memo[key] = min(tries)
    return memo[key]


def test_align_three_is_exact():
    rng = random.Random(4)
    for _ in range(60):
        a, b, c = ([rng.choice("ab") for _ in range(rng.randrange(5))] for _ in range(3))
        columns = alignment.align_three(a, b, c, band=2)
        assert [[x[s] for x in columns if x[s] is not None] for s in range(3)] == [a, b, c]
        assert sum((x[0] != x[1]) + (x[0] != x[2]) + (x[1] != x[2]) for x in columns) == three_cost(a, b, c, {})


def test_long_streams_in_a_narrow_band():
    """A band that is too narrow at first is widened until the way is free of it; the columns are those of a band that holds all cells."""
    rng = random.Random(14)
    for _ in range(6):
        a = [rng.choice("abcd") for _ in range(rng.randrange(20, 40))]
        b = [t for t in a if rng.random() > 0.2]
        c = [x for t in a for x in ([t, rng.choice("abcd")] if rng.random() < 0.2 else [t])]
        assert alignment.align_three(a, b, c, band=1) == alignment.align_three(a, b, c, band=200)
        columns = alignment.between_anchors([a, b, a], [])
        assert columns == alignment.align_three(a, b, a)
    cut = alignment.between_anchors([list("axb"), list("xb"), list("aaxb")], [(1, 0, 2)])
    assert ["x", "x", "x"] in cut and [[x[s] for x in cut if x[s] is not None] for s in range(3)] == [list("axb"), list("xb"), list("aaxb")]


def test_least_errors_of_hypotheses():
    from itertools import product

    rng = random.Random(15)
    for _ in range(60):
        word = lambda n: [rng.choice("abc") for _ in range(rng.randrange(n))]
        chunks, ref = [[word(4) for _ in range(rng.randrange(1, 4))] for _ in range(3)], word(9)
        best = min(sum(o != "M" for o, _, _ in alignment.align(ref, [t for h in pick for t in h])) for pick in product(*chunks))
        assert alignment.nbest_errors(chunks, ref) == best


def test_best_choice_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        columns = [[rng.choice(["a", "b", None]) for _ in range(3)] for _ in range(rng.randrange(5))]
        columns = [c for c in columns if any(c)]
        ref = [rng.choice("ab") for _ in range(rng.randrange(5))]
        got = [x for x in alignment.best_choice(columns, ref) if x is not None]
        assert dp(got, ref) == min((dp([x for x in pick if x], ref) for pick in product(*columns)), default=len(ref))


def test_vote(spark):
    cases = [(["a", "a", "a"], "a", "unanimous"), (["a", None, "a"], "a", "majority"), (["a", None, None], None, "epsilon"), (["a", "b", "c"], "b", "tie_pivot"), (["a", None, "c"], "a", "tie_priority")]
    rows = spark.createDataFrame(cases, "c array<string>, t string, r string").select("t", "r", alignment.vote(F.col("c"), 1).alias("v")).collect()
    assert [(r.v.token, r.v.reason) for r in rows] == [(r.t, r.r) for r in rows]


def test_ratios(spark):
    rows = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("abc", "xxabcxx")], "a string, b string").select(alignment.indel_ratio("a", "b").alias("i"), alignment.partial_ratio("a", "b").alias("p"), alignment.block_ratio("a", "b").alias("k"), alignment.damerau("a", "b").alias("d")).collect()
    assert [round(r.i, 3) for r in rows] == [0.75, 1.0, 0.6] and rows[2].p == 1.0 and rows[0].d == 1 and rows[0].k == 0.75


def test_times_and_loops(spark):
    assert alignment.transfer_times(["a", "x", "b"], ["a", "b"], [1.0, 3.0], 6.0) == [1.0, 2.0, 3.0]
    row = spark.createDataFrame([(["a"] * 6,), (["a", "b"] * 3 + ["c"],), (["x"] + ["a", "b"] * 6 + ["c"],), (list("abcdefghijkl") * 2 + ["a"],), ([],)], "w array<string>").select(alignment.tandem_excess("w").alias("e")).collect()
    assert [r.e for r in row] == [5, 0, 10, 12, 0]


def test_selection(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i % 5), f"s{i % 7}") for i in range(70)], "id int, g string, score double, spk string")
    assert {r.g: r["count"] for r in selection.stratified(rows, ["g"], "id", 10, "x").groupBy("g").count().collect()} == {"a": 10, "b": 10}
    batches = selection.batches(rows, "id", 8, "s").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in batches] == [8] * 8 + [6]
    assert sorted(selection.mulberry_order(50, 7)) == list(range(50)) and selection.mulberry_order(50, 7) == selection.mulberry_order(50, 7)
    top = selection.diverse_top(rows, "id", "score", ["g", "spk"], 20).collect()
    assert len({r.id for r in top}) == 20 and [r.rank for r in top] == list(range(1, 21))
    seen, left = {}, {r.id: r for r in rows.collect()}
    for r in top:  # plain greedy
        gain = lambda x: x.score / np.sqrt(1 + seen.get(("g", x.g), 0)) / np.sqrt(1 + seen.get(("s", x.spk), 0))  # noqa: E731, B023
        assert abs(max(gain(x) for x in left.values()) - r.gain) < 1e-9
        x = left.pop(r.id)
        seen["g", x.g] = seen.get(("g", x.g), 0) + 1
        seen["s", x.spk] = seen.get(("s", x.spk), 0) + 1
    split = selection.speaker_split(rows.withColumn("sec", F.lit(100.0)), "g", "spk", "sec", [], "z", target=0.14, floor=1, window=(0.1, 0.3))
    assert split.groupBy("spk").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_pack(spark):
    rows = spark.createDataFrame([("m", i, i * 10.0, i * 10.0 + 9) for i in range(7)] + [("m", 99, 0.0, 60.0)], "k string, id int, start double, end double")
    out = selection.pack(rows, ["k"], "id").orderBy("pack", "t_start").collect()
    assert [r.pack for r in out] == [0, 0, 0, 1, 1, 1, 2] and max(r.t_end for r in out) <= 29.5


def test_pack_takes_no_rounding_of_late_times(spark):
    """Two items that just fill a pack do so however late they are."""
    rows = spark.createDataFrame([x for r in range(1, 2000) for x in ((r, 0, 0.0, 25.74), (r, 1, r * 100.0, r * 100.0 + 3.36))], "k int, id int, start double, end double")
    out = selection.pack(rows, ["k"], "id").filter("id = 1").select("pack", "t_start", "t_end").distinct().collect()
    assert [tuple(r) for r in out] == [(0, 26.14, 29.5)]


def test_rescored_ties_go_to_the_better_rank(spark):
    """Gains that are equal but for the rounding of their sums are a tie."""
    gain = lambda a, b: a / 20.0 + 0.3 * b / 5.0
    ways = {}
    for a, b in product(range(0, 400, 3), range(17)):
        ways.setdefault(round(gain(a / 10, b), 9), []).append((gain(a / 10, b), a / 10, float(b)))
    pairs = [(min(w), max(w)) for g, w in ways.items() if g > 0 and min(w)[0] < max(w)[0]]
    assert len(pairs) > 10
    rows = [x for k, (low, high) in enumerate(pairs) for x in ((k, 0, 0.0, 0.0), (k, 1, *low[1:]), (k, 2, *high[1:]))]
    out = fusion.rescored(spark.createDataFrame(rows, "k int, r int, a double, b double"), ["k"], "r", "a", "b", 0.3, 20.0, 5.0).collect()
    assert len(out) == len(pairs) and {r.r for r in out} == {1}


def test_seams_meet_few_windows(spark):
    """Candidates of one key meet the windows around them, however many the key has; and the same ones are kept as by a plain loop."""
    spans = spark.createDataFrame([(1, 0.0, 8000.0), (2, 5.0, 61.0), (3, -90.0, -7.0)], "k int, start double, end double")
    windows = intervals.windows(spans, 30, 20).drop("start", "end")
    wide = windows.select("k", "window", F.col("w_start").alias("start"), (F.col("w_start") + 7).alias("end"))
    four = wide.unionAll(wide.select("k", "window", F.col("start") + 20, F.col("end") + 20)).unionAll(wide.select("k", "window", F.col("start") + 9, F.col("end") + 9))
    kept = fusion.seam_kept(four, windows, ["k"])
    all_ = windows.collect()
    want = []
    for c in four.collect():
        m = (c.start + c.end) / 2
        near = [(abs(m - (x.w_start + x.w_end) / 2), x.window, x) for x in all_ if x.k == c.k and x.w_start - 1e-7 <= m <= x.w_end + 1e-7]
        if near and min(near)[1] == c.window and min(near)[2].own_start - 1e-7 <= m <= min(near)[2].own_end + 1e-7:
            want.append(tuple(c))
    assert sorted(map(tuple, kept.collect())) == sorted(want) and len(want) > 400
    assert "_bucket" in kept._jdf.queryExecution().optimizedPlan().toString()


def test_statistics(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(6), rng.random() < 0.4) for _ in range(60)]
    df = spark.createDataFrame(rows, "s int, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(statistics.auroc(df, [], "s", F.col("y")).first().auroc - want) < 1e-9
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.adjusted, 6) for r in statistics.holm(p, "k").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    assert {r.k: round(r.adjusted, 6) for r in statistics.benjamini_hochberg(p, "k").collect()} == {"a": 0.03, "c": 0.04, "b": 0.04}
    data = spark.createDataFrame([(c, c + rng.randrange(3), c, 20) for c in range(12) for _ in range(3)], "c int, a int, b int, n int")
    ci = statistics.cluster_bootstrap(data, "c", "a", "b", "n", draws=1000).first()
    assert ci.low <= ci.delta <= ci.high and ci.n_clusters == 12
    rows = [("none", i, 0, 0, 1) for i in range(5)] + [("much", i, 20 + i, 0, 100) for i in range(12)] + [("equal", i, 2, 0, 4) for i in range(6)]
    out = {r.h: r for r in statistics.wild_cluster_test(spark.createDataFrame(rows, "h string, c int, a int, b int, n int"), "h", "c", "a", "b", "n", draws=999).collect()}
    assert out["none"].p == 1.0 and out["much"].p < 0.01 and out["equal"].p == 0.001 and out["equal"].se == 0
    d = np.arange(12) + 20.0
    assert abs(out["much"].se - np.sqrt(((d - d.sum() / 1200 * 100) ** 2).sum()) / 1200) < 1e-9


def test_label_replay(spark):
    events = spark.createDataFrame([(1, "u", {"status": "include", "notes": "x"}), (2, "u", {"notes": None}), (3, "v", {"status": "exclude"}), (4, "u", {"status": "exclude"})], "id int, key string, patch map<string,string>")
    snap = spark.createDataFrame([("v", "unreviewed", "old"), ("w", "include", "kept")], "key string, status string, notes string")
    out = {r.key: (r.status, r.notes) for r in labels.replay(events, "key", ["id"], snapshot=snap).collect()}
    assert out == {"u": ("exclude", None), "v": ("exclude", "old"), "w": ("include", "kept")}


def test_journal(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "seq int, prev string, v string")
    first = rows.filter("seq = 1").withColumn("own", labels.chain_hash(F.col("prev"), F.col("v")))
    head = first.first().own
    good = first.unionByName(rows.filter("seq = 2").withColumn("prev", F.lit(head)).withColumn("own", labels.chain_hash(F.col("prev"), F.col("v"))))
    assert labels.broken_links(good, "seq", "prev", "own", ["v"]).isEmpty()
    assert labels.broken_links(good.withColumn("v", F.lit("z")), "seq", "prev", "own", ["v"]).count() == 2


def test_boundary(spark):
    kind = "words array<struct<text:string,start:double,end:double,score:double>>, vad array<struct<start:double,end:double>>"
    rows = spark.createDataFrame([([("a", 0.6, 3.4, 0.9)], []), ([], []), ([("a", 0.1, 3.4, 0.9)], []), ([("a", 1.5, 3.4, 0.9)], [(0.6, 1.4)])], kind)
    got = [r.b.status for r in rows.select(classify.boundary(F.col("words"), F.col("vad"), F.lit(3.0), F.lit(4.0)).alias("b")).collect()]
    assert got == ["ok", "align_failed", "suspect_cut_start", "suspect_bleed_in"]


def test_families_and_terms(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t2", "b"), ("t3", "b"), ("t4", "c")], "term string, alias string")
    assert {r.term: r.family for r in selection.owners(edges, "alias", "term").collect()} == {"t1": "t1", "t2": "t1", "t3": "t1", "t4": "t4"}
    rows = spark.createDataFrame([("m1", "athens city hall"), ("m2", "city hall"), ("m2", "hall")], "m string, t string")
    out = language.attested(rows, text.word_tokens(F.col("t")), spark.createDataFrame([("city hall",), ("none",)], "term string"), "m")
    assert {r.term: r.meetings for r in out.collect()} == {"city hall": 2, "none": 0}


def test_experiments(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", float(i)) for i in range(12)], "id int, g string, x double")
    idea = experiments.Idea("mean", lambda d: {"m": d["x"].mean()}, lambda d, p: d.assign(out=p["m"]))
    book = experiments.Registry()
    book.register(idea)
    with pytest.raises(ValueError):
        book.confirm(rows, "mean", "g", "id", "double")
    book.freeze("mean")
    out = book.confirm(rows, "mean", "g", "id", "double").collect()
    values = rows.collect()
    assert len(out) == 12 and all(abs(r.out - np.mean([v.x for v in values if v.g != r.g])) < 1e-9 for r in out)
    assert experiments.grid(spark, lr=[1, 2], rank=[3, 4, 5]).count() == 6


def test_active_sets_and_agreement(spark):
    rng = random.Random(7)
    rows = [("x", rng.choice("abc"), float(a := rng.randrange(60)), float(a + rng.randrange(6))) for _ in range(40)]
    out = intervals.active_sets(spans(spark, rows), ["k"], "m", 5.0).collect()
    for t in (i + 0.5 for i in range(70)):
        want = "+".join(sorted(covered(rows, t)))
        assert [r.members for r in out if r.start <= t < r.end] == ([want] if want else [])
    ordered = sorted(out, key=lambda r: r.start)
    assert all(not (a.end == b.start and a.members == b.members) for a, b in zip(ordered, ordered[1:]))
    stream = lambda shift: spark.createDataFrame([("x", w, i + shift) for i, w in enumerate("abca")], "k string, token string, t double")
    assert sorted(r.t for r in intervals.agreeing([stream(0.0), stream(0.2), stream(-0.3)], ["k"], 0.4).collect()) == [0.0, 1.0, 2.0, 3.0]
    assert intervals.agreeing([stream(0.0), stream(0.2), stream(-0.5)], ["k"], 0.4).isEmpty()


def test_nulls_thresholds_and_picks(spark):
    rng = random.Random(8)
    rows = [(f"c{i % 5}", rng.random() + (i % 3 == 0) * 0.4, i % 3 == 0) for i in range(120)]
    out = statistics.permutation_null(spark.createDataFrame(rows, "c string, s double, y boolean"), "c", "s", "y", draws=200).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert abs(out.auroc - np.mean([p > n for p in pos for n in neg])) < 1e-9 and out.p < 0.05 and abs(out.null_mean - 0.5) < 0.05
    curve = spark.createDataFrame([("k", 0.9, 2), ("k", 0.8, -1), ("k", 0.7, 1), ("k", 0.6, -5), ("z", 0.9, -1)], "k string, s double, g int")
    got = {r.k: (r.threshold, r.total) for r in statistics.fit_threshold(curve, "s", "g", ["k"]).collect()}
    assert got == {"k": (0.9, 2), "z": (None, 0)}
    assert alignment.transfer_marks("ναι το είδα χθες".split(), "Ναι, είδα χτες.".split()) == ["Ναι,", "το", "είδα", "χθες"]
    picks = selection.spaced_picks(spark.createDataFrame([("m", i, i * 3.0) for i in range(30)], "k string, id int, start double"), ["k"], "k string", 5, 10.0, "s").collect()
    assert len(picks) == 5 and all(abs(a.start - b.start) >= 10 for a in picks for b in picks if a.id != b.id)
    items = spark.createDataFrame([("m", 1, 10.0, True), ("m", 2, 11.0, False), ("m", 3, 50.0, False), ("m", 4, 10.0, True)], "k string, item int, seconds double, flagged boolean")
    assert sorted((r.item, r.null_item is None or np.isnan(r.null_item)) for r in selection.matched_null(items, ["k"], "k string", 1).collect()) == [(1, False), (4, True)]


def test_changes_outside_spans_and_eligible_stretches(spark):
    from palimpsest.operators import fusion

    rng = random.Random(20)
    stretches, spans_ = [], []
    for k in "xyz":
        at = 0.0
        for _ in range(25):
            at += rng.randrange(3)
            end = at + rng.randrange(1, 5)
            stretches.append((k, float(at), float(end), rng.randrange(1, 4)))
            at = end
        spans_ += [(k, float(a := rng.randrange(80)), float(a + rng.randrange(6))) for _ in range(6)]
    df = spark.createDataFrame(stretches, "k string, start double, end double, n int")
    out = {(r.k, r.t) for r in fusion.other_changes(df, spark.createDataFrame(spans_, "k string, start double, end double"), ["k"], 5.0).collect()}
    want = set()
    for k in "xyz":
        own = [s for s in stretches if s[0] == k]
        want |= {(k, (a[2] + b[1]) / 2) for a, b in zip(own, own[1:]) if not any(x[0] == k and x[1] <= (a[2] + b[1]) / 2 <= x[2] for x in spans_)}
    assert out == want
    kept = {(r.k, r.start) for r in fusion.eligible(df, 1.2).collect()}
    assert kept == {(k, a) for k, a, b, n in stretches if (b - a >= 1.5 if n == 1 else 1.2 * (b - a) >= 3)}


def test_floor_changes_and_interval_matches(spark):
    rows = spans(spark, [("x", "a", 0.0, 5.0), ("x", "b", 4.0, 9.0), ("x", "a", 12.0, 13.0), ("x", "c", 12.5, 12.8)])
    out = intervals.floor_changes(rows, ["k"], "k string", "m", 5.0).orderBy("cut").collect()
    assert [(r.cut, r.low, r.high) for r in out] == [(5.0, 5.0, 5.0), (10.5, 9.0, 12.0)]
    both = spark.createDataFrame([("x", "flag", 0.0, 2.0), ("x", "flag", 1.0, 3.0), ("x", "flag", 8.0, 9.0), ("x", "truth", 1.5, 2.5), ("x", "truth", 2.6, 4.0)], "k string, side string, start double, end double")
    got = sorted((r.start, r.truth_start) for r in intervals.overlap_matches(both, ["k"], "k string").collect())
    assert got == [(0.0, 1.5), (1.0, 2.6)]
