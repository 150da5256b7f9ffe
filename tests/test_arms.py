"""Arms over overlaps, and the drift guard, against plain loops."""

import difflib
import random

from pyspark.sql import functions as F

from palimpsest.operators import fusion


def mask_of(active):
    rows = sorted(active)
    out = []
    for i, (_, _, n) in enumerate(rows):
        if n >= 2:
            low = rows[i - 1][0] if i else rows[i][0]
            high = rows[i + 1][1] if i + 1 < len(rows) else rows[i][1]
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], high))
            else:
                out.append((low, high))
    return out


def like(x, y):
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 0.0


def arm_of(active, streams, base, cuts):
    spans = mask_of(active)
    inside = sorted({t for t in cuts if any(a < t < z for a, z in spans)})
    if not spans:
        return [w for _, w in base], 0, 0
    edges = sorted({t for s in spans for t in s} | set(inside))
    out, replaced = [], 0
    for low, high in zip([float("-inf"), *edges], [*edges, float("inf")], strict=True):
        mid = (low if low != float("-inf") else high - 1) / 2 + (high if high != float("inf") else low + 1) / 2
        own = [w for t, w in base if low <= t < high]
        if not any(a <= mid < z for a, z in spans):
            out += own
            continue
        said = [[w for t, w in s if low <= t < high] for s in streams]
        scores = [sum(like(x, y) for y in said) - like(x, x) for x in said]
        best = scores.index(max(scores))
        out += said[best] if any(said) else []
        replaced += len(own)
    return out, len(inside), replaced


def test_overlap_arms(spark):
    rng = random.Random(11)
    active, tokens, base, cuts, want = [], [], [], {"none": [], "speaker": [], "other": []}, {}
    for key in range(6):
        edges = sorted(rng.sample(range(0, 200), 12))
        own = [(float(a), float(b), 1 if key == 5 else rng.choice([1, 1, 2])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        active += [(key, *x) for x in own]
        words = [(float(t), f"w{rng.randrange(30)}") for t in sorted(rng.sample(range(-5, 215), 90))]
        streams = [[(t, w if rng.random() > 0.15 else "odd") for t, w in words if rng.random() > 0.1] for _ in range(3)]
        mine = [(t, w) for t, w in words if rng.random() > 0.1]
        tokens += [(key, s, p, w, t) for s, stream in enumerate(streams) for p, (t, w) in enumerate(stream)]
        base += [(key, p, w, t) for p, (t, w) in enumerate(mine)]
        at = {"none": [], "speaker": [float(a) for a, _, _ in own], "other": [rng.randrange(200) + 0.5 for _ in range(9)]}
        for name, times in at.items():
            cuts[name] += [(key, t) for t in times]
            want[key, name] = arm_of(own, streams, mine, times)
    frame = spark.createDataFrame
    got = fusion.overlap_arms(frame(active, "k int, start double, end double, n int"), frame(tokens, "k int, stream int, pos int, token string, t double"), frame(base, "k int, pos int, token string, t double"), {n: frame(c, "k int, t double") for n, c in cuts.items()}, ["k"], 50.0).collect()
    assert {(r["k"], r["arm"]): (list(r["words"]), r["dose"], r["replaced"]) for r in got} == want
    assert len({tuple(want[2, n][0]) for n in cuts}) > 1


def test_matched_cuts(spark):
    pool = spark.createDataFrame([(1, float(t)) for t in range(5)] + [(2, 1.0), (3, 4.0)], "k int, t double")
    wanted = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.0), (2, 9.0)], "k int, t double")
    got = [tuple(r) for r in fusion.matched_cuts(pool, wanted, ["k"], "s").collect()]
    assert len(got) == 2 and {k for k, _ in got} == {1} and len(set(got)) == 2


def test_drift_guard(spark):
    rng = random.Random(2)
    rows = []
    for key in ("a", "b", None):
        for p in range(40):
            starts = [round(rng.random() * 4, 2) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
            rows.append((key, p, rng.choice([1, 2, 3]), starts))
    got = fusion.drift_guard(spark.createDataFrame(rows, "k string, p int, n int, starts array<double>"), ["k"], "p", F.col("n"), F.col("starts"), 1.5).collect()
    want = set()
    for key in ("a", "b", None):
        own = sorted((p, n == 1, len(s) >= 2 and max(s) - min(s) > 1.5) for k, p, n, s in rows if k == key)
        i = zones = 0
        while i < len(own):
            j = i
            while j < len(own) and (own[j][1] or own[j][2]):
                j += 1
            zone = sum(x[2] for x in own[i:j]) >= 2
            zones += zone
            want |= {(key, x[0], x[2], x[1], zones if zone else None, zone and x[1]) for x in own[i : max(j, i)]}
            if j < len(own):
                want.add((key, own[j][0], False, False, None, False))
            i = j + 1
    assert {(r["k"], r["p"], r["disagrees"], r["thin"], r["zone"], r["fires"]) for r in got} == want
