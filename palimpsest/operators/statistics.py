"""Rates, leave-one-out, ranks, tests and resampling over clusters.

Corpus rates are sums over sums. Resampling works on one row per cluster, which is aggregated first; what a draw
takes follows from an MD5 of the seed, the draw and the place, so draws are rows like any others, are summed by groups, and
come out the same in any engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut

from .alignment import vector


def micro_rate(errors: Column, size: Column) -> Column:
    """Sum over sum; null without size."""
    return F.sum(errors) / F.nullif(F.sum(size), F.lit(0))


def rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """S, D and I by key with their rates per reference word."""
    n = F.nullif(F.sum("n"), F.lit(0))
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in "sdin"), *((F.sum(c) / n).alias(f"{c}_rate") for c in "sdi"), ((F.sum("s") + F.sum("d") + F.sum("i")) / n).alias("wer"))


def head_to_head(a: Column, b: Column) -> list[Column]:
    return [F.count_if(a < b).alias("a_better"), F.count_if(a == b).alias("tie"), F.count_if(a > b).alias("b_better")]


def leave_one_out(rows: DataFrame, cluster: str, a: str, b: str, size: str) -> DataFrame:
    """The paired delta (sum a - sum b) / sum size without each cluster, from one total."""
    sums = rows.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("d"), F.sum(size).alias("n"))
    total = sums.agg(F.sum("d").alias("d"), F.sum("n").alias("n")).first()  # one row
    return sums.select(cluster, (F.col("d") / F.nullif(F.col("n"), F.lit(0))).alias("own"), ((F.lit(total["d"]) - F.col("d")) / F.nullif(F.lit(total["n"]) - F.col("n"), F.lit(0))).alias("without"), F.lit(total["d"] / total["n"] if total["n"] else None).cast("double").alias("delta"))


def domination(rows: DataFrame, key: str, gain: str) -> DataFrame:
    """The largest share of the total gain that one key has."""
    sums = rows.groupBy(key).agg(F.sum(gain).alias("g"))
    return sums.agg(F.max_by(key, F.struct(F.abs("g"), key)).alias(key), (F.max(F.abs("g")) / F.nullif(F.sum(F.abs("g")), F.lit(0))).alias("share"))


def order_quantile(values: Column, p: float) -> Column:
    """The value at index min(n - 1, floor(p * n)) of a sorted array: no interpolation."""
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.lit(p) * F.size(values)).cast("int")))


def order_quantiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Order-statistic quantiles by rank, so that no key's values are gathered in one array."""
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.filter(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w) - 1).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == at(p), F.col(value))).alias(name) for name, p in ps.items()))


def histogram(rows: DataFrame, keys: list[str], share: Column, width: int = 5) -> DataFrame:
    """Counts by bins of ``width`` percent."""
    return rows.groupBy(*keys, (F.floor(share * 100 / width) * width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(rows: DataFrame, value: str, cutoffs: list[float]) -> DataFrame:
    """Rows kept (at or above) and dropped for each cutoff, in one pass."""
    counts = [F.struct(F.lit(float(c)).alias("cutoff"), F.count_if(F.col(value) >= c).alias("kept"), F.count_if(F.col(value) < c).alias("dropped")) for c in cutoffs]
    return rows.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _tests(pvals: DataFrame, key: str, p: str) -> DataFrame:
    # Windows over all rows: one row for each hypothesis.
    return pvals.select(key, p, F.row_number().over(Window.orderBy(p, key)).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_m"))


def holm(pvals: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Step-down adjusted p values, which bound the chance of any false rejection."""
    w = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return _tests(pvals, key, p).select(key, p, F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))).over(w).alias("adjusted"))


def benjamini_hochberg(pvals: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Step-up adjusted p values, which bound the share of false rejections."""
    w = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    return _tests(pvals, key, p).select(key, p, F.min(F.least(F.lit(1.0), F.col("_m") * F.col(p) / F.col("_i"))).over(w).alias("adjusted"))


def _counts(rows: DataFrame, keys: list[str], score: str, label: Column) -> DataFrame:
    """Per distinct score: rows, positives, and rows below within the key. Windows run over distinct scores, not rows."""
    sums = rows.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(score)
    return sums.withColumn("below", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def auroc(rows: DataFrame, keys: list[str], score: str, label: Column) -> DataFrame:
    """Chance that a positive scores above a negative, ties one half; null if a class is missing."""
    sums = _counts(rows, keys, score, label)
    out = sums.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("_r"), F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    return out.select(*keys, F.when((F.col("_p") > 0) & (F.col("_p") < F.col("_n")), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * (F.col("_n") - F.col("_p")))).alias("auroc"))


def average_precision(rows: DataFrame, keys: list[str], score: str, label: Column) -> DataFrame:
    """Sum over distinct scores, highest first, of precision times the recall gained."""
    sums = rows.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = sums.select(*keys, "pos", (F.sum("pos").over(w) / F.sum("n").over(w)).alias("precision"))
    return steps.groupBy(*keys).agg((F.sum(F.col("precision") * F.col("pos")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def midranks(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average ranks from 1, ties sharing theirs."""
    w, tie = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return rows.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2)


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of midranks; null below three rows or if one side is constant."""
    ranked = midranks(midranks(rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, a, "_a"), keys, b, "_b")
    corr = F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0), F.corr("_a", "_b"))
    return ranked.groupBy(*keys).agg(corr.alias("spearman"))


def bottom_share(rows: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Flags the lowest ``share`` of a key, ties at the edge included."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("bottom", F.rank().over(w) <= F.greatest(F.lit(1), F.floor(n * share)))


def bucket_rates(rows: DataFrame, score: str, edges: list[float], wrong: Column) -> DataFrame:
    """Error rate by score bucket; bucket i holds edges[i-1] <= score < edges[i]."""
    bucket = sum(((F.col(score) >= e).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"), (F.count_if(wrong) / F.count(F.lit(1))).alias("rate"))


def _binomial_tail(k: int, n: int) -> float:
    """Two-sided exact p of k or fewer of n at one half, k the smaller side."""
    from math import comb

    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


@vector("double")
def exact_sign_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact sign test (or McNemar's) of two counts: one row per comparison, so Python is no burden."""
    return pd.Series([_binomial_tail(min(a, b), a + b) for a, b in zip(wins, losses, strict=True)])


def clusters(rows: DataFrame, cluster: str, a: str, b: str, size: str) -> DataFrame:
    """One row per cluster: ``d`` = errors of a less those of b, and ``n``."""
    return rows.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).cast("double").alias("d"), F.sum(size).cast("double").alias("n"))


def _dice(sides: Column | int, *parts: Column) -> Column:
    """A number from 0 to ``sides`` - 1 that the parts decide: 60 bits of their MD5."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(sides) if isinstance(sides, int) else sides)


def numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``number`` from 0 in the order of the key's MD5, by counts of 256 ranges and ranks within these."""
    hashed = rows.withColumn("_m", F.md5(F.col(key).cast("string"))).withColumn("_p", F.substring("_m", 1, 2))
    counts = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_m", key))
    return hashed.withColumn("_r", rank).join(F.broadcast(before), "_p").withColumn(number, F.col("_before") + F.col("_r") - 1).drop("_m", "_p", "_r", "_before")


def _draws(rows: DataFrame, draws: int) -> DataFrame:
    """``draw`` 1..draws beside each row."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))


def resampled(sums: DataFrame, cluster: str, columns: list[str], draws: int, seed: int) -> DataFrame:
    """Per draw the sums of ``columns`` (one row per cluster in ``sums``) over as many clusters as there are, taken with replacement.

    A draw has one row for each place in it, joined to the cluster whose number comes up."""
    known = numbered(sums.filter(F.col(cluster).isNotNull()), cluster, "number")
    many = known.count()
    places = _draws(known.select(F.col("number").alias("place")), draws)
    picks = places.select("draw", _dice(max(1, many), F.lit(seed), F.col("draw"), F.col("place")).alias("number"))
    return picks.join(known.select("number", *columns), "number").groupBy("draw").agg(*(F.sum(c).alias(c) for c in columns))


def cluster_interval(sums: DataFrame, cluster: str, columns: list[str], estimate: Column, draws: int = 10_000, seed: int = 7, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """One row: ``estimate`` (a column of summed ``columns``) over all clusters, with a percentile interval of it over resampled clusters.

    Draws in which it is undefined are counted and left out. With rates of arms as columns this is the interval of paired
    deltas, of differences over different tokens, of means over seeds (one resample for all) and of means over meetings; one-sided
    bounds are its ends."""
    whole = sums.filter(F.col(cluster).isNotNull()).agg(F.count(F.lit(1)).alias("n_clusters"), *(F.sum(c).alias(c) for c in columns)).select(estimate.cast("double").alias("delta"), "n_clusters").first()  # one row
    drawn = resampled(sums, cluster, columns, draws, seed).select(estimate.cast("double").alias("e"))
    ends = drawn.agg(F.percentile("e", F.lit(low / 100)).alias("low"), F.percentile("e", F.lit(high / 100)).alias("high"), F.count_if(F.col("e").isNull()).alias("undefined"))
    delta, many = F.lit(whole["delta"]).cast("double"), whole["n_clusters"]
    out = ends.select(delta.alias("delta"), "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"), F.lit(many).cast("long").alias("n_clusters"), "undefined")
    return out if many else out.limit(0)


def cluster_bootstrap(rows: DataFrame, cluster: str, a: str, b: str, size: str, draws: int = 10_000, seed: int = 7, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """One row: delta of the rates of a and b with a percentile interval over resampled clusters."""
    sums = clusters(rows, cluster, a, b, size)
    return cluster_interval(sums, cluster, ["d", "n"], F.col("d") / F.nullif(F.col("n"), F.lit(0.0)), draws, seed, low, high).drop("undefined")


def wild_cluster_test(rows: DataFrame, hypothesis: str, cluster: str, a: str, b: str, size: str, delta0: float = 0.0, draws: int = 9_999, seed: int = 1, alternative: str = "two-sided") -> DataFrame:
    """Per hypothesis: delta, its clustered standard error, t, and p of a wild cluster bootstrap with the null imposed.

    In each draw a cluster's distance from the null keeps or turns its sign, as a die of the seed, the draw and the cluster
    says. A draw's estimate and its error need four sums over clusters only: of the new distances, of their squares, of their
    products with the sizes, and of the squared sizes. Without any spread p is 1 where the estimate meets the null (or lies on
    its side), else the least possible."""
    sums = rows.groupBy(hypothesis, cluster).agg(F.sum(F.col(a) - F.col(b)).cast("double").alias("d"), F.sum(size).cast("double").alias("n"))
    parts = lambda x, *keys: [*keys, F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.sum(x * F.col("n")).alias("sn")]
    spread = lambda: F.sqrt(F.greatest(F.lit(0.0), F.col("ss") - 2 * F.col("s") / F.col("size") * F.col("sn") + F.pow(F.col("s") / F.col("size"), F.lit(2)) * F.col("nn"))) / F.col("size")
    flat = lambda: F.col("spread") <= 1e-9 * F.sqrt("ss") / F.col("size")
    whole = sums.groupBy(hypothesis).agg(*parts(F.col("d")), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("n_clusters"))
    whole = whole.withColumns({"delta": F.col("s") / F.col("size"), "spread": spread()})
    whole = whole.withColumns({"se": F.when(flat(), 0.0).otherwise(F.col("spread"))}).withColumn("t", F.when(F.col("se") > 0, (F.col("delta") - delta0) / F.col("se")).otherwise(0.0))
    facts = whole.select(hypothesis, "size", "nn", "n_clusters", "delta", "se", "t")
    turned = F.lit(delta0) * F.col("n") + (F.col("d") - F.lit(delta0) * F.col("n")) * (1 - 2 * _dice(2, F.lit(seed), F.col("draw"), F.col(cluster)))
    drawn = _draws(sums, draws).withColumn("d", turned).groupBy(hypothesis, "draw").agg(*parts(F.col("d")))
    drawn = drawn.join(facts, hypothesis).withColumns({"gap": F.col("s") / F.col("size") - delta0, "spread": spread()})
    far = F.when(~flat(), F.col("gap") / F.col("spread")).when(F.abs("gap") <= 1e-12, 0.0).otherwise(F.lit(float("inf")))
    hit = (far <= F.col("t") + 1e-9) if alternative == "less" else (F.abs(far) >= F.abs(F.col("t")) - 1e-9)
    hits = drawn.groupBy(hypothesis).agg(F.count_if(hit).alias("hits"))
    holds = (F.abs(F.col("delta") - delta0) <= 1e-12) | (F.lit(alternative == "less") & (F.col("delta") > delta0))
    least = F.lit(1 / (draws + 1))
    p = F.when(F.col("se") > 0, (1 + F.col("hits")) * least).when(holds, 1.0).otherwise(least)
    return facts.join(hits, hypothesis).select(hypothesis, "delta", "se", "n_clusters", "t", p.alias("p"))


def permutation_null(rows: DataFrame, cluster: str, score: str, label: str, draws: int = 500, seed: int = 3) -> DataFrame:
    """One row: AUROC, the mean AUROC under labels shuffled within clusters, and the share of shuffles that reach it.

    In each draw the rows of a cluster that come first by an MD5 of the seed, the draw and their place hold its positive labels; the
    sum of their ranks over all clusters gives the draw's AUROC. Rows are counted and summed by the first two digits of that MD5; only those
    of the digits at which a cluster's number is reached are put in order, a 256th of all."""
    known = rows.filter(F.col(score).isNotNull()).select(F.col(cluster).alias("c"), F.col(score).alias("s"), F.col(label).cast("boolean").alias("y"))
    counts = _counts(known, [], "s", F.col("y")).select("s", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))
    seen = auroc(known, [], "s", F.col("y")).first()["auroc"]
    whole = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")).first()  # one row
    own = known.groupBy("c").agg(F.count_if("y").alias("pos")).filter("pos > 0")
    place = F.row_number().over(Window.partitionBy("c").orderBy("s", "y"))
    ranked = cut(known.withColumn("place", place).join(counts, "s").join(own, "c").select("c", "place", "rank", "pos"))
    die = lambda draw: F.md5(F.concat_ws("|", F.lit(seed), draw, "c", "place"))
    cells = _draws(ranked, draws).groupBy("c", "draw", F.left(die(F.col("draw")), F.lit(2)).alias("cell")).agg(F.first("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c", "draw").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut(cells.withColumn("need", F.col("pos") - before).filter("need > 0"))
    split = cells.filter("need < n").groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("draw", F.struct("cell", "need")))).alias("split"))  # a row for each cluster
    picked = ranked.join(split, "c").select("c", "place", "rank", "split", F.explode(F.filter(F.map_keys("split"), lambda d: F.left(die(d), F.lit(2)) == F.col("split")[d]["cell"])).alias("draw"))
    order = F.row_number().over(Window.partitionBy("c", "draw").orderBy(die(F.col("draw")), "place"))
    last = picked.select("c", "draw", "place", "rank", F.col("split")[F.col("draw")]["need"].alias("need")).withColumn("_r", order).filter("_r <= need")
    sums = cells.filter("need >= n").select("draw", "ranks").unionByName(last.select("draw", F.col("rank").alias("ranks"))).groupBy("draw").agg(F.sum("ranks").alias("ranks"))
    pos, neg = whole["pos"], whole["n"] - whole["pos"]
    area = (F.col("ranks") - F.lit(pos * (pos + 1) / 2)) / F.lit(float(max(1, pos * neg)))
    return sums.select(area.alias("a")).agg(F.lit(seen).cast("double").alias("auroc"), F.avg("a").alias("null_mean"), F.avg((F.col("a") >= F.lit(seen) - 1e-12).cast("double")).alias("p"))


def fit_threshold(rows: DataFrame, score: str, gain: str, keys: list[str]) -> DataFrame:
    """Per key the threshold at which acting on scores at or above it gains most in sum (the larger of equals); null if nothing gains.

    The sums over thresholds are a running sum over distinct scores, highest first."""
    sums = rows.groupBy(*keys, score).agg(F.sum(gain).alias("g"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    curve = sums.withColumn("total", F.sum("g").over(w))
    best = curve.groupBy(*keys).agg(F.max(F.struct("total", score)).alias("b"))
    return best.select(*keys, F.when(F.col("b.total") > 0, F.col(f"b.{score}")).alias("threshold"), F.greatest(F.lit(0), F.col("b.total")).alias("total"))
