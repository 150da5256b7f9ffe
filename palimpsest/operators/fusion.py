"""What follows an alignment: guards, choices by confidence, boundary disagreements, zones, cells, seams and hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut

from . import intervals
from .alignment import consensus, vote

_ENDLESS = float("inf")


def compose_guarded(columns: Column, pivot: Column | int, fire: Column, priority: tuple[int, ...] = (0, 1, 2)) -> Column:
    """The voted words of all columns; in a column whose index is in ``fire`` a word that one stream alone has stays."""

    def word(c: Column, i: Column) -> Column:
        present = F.array_compact(c)
        alone = F.array_contains(fire, i) & (F.size(present) == 1)
        return F.coalesce(vote(c, pivot, priority)["token"], F.when(alone, F.get(present, F.lit(0))))

    return F.array_compact(F.transform(columns, word))


def override(tokens: Column, choices: Column, least: float) -> Column:
    """``tokens`` with those of ``choices`` (struct i, token, confidence) in their places whose confidence is ``least`` or more; null takes a word away."""
    sure = F.filter(choices, lambda c: c["confidence"] >= least)

    def word(t: Column, i: Column) -> Column:
        here = F.filter(sure, lambda c: c["i"] == i)
        return F.when(F.size(here) > 0, F.element_at(here, -1)["token"]).otherwise(t)

    return F.array_compact(F.transform(tokens, word))


def split_or_merged(columns: Column) -> Column:
    """Indices of neighbouring columns in which two streams spell the same letters but cut them into words at different places."""

    def clash(c: Column, d: Column) -> Column:
        letters = lambda s: F.concat(F.coalesce(F.get(c, F.lit(s)), F.lit("")), F.coalesce(F.get(d, F.lit(s)), F.lit("")))
        same = lambda x, y: (letters(x) != "") & (letters(x) == letters(y)) & ~(F.get(c, F.lit(x)).eqNullSafe(F.get(c, F.lit(y))) & F.get(d, F.lit(x)).eqNullSafe(F.get(d, F.lit(y))))
        return same(0, 1) | same(0, 2) | same(1, 2)

    found = F.flatten(F.transform(columns, lambda c, i: F.when((i + 1 < F.size(columns)) & F.coalesce(clash(c, F.get(columns, i + 1)), F.lit(False)), F.array(i, i + 1)).otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(found))


def zones(rows: DataFrame, keys: list[str], order: str, conflict: Column, gap: str, t: str) -> DataFrame:
    """Maximal runs of conflicting rows of a key: first and last place, rows, earliest and latest time, largest gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumns({"_bad": F.coalesce(conflict, F.lit(False)), "_p": F.row_number().over(w)}).filter("_bad")
    marked = marked.withColumn("_run", F.col("_p") - F.row_number().over(w))
    return marked.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.min(t).alias("page_start"), F.max(t).alias("page_end"), F.max(gap).alias("max_gap")).drop("_run")


def deletion_runs(rows: DataFrame, keys: list[str], order: str, op: str, t: str, least: int = 3) -> DataFrame:
    """Spans (start, end) of runs of ``least`` or more deletions that follow each other."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_p", F.row_number().over(w)).filter(F.col(op) == "D").withColumn("_run", F.col("_p") - F.row_number().over(w))
    spans = marked.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.min_by(t, order).alias("start"), F.max_by(t, order).alias("end"))
    return spans.filter(F.col("_n") >= least).drop("_run", "_n")


def cells(cuts: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Half-open cells (start, end) between cuts that tile all time; a key with cuts has one cell more than cuts."""
    w = Window.partitionBy(*keys).orderBy(t)
    after = cuts.select(*keys, F.col(t).cast("double").alias("start"), F.coalesce(F.lead(t).over(w).cast("double"), F.lit(_ENDLESS)).alias("end"))
    first = cuts.groupBy(*keys).agg(F.min(t).cast("double").alias("end")).select(*keys, F.lit(-_ENDLESS).alias("start"), "end")
    return first.unionByName(after)


def in_cells(tokens: DataFrame, cuts: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """``cell``: how many cuts of the key stand at or before a token, by one sorted pass over both."""
    both = tokens.withColumn("_cut", F.lit(0)).unionByName(cuts.select(*keys, t).withColumn("_cut", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("cell", F.sum("_cut").over(upto)).filter("_cut = 0").drop("_cut")


def other_changes(stretches: DataFrame, spans: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Times between neighbouring ``stretches`` (start, end) of a key at which the active set changes, but for those inside ``spans``, ends included."""
    w = Window.partitionBy(*keys).orderBy("start")
    changes = stretches.withColumn("t", (F.col("end") + F.lead("start").over(w)) / 2).filter("t IS NOT NULL").select(*keys, "t").distinct()
    bucket = lambda x: F.floor(x / F.lit(float(width))).cast("long")
    reach = spans.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("_bucket"))
    joined = changes.withColumn("_bucket", bucket(F.col("t"))).alias("c")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("c._bucket") == F.col("s._bucket"), F.col("t") >= F.col("_a"), F.col("t") <= F.col("_b")]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return joined.join(reach.alias("s"), condition, "left_anti").select(*(f"c.{k}" for k in keys), "t")


def eligible(stretches: DataFrame, rate: float, least_seconds: float = 1.5, least_words: int = 3) -> DataFrame:
    """Stretches (start, end, n) in which a loss can be told: of one speaker and long enough, or long enough for ``least_words`` of one of several."""
    seconds = F.col("end") - F.col("start")
    return stretches.filter(F.when(F.col("n") == 1, seconds >= least_seconds).otherwise(F.lit(rate) * seconds >= least_words))


def backwards(rows: DataFrame, keys: list[str], order: list, t: str, tolerance: float = 1e-6) -> DataFrame:
    """``backwards`` where a time lies before the largest one so far, and by how much (``regression``); null times tell nothing."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.max(t).over(w) - F.col(t)
    late = F.coalesce(behind > tolerance, F.lit(False))
    return rows.withColumns({"backwards": late, "regression": F.when(late, F.round(behind, 3))})


def seam_kept(candidates: DataFrame, windows: DataFrame, keys: list[str], tolerance: float = 1e-7) -> DataFrame:
    """Candidates (window, start, end) that their own window (window, w_start, w_end, own_start, own_end) is to give.

    A candidate belongs to the window that covers its midpoint with the nearest centre, the first of equals; those of other
    windows are copies of what that one gives, and so are those outside what it owns."""
    middle = (F.col("start") + F.col("end")) / 2
    named = candidates.withColumns({"_id": F.monotonically_increasing_id(), "_middle": middle})
    mine = windows.select(*keys, F.col("window").alias("_w"), "w_start", "w_end", "own_start", "own_end")
    # A candidate and the windows that cover its midpoint share a bucket of about a window's length: many windows of one key are no product.
    width = F.broadcast(windows.agg(F.max(F.col("w_end") - F.col("w_start")).alias("_width")).select(F.greatest("_width", F.lit(1e-3)).alias("_width")))  # one row
    bucket = lambda t: F.floor(t / F.col("_width")).cast("long")
    placed = mine.crossJoin(width).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("w_start") - tolerance), bucket(F.col("w_end") + tolerance)))).drop("_width")
    points = named.crossJoin(width).withColumn("_bucket", bucket(F.col("_middle"))).drop("_width")
    covering = points.join(placed, [*keys, "_bucket"]).filter(F.col("_middle").between(F.col("w_start") - tolerance, F.col("w_end") + tolerance))
    near = F.struct(F.abs(F.col("_middle") - (F.col("w_start") + F.col("w_end")) / 2), F.col("_w"))
    w = Window.partitionBy(*keys, *(c for c in candidates.columns if c not in keys), "_id").orderBy(near)
    best = covering.withColumn("_r", F.row_number().over(w)).filter("_r = 1 AND _w = window")
    return best.filter(F.col("_middle").between(F.col("own_start") - tolerance, F.col("own_end") + tolerance)).select(*candidates.columns)


def word_parts(tokens: Column, start: Column, end: Column) -> Column:
    """Spans, array of struct(token, start, end), of the tokens of one timed word: its time in shares of their lengths."""
    size = lambda ts: F.aggregate(ts, F.lit(0), lambda acc, t: acc + F.length(t))
    total = F.greatest(F.lit(1), size(tokens))
    at = lambda i: start + (end - start) * size(F.slice(tokens, F.lit(1), i)) / total
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), at(i).alias("start"), F.when(i + 1 == F.size(tokens), end).otherwise(at(i + 1)).alias("end")))


def distinct_hypotheses(rows: DataFrame, keys: list[str], form: Column, rank: str) -> DataFrame:
    """Of hypotheses with the same form the one of the best rank."""
    w = Window.partitionBy(*keys, form).orderBy(rank)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rescored(rows: DataFrame, keys: list[str], rank: str, a: str, b: str, weight: float, scale_a: float, scale_b: float) -> DataFrame:
    """One hypothesis per key: that of the largest gain over the first one, (a - a0) / scale_a + weight * (b - b0) / scale_b, if any gains; the better rank on a tie.
    Gains count to nine decimals: equal ones differ beyond by the rounding of their sums."""
    top = rows.groupBy(*keys).agg(F.min_by(F.struct(a, b), rank).alias("_top"))
    gain = (F.col(a) - F.col(f"_top.{a}")) / scale_a + weight * (F.col(b) - F.col(f"_top.{b}")) / scale_b
    w = Window.partitionBy(*keys).orderBy(F.desc("gain"), rank)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(rank)) == 1
    scored = rows.join(top, keys).withColumn("gain", F.when(first, 0.0).otherwise(F.round(gain, 9))).drop("_top")
    return scored.filter("gain >= 0").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def first_least(totals: DataFrame, setting: str, cost: str) -> DataFrame:
    """The setting of least cost, the least setting of equals."""
    return totals.agg(F.min_by(setting, F.struct(cost, setting)).alias(setting), F.min(cost).alias(cost))


def partition_vote(tokens: DataFrame, cuts: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Per cell between cuts the words of the stream that is most like the others: (keys, cell, winner, words).

    ``tokens``: keys, stream (0, 1, 2), pos, token and time. A cell without words in a stream counts that one as empty."""
    placed = in_cells(tokens, cuts, keys, t)
    words = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("stream") == n, F.struct("pos", "token")))), lambda x: x["token"])
    streams = placed.groupBy(*keys, "cell").agg(*(words(n).alias(f"s{n}") for n in range(3)))
    chosen = streams.withColumn("winner", consensus("s0", "s1", "s2"))
    return chosen.select(*keys, "cell", "winner", F.get(F.array("s0", "s1", "s2"), F.col("winner")).alias("words"))


def drift_guard(rows: DataFrame, keys: list[str], order: str, occupants: Column, starts: Column, tolerance: float) -> DataFrame:
    """``rows``, columns of an alignment in order, with ``disagrees``, ``thin``, ``zone`` (number within the key, null outside) and ``fires``.

    A column disagrees if it has two times or more (``starts``, an array without nulls) that lie further apart than ``tolerance``, and is thin if it has
    one occupant. A run of columns that are either is a zone if two of them disagree, for one odd time is no drift; thin columns of a zone
    fire."""
    w = Window.partitionBy(*keys).orderBy(order)
    apart = (F.size(starts) >= 2) & (F.array_max(starts) - F.array_min(starts) > tolerance)
    known = rows.withColumns({"disagrees": F.coalesce(apart, F.lit(False)), "thin": F.coalesce(occupants == 1, F.lit(False))})
    odd = F.col("disagrees") | F.col("thin")
    runs = known.withColumn("_p", F.row_number().over(w)).withColumn("_run", F.when(odd, F.col("_p") - F.row_number().over(Window.partitionBy(*keys, odd).orderBy(order))))
    of_run = Window.partitionBy(*keys, "_run")
    drift = runs.withColumn("_zone", F.col("_run").isNotNull() & (F.sum(F.col("disagrees").cast("int")).over(of_run) >= 2))
    first = F.col("_zone") & ~F.coalesce(F.lag("_zone").over(w), F.lit(False))
    numbered = drift.withColumn("zone", F.when(F.col("_zone"), F.sum(first.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return numbered.withColumn("fires", F.col("_zone") & F.col("thin")).drop("_p", "_run", "_zone")


# --- arms over the overlaps of a timeline --------------------------------------------------------------------------


def overlap_mask(active: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start, end) of each overlap with its two neighbouring stretches, touching ones merged. ``active``: keys, start, end, n (speakers)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    wide = active.withColumns({"_low": F.coalesce(F.lag("start").over(w), F.col("start")), "_high": F.coalesce(F.lead("end").over(w), F.col("end"))})
    return intervals.merge(wide.filter("n >= 2").select(*keys, F.col("_low").alias("start"), F.col("_high").alias("end")), keys)


def interior(cuts: DataFrame, spans: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Distinct cuts (keys, t) that lie strictly inside a span: at its edges there is an edge of the cells already."""
    hit = intervals.point_join(cuts.select(*keys, "t").distinct(), spans, keys, width)
    return hit.filter("t > start").select(*keys, "t").distinct()


def matched_cuts(pool: DataFrame, wanted: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """As many cuts of ``pool`` (keys, t) as ``wanted`` has for the key, in seeded order; keys whose pool has too few are left out (no row, though cuts are wanted)."""
    k = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys)
    order = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in keys), F.col("t").cast("string")))
    ranked = pool.join(k, keys).withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(order, "t"))})
    return ranked.filter("_n >= _k AND _r <= _k").select(*keys, "t")


def overlap_arms(active: DataFrame, tokens: DataFrame, base: DataFrame, cuts: dict[str, DataFrame], keys: list[str], width: float) -> DataFrame:
    """(keys, arm, words, dose, replaced): what ``base`` (keys, pos, token, t) becomes in each arm.

    Every arm takes the same mask (``overlap_mask``), cuts it at its own times (``cuts``: arm -> keys, t) into cells, and in each cell inside the mask puts
    the words of the stream that is most like the others (``tokens``: keys, stream 0 to 2, pos, token, t) in the place of those of the base;
    outside it the base stays. ``dose`` is the number of cuts inside the mask, ``replaced`` that of words of the base that went. A key
    without an overlap keeps its words in all arms.

    The mask, and both tables of words, are made once and stored; arms are a key beside ``keys`` from then on, so that all of them are cut,
    placed and voted on in one plan, however many they are."""
    spans = cut(overlap_mask(active, keys))
    names = F.explode(F.array(*map(F.lit, cuts))).alias("arm")
    own = [*keys, "arm"]
    each = spans.select("*", names)
    inner = [interior(df, spans, keys, width).withColumn("arm", F.lit(name)) for name, df in cuts.items()]
    chosen = inner[0]
    for more in inner[1:]:
        chosen = chosen.unionByName(more)
    chosen = cut(chosen)
    ends = each.select(*own, F.col("start").alias("t")).unionByName(each.select(*own, F.col("end").alias("t"))).unionByName(chosen.select(*own, "t")).distinct()
    said, kept = cut(tokens.join(spans.select(*keys).distinct(), keys, "left_semi")), cut(base)
    tiles = cells(ends, own).withColumn("cell", F.row_number().over(Window.partitionBy(*own).orderBy("start")) - 1)
    middle = (F.when(F.col("start") == -_ENDLESS, F.col("end") - 1).otherwise(F.col("start")) + F.when(F.col("end") == _ENDLESS, F.col("start") + 1).otherwise(F.col("end"))) / 2
    within = intervals.point_join(tiles.select(*own, "cell", middle.alias("t")), each, own, width).select(*own, "cell").distinct()
    mine = in_cells(kept.join(spans.select(*keys).distinct(), keys, "left_semi").select("*", names), ends, own)
    voted = partition_vote(said.select("*", names), ends, own).join(within, [*own, "cell"], "left_semi")
    outside = mine.join(within, [*own, "cell"], "left_anti").groupBy(*own, "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("words"))
    gone = mine.join(within, [*own, "cell"], "left_semi").groupBy(*own).agg(F.count(F.lit(1)).alias("replaced"))
    parts = voted.select(*own, "cell", "words").unionByName(outside).groupBy(*own).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "words"))), lambda x: x["words"])).alias("words"))
    dose = chosen.groupBy(*own).agg(F.count(F.lit(1)).alias("dose"))
    rest = kept.join(spans.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("words"))
    whole = parts.unionByName(rest.select(*keys, names, "words"))
    return whole.join(dose, own, "left").join(gone, own, "left").select(*own, "words", F.coalesce("dose", F.lit(0)).alias("dose"), F.coalesce("replaced", F.lit(0)).alias("replaced"))
