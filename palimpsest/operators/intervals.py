"""Half-open intervals: islands, sweeps, gaps, set operations and joins.

Interval joins carry a bucket key: the longer side is spread over the buckets of time it touches and joined by
equality, with the exact condition beside it, instead of comparing every row with every other. A
pair that meets in several buckets is taken in the one where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t.cast("double") / F.lit(float(width))).cast("long")


def merge(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: float = 0.0) -> DataFrame:
    """Touching or overlapping spans of a key (or closer than ``gap``) as one; empty and inverted spans are dropped."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.filter(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > reach + gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(spans: DataFrame, keys: list[str], least: float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """What lies between consecutive islands of a key, from ``least`` on."""
    w = Window.partitionBy(*keys).orderBy(start)
    rows = merge(spans, keys, start, end).withColumn("_next", F.lead(start).over(w))
    return rows.filter(F.col("_next") - F.col(end) >= least).select(*keys, F.col(end).alias(start), F.col("_next").alias(end))


def sweep(spans: DataFrame, keys: list[str], member: str, start: str = "start", end: str = "end") -> DataFrame:
    """Maximal stretches of a key with a constant number of distinct members (``n_members`` of at least 1).

    Members are merged by themselves first, so that a member's own overlaps count once; then starts
    and ends are summed up in order of time."""
    own = merge(spans, [*keys, member], start, end)
    events = own.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(own.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = events.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    steps = steps.filter("d <> 0").select(*keys, F.col("t").alias(start), F.lead("t").over(w).alias(end), F.sum("d").over(w).alias("n_members"))
    return steps.filter("n_members > 0")


def overlaps(spans: DataFrame, keys: list[str], member: str, least: int = 2, start: str = "start", end: str = "end") -> DataFrame:
    """Islands in which at least ``least`` distinct members are active."""
    return merge(sweep(spans, keys, member, start, end).filter(F.col("n_members") >= least), keys, start, end)


def handovers(spans: DataFrame, keys: list[str], member: str, start: str = "start", end: str = "end") -> DataFrame:
    """Between consecutive spans of different members: the middle of the end of one and the start of the next."""
    w = Window.partitionBy(*keys).orderBy(start, end, member)
    rows = spans.select(*keys, start, member, F.lag(member).over(w).alias("before"), F.lag(end).over(w).alias("_end"))
    return rows.filter(F.col("before") != F.col(member)).select(*keys, "before", F.col(member).alias("after"), ((F.col("_end") + F.col(start)) / 2).alias("t"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("r_start", "r_end"), how: str = "overlap") -> DataFrame:
    """Pairs of one key whose spans overlap, or whose left span lies ``within`` the right one.

    ``width`` is the bucket: about the length of a usual span. Columns other than ``keys`` must differ in name."""
    a, b = left_span
    c, d = right_span
    # The last bucket of a half-open span is that of the largest time below its end.
    last = lambda s, e: F.greatest(_bucket(s, width), F.ceil(e.cast("double") / float(width)).cast("long") - 1)
    x = left.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(a), width), last(F.col(a), F.col(b)))))
    y = right.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(c), width), last(F.col(c), F.col(d)))))
    out = x.join(y, [*keys, "_bucket"]).filter(F.col("_bucket") == _bucket(F.greatest(F.col(a), F.col(c)), width))
    condition = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) if how == "overlap" else (F.col(c) <= F.col(a)) & (F.col(b) <= F.col(d))
    return out.filter(condition).drop("_bucket")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], width: float, t: str = "t", span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """(point, span) pairs of one key with start <= t < end."""
    a, b = span
    y = spans.filter(F.col(b) > F.col(a)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(a), width), _bucket(F.col(b), width))))
    return points.withColumn("_bucket", _bucket(F.col(t), width)).join(y, [*keys, "_bucket"]).filter((F.col(t) >= F.col(a)) & (F.col(t) < F.col(b))).drop("_bucket")


def overlap_seconds(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def intersect(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Parts that both sets of (start, end) cover."""
    y = merge(right, keys).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    return interval_join(merge(left, keys), y, keys, width).select(*keys, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Parts that the left set covers and the right one does not, by one sweep over both."""
    mark = lambda df, a, b: merge(df, keys).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(a).alias("l"), F.lit(b).alias("r")), F.struct(F.col("end").alias("t"), F.lit(-a).alias("l"), F.lit(-b).alias("r")))).alias("e")).select(*keys, "e.*")
    steps = mark(left, 1, 0).unionByName(mark(right, 0, 1)).groupBy(*keys, "t").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy("t")
    steps = steps.select(*keys, F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.sum("l").over(w).alias("l"), F.sum("r").over(w).alias("r"))
    return merge(steps.filter("l > 0 AND r = 0").select(*keys, "start", "end"), keys)


def assign_members(items: DataFrame, spans: DataFrame, keys: list[str], item: str, member: str, width: float, ambiguous: float = 0.8) -> DataFrame:
    """For each item (start, end) the member of ``spans`` (r_start, r_end) that overlaps it longest.

    ``status``: non_speech without overlap; ambiguous if the second member has ``ambiguous`` of the first's
    seconds or more; else named. Ties go to the least member."""
    pairs = interval_join(items, spans, keys, width)
    sums = pairs.groupBy(*keys, item, member).agg(F.sum(overlap_seconds(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("seconds"))
    w = Window.partitionBy(*keys, item).orderBy(F.desc("seconds"), member)
    ranked = sums.select("*", F.row_number().over(w).alias("_rank"), F.lead("seconds").over(w).alias("runner_up"))
    best = ranked.filter("_rank = 1").drop("_rank")
    status = F.when(F.col(member).isNull(), "non_speech").when(F.col("runner_up") >= ambiguous * F.col("seconds"), "ambiguous").otherwise("named")
    return items.join(best, [*keys, item], "left").withColumn("status", status)


def nearest(points: DataFrame, others: DataFrame, keys: list[str], t: str = "t", other_t: str = "other_t") -> DataFrame:
    """Each point with the nearest other time of its key, earlier on a tie: as-of in both directions, by one sorted pass."""
    both = points.select(*points.columns, F.lit(None).cast(others.schema[other_t].dataType).alias("_o")).unionByName(others.select(*keys, F.col(other_t).alias("_o"), F.col(other_t).alias(t)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(t))
    before = F.last("_o", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_o", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"_before": before, "_after": after}).filter("_o IS NULL")
    near = F.when(F.col("_after").isNull() | (F.col(t) - F.col("_before") <= F.col("_after") - F.col(t)), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    return rows.withColumn(other_t, near).drop("_o", "_before", "_after")


def windows(spans: DataFrame, size: float, stride: float, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping windows of ``size`` at every ``stride`` that cover each span exactly; each owns its centre, the outer ones the ends too."""
    count = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start) - size) / stride).cast("int") + 1)
    rows = spans.withColumn("_n", count).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low = F.col(start) + F.col("window") * stride
    centre = (size - stride) / 2
    return rows.withColumns({
        "w_start": low,
        "w_end": F.least(low + size, F.col(end)),
        "own_start": F.when(F.col("window") == 0, F.col(start)).otherwise(low + centre),
        "own_end": F.when(F.col("window") == F.col("_n") - 1, F.col(end)).otherwise(low + centre + stride),
    }).drop("_n")


def uncovered(tiles: DataFrame, keys: list[str], start: str = "own_start", end: str = "own_end") -> DataFrame:
    """Tiles of a key that do not begin where the one before ends: none if the cover is exact."""
    w = Window.partitionBy(*keys).orderBy(start)
    return tiles.withColumn("_before", F.lag(end).over(w)).filter(F.abs(F.col("_before") - F.col(start)) > 1e-9)


def invalid_sequences(segments: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Segments that are negative, inverted or begin before the one before them."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return segments.withColumn("_before", F.lag(start).over(w)).filter((F.col(start) < 0) | (F.col(end) < F.col(start)) | (F.col(start) < F.col("_before"))).drop("_before")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal ``value`` in order: first and last place and length. Nulls form runs of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place = F.row_number().over(w)
    flag = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = rows.withColumn("_place", place).withColumn("_new", F.when(F.col("_place") == 1, 1).otherwise(flag))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run", value).agg(F.min("_place").cast("long").alias("first_place"), F.max("_place").cast("long").alias("last_place"), F.count(F.lit(1)).alias("length")).drop("_run")


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``value`` with the last one before where it is null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def turns(rows: DataFrame, keys: list[str], member: str, silence: float, start: str = "start", end: str = "end") -> DataFrame:
    """Consecutive rows of one member, cut where ``silence`` or more lies between."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    new = (F.lag(member).over(w) != F.col(member)) | (F.col(start) - F.lag(end).over(w) >= silence)
    marked = rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("_turn", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_turn", member).agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_turn")


def monotone(rows: DataFrame, keys: list[str], order: list[str], t: str) -> DataFrame:
    """Times raised to the largest so far, so that they never fall; ``raised`` marks those that were changed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    high = F.max(t).over(w)
    return rows.withColumn("_high", high).withColumn("raised", F.col("_high") > F.col(t)).withColumn(t, F.col("_high")).drop("_high")


def context(rows: DataFrame, keys: list[str], order: list[str], value: str, before: int, after: int) -> DataFrame:
    """``value`` of the rows before and after each row of a key, as arrays in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"before": F.collect_list(value).over(w.rowsBetween(-before, -1)), "after": F.collect_list(value).over(w.rowsBetween(1, after))})


def active_sets(spans: DataFrame, keys: list[str], member: str, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Maximal stretches of a key with the same set of active members (``members``, sorted).

    All ends of a key cut time into elementary stretches; the members' spans are joined to these by bucket, and
    neighbours of one set are put together."""
    own = merge(spans, [*keys, member], start, end)
    w = Window.partitionBy(*keys).orderBy(start)
    cuts = own.select(*keys, F.explode(F.array(start, end)).alias(start)).distinct().withColumn(end, F.lead(start).over(w)).filter(F.col(end).isNotNull())
    named = own.select(*keys, member, F.col(start).alias("r_start"), F.col(end).alias("r_end"))
    sets = interval_join(cuts, named, keys, width, (start, end)).groupBy(*keys, start, end).agg(F.array_join(F.array_sort(F.collect_set(member)), "+").alias("members"))
    new = (F.lag("members").over(w) != F.col("members")) | (F.lag(end).over(w) != F.col(start))
    marked = sets.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run", "members").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def agreeing(streams: list[DataFrame], keys: list[str], tolerance: float, token: str = "token", t: str = "t") -> DataFrame:
    """Places at which all streams have one token within ``tolerance`` of each other: the first stream's (token, t) with the others' times.

    Joined by token and by time bucket, each place with its own bucket and the two beside it."""
    out = streams[0]
    for n, other in enumerate(streams[1:], 1):
        bucket = _bucket(F.col(t), tolerance)
        near = other.select(*keys, token, F.col(t).alias(f"t{n}"), F.explode(F.array(*(_bucket(F.col(t), tolerance) + d for d in (-1, 0, 1)))).alias("_bucket"))
        out = out.withColumn("_bucket", bucket).join(near, [*keys, token, "_bucket"]).filter(F.abs(F.col(t) - F.col(f"t{n}")) <= tolerance).drop("_bucket")
    return out


def floor_changes(spans: DataFrame, keys: list[str], schema_key: str, member: str, width: float) -> DataFrame:
    """Where the floor passes to others: (cut, low, high), the cut in the middle of the span from the last stretch with anyone of the
    holding set to the first with none of it, which then holds. Newcomers beside a holder do not hold.

    Each step depends on who holds, so the stretches of a key (``active_sets``) are walked in order."""
    import pandas as pd

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        out, holders, last = [], None, 0.0
        for row in group.sort_values("start").itertuples(index=False):
            here = set(row.members.split("+"))
            if holders is None or not here & holders:
                if holders is not None:
                    out.append([*(getattr(row, k) for k in keys), (last + row.start) / 2, last, row.start])
                holders = here
            last = row.end
        return pd.DataFrame(out, columns=[*keys, "cut", "low", "high"])

    return active_sets(spans, keys, member, width).groupBy(*keys).applyInPandas(walk, f"{schema_key}, cut double, low double, high double")


def overlap_matches(both: DataFrame, keys: list[str], schema_key: str) -> DataFrame:
    """One-to-one matches of 'flag' spans, in order of start, each to the first free 'truth' span that it overlaps, per key."""
    import pandas as pd

    def match(group: pd.DataFrame) -> pd.DataFrame:
        flags, truths = (group[group["side"] == side].sort_values(["start", "end"]) for side in ("flag", "truth"))
        free, out = list(truths[["start", "end"]].itertuples(index=False)), []
        for flag in flags.itertuples(index=False):
            hit = next((t for t in free if flag.start < t.end and t.start < flag.end), None)
            if hit is not None:
                free.remove(hit)
                out.append([*(getattr(flag, k) for k in keys), flag.start, flag.end, hit.start])
        return pd.DataFrame(out, columns=[*keys, "start", "end", "truth_start"])

    return both.groupBy(*keys).applyInPandas(match, f"{schema_key}, start double, end double, truth_start double")
