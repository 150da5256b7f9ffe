"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash that is uniform and does not depend on the run. A source's budget
is met by taking the documents whose hash is below a threshold; the threshold is found from
histograms of tokens by hash bucket, first over coarse buckets, then over finer ones within the
one bucket in which the budget runs out. Nothing is sorted and no document is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, stored

#: Bits of the hash, and bits that each level of the histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 10
#: Sources broadcast at most, some 50 bytes each; beyond, the plan is joined by source.
BROADCAST_SOURCES = 50_000
#: Sources in a range at least, where they are put in order.
RANGE_SOURCES = 10_000


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: float = 3) -> dict[str | None, float]:
    """Tokens to take of each source: the total, shared by weight, none above ``most`` times its size. (``targets`` does so for a table.)

    Weights repeat over the sources in code-point order, null last. What a source cannot give is
    shared again by weight among the rest until none is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * share for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def _point(key: str, seed: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(f"`{key}`").cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """``key``, source, size in words and hash of every document; no text."""
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _point(key, seed).alias("point"))


def _small(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table


def thresholds(rows: DataFrame, budgets: DataFrame, few: bool = False) -> DataFrame:
    """For each source of ``budgets`` (source, budget; ``few`` if they may be broadcast): ``below``, such that documents with a smaller hash hold about ``budget`` tokens.

    Each level reads the rows within the last boundary bucket only and sums them into 2**LEVEL_BITS
    buckets a source. At the last level a bucket holds documents of one hash; that bucket is in
    if this brings the sum nearer to the budget."""
    found = budgets.select("source", F.col("budget"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("held"))
    for level in range(HASH_BITS // LEVEL_BITS):
        width = 1 << (HASH_BITS - LEVEL_BITS * (level + 1))
        span = width << LEVEL_BITS
        near = rows.join(_small(found, few), rows["source"].eqNullSafe(found["source"])).filter((F.col("point") >= F.col("start")) & (F.col("point") < F.col("start") + span))
        bucket = F.expr(f"(point - start) div {width}")
        sums = near.groupBy(found["source"], F.col("budget"), F.col("start"), F.col("held"), bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        # A source has 1,024 buckets at most here, whatever its number of documents.
        lists = sums.groupBy("source", "budget", "start", "held").agg(F.array_sort(F.collect_list(F.struct("bucket", "tokens"))).alias("hist"))
        step = F.aggregate(
            "hist",
            F.struct(F.col("held").alias("held"), F.lit(-1).cast("long").alias("at")),
            lambda acc, x: F.when((acc["at"] < 0) & (acc["held"] + x["tokens"] <= F.col("budget")), F.struct((acc["held"] + x["tokens"]).alias("held"), acc["at"].alias("at")))
            .when(acc["at"] < 0, F.struct(acc["held"].alias("held"), x["bucket"].alias("at")))
            .otherwise(acc),
        )
        lists = lists.withColumn("_step", step)
        edge = F.col("_step.at")
        in_edge = F.element_at(F.transform(F.filter("hist", lambda x: x["bucket"] == edge), lambda x: x["tokens"]), 1)
        if width == 1:
            nearer = F.col("_step.held") + in_edge - F.col("budget") < F.col("budget") - F.col("_step.held")
            below = F.when(edge < 0, F.col("start") + span).otherwise(F.col("start") + edge + F.when(nearer, 1).otherwise(0))
            last = lists.select("source", below.alias("below"))
            done = done.unionByName(last) if level else last
            return checkpoint(done)
        # A budget that all documents of the span fit into needs no finer level.
        ended = lists.filter(edge < 0).select("source", (F.col("start") + span).alias("below"))
        done = done.unionByName(ended) if level else ended
        found = checkpoint(lists.filter(edge >= 0).select("source", "budget", (F.col("start") + edge * width).alias("start"), F.col("_step.held").alias("held")))


def _summed(table: DataFrame, order: list[Column], sums: dict[str, Column], ranges: int) -> DataFrame:
    """``table`` with running sums of ``sums`` over all rows up to each one, in ``order``: within ranges, plus what the ranges before hold."""
    ranged = stored(table.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    each = sorted(ranged.groupBy("_part").agg(*(F.sum(c.cast("double")).alias(n) for n, c in sums.items())).collect())  # a row for each range
    before, so_far = [], [0.0] * len(sums)
    for part, *own in each:
        before.append((part, *so_far))
        so_far = [x + (y or 0.0) for x, y in zip(so_far, own, strict=True)]
    offsets = table.sparkSession.createDataFrame(before, "_at int, " + ", ".join(f"_{n} double" for n in sums))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({n: F.sum(c.cast("double")).over(upto) for n, c in sums.items()}).join(F.broadcast(offsets), F.col("_part") == F.col("_at"))
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", "_at", *(f"_{n}" for n in sums))


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``sizes`` (source, size) with ``target``: the total, shared by weight, none above ``most`` times its size.

    Weights repeat over the sources in code-point order, null last. The limit binds first for the sources with the least limit per
    weight: in that order the share per weight that is left after the sources before is the right one at the last source that keeps
    within its limit. Both orders are made over ranges, whatever the number of sources."""
    ranges = 1 + sizes.count() // RANGE_SOURCES
    named = _summed(sizes, [F.asc_nulls_last("source")], {"rank": F.lit(1)}, ranges)
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    named = named.withColumn("weight", F.get(kinds, ((F.col("rank") - 1) % len(weights)).cast("int"))).withColumn("limit", F.lit(float(most)) * F.col("size")).drop("rank")
    held = stored(_summed(named, [(F.col("limit") / F.col("weight")).asc(), F.asc_nulls_last("source")], {"full": F.col("limit"), "heavy": F.col("weight")}, ranges))
    whole = held.agg(F.sum(F.col("size").cast("double")).alias("size"), F.sum("weight").alias("weight")).first()  # one row
    left = (F.lit(whole["size"] or 0.0) - (F.col("full") - F.col("limit"))) / (F.lit(whole["weight"] or 1.0) - (F.col("heavy") - F.col("weight")))
    share = F.lit(held.filter(F.col("weight") * left <= F.col("limit")).agg(F.max(left)).first()[0] or 0.0)  # one row
    return held.select("source", "size", F.least(F.col("limit"), F.col("weight") * share).alias("target"))


def plan(rows: DataFrame, weights: Sequence[float], most: int) -> tuple[DataFrame, bool]:
    """Per source of ``sized`` rows: size, target, ``whole`` (times that every document is taken) and ``below`` (hashes taken once more); and whether they are few."""
    sizes = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("size")))
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    table = targets(sizes, weights, most).withColumn("whole", F.when(F.col("size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("int"))
    table = checkpoint(table.select(F.col("source").alias("_of"), F.col("size").alias("source_size"), "target", "whole", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("size")).otherwise(0.0).alias("budget")))
    below = thresholds(rows.filter("size > 0"), table.filter("budget > 0").select(F.col("_of").alias("source"), "budget"), few)
    planned = table.join(_small(below, few), F.col("_of").eqNullSafe(F.col("source")), "left").select("_of", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    return checkpoint(planned), few


def _times(rows: DataFrame, planned: tuple[DataFrame, bool]) -> DataFrame:
    """``rows`` with their source's plan and ``times``, how often the mix takes the document."""
    out = rows.join(_small(*planned), F.col("source").eqNullSafe(F.col("_of")), "left")
    return out.withColumn("times", F.col("whole") + F.when(F.col("point") < F.col("below"), 1).otherwise(0))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """What the mix takes of each document: ``key``, source, size, source_size, target, taken (words, repeats counted).

    A source whose target is several times its size is taken whole so many times, and the rest of
    its target by hash threshold. The hash is of the key, so reruns agree, and rows that repeat a key
    stand or fall together; null keys share one hash. Null texts have size 0; a null source is a
    source; an empty table gives an empty result; further columns are left out. Sources may be many: their weights, targets and
    thresholds are made on Spark, and brought to the documents by a broadcast only if they are counted few."""
    rows = checkpoint(sized(docs, text, key, source, seed))
    return _times(rows, plan(rows, weights, most)).select(key, "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns. Texts are not shuffled where sources are few: the thresholds are brought to them.

    A row without words is taken as its hash tells, as all others; nulls, ties and empty tables are as in ``mix``; columns may have any names."""
    table = plan(checkpoint(sized(docs, text, key, source, seed)), weights, most)
    rows = docs.select(F.col(f"`{source}`").alias("source"), _point(key, seed).alias("point"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return _times(rows, table).filter("times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")
