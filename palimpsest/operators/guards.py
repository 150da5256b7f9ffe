"""Guard chains: rows dropped for the first reason that holds, every drop counted; checks that return what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_reason(reasons: dict[str, Column]) -> Column:
    """The first reason, in order, whose condition holds; null for a row that stays. Unknown counts as not holding."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons.items()):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def guarded(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    return rows.withColumn("drop_reason", drop_reason(reasons))


def kept(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    return guarded(rows, reasons).filter("drop_reason IS NULL").drop("drop_reason")


def drop_counts(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, n) with ``kept`` for the rest: the counts add up to the rows."""
    return guarded(rows, reasons).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def deny(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose composite key is not in the list. Spark broadcasts the list if it is small enough, by its own size check."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def allow(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def reasons_by_key(lists: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Several lists of keys as one, each key with the sorted reasons it is listed for."""
    tagged = [df.select(*on, F.lit(reason).alias("reason")) for reason, df in lists.items()]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return both.groupBy(*on).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with a few examples if there is a violation."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{message}: {some}")


def leaked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in both sides: none if a split holds."""
    return left.select(*keys).intersect(right.select(*keys))


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that either has more often than the other, with the side: none if the tables are equal as multisets."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def divided(rows: DataFrame, key: str, item: str, required: list, good: Column | None = None) -> DataFrame:
    """Keys that have every required item (relational division), in rows for which ``good`` holds."""
    rows = rows.filter(F.col(item).isin(*required) & (F.lit(True) if good is None else good))
    return rows.groupBy(key).agg(F.count_distinct(item).alias("n_items")).filter(F.col("n_items") == len(set(required))).select(key)


def divided_by(rows: DataFrame, required: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that have every item of ``required``, a table: its size is one number, its items are joined, not brought to the driver."""
    needed = required.select(item).distinct()
    n = needed.count()
    found = rows.select(key, item).join(needed, item, "left_semi").groupBy(key).agg(F.count_distinct(item).alias("n_items"))
    return found.filter(F.col("n_items") == n).select(key)


def multiset_semijoin(rows: DataFrame, other: DataFrame, on: list[str], order: list) -> DataFrame:
    """Rows that find a partner of equal key, each partner used once."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    m = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    return rows.withColumn("_n", n).join(other.select(*on).withColumn("_n", m), [*on, "_n"], "left_semi").drop("_n")
