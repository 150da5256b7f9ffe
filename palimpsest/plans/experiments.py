"""Extension surface: an idea is fitted on all groups but one and applied to that one; registered ideas are compared on the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Idea:
    """``fit``: rows of the other groups -> parameters; ``apply``: (rows of a group, parameters) -> those rows with ``out``."""

    name: str
    fit: Callable[[pd.DataFrame], dict]
    apply: Callable[[pd.DataFrame, dict], pd.DataFrame]


#: Rows that one fold's task may hold: beyond, an idea whose fit needs sums alone is applied by ``leave_one_group_out_by_sums``, at any size.
FOLD_ROWS = 200_000


def leave_one_group_out(rows: DataFrame, idea: Idea, group: str, key: str, value_schema: str) -> DataFrame:
    """``key``, ``group`` and out of each row, by parameters that its group had no part in.

    The rows go to one task per held-out group (few groups of evaluation windows, as a benchmark has): a fit that is a function of
    all rows at once needs them in one place. Larger tables are for ``leave_one_group_out_by_sums``."""
    kinds = dict(rows.dtypes)
    if rows.limit(FOLD_ROWS + 1).count() > FOLD_ROWS:
        raise ValueError(f"a fold in one task is for up to {FOLD_ROWS} rows; use leave_one_group_out_by_sums")
    folds = [r[0] for r in rows.select(group).distinct().collect()]
    doubled = rows.withColumn("_fold", F.explode(F.array(*map(F.lit, folds)))) if folds else rows.withColumn("_fold", F.col(group))

    def run(fold: pd.DataFrame) -> pd.DataFrame:
        own = fold[group] == fold["_fold"]
        out = idea.apply(fold[own].copy(), idea.fit(fold[~own]))
        return out[[key, group, "out"]]

    return doubled.groupBy("_fold").applyInPandas(run, f"`{key}` {kinds[key]}, `{group}` {kinds[group]}, out {value_schema}")


def leave_one_group_out_by_sums(rows: DataFrame, sums: dict[str, Column], out: Callable[[dict[str, Column]], Column], group: str) -> DataFrame:
    """``rows`` with ``out``, made from the ``sums`` over all rows of other groups: what a group holds is taken from the whole.

    For ideas whose parameters are functions of sums (rates, means, moments, least squares). Partial sums in every task, then a row for each group; any
    number of rows and groups. Sums without rows are 0; a null group is one of its own."""
    named = {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in sums.items()}
    whole = rows.agg(*(c.alias(n) for n, c in named.items())).first()  # one row
    each = rows.groupBy(F.col(group).alias("_group")).agg(*(c.alias(f"_{n}") for n, c in named.items()))
    joined = rows.join(each, F.col(group).eqNullSafe(F.col("_group")))
    rest = {n: F.lit(whole[n]) - F.col(f"_{n}") for n in sums}
    return joined.withColumn("out", out(rest)).drop("_group", *(f"_{n}" for n in sums))


@dataclass
class Registry:
    """Ideas in the order they were registered; a name is registered once."""

    ideas: dict[str, Idea] = field(default_factory=dict)
    frozen: set[str] = field(default_factory=set)

    def register(self, idea: Idea) -> None:
        if idea.name in self.ideas:
            raise ValueError(f"{idea.name} is registered already")
        self.ideas[idea.name] = idea

    def freeze(self, name: str) -> Idea:
        """The idea, which may be confirmed on held-back rows from now on."""
        self.frozen.add(name)
        return self.ideas[name]

    def confirm(self, rows: DataFrame, name: str, group: str, key: str, value_schema: str) -> DataFrame:
        if name not in self.frozen:
            raise ValueError(f"{name} must be frozen before it is confirmed")
        return leave_one_group_out(rows, self.ideas[name], group, key, value_schema)


def grid(spark, **axes: list) -> DataFrame:
    """All combinations of settings: one row each."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")


def leaderboard(results: DataFrame, metric: str, regression: str, baseline: float, most: float = 0.0) -> DataFrame:
    """Results by metric with their delta; ``eligible`` if the regression measure is unknown or within ``most``."""
    return results.withColumns({"delta": F.col(metric) - F.lit(baseline), "eligible": F.coalesce(F.col(regression) <= most, F.lit(True))}).orderBy(F.asc_nulls_last(metric))
