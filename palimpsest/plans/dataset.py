"""The staged build of a published table: sources as one, guards with counted drops, one row a span, splits, signatures, results joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import row_signature
from palimpsest.operators import chains, guards, labels, selection


def stage_rows(sources: list[DataFrame], reasons: dict[str, Column], denied: DataFrame, on: list[str], span: list[str], order: list, owner: Column, share: float) -> DataFrame:
    """Rows of all sources (columns that one lacks are null) that no reason drops and no list denies, the first of each span, with ``split`` by owner."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = guards.deny(guards.kept(rows, reasons), denied, on)
    return chains.first_per_key(rows, span, order).withColumn("split", selection.hash_split(owner, share))


def stage_report(sources: list[DataFrame], reasons: dict[str, Column]) -> DataFrame:
    """(reason, n) over all sources, kept rows among them: nothing goes without being counted."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return guards.drop_counts(rows, reasons)


def stage_work(rows: DataFrame, key: str, *parts: str) -> DataFrame:
    """``key`` and the signature of what its result is made of."""
    return rows.select(key, row_signature(*(F.col(p) for p in parts)).alias("row_sig"))


def stage_finalize(rows: DataFrame, key: str, work: DataFrame, results: DataFrame) -> DataFrame:
    """``rows`` with the results that were made of their present parts; null where there is none yet, so that an old one is never taken."""
    return rows.join(labels.valid_results(work, results, key, "row_sig").drop("row_sig"), key, "left")


def boundary_report(rows: DataFrame, status: str, score: str, start: str, end: str, raw_start: str, raw_end: str) -> DataFrame:
    """Per boundary status: rows, their share, mean score, and the largest shift of either end."""
    shift = F.greatest(F.abs(F.col(start) - F.col(raw_start)), F.abs(F.col(end) - F.col(raw_end)))
    sums = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(shift).alias("max_shift"))
    total = sums.agg(F.sum("n")).first()[0] or 1  # one row
    return sums.withColumn("share", F.col("n") / F.lit(total))


def relocated(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """``rows`` whose paths below ``old`` lie below ``new`` now; others stay."""
    here = F.col(path)
    return rows.withColumn(path, F.when(here.startswith(old), F.concat(F.lit(new), F.substring(here, len(old) + 1, 1_000_000))).otherwise(here))
