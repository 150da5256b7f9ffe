"""Edit histories: rows of edits as chains, first and last states, link integrity, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import canonical


def reconstruct(edits: DataFrame, key: str = "utterance_id", order: tuple[str, ...] = ("edit_timestamp",), before: str = "before_text", after: str = "after_text", editor: str = "edited_by", machine: str = "task", human: str = "user") -> DataFrame:
    """One row per chain: first input, last output, editors in order, link integrity.

    A link holds if an edit's input and the output before it are canonically equal. ``order`` should end
    in a tie-breaker; rows that still tie follow by input. One shuffle by ``key`` serves window and aggregate."""
    w = Window.partitionBy(key).orderBy(*order, before)
    linked = F.when(F.row_number().over(w) > 1, canonical(F.col(before)) == canonical(F.lag(after).over(w)))
    rows = edits.withColumns({"_place": F.row_number().over(w), "_linked": linked})
    return rows.groupBy(key).agg(
        F.min_by(before, "_place").alias("input_raw"),
        F.max_by(after, "_place").alias("gold_final"),
        F.transform(F.array_sort(F.collect_list(F.struct("_place", F.col(editor).alias("e")))), lambda x: x["e"]).alias("edited_by_seq"),
        F.bool_or(F.col(editor) == machine).alias("has_task"),
        F.bool_or(F.col(editor) == human).alias("has_user"),
        F.coalesce(F.min(F.when(F.col(editor) == machine, F.col("_place"))) < F.max(F.when(F.col(editor) == human, F.col("_place"))), F.lit(False)).alias("task_then_user"),
        F.count(F.lit(1)).alias("n_edits"),
        F.coalesce(F.bool_and("_linked"), F.lit(True)).alias("links_ok"),
    )


def chain_type(similarity: Column, equal: Column, pure: float = 0.85, mixed: float = 0.5) -> Column:
    """pure_correction, mixed or semantic_rewrite by the similarity ratio of first input and last output."""
    return F.when(equal | (similarity >= pure), "pure_correction").when(similarity >= mixed, "mixed").otherwise("semantic_rewrite")


def edit_class(has_task: Column, has_user: Column, task_then_user: Column) -> Column:
    return F.when(task_then_user, "task_then_user").when(has_task & has_user, "task_plus_user").when(has_user, "user_only").otherwise("task_only")


def groups(edits: DataFrame, key: str, order: list[str], fields: list[str], latest: list[str]) -> DataFrame:
    """One row per key with its edits as an ordered array, ``latest`` fields of the last edit, and whether all links hold on the raw text."""
    item = F.struct(*order, *[f for f in fields if f not in order])
    out = edits.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("edits"))
    last = F.element_at("edits", -1)
    links = F.zip_with(F.slice("edits", F.lit(1), F.size("edits") - 1), F.slice("edits", F.lit(2), F.size("edits")), lambda a, b: a["after_text"] == b["before_text"])
    return out.select(key, "edits", *(last[f].alias(f) for f in latest), F.when(F.size("edits") > 1, F.forall(links, lambda x: x)).otherwise(True).alias("consistent"))


def source_profile(edits: Column, machine: str = "task", human: str = "user") -> Column:
    """task, user, both or unknown, by who edited."""
    by = lambda who: F.exists(edits, lambda e: e["edited_by"] == who)
    return F.when(by(machine) & by(human), "both").when(by(machine), "task").when(by(human), "user").otherwise("unknown")


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_known(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per key the first value of each field that is not null."""
    return rows.groupBy(key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def preferred_value(rows: DataFrame, keys: list[str], value: str, order: list) -> DataFrame:
    """``value`` of the best row of a key in all its rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(value, F.first(value).over(w))
