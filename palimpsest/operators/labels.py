"""An event-sourced label store in tables: replay, merge, journals, resumable work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(events: DataFrame, key: str, order: list[str], patch: str = "patch", fields: tuple[str, ...] = ("status", "notes"), snapshot: DataFrame | None = None) -> DataFrame:
    """State per key after all patches in order: an omitted field keeps its value, a null clears it.

    ``patch`` is a map, so that omitted and null differ. ``snapshot`` (key, fields) is the state before the
    first event. A field is that of the last event whose patch has it: one ordered maximum per field, no fold."""
    place = F.struct(*order)
    has = lambda f: F.map_contains_key(F.col(patch), f)
    last = [F.max(F.when(has(f), F.struct(place.alias("o"), F.element_at(F.col(patch), f).alias("v")))).alias(f"_{f}") for f in fields]
    state = events.groupBy(key).agg(*last, F.max(place).alias("last_event"))
    if snapshot is None:
        return state.select(key, *(F.col(f"_{f}.v").alias(f) for f in fields), "last_event")
    old = snapshot.select(key, *(F.col(f).alias(f"old_{f}") for f in fields))
    both = state.join(old, key, "full_outer")
    return both.select(key, *(F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f"old_{f}")).alias(f) for f in fields), "last_event")


def merge_logs(left: DataFrame, right: DataFrame, identity: list[str], ts: str, number: str = "id") -> DataFrame:
    """Two logs as one: exact duplicates once, in order of time, numbered from 1.

    Numbers come from counts per day and ranks within a day, so no task sorts the whole log."""
    rows = left.select(*identity).unionByName(right.select(*identity)).dropDuplicates(identity).withColumn("_day", F.substring(F.col(ts).cast("string"), 1, 10))
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_day").orderBy(ts, *[c for c in identity if c != ts])
    return rows.join(before, "_day").withColumn(number, F.col("_before") + F.row_number().over(w)).drop("_day", "_before")


def chain_hash(previous, *parts):
    """Hash of a journal entry over the one before it."""
    return F.sha2(F.concat_ws("|", previous, *parts), 256)


def broken_links(journal: DataFrame, seq: str, previous: str, own: str, parts: list[str], stream: str | None = None) -> DataFrame:
    """Journal entries that do not follow from the one before, or whose own hash is not theirs."""
    w = (Window.partitionBy(stream) if stream else Window).orderBy(seq)
    rows = journal.withColumn("_before", F.lag(own).over(w))
    wrong = (F.col("_before").isNotNull() & (F.col("_before") != F.col(previous))) | (chain_hash(F.col(previous), *(F.col(p).cast("string") for p in parts)) != F.col(own))
    return rows.filter(wrong).drop("_before")


def unfinished(work: DataFrame, done: DataFrame, key: str, signature: str) -> DataFrame:
    """Work whose result is missing or was made of other inputs."""
    return work.join(done.select(key, signature).distinct(), [key, signature], "left_anti")


def valid_results(work: DataFrame, shards: DataFrame, key: str, signature: str) -> DataFrame:
    """Results of all shards for the present inputs, once per key; conflicting ones are an error of ``guards.conflicts``."""
    return shards.join(work.select(key, signature).distinct(), [key, signature], "left_semi").dropDuplicates([key, signature])


def next_batch(ids: DataFrame, labels: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The next ``n`` keys without a label, in seeded order."""
    from palimpsest.functions.scalars import hash_order

    return ids.join(labels.select(key), key, "left_anti").orderBy(hash_order(seed, F.col(key)), key).limit(n)


def by_status(ids: DataFrame, labels: DataFrame, key: str, status: str) -> DataFrame:
    """Keys with a label status; those without a label are unreviewed."""
    return ids.join(labels.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("unreviewed"))).filter(F.col("status") == status)
