"""Structured Streaming over events: windows with late data, sessions, labels as state, bounded dedupe, upserts."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int | None = None, glob: str | None = None) -> DataFrame:
    """A file stream of events; times become session-zone timestamps, which watermarks need."""
    reader = spark.readStream.schema(EVENTS)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count and sum by tumbling or sliding window and keys; later than ``late`` is dropped when streaming."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "10 minutes", key: str = "user_id") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")


def recent_distinct(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first of each key within the watermark: state is bounded by time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def label_state(events: DataFrame, key: str = "utterance_id") -> DataFrame:
    """Current label per key of a stream of (key, id, patch map): omitted fields stay, null ones are cleared, old ids are ignored."""

    def update(name: tuple, groups, state: GroupState):
        last, label = state.get if state.exists else (-1, "{}")
        fields = dict(json.loads(label))
        for frame in groups:
            for number, patch in sorted(zip(frame["id"], frame["patch"], strict=True), key=lambda x: x[0]):
                if number > last:
                    last = int(number)
                    fields |= dict(patch)
        fields = {k: v for k, v in fields.items() if v is not None}
        text = json.dumps(fields, sort_keys=True)
        state.update((last, text))
        yield pd.DataFrame({key: [name[0]], "last_id": [last], "label": [text]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} string, last_id long, label string", "last_id long, label string", "update", GroupStateTimeout.NoTimeout)


def upsert(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key; a repeated batch changes nothing. Versions alternate between two folders."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        from palimpsest.operators.chains import first_per_key

        old, new = f"{path}/{(number + 1) % 2}", f"{path}/{number % 2}"
        rows = batch if number == 0 else spark.read.parquet(old).unionByName(batch)
        first_per_key(rows, [key], [F.desc(order)]).write.mode("overwrite").parquet(new)

    return write


def refreshed(compute: Callable[[], DataFrame], path: str) -> DataFrame:
    """Recompute a statistics table and swap it in; readers of the old one keep their files."""
    rows = compute()
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything available now, into a Parquet table below ``path``: what each batch gives is added; ``complete`` keeps the last batch alone, which has all rows.

    With ``update`` a key has a row for each change: the newest one is its state. A batch that is repeated after a failure adds its rows again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything available now, into a memory table: for tests and small jobs."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table(name)
