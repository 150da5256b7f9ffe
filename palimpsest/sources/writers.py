"""Sinks: split tables with a check, signed results, newline JSON, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_split(rows: DataFrame, path: str, split: str = "split", json_too: bool = True) -> DataFrame:
    """Parquet (and JSON lines) partitioned by split, read back; an error if a count or the columns differ."""
    rows.write.mode("overwrite").partitionBy(split).parquet(f"{path}/parquet")
    if json_too:
        rows.write.mode("overwrite").partitionBy(split).json(f"{path}/json")
    back = rows.sparkSession.read.parquet(f"{path}/parquet")
    if set(back.columns) != set(rows.columns):
        raise ValueError(f"columns differ: {back.columns}")
    count = lambda df: {r[split]: r["n"] for r in df.groupBy(F.col(split).cast("string").alias(split)).agg(F.count(F.lit(1)).alias("n")).collect()}
    if count(back) != count(rows):
        raise ValueError("counts differ after reading back")
    return back


def append_results(results: DataFrame, path: str) -> None:
    """A new shard of results; readers merge shards by signature."""
    results.write.mode("append").parquet(path)


def export_lines(groups: DataFrame, path: str) -> None:
    """Included groups as one JSON object a line; adjusted times win over raw ones."""
    rows = groups.filter("include_status = 'include'").withColumns({"start": F.coalesce("adjusted_start", "start"), "end": F.coalesce("adjusted_end", "end")})
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def versioned(rows: DataFrame, path: str, version: int, **meta: str) -> None:
    """A table beside a one-row table of its version and further facts."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(version, {k: str(v) for k, v in meta.items()})], "version int, meta map<string,string>").write.mode("overwrite").json(f"{path}/meta")


def open_versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows of a table of this version; an error for any other."""
    found = spark.read.schema("version int, meta map<string,string>").json(f"{path}/meta").first()
    if found is None or found["version"] != version:
        raise ValueError(f"table has version {found and found['version']}, not {version}")
    return spark.read.parquet(f"{path}/rows")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of change of the files behind a path: what tells whether a source is still the same."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
