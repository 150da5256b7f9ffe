"""Helpers that several operators share: let-bindings, checkpoints, row selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class and as the characters themselves.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column that a lambda captures is evaluated again for each element once Catalyst
    has inlined it; a lambda variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items that an inner fold takes, so that what it appends to stays short.
_FOLD = 256


def fold(items: Column, state: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Struct (s, out) of a walk over ``items``: ``step(state, item)`` gives the next state, whether a row is put out, and the row.

    Appending copies an array, so rows are gathered in blocks of _FOLD items, and blocks are then joined at
    once: long arrays cost about _FOLD copies an item, not their own length."""
    size = F.size(items)

    def one(acc: Column, x: Column) -> Column:
        after, put, row = step(acc["s"], x)
        return F.struct(after.alias("s"), F.when(put, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(items, b * _FOLD + 1, F.lit(_FOLD)), F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return let(inner, lambda x: F.struct(x["s"].alias("s"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((size - 1) / _FOLD).cast("int"))
    zero = F.struct(state.alias("s"), F.filter(F.array(none), lambda x: F.lit(False)).alias("out"))
    whole = F.aggregate(blocks, zero, block)
    return F.when(size > 0, let(whole, lambda x: F.struct(x["s"].alias("s"), F.flatten(x["out"]).alias("out")))).otherwise(F.struct(state.alias("s"), none.alias("out")))


def call(name: str, *args: Column) -> Column:
    """A SQL function by name, for those whose Python wrappers take no columns."""
    return F.call_function(name, *args)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; our own only where that is unset, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, but as a Parquet table in the shared folder: a third of the size, and columns can be pruned."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows_per_part: int = 50_000) -> tuple[DataFrame, int]:
    """A checkpoint in no more parts than its rows are worth, and the number of rows: what reads it then writes few shuffle files."""
    df = checkpoint(df)
    rows = df.count()
    return df.coalesce(max(1, -(-rows // rows_per_part))), rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
