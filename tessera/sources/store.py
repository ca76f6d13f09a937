"""Append-only event log and its fold.

Plain Parquet has no MERGE, so every write is an event (namespace, id, seq, op, payload); the state is a fold that
does not depend on the order of files. Snapshots are written beside each other and named by a one-line manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPS = ("ADD", "PATCH", "INVALIDATE", "TOUCH")


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("namespace").parquet(path)


def fold_upserts(events: DataFrame) -> DataFrame:
    """Last write wins for each (namespace, id); created_at stays that of the first write."""
    last = F.max_by(F.struct("seq", "value", "at"), "seq")
    return events.groupBy("namespace", "id").agg(last.alias("x"), F.min("at").alias("created_at")).select(
        "namespace", "id", "x.seq", "x.value", F.col("x.at").alias("updated_at"), "created_at")


def fold_patches(events: DataFrame, columns: list[str]) -> DataFrame:
    """Each column from the newest event that states it."""
    newest = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    return events.groupBy("namespace", "id").agg(*newest)


def fold_invalidations(events: DataFrame) -> DataFrame:
    """Closing twice is closing once, at the earliest time."""
    return events.groupBy("namespace", "id").agg(F.min(F.when(F.col("op") == "INVALIDATE", F.col("at"))).alias("invalidated_at"))


def touch_duplicates(rows: DataFrame, text: str, at: str) -> DataFrame:
    """One live row for each (namespace, text): restatements add to access_count and move last_access."""
    return rows.groupBy("namespace", text).agg((F.count(F.lit(1)) - 1).alias("access_count"), F.max(at).alias("last_access"), F.min("id").alias("id"))


def live_text_dedupe(rows: DataFrame, text: str, order: list) -> DataFrame:
    """The row that stays of each (namespace, md5(text))."""
    w = Window.partitionBy("namespace", F.md5(text)).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w))


def publish(state: DataFrame, root: str, version: int) -> str:
    """Write a snapshot, and then its line to the manifest. Lines are only ever added, so a reader finds the old version or
    the new one, never none."""
    state.write.parquet(f"{root}/snapshots/{version:08d}")
    spark = state.sparkSession
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return f"{root}/snapshots/{version:08d}"


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version long").json(f"{root}/manifest").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/snapshots/{version:08d}")


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the whole runs below a root, oldest first (one line a run)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r["run"] for r in spark.read.schema("number long, run string").json(f"{root}/manifest").orderBy("number").collect()]


def commit(spark: SparkSession, root: str, number: int, run: str) -> None:
    """The line that makes the files of a run count; written after them."""
    spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(run).alias("run")).coalesce(1).write.mode("append").json(f"{root}/manifest")


def runs_of(spark: SparkSession, folder: str, runs: list[str], schema: str) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in runs])
