"""Structured Streaming: idle-gap flush of sessions, and promotion by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def idle_sessions(turns: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Sessions that end after ``gap`` without activity (append mode: emitted once the watermark has passed)."""
    return turns.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def batch_sessions(turns: DataFrame, gap: str) -> DataFrame:
    """The same over a finished table: the closing flush."""
    return turns.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def still_open(turns: DataFrame, sink: DataFrame, gap: str) -> DataFrame:
    """The flush at the end of the input: sessions that the watermark has not passed, so that the sink lacks them."""
    whole, held = batch_sessions(turns, gap).alias("w"), sink.withColumn("held", F.lit(True)).alias("s")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("user_id", "start", "end")]
    # not an anti join: the optimiser moves one below the aggregate, where windows are not merged yet
    return whole.join(held, same, "left").where("held is null").select("w.*")


def tumbling(turns: DataFrame, width: str, watermark: str) -> DataFrame:
    return turns.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything available, then stop; files and offsets make a restart continue where it ended."""
    df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def promote_batches(df: DataFrame, processed: str, checkpoint: str, key: str = "event_id") -> None:
    """Each micro-batch without what was processed before, appended under its batch number (a repeated batch
    overwrites itself)."""

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        if number:  # the first batch has nothing before it
            done = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{processed}/batch={k}" for k in range(number)])
            done = done.select(F.col(key).alias("_done"))
            fresh = fresh.join(done, fresh[key].eqNullSafe(done["_done"]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{processed}/batch={number}")

    df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
