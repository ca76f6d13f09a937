"""Counts and sums over structured facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalise


def members(facts: DataFrame, since: str | None = None) -> DataFrame:
    """Distinct members of each (subject, predicate); the first statement of a member counts. Undated facts are out
    of a time scope."""
    if since:
        facts = facts.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    first = F.min_by(F.struct("obj", "quantity", "unit"), F.struct("pos", "quantity", "unit"))
    return facts.groupBy("subject", "predicate", normalise(F.col("obj")).alias("member")).agg(first.alias("x"), F.min("pos").alias("pos")).select("subject", "predicate", "member", "pos", "x.quantity", "x.unit")


def summarise(facts: DataFrame, since: str | None = None, min_count: int = 1) -> DataFrame:
    unit = F.min_by(F.when(F.col("unit") != "", F.col("unit")), F.when(F.col("unit") != "", F.struct("pos", "unit")))
    return members(facts, since).groupBy("subject", "predicate").agg(
        F.count(F.lit(1)).alias("members"), F.sum("quantity").alias("total"), unit.alias("unit")).where(F.col("members") >= min_count)


def newest_per_key(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("subject", "attribute").orderBy(F.desc("valid_from"), F.desc("id"))
    return facts.withColumn("is_current", F.row_number().over(w) == 1)


def max_per_session_sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session", "role").agg(F.max("tokens").alias("m")).groupBy("role").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("sessions"))
