"""Bi-temporal operators: valid time and transaction time, intervals, supersession, prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("subject", "attribute")


def at(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open interval; a null border is open."""
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) > t))


def known_at(t: Column, recorded: str = "recorded_at", closed: str = "invalidated_at") -> Column:
    return (F.col(recorded) <= t) & (F.col(closed).isNull() | (F.col(closed) > t))


def latest(facts: DataFrame, keys=KEY) -> DataFrame:
    """One fact a key: newest valid time, then the later recording, then the larger id. Aggregates on the map side."""
    order = F.struct("valid_from", "recorded_at", "id")
    return facts.groupBy(*keys).agg(F.max_by(F.struct("id", "value", "valid_from", "recorded_at"), order).alias("x")).select(*keys, "x.*")


def as_of(facts: DataFrame, valid: str | None = None, known: str | None = None, keys=KEY) -> DataFrame:
    if valid:
        facts = facts.where(F.col("valid_from") <= at(valid))
    if known:
        facts = facts.where(F.col("recorded_at") <= at(known))
    return latest(facts, keys)


def intervals(facts: DataFrame, keys=KEY) -> DataFrame:
    """valid_to and superseded_by from the next fact of the key; recomputed from all rows, so late corrections split
    older intervals."""
    w = Window.partitionBy(*keys).orderBy("valid_from", "recorded_at", "id")
    return facts.withColumns({"valid_to": F.lead("valid_from").over(w), "superseded_by": F.lead("id").over(w)})


def as_of_join(asked: DataFrame, facts: DataFrame, when: str, keys=KEY) -> DataFrame:
    """For each asked (key, time) the latest fact with valid_from <= time: both sides in one sorted sweep, no pairs."""
    order = F.struct("valid_from", "recorded_at", "id")
    side = facts.select(*keys, F.col("valid_from").alias("_t"), F.lit(0).alias("_s"), order.alias("_o"), F.struct("id", "value").alias("_f"), F.lit(None).cast("long").alias("ask_id"))
    ask = asked.select(*keys, F.col(when).alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast(side.schema["_o"].dataType).alias("_o"),
                       F.lit(None).cast(side.schema["_f"].dataType).alias("_f"), F.col("ask_id"))
    w = Window.partitionBy(*keys).orderBy("_t", "_s", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return side.unionByName(ask).withColumn("_hit", F.last("_f", ignorenulls=True).over(w)).where("_s = 1").select("ask_id", *keys, F.col("_hit.id").alias("fact_id"), F.col("_hit.value").alias("value"))


def timeline(facts: DataFrame, since: str, until: str) -> DataFrame:
    return facts.where((F.col("valid_from") >= at(since)) & (F.col("valid_from") < at(until)))


def prune(rows: DataFrame, cutoff: str, max_importance: float, max_access: int, limit: int) -> DataFrame:
    """Coldest rows that meet every condition, oldest access first; the caller turns them into INVALIDATE events."""
    cold = F.coalesce("last_access", "valid_from")
    hit = rows.where((cold < at(cutoff)) & (F.coalesce("importance", F.lit(0.0)) <= max_importance) & (F.coalesce("access_count", F.lit(0)) <= max_access))
    return hit.withColumn("_cold", cold).orderBy("_cold", "id").limit(limit).drop("_cold")


def over_cap(rows: DataFrame, owner: str, cap: int) -> DataFrame:
    """Rows beyond an owner's cap: the least important, then the oldest, go."""
    w = Window.partitionBy(owner).orderBy(F.desc("importance"), F.desc("valid_from"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > cap)
