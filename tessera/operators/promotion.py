"""Promotion: scan, decide, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADD_BELOW, NOOP_ABOVE = 0.5, 0.97


def unprocessed(blocks: DataFrame, promotions: DataFrame) -> DataFrame:
    return blocks.join(promotions.select("id").distinct(), "id", "left_anti")


def decide(retraction: Column, similarity: Column) -> Column:
    """Rules that need no model; anything between the thresholds is left to a decider."""
    return (
        F.when(retraction & (F.coalesce(similarity, F.lit(0.0)) >= ADD_BELOW), "DELETE").when(retraction, "NOOP")
        .when(similarity.isNull() | (similarity < ADD_BELOW), "ADD").when(similarity > NOOP_ABOVE, "NOOP").otherwise("UNDECIDED"))


def with_decider(decided: DataFrame, decider: Callable | None, schema: str) -> DataFrame:
    """Undecided rows through an injected ``mapInPandas`` function; without one they pass through."""
    if decider is None:
        return decided
    open_rows = decided.where("op = 'UNDECIDED'").mapInPandas(decider, schema)
    return decided.where("op <> 'UNDECIDED'").unionByName(open_rows)


def report(decided: DataFrame) -> DataFrame:
    n = lambda op: F.count_if(F.col("op") == op).alias(op.lower())
    return decided.agg(n("ADD"), n("DELETE"), n("NOOP"), n("UNDECIDED"), F.count(F.lit(1)).alias("total"))


def accumulated(blocks: DataFrame, threshold: int = 20) -> DataFrame:
    return blocks.groupBy("session").agg(F.count(F.lit(1)).alias("waiting")).withColumn("fires", F.col("waiting") >= threshold)


def new_entities(entities: DataFrame, known: DataFrame) -> DataFrame:
    key = lambda d: d.select(F.lower("text").alias("entity")).distinct()
    return key(entities).join(key(known), "entity", "left_anti")
