"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalise, overlap, tokens


def recall_at(hits: DataFrame, k: int, total: DataFrame) -> DataFrame:
    """Share of each query's relevant rows among its first k hits."""
    got = hits.where((F.col("rank") <= k) & F.col("relevant")).groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    return total.join(got, "query_id", "left").select("query_id", (F.coalesce("got", F.lit(0)) / F.least(F.col("n_relevant"), F.lit(k))).alias("recall"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p n / 100). Rows are counted by value before they move, so that a key
    with a third of all rows sorts its distinct values only; nulls come first."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    placed = counts.withColumns({"_to": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    place = lambda p: F.ceil(F.lit(p) * F.col("_n") / 100)
    return placed.groupBy(*keys).agg(*[F.max(F.when((F.col("_to") >= place(p)) & (F.col("_to") - F.col("_c") < place(p)), F.col(value))).alias(f"p{p}") for p in percents])


def histogram(rows: DataFrame, bucket: str, buckets: list[str]) -> DataFrame:
    """Counts with a row for every bucket, zero included."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, buckets))).alias(bucket))
    return names.join(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), bucket, "left").select(bucket, F.coalesce("n", F.lit(0)).alias("n"))


def majority(votes: DataFrame) -> DataFrame:
    """Most frequent normalised answer, the earliest on a tie; empty answers count only if all are empty."""
    counted = votes.withColumn("key", normalise(F.col("answer"))).groupBy("question", "key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return counted.groupBy("question").agg(F.max_by("key", F.struct(F.col("key") != "", F.col("n"), -F.col("pos"))).alias("answer"))


def answer_match(answer: Column, gold: Column) -> Column:
    """exact, normalised, contained, overlap or none."""
    a, g = normalise(answer), normalise(gold)
    return (F.when(answer == gold, "exact").when(a == g, "normalized").when((g != "") & F.contains(a, g), "contained")
            .when(overlap(F.array_distinct(tokens(a)), F.array_distinct(tokens(g))) >= 0.7, "overlap").otherwise("none"))


def latency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and p95, the latter the value at place floor(0.95 n) from 1, as the retrieval bench counts it."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy(value, "id")), "_n": F.count(F.lit(1)).over(w)})
    place = F.greatest(F.lit(1), F.floor(F.col("_n") * 95 / 100))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(F.when(F.col("_k") == place, F.col(value))).alias("p95"))
