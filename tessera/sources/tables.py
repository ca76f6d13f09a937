"""Inputs as memory tables. Timestamps are made zoned (UTC) at load; no schema is inferred beyond the files' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bi-temporal facts out of events: valid from ts, recorded up to 29 days later."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("ns"), F.pmod("user_id", F.lit(3)).cast("string")).alias("namespace"),
        F.col("user_id").alias("subject"), F.col("event_type").alias("attribute"), "value", F.col("ts").alias("valid_from"),
        F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.col("event_id") * 37, F.lit(30)) * 86_400_000_000).alias("recorded_at"),
        (F.pmod("event_id", F.lit(100)) / 100.0).alias("importance"), F.pmod("event_id", F.lit(5)).cast("int").alias("access_count"),
        F.get_json_object("props", "$.k").alias("tag"), "props",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with whitespace token counts."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text",
                    F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), "")).cast("long").alias("tokens"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").cast("array<double>").alias("v"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed labelled edges: order -> customer, part, supplier; customer, supplier -> nation -> region; and region -> one
    nation, which closes cycles."""
    n, c, s, o, l = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier", "orders", "lineitem"))

    def edge(df: DataFrame, a: str, source: str, b: str, target: str, predicate: str, weight: float) -> DataFrame:
        to = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        return df.select(to(a, source).alias("source"), to(b, target).alias("target"), F.lit(predicate).alias("predicate"), F.lit(weight).alias("weight"))

    return (
        edge(n, "n", "n_nationkey", "r", "n_regionkey", "IN", 1.0).unionByName(edge(c, "c", "c_custkey", "n", "c_nationkey", "LIVES", 0.5))
        .unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey", "LIVES", 0.5)).unionByName(edge(o, "o", "o_orderkey", "c", "o_custkey", "FOR", 0.9))
        .unionByName(edge(l.select("l_orderkey", "l_partkey").distinct(), "o", "l_orderkey", "p", "l_partkey", "HOLDS", 0.3))
        .unionByName(edge(l.select("l_orderkey", "l_suppkey").distinct(), "o", "l_orderkey", "s", "l_suppkey", "FROM", 0.4))
        .unionByName(edge(n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")), "r", "n_regionkey", "n", "k", "HAS", 0.8))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored memories out of facts: three layers, closed by the next fact of the key, some invalidated or retracted."""
    f = facts(spark, sf_dir)
    later = lambda c, days: F.timestamp_micros(F.unix_micros(c) + days * 86_400_000_000)
    w = Window.partitionBy("subject", "attribute").orderBy("valid_from", "recorded_at", "id")
    stated = F.when(F.pmod("id", F.lit(11)) != 0, F.col("valid_from"))
    return f.withColumn("next", F.lead("valid_from").over(w)).select(
        "id", "namespace", "subject", "attribute", "value", "tag", "importance", "access_count",
        F.element_at(F.array(F.lit("STM"), F.lit("MTM"), F.lit("LTM")), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("layer"),
        (0.5 + F.pmod("id", F.lit(5)) * 0.1).alias("confidence"), F.concat("attribute", F.lit(" is "), F.floor("value").cast("string")).alias("text"),
        F.col("recorded_at").alias("created_at"), stated.alias("valid_from"), F.col("next").alias("valid_to"),
        F.when(F.pmod("id", F.lit(7)) == 0, later("recorded_at", 3)).alias("invalidated_at"),
        F.when(F.pmod("id", F.lit(4)) == 0, later("recorded_at", 1)).alias("last_access"), (F.pmod("id", F.lit(35)) == 0).alias("retracted"))
