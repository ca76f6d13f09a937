"""Graph walks over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


#: Sources up to which edges are filtered where they are read.
MAX_SOURCES = 200_000


def walk(seeds: DataFrame, edges: DataFrame, hops: int, predicates: list[str] | None = None, min_weight: float | None = None, cap: int | None = None) -> DataFrame:
    """Paths of up to ``hops`` edges that visit no node twice: (seed, target, depth, path). The first edge of every seed meets
    the paths that go on from its target, which are found once for each node and not for each seed on the way to it; the
    path guard ends cycles. Predicates and weights cut the edges first; ``cap`` is the number of paths that a seed reports,
    nearest first."""
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(predicates))
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    paths = _paths(seeds.select(F.col("id").alias("seed")), edges.select(F.col("source").alias("seed"), "target"), hops)
    if cap is None:
        return paths
    order = Window.partitionBy("seed").orderBy("depth", F.concat_ws(">", "path"))
    return paths.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap).drop("_k")


def _paths(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    first = starts.join(edges, "seed").where("seed <> target")
    one = first.select("seed", "target", F.lit(1).alias("depth"), F.array("seed", "target").alias("path"))
    if hops == 1:
        return one
    onward = _paths(first.select(F.col("target").alias("seed")).distinct(), edges, hops - 1)
    onward = onward.select(F.col("seed").alias("via"), F.col("target").alias("end"), F.col("depth").alias("more"), F.col("path").alias("rest"))
    longer = first.join(onward, F.col("target") == F.col("via")).where(~F.array_contains("rest", F.col("seed")))
    return one.unionByName(longer.select("seed", F.col("end").alias("target"), (F.col("more") + 1).alias("depth"), F.concat(F.array("seed"), "rest").alias("path")))


def live_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose target is a live entity, with its name."""
    there = entities.where("live").select(F.col("id").alias("target"), "name")
    return edges.join(there, "target")


def expand(hits: DataFrame, edges: DataFrame, seeds: int) -> DataFrame:
    """Neighbours of each query's first ``seeds`` hits that are not hits yet, with score 0. Hits are counted: few sources
    filter the edges where these are read."""
    hits = written(hits.select("query_id", "id", "rank"))
    start = hits.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("source"))
    from_here = edges.select("source", "target")
    sources = start.select("source").distinct()
    if sources.count() <= MAX_SOURCES:
        from_here = from_here.join(F.broadcast(sources), "source", "left_semi")
    new = start.join(from_here, "source").select("query_id", F.col("target").alias("id")).distinct()
    return new.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
