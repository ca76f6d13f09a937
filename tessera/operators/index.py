"""An approximate index of vectors: every row in the list of its nearest centroid, lists cut into blocks of bounded size and
written as a table. A query visits its nearest lists only and meets their blocks in a shuffle join.

Centroids are fitted on a bounded sample (``SAMPLE_ROWS`` rows in the mean, twice as many at most). Only they and the number
of blocks of each list (at most ``MAX_LISTS`` rows) are broadcast. A list with a third of all rows is dealt over blocks at
random. Vectors are taken at length 1; rows without a vector or a direction are not indexed. An empty memory has no index."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.sources.shared import shared_folder, ship, written

SAMPLE_ROWS, MAX_LISTS, ROUNDS, SEED = 1 << 14, 1024, 8, 11
BLOCK_ROWS = 2048


class Index(NamedTuple):
    path: str  # table (list, part, ids, vectors) of blocks
    centroids: np.ndarray
    parts: np.ndarray  # blocks of each list


def spherical(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids on the sphere; one that no row is nearest to stays."""
    c = x[np.random.default_rng(SEED).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        sums = np.zeros_like(c)
        np.add.at(sums, np.argmax(x @ c.T, axis=1), x)
        length = np.sqrt((sums**2).sum(1, keepdims=True))
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    return c


def build(memory: DataFrame) -> Index | None:
    """The index of ``memory`` (id, v)."""
    spark = memory.sparkSession
    ship(spark)
    rows = memory.where("v is not null and exists(v, x -> x <> 0)").select("id", "v")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    sample = rows.select("v").sample(min(1.0, SAMPLE_ROWS / n), SEED).limit(2 * SAMPLE_ROWS).toArrow()["v"].combine_chunks()
    if not len(sample):
        sample = rows.select("v").limit(1).toArrow()["v"].combine_chunks()
    centroids = spherical(wide(sample, dim), min(MAX_LISTS, isqrt(n)))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng(TaskContext.get().partitionId())
        for b in batches:
            mine = np.argmax(wide(b.column("v"), dim) @ shared.value.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(mine), b.column("id"), b.column("v"), pa.array(rng.integers(0, 1 << 31, len(mine)))], ["list", "id", "v", "deal"])

    typed = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in ("id", "v"))
    dealt = f"{shared_folder(spark)}"
    rows.mapInArrow(assign, f"list int, {typed}, deal long").write.parquet(dealt)
    dealt = spark.read.schema(f"list int, {typed}, deal long").parquet(dealt)
    counts = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    parts = np.zeros(len(centroids), np.int64)
    for r in counts.collect():  # at most MAX_LISTS rows
        parts[r["list"]] = r["parts"]
    path = shared_folder(spark)
    keyed = dealt.join(F.broadcast(counts), "list").select("list", (F.col("deal") % F.col("parts")).cast("int").alias("part"), F.struct("id", "v").alias("x"))
    keyed.groupBy("list", "part").agg(F.sort_array(F.collect_list("x")).alias("x")).select("list", "part", F.col("x.id").alias("ids"), F.col("x.v").alias("vectors")).write.parquet(path)
    return Index(path, centroids, parts)


def wide(lists: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    rows = blocks.matrix(lists)[0]
    out[:, : rows.shape[1]] = rows[:, :dim]
    return out


def search(queries: DataFrame, index: Index, probes: int, k: int) -> DataFrame:
    """(query_id, id, score, rank): the best k rows in the ``probes`` nearest lists of each of ``queries`` (query_id, q)."""
    spark = queries.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((index.centroids, index.parts))
    dim = index.centroids.shape[1]
    table = spark.read.parquet(index.path)
    kind = queries.schema["query_id"].dataType.simpleString()

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, parts = shared.value
        for b in blocks.gathered(batches, blocks.AT_ONCE * blocks.SCORED):
            for i in range(0, b.num_rows, blocks.SCORED):
                some = b.slice(i, blocks.SCORED)
                near = np.argsort(-(wide(some.column("q"), dim) @ centroids.T), axis=1, kind="stable")[:, :probes]
                for which in np.unique(near):
                    mine = pa.array(np.flatnonzero((near == which).any(1)))
                    cells = [pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), some.column(c).take(mine)) for c in ("query_id", "q")]
                    for part in range(int(parts[which])):
                        yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([part], pa.int32()), *cells], ["list", "part", "query_id", "q"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                asked, ids = row.column("query_id").flatten(), row.column("ids").flatten()
                score = wide(row.column("q").flatten(), dim) @ wide(row.column("vectors").flatten(), dim).T
                r, c = blocks.best(score.round(blocks.TIE_DIGITS), blocks.different(asked, ids), k)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(r)), ids.take(pa.array(c)), pa.array(score[r, c])], ["query_id", "id", "score"])

    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).mapInArrow(asks, f"list int, part int, query_id array<{kind}>, q array<array<double>>")
    found = asked.join(table, ["list", "part"]).mapInArrow(answer, f"query_id {kind}, id {table.schema['ids'].dataType.elementType.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", blocks.TIE_DIGITS)), "id"))
    return written(found.withColumn("rank", rank).where(F.col("rank") <= k), blocks.PAIRS)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact hits that the index found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def probes_for(index: Index, share: float) -> int:
    return max(1, ceil(share * len(index.centroids)))
