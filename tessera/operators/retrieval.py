"""Batched retrieval: many queries against the whole memory in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text as tx
from tessera.operators import blocks
from tessera.sources.shared import written

#: Terms of all queries up to which documents are filtered where they are read.
MAX_TERMS = 500
#: Ids that are swept together.
ID_RANGE = 100_000


def rank_by(df: DataFrame, score, k: int, ties=("id",), name: str = "rank") -> DataFrame:
    """The first k of each query; Spark keeps only k rows of a query in each task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(score, *[F.col(t) for t in ties])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def knn(queries: DataFrame, memory: DataFrame, k: int, same_kind: bool = False) -> DataFrame:
    """Exact cosine top-k of a stated query set: blocks of queries against blocks of memory, one matrix product for each
    pair, and the best of each block before the shuffle. ``same_kind``: only memories of the query's kind."""
    asked = queries.select("query_id", "q", *(["query_kind"] if same_kind else []))
    return written(rank_by(blocks.cosines(asked, memory.select("id", "kind", "v"), k, same_kind), F.desc(F.round("score", blocks.TIE_DIGITS)), k), blocks.PAIRS)


def neighbours_by_id(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): the k ids next to each query's, from one sorted sweep instead of pairs."""
    both = memory.select("id", F.lit(False).alias("asks")).unionByName(queries.select(F.col("query_id").alias("id"), F.lit(True).alias("asks")))
    ids = F.col("id")
    part = F.floor(ids / ID_RANGE)
    # an id is read in its own range and in the ranges next to it, whose borders may cut a neighbourhood
    spread = both.withColumn("_range", F.explode(F.when(F.col("asks"), F.array(part)).otherwise(F.array(part - 1, part, part + 1))))
    w = Window.partitionBy("_range").orderBy("id", "asks")
    near = F.collect_list(F.when(~F.col("asks"), ids)).over(w.rowsBetween(-2 * k - 1, 2 * k + 1))
    found = spread.withColumn("_near", near).where("asks").select(ids.alias("query_id"), F.explode("_near").alias("id")).where("id <> query_id")
    return rank_by(found.withColumn("gap", F.abs(F.col("id") - F.col("query_id"))), F.col("gap"), k).select("query_id", "id", "rank")


def trigram_topk(queries: DataFrame, memory: DataFrame, k: int, threshold: float) -> DataFrame:
    """Trigram similarity of a stated query set (``grams``: see ``blocks.with_grams``): pairs of blocks of queries and of memory are
    bounded by sizes and groups of grams, then by a matrix product, and what is left is counted; no gram is a row of a shuffle."""
    return written(rank_by(blocks.jaccards(queries.select("query_id", F.col("grams").alias("asked")), memory.select("id", "grams"), k, threshold), F.desc("score"), k), blocks.CODED_PAIRS)


def bm25(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 with idf ln(1 + (N - df + .5) / (df + .5)). Only the queries' terms are joined; term counts aggregate
    on the map side."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    docs = corpus.select("id", tx.tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    terms = [r["term"] for r in asked.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    if len(terms) <= MAX_TERMS:  # few terms: others go before the arrays are exploded
        tokens = docs.select("id", "len", F.explode(F.filter("t", lambda x: x.isin(terms))).alias("term"))
    else:
        tokens = docs.select("id", "len", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = tokens.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").join(asked, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rank_by(scored.groupBy("query_id", "id").agg(F.sum(part).alias("score")), F.desc(F.round("score", 9)), k)


def fuse(channels: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion of any number of channels (query_id, id, rank); ties: best rank, then id."""
    all_ranks = channels[0].select("query_id", "id", "rank")
    for c in channels[1:]:
        all_ranks = all_ranks.unionByName(c.select("query_id", "id", "rank"))
    fused = all_ranks.groupBy("query_id", "id").agg(F.sum(scoring.rrf(F.col("rank"))).alias("rrf"), F.min("rank").alias("best"))
    return rank_by(fused, F.desc(F.round("rrf", 12)), k, ("best", "id"), "position")


def fuse_first_seen(channels: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion whose ties go to the hit that the channels, in their order, name first. An empty channel
    adds nothing."""
    rows = None
    for i, c in enumerate(channels):
        some = c.select("query_id", "id", "rank", F.lit(i).alias("channel"))
        rows = some if rows is None else rows.unionByName(some)
    fused = rows.groupBy("query_id", "id").agg(F.sum(scoring.rrf(F.col("rank"))).alias("rrf"), F.min(F.struct("channel", "rank")).alias("seen"))
    return rank_by(fused, F.desc(F.round("rrf", 12)), k, ("seen", "id"), "position")


def hybrid(queries: DataFrame, memory: DataFrame, k: int, pool: int) -> DataFrame:
    """Dense and lexical channels, fused, normalised and scored with importance and recency."""
    dense = knn(queries.select("query_id", "q"), memory.select("id", "kind", "v"), pool)
    lexical = trigram_topk(queries.select("query_id", "grams"), memory.select("id", "grams").where("id is not null"), pool, 0.05).where("id <> query_id")
    fused = fuse([dense, lexical], pool)
    w = Window.partitionBy("query_id")
    scored = fused.join(memory.select("id", "importance", "age_hours", "access_count"), "id").withColumn(
        "relevance", scoring.minmax(F.col("rrf"), F.min("rrf").over(w), F.max("rrf").over(w), 1.0))
    score = scoring.composite(F.col("relevance"), F.col("importance"), scoring.recency(F.col("age_hours"), F.col("access_count")), F.lit(1.0))
    return rank_by(scored.withColumn("score", score), F.desc(F.round("score", 9)), k).select("query_id", "id", "rank", "score")
