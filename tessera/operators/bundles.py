"""Bundles: the hits of one query, of a stated size, on their way into a context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring

LAYERS = ("LTM", "MTM", "STM")
DEDUPE_THRESHOLD, DEDUPE_MIN_ITEMS = 0.92, 10


def gate(hits: DataFrame) -> DataFrame:
    """Hits that may be shown: neither restricted nor expired."""
    return hits.where(~F.coalesce("restricted", F.lit(False)) & ~F.coalesce("expired", F.lit(False)))


def boosted(hits: DataFrame) -> DataFrame:
    """Scores raised for preferences, for urgent tasks, and for procedures where the query asks how; 1 at most."""
    add = lambda condition, x: F.when(condition, x).otherwise(0.0)
    kind = F.col("candidate_type")
    score = F.col("score") + add(kind == "user_preference", 0.10) + add((kind == "task") & F.col("urgent"), 0.15) + add((kind == "procedure") & F.col("how"), 0.10)
    return hits.withColumn("score", F.least(F.lit(1.0), score))


def rerank(hits: DataFrame, head: int, score: Column) -> DataFrame:
    """Positions after the first ``head`` hits are put in the order of another score; the tail stays."""
    first = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    rows = hits.withColumn("_p", F.row_number().over(first))
    in_head = F.col("_p") <= head
    order = Window.partitionBy("query_id").orderBy(in_head.desc(), F.when(in_head, score).desc_nulls_last(), "_p")
    return rows.withColumn("position", F.row_number().over(order)).drop("_p")


def assemble(hits: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Hits that fit their layer's budget (a prefix by position), long-term memory first."""
    used = F.sum("tokens").over(Window.partitionBy("query_id", "layer").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    budget = F.element_at(F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))]), F.col("layer"))
    turn = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    return hits.where(F.col("layer").isin(list(budgets))).withColumn("_used", used).where(F.col("_used") <= budget).withColumn(
        "place", F.row_number().over(Window.partitionBy("query_id").orderBy(turn, "position"))).drop("_used")


def retrieved(hits: DataFrame, memory: DataFrame, head: int, rerank_score: Column, budgets: dict[str, int]) -> DataFrame:
    """The whole way of hits (query_id, id, score) into a context: their attributes from ``memory`` (id, candidate_type, urgent,
    how, restricted, expired, layer, tokens; hits that it lacks have vanished), the gate, the boosts, the rerank of the
    first ``head``, and the assembly within the layers' budgets. Adds position and place."""
    hydrated = hits.join(memory, "id")
    return assemble(rerank(boosted(gate(hydrated)), head, rerank_score), budgets)


def pairs(bundle: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a before b) within a bundle with a cosine of ``threshold`` or more."""
    side = lambda x: bundle.select("query_id", F.col("id").alias(x), F.col("rank").alias(f"rank_{x}"), F.col("v").alias(f"v_{x}"))
    both = side("a").join(side("b"), "query_id").where("rank_a < rank_b")
    return both.withColumn("sim", scoring.cosine(F.col("v_a"), F.col("v_b"))).where(F.col("sim") >= threshold)


def value_score(importance, confidence):
    return importance + 0.1 * confidence


def dedupe(bundle: DataFrame, threshold: float = DEDUPE_THRESHOLD, min_items: int = DEDUPE_MIN_ITEMS) -> DataFrame:
    """``bundle`` without hits that repeat another. Hits are taken in order; one that is still there is held against the
    later ones that are, and of each pair the one of less value goes, on a tie that of the smaller name. Bundles of fewer
    than ``min_items`` stay."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("rank").reset_index(drop=True)
        if len(items) < min_items:
            return items
        v = np.array(items["v"].tolist(), float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        alike = np.argwhere(np.triu(v @ v.T, 1) >= threshold)
        value = value_score(items["importance"], items["confidence"]).to_numpy()
        there, name = np.ones(len(items), bool), items["id"].astype(str)
        for i in range(len(items)):
            if not there[i]:
                continue
            for j in alike[alike[:, 0] == i, 1]:
                if there[j]:
                    there[i if (value[i], name[i]) < (value[j], name[j]) else j] = False
        return items[there]

    return bundle.groupBy("query_id").applyInPandas(run, bundle.schema)


def prune_to_fit(items: DataFrame, budget: int, keep_blocks: int = 2, prune_turns: bool = False) -> DataFrame:
    """``items`` (query_id, id, layer, value, created_at, tokens) until they fit: facts of least value first, then all but
    the newest ``keep_blocks`` blocks, oldest first, and turns only if asked. The item that crosses the line goes too."""
    part = Window.partitionBy("query_id")
    newest = F.row_number().over(Window.partitionBy("query_id", "layer").orderBy(F.desc("created_at"), F.desc("id")))
    rows = items.withColumns({"_newest": newest, "_over": F.sum("tokens").over(part) - budget})
    step = F.when(F.col("layer") == "LTM", 1).when((F.col("layer") == "MTM") & (F.col("_newest") > keep_blocks), 2).when((F.col("layer") == "STM") & F.lit(prune_turns), 3)
    order = part.orderBy(F.asc_nulls_last("_step"), F.when(F.col("_step") == 1, F.col("value")), "created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_step", step).withColumn("_before", F.sum("tokens").over(order) - F.col("tokens"))
    gone = F.col("_step").isNotNull() & (F.col("_over") > 0) & (F.col("_before") < F.col("_over"))
    return rows.where(~gone).drop("_newest", "_over", "_step", "_before")


def evict(turns: DataFrame, limit: int) -> DataFrame:
    """(session, seq, ...) that a session keeps: while it has more than ``limit`` turns the oldest of LOW and NORMAL importance
    goes, then of HIGH, then of any, summaries last. Turns only ever leave, so the kept ones are the last of one order."""
    rank = F.when(F.col("summary"), 3).when(F.col("importance").isin("LOW", "NORMAL"), 0).when(F.col("importance") == "HIGH", 1).otherwise(2)
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    gone = F.row_number().over(Window.partitionBy("session").orderBy(rank, "seq"))
    return turns.withColumns({"_n": n, "_k": gone}).where(F.col("_k") > F.col("_n") - limit).drop("_n", "_k")


def chain(turns: DataFrame, budget: int, keep: int) -> DataFrame:
    """Strategies one after another, each only for bundles (sessions) that do not fit yet: the last ``keep`` turns, then
    the newest turns within the budget."""
    part = Window.partitionBy("session")
    newest = part.orderBy(F.desc("seq"))
    rows = turns.withColumns({"_total": F.sum("tokens").over(part), "_k": F.row_number().over(newest)}).where((F.col("_total") <= budget) | (F.col("_k") <= keep))
    used = F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_left": F.sum("tokens").over(part), "_used": used})
    return rows.where((F.col("_left") <= budget) | (F.col("_used") <= budget)).drop("_total", "_k", "_left", "_used")
