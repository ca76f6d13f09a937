"""Token-budget operators over ordered turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_first(partition: str = "session", order: str = "seq") -> Window:
    return Window.partitionBy(partition).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def within_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns whose running token sum fits (a prefix: it ends at the first overflow)."""
    return turns.withColumn("running", F.sum("tokens").over(newest_first())).where(F.col("running") <= budget)


def within_budget_keep_first(turns: DataFrame, budget: int) -> DataFrame:
    """As ``within_budget``, but the newest block always stays and a used-up budget ends the list."""
    rows = turns.withColumns({"running": F.sum("tokens").over(newest_first()), "position": F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))})
    return rows.where((F.col("position") == 1) | ((F.col("running") <= budget) & (F.col("running") - F.col("tokens") < budget)))


def last_n(turns: DataFrame, n: int) -> DataFrame:
    return turns.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).where(F.col("position") <= n)


def stats(turns: DataFrame, budget: int, reserve: int) -> DataFrame:
    used = F.coalesce(F.sum("tokens"), F.lit(0))
    return turns.groupBy("session").agg(F.count(F.lit(1)).alias("turns"), used.alias("tokens"), (used / (budget - reserve)).alias("utilization"),
                                        F.greatest(F.lit(0), F.lit(budget - reserve) - used).alias("remaining"))


def prune_to_fit(items: DataFrame, budget: int) -> DataFrame:
    """Least valuable first until the rest fits; the item that crosses the line goes too."""
    total = F.sum("tokens").over(Window.partitionBy("session"))
    order = Window.partitionBy("session").orderBy("score", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumns({"overage": total - budget, "before": F.sum("tokens").over(order) - F.col("tokens")})
    return rows.where(~((F.col("overage") > 0) & (F.col("before") < F.col("overage"))))


def trim(turns: DataFrame, keep: int, max_chars: int) -> DataFrame:
    """Older turns folded into one line, newest ``keep`` untouched."""
    rows = turns.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq"))))
    older = rows.where(F.col("position") > keep).groupBy("session").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("texts"), F.count(F.lit(1)).alias("folded"))
    return older.select("session", "folded", F.substring(F.concat_ws(" | ", "texts"), 1, max_chars).alias("summary"))


def evidence_window(turns: DataFrame, reach: int) -> DataFrame:
    """Each turn with the turns around it in its session."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(-reach, reach)
    return turns.withColumns({"window_tokens": F.sum("tokens").over(w), "window_turns": F.count(F.lit(1)).over(w)})


def position_tiers(items: DataFrame) -> DataFrame:
    """The first 15 % of each session, the next 25 %, and the rest."""
    w = Window.partitionBy("session")
    share = F.row_number().over(w.orderBy(F.desc("score"), "seq")) / F.count(F.lit(1)).over(w)
    return items.withColumn("tier", F.when(share <= 0.15, 1).when(share <= 0.40, 2).otherwise(3))
