"""Answers to counting questions from counted facts, and the order of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import text as tx

DATASET_ROUTES = {
    "single-session-user": "fact_lookup", "single-session-assistant": "assistant_memory_lookup", "single-session-preference": "preference_profile",
    "knowledge-update": "knowledge_update", "multi-session": "multi_session_aggregate", "temporal-reasoning": "temporal_reasoning",
}
FALLBACK_SUMMARIES = 6


def route(question: Column, hint: Column) -> Column:
    """The wording decides; where it is neutral, the dataset's type of question; else a fact is looked up."""
    of_hint = F.element_at(F.create_map(*[F.lit(x) for kv in DATASET_ROUTES.items() for x in kv]), F.lower(F.trim(hint)))
    return F.coalesce(tx.first_label(question, fx.ROUTES, None), F.when(hint.isNotNull(), of_hint), F.lit("fact_lookup"))


def relevant(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, subject, predicate, members, ...): each subject's counted facts that a question names, or, if it names
    none, the largest of two members or more. ``questions`` is a small stated table."""
    both = facts.join(F.broadcast(questions)).withColumn("named", tx.names_predicate(F.col("predicate"), F.col("question")))
    w = Window.partitionBy("question_id", "subject")
    rank = F.row_number().over(w.orderBy(F.desc("members"), "predicate"))
    both = both.withColumns({"_any": F.bool_or("named").over(w), "_k": rank})
    return both.where(F.col("named") | (~F.col("_any") & (F.col("members") >= 2) & (F.col("_k") <= FALLBACK_SUMMARIES))).drop("_any", "_k")


def count_answers(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, subject, answer): answered only if the question asks plainly for a count or a sum, is bound to no
    window of time, and names exactly one of the subject's facts."""
    q = F.col("question")
    asks = ~q.rlike(fx.SCOPED) & (q.rlike(fx.COUNT_INTENT) | q.rlike(fx.MONEY_SUM))
    rows = facts.join(F.broadcast(questions.where(asks))).where(tx.names_predicate(F.col("predicate"), q))
    one = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("question_id", "subject"))).where("_n = 1")
    total = F.trim(F.concat(tx.number(F.col("total")), F.lit(" "), F.coalesce("unit", F.lit(""))))
    answer = (F.when(F.col("total").isNotNull() & (q.rlike(fx.MONEY_SUM) | q.rlike(fx.SUM_INTENT)), total)
              .when(q.rlike(fx.COUNT_INTENT) & (F.col("members") >= 2), F.col("members").cast("string")))
    return one.select("question_id", "subject", answer.alias("answer")).where("answer is not null")


def heuristic_supersession(facts: DataFrame) -> DataFrame:
    """(id, op, target): a fact with an update marker ends the latest earlier fact without one that mentions one of its
    entities. Facts (owner, id, seq, text, entities) meet by entity words, not as pairs."""
    marked = facts.withColumn("marker", F.col("text").rlike(fx.UPDATE_MARKERS))
    said = marked.where("marker").select("owner", "id", "seq", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("word"))
    words = marked.where("not marker").select("owner", F.col("id").alias("old"), F.col("seq").alias("old_seq"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word"))
    # one sorted sweep for each (owner, word): the latest unmarked fact before
    side = words.select("owner", "word", F.col("old_seq").alias("seq"), F.lit(0).alias("k"), F.col("old"), F.lit(None).cast("long").alias("id"))
    ask = said.select("owner", "word", "seq", F.lit(1).alias("k"), F.lit(None).cast("long").alias("old"), "id")
    w = Window.partitionBy("owner", "word").orderBy("seq", "k").rowsBetween(Window.unboundedPreceding, 0)
    hits = side.unionByName(ask).withColumns({"_t": F.last("old", True).over(w), "_s": F.last(F.when(F.col("k") == 0, F.col("seq")), True).over(w)}).where("k = 1")
    found = hits.groupBy("id").agg(F.max(F.struct("_s", "_t")).alias("x"))
    rows = marked.select("id", "marker").join(found, "id", "left")
    return rows.select("id", F.when(F.col("marker") & F.col("x._t").isNotNull(), "DELETE").otherwise("NOOP").alias("op"), F.when(F.col("marker"), F.col("x._t")).alias("target"))
