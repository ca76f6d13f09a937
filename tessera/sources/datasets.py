"""Question data sets from JSON, and results and traces to JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

TURN = "struct<role: string, content: string>"
QUESTIONS = (
    "question_id string, question string, answer string, question_type string, question_date string, haystack_session_ids array<string>, "
    f"haystack_dates array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"
)
CONVERSATION_TURN = "speaker string, text string, dia_id string"
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row a question; numbers as answers are read as text."""
    return spark.read.schema(QUESTIONS).option("multiLine", "false").json(path)


def haystack_turns(questions: DataFrame) -> DataFrame:
    """One row a turn of a question's sessions, with the session's date."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    sessions = questions.select("question_id", F.explode(zipped).alias("s"))
    turns = sessions.select("question_id", F.col("s.session_id").alias("session_id"), tx.haystack_date(F.col("s.date")).alias("session_at"), F.posexplode("s.turns").alias("turn", "t"))
    return turns.select("question_id", "session_id", "session_at", "turn", "t.role", "t.content")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn of (sample_id, sessions map<name, array<turn>>, dates map<name, text>), sessions by their number."""
    rows = conversations.select("sample_id", "dates", F.explode("sessions").alias("session", "turns"))
    number = F.regexp_extract("session", "([0-9]+)$", 1).cast("int")
    turns = rows.select("sample_id", "session", number.alias("session_no"), F.element_at("dates", F.col("session")).alias("session_date"), F.posexplode("turns").alias("turn", "t"))
    return turns.select("sample_id", "session_no", "session_date", "turn", "t.speaker", "t.text", "t.dia_id")


def write_results(rows: DataFrame, path: str) -> None:
    """metrics (JSON, one line) and failures (CSV with a header) of rows (id, kind, correct, ms)."""
    metrics = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.round(F.avg("ms"), 9).alias("mean_ms"), F.median("ms").alias("median_ms"))
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    rows.where("not correct").select("id", "kind", "ms").write.mode("overwrite").option("header", True).csv(f"{path}/failures")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema("n long, accuracy double, mean_ms double, median_ms double").json(f"{path}/metrics"),
            spark.read.schema("id long, kind string, ms long").option("header", True).csv(f"{path}/failures"))


def checked_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces with ``valid``: every field there and of its type."""
    rows = spark.read.schema("question_id string, answer string, latency_ms double, _corrupt_record string").json(path)
    return rows.withColumn("valid", F.col("question_id").isNotNull() & F.col("answer").isNotNull() & F.col("latency_ms").isNotNull() & F.col("_corrupt_record").isNull())
