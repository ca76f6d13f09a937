"""Cleaning, shapes and support of answers against labels written by hand."""

from pyspark.sql import functions as F

from tessera.operators import answers as an

CLEANED = [
    ("  Lund. ", "Lund"), ("Matching facts: a\n- b\nSub-answer: 45 minutes each way.", "45 minutes each way"), ("Matching facts: only", "Matching facts: only"), ("Matching facts: x\nsub answer:", "sub answer:"),
    ('{"final_answer": " Target "}', "Target"), ('{"other": 1}', '{"other": 1}'), ('{broken', '{broken'), ("- one\n* two\nThe answer is Lund.\n• three", "The answer is Lund"), ("- one\n- two", "- one\n- two"),
    (".", "."), ("", ""), (None, ""), ("A long answer that is well beyond sixty characters keeps the period at its end.", "A long answer that is well beyond sixty characters keeps the period at its end."),
]


def test_cleaned(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CLEANED)], "i int, r string")
    assert [r["x"] for r in frame.select("i", an.cleaned(F.col("r")).alias("x")).orderBy("i").collect()] == [w for _, w in CLEANED]


SHAPES = [
    ("", "count", "empty_answer"), ("?!", "count", "answer_is_scaffold"), ("Sub-Answer:", "count", "answer_is_scaffold"), ("Candidates: 1", "count", "answer_is_scaffold"), ("candidates for the job are three", "count", None), ("user", "person", "answer_is_scaffold"),
    ("- turn 3 (assistant): Lund", "location", "answer_is_scaffold"), ("Sure, here are three ideas", "preference", "answer_is_scaffold"), ("Sure, here are three ideas for the trip", "preference", None), ("It seems to be 3", "count", "answer_is_analysis_prose"),
    (" ".join(["word"] * 26), "generic_fact", "answer_is_analysis_prose"), ("I'm not sure about it", "count", "answer_is_idk"), ("Seven", "count", None), ("a few", "count", "count_missing_number"), ("3 weeks", "duration", None), ("3 parks", "duration", "duration_missing_unit_or_number"),
    ("some hours", "duration", "duration_missing_unit_or_number"), ("on Tuesday", "date_time", None), ("long before", "date_time", "datetime_missing_date_phrase"), ("Bought it in Lund", "location", "location_not_place_shaped"), ("the library", "location", None),
    ("over there", "location", "location_not_place_shaped"), ("my friend Ada", "person", None), ("a friend", "person", "entity_or_person_not_named"), ("Try tea", "preference", "preference_is_generic_advice"), ("green tea", "preference", None), ("whatever", "temporal_reasoning", None),
]


def test_shapes(spark):
    frame = spark.createDataFrame([(i, a, t) for i, (a, t, _) in enumerate(SHAPES)], "i int, a string, t string")
    assert [r["x"] for r in frame.select("i", an.shape_fault(F.col("a"), F.col("t")).alias("x")).orderBy("i").collect()] == [w for *_, w in SHAPES]


def test_echo(spark):
    rows = [("Where do I live now?", "where do I live", True), ("Where is it?", "Lund", False), ("Which painting did I sell last year?", "the painting sold last year in sell", True), ("Which painting?", "", False), (None, "x", False)]
    frame = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(rows)], "i int, q string, a string")
    assert [r["x"] for r in frame.select("i", an.is_echo(F.col("a"), F.col("q")).alias("x")).orderBy("i").collect()] == [w for *_, w in rows]


SUPPORT = [
    (1, "lives in  LUND", None), (1, "a red bike of Bo", None), (1, "a blue boat", "unsupported_by_claim"), (1, "I don't know", "answer_is_idk_with_claims"), (2, "I don't know", "answer_is_idk"), (2, "Lund", "no_supporting_claims"), (1, "", "empty_answer"),
    (1, "user", "answer_is_scaffold"), (1, "**Lund**", "answer_is_heading"), (1, "Topic: Lund", "answer_is_heading"), (1, "Can you find Lund", "answer_is_user_request"), (1, "110 for Lund", "answer_is_timestamp_junk"), (1, "According to Ada, Lund", "answer_is_analysis_prose"), (None, "Lund", "no_supporting_claims"),
]


def test_support(spark):
    answers = spark.createDataFrame([(i, s, a, "kept") for i, (s, a, _) in enumerate(SUPPORT)], "answer_id int, session int, answer string, claim string")
    claims = spark.createDataFrame([(1, "Ada lives in Lund"), (1, "Ada has a  red bike"), (1, None), (3, "Lund"), (1, "Ada lives in Lund")], "session int, claim string")
    rows = an.claim_faults(answers, claims).orderBy("answer_id").collect()
    assert [r["claim_fault"] for r in rows] == [w for *_, w in SUPPORT] and {r["claim"] for r in rows} == {"kept"}
    assert an.claim_faults(answers.limit(0), claims).count() == 0 and set(an.claim_faults(answers.where("answer_id = 0"), claims.limit(0)).toPandas()["claim_fault"]) == {"no_supporting_claims"}


def test_only_open_answers_meet_claims(spark):
    """One join, on the session, and no pairs for answers that are judged by themselves."""
    answers = spark.createDataFrame([(1, 1, "Lund", "x"), (2, 1, "**Lund**", "x"), (3, 1, "", "x"), (4, 2, "Lund", "y")], "answer_id int, session int, answer string, other string")
    found = an.claim_faults(answers, spark.createDataFrame([(1, f"I like tea {i}") for i in range(5)], "session int, claim string"))
    assert {r["answer_id"]: r["claim_fault"] for r in found.collect()} == {1: "unsupported_by_claim", 2: "answer_is_heading", 3: "empty_answer", 4: "no_supporting_claims"}
    assert found.columns == [*answers.columns, "claim_fault"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "LeftOuter" in plan


def test_cleaned_step_by_step(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CLEANED)], "i int, r string")
    found = an.with_cleaned(frame, "r", "x")
    assert [r["x"] for r in found.orderBy("i").collect()] == [w for _, w in CLEANED]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") <= 2
