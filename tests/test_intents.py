"""Intents, gates, parts and their guard against labels written by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import intents

INTENTS = [
    ("What was my previous occupation?", "previous_occupation", "occupation_title", {}), ("what is my LAST job", "previous_occupation", "occupation_title", {}), ("What role did I hold in the past?", "previous_occupation", "occupation_title", {}),
    ("What did I use to work as?", "previous_occupation", "occupation_title", {}), ("What did I do for a living before?", "previous_occupation", "occupation_title", {}), ("What major did I study?", "degree_in", "field_of_study", {}),
    ("What did I buy for my sister's birthday?", "bought_gift_for", "purchased_item", {"recipient": "sister", "occasion": "birthday"}), ("What did I pick up for my brother’s wedding?", "bought_gift_for", "purchased_item", {"recipient": "brother", "occasion": "wedding"}),
    ("What did I get yesterday?", "bought_gift_for", "purchased_item", {}), ("How much is the painting worth in terms of what I paid?", "value_compared_to_paid", "comparative_phrase", {"asset": "painting"}),
    ("How many shirts did I pack for Costa Rica?", "count_packed", "count_with_unit", {"item": "shirt", "destination": "costa rica"}), ("How many dresses did I bring?", "count_packed", "count_with_unit", {"item": "dresse"}),
    ("When was the fundraising dinner?", "event_date", "date", {"event": "when was the fundraising"}), ("Where do I live?", None, None, {}), ("", None, None, {}), (None, None, None, {}),
]


def test_intents(spark):
    frame = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(INTENTS)], "i int, q string")
    got = {r["i"]: (r["relation"], r["shape"], dict(r["constraints"])) for r in frame.select("i", *intents.parsed(F.col("q"))).collect()}
    assert [got[i] for i in range(len(INTENTS))] == [tuple(x[1:]) for x in INTENTS]


def test_gates(spark):
    rows = [("Can you RECOMMEND a book?", "preference"), ("What happened since May", "temporal"), ("since when?", ""), ("Where do I currently live after the move", "temporal knowledge_update"), (None, "")]
    frame = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "i int, q string").select("i", *intents.gates(F.col("q"))).orderBy("i").collect()
    assert [" ".join(g for g in ("preference", "temporal", "knowledge_update") if r[g]) for r in frame] == [w for _, w in rows]


def test_parts(spark):
    rows = [
        ("Which is newer, A or B?", "1. A?\n2) B?\r\n\n - a?\n• C?\n* D?\nE?", ["A?", "B?", "C?", "D?"]), ("Where do I live?", "Where?\nWho am I?", ["Where do I live?"]), ("Where do I live?", "Where is home?", ["Where is home?"]),
        ("Where have I lived?", "Where?\nWhen?", ["Where?", "When?"]), ("Anything?", None, ["Anything?"]), ("Anything?", " \n- ", ["Anything?"]),
    ]
    frame = spark.createDataFrame([(i, q, r) for i, (q, r, _) in enumerate(rows)], "i int, q string, r string")
    assert [r["p"] for r in frame.select("i", intents.parts(F.col("r"), F.col("q")).alias("p")).orderBy("i").collect()] == [w for *_, w in rows]


GUARD = [
    ("How much is the painting worth?", "how much is the painting WORTH? ", None), ("How much is the painting worth?", "How much did I pay for the painting?", "relation_changed"), ("How much is the painting worth?", "Where is the painting?", "answer_type_changed"),
    ("Which painting?", "Which bookshelf?", "object_dropped"), ("Tell me of the painting", "Tell me of the bookshelf", None), ("Where did I get my degree?", "Where did I get it?", "object_anchor_dropped"), ("Where did I go in 2021 with Ada?", "Where did I go with Ada?", "temporal_dropped"),
    ("Where did I go in 2021 with Ada?", "Where did I go in 2022 with Ada?", "temporal_changed"), ("Where did I go with Ada?", "Where did I go with Ada since 2020?", "temporal_added_specific"), ("Where did I go with Ada?", "Where did I go with Ada now?", None),
    ("Is it?", "Was that?", "different_fact"),
]


def test_guard(spark):
    rows = GUARD
    frame = spark.createDataFrame([(i, q, [p, " "], "kept") for i, (q, p, _) in enumerate(rows)], "i int, question string, parts array<string>, `a.b` string")
    got = {r["i"]: r for r in intents.guarded(frame).collect()}
    assert [got[i]["reason"] for i in range(len(rows))] == [w for *_, w in rows]
    assert all(r["fallback"] == (r["reason"] is not None) and r["a.b"] == "kept" and r["pos"] == 0 for r in got.values())


@pytest.mark.parametrize("question, parts, want", [("Where is Ada and who is Bo?", ["Where is Ada?", "Who was it?"], [(0, None, False), (1, "answer_type_changed", False)]), ("x", [], []), ("x", None, []), (None, ["Where?"], [(0, "different_fact", True)])])
def test_fallback_and_edges(spark, question, parts, want):
    frame = spark.createDataFrame([(question, parts)], "question string, parts array<string>")
    assert [(r["pos"], r["reason"], r["fallback"]) for r in intents.guarded(frame).orderBy("pos").collect()] == want
