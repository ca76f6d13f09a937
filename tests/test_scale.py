"""What keeps a query's growth down: work that is not repeated, not shuffled, and not done where it cannot find anything."""

import re
import time

from pyspark.sql import functions as F

from tessera.functions import fixed as fx, replies, text as tx
from tessera.operators import candidates, graph, grounding as gr, intents, summaries

SF = "/root/testdata/sf0.001"
WORDS = "Ada and Bo work at the Acme Corp; Cy_2 uses Spark-SQL and Dee's tools, the R&D team made\n\tOrbit's  core (Bo built it) uses works at é x’y created a_b developed by was employed by Big Co".split(" ")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_relations_are_those_of_the_patterns_on_the_whole_text(spark):
    texts = [" ".join(WORDS[(i * k + i // 7) % len(WORDS)] + (".", ",", " -", "", "")[(i + k) % 5] for i in range(k, k + 60)) for k in range(1, 60)] + ["", "a uses b uses c", "x uses y.z uses w", ".́uses q uses r"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: [tuple(x) for x in r["x"]] for r in frame.select("id", tx.relations(F.col("t")).alias("x")).collect()}
    of = lambda kind, p, t: [(m[1].strip(" "), kind, m[2].strip(" ")) for m in re.finditer(p, t, re.ASCII)]
    assert got == {i: [x for kind, p in fx.RELATIONS for x in of(kind, p, t)] for i, t in enumerate(texts)} and sum(map(len, got.values())) > 30


def test_texts_without_a_relation_cost_little(spark):
    prose = "The quick brown fox went over many lazy dogs near old river banks while seven grey birds sang below low clouds. " * 9000
    frame = spark.createDataFrame([(i, prose) for i in range(8)], "id int, t string").repartition(4).cache()
    assert frame.count() == 8
    began = time.time()
    assert frame.select(F.sum(F.size(tx.relations(F.col("t"))))).first()[0] == 0
    assert time.time() - began < 8  # half a minute and more where every pattern runs over every word


def test_summaries_are_made_inside_the_row(spark):
    frame = spark.createDataFrame([(1, "A boat. A boat sails. Rain falls."), (1, "A boat. A boat sails. Rain falls."), (2, None)], "id long, text string")
    made = summaries.summaries(frame, 5)
    assert "Exchange" not in plan(made)
    assert sorted(made.collect()) == [(1, "A boat. A boat sails."), (1, "A boat. A boat sails."), (2, "")]  # rows that share an id have a summary each


def test_expansion_filters_edges_where_they_are_read(spark, monkeypatch):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "query_id long, id string, rank int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c"), ("b", "c"), ("z", "a")], "source string, target string").distinct()
    want = [(1, "c", 0.0), (2, "c", 0.0)]
    tree = plan(graph.expand(hits, edges, 1))
    distinct = [m.start() for m in re.finditer(r"HashAggregate\(keys=\[source#\d+, target#", tree)]
    assert len(distinct) == 2 and tree.index("LeftSemi") > max(distinct)  # below the distinct and its shuffle
    assert sorted(tuple(r) for r in graph.expand(hits, edges, 1).select("query_id", "id", "score").collect()) == want
    monkeypatch.setattr(graph, "MAX_SOURCES", 0)  # many sources: a shuffle join
    assert sorted(tuple(r) for r in graph.expand(hits, edges, 1).select("query_id", "id", "score").collect()) == want


def test_walks_carry_no_paths_through_shuffles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "b"), ("e", None), (None, "a")]
    edges = spark.createDataFrame(rows, "source string, target string")
    seeds = spark.createDataFrame([("a",), ("x",), ("a",), (None,), ("q",)], "id string")
    walks, found = [[s] for s in ("a", "x", "a")], []
    for _ in range(4):
        walks = [[*w, t] for w in walks for s, t in rows if s == w[-1] and t is not None and t not in w]
        found += walks
    made = graph.walk(seeds, edges, 4)
    assert sorted((r["seed"], r["target"], r["depth"], tuple(r["path"])) for r in made.collect()) == sorted((w[0], w[-1], len(w) - 1, tuple(w)) for w in found)
    # the first edges are shuffled as pairs of nodes
    assert not re.search(r"Exchange hashpartitioning\(target[^\n]*\n[^\n]*Project \[[^\]]*array", plan(made))


def test_parts_are_judged_once(spark):
    frame = spark.createDataFrame([(1, "Where did I get my degree?", ["Where did I get my degree?", "Who visited Lund in 2021?"]), (2, "Where?", []), (3, "Where?", None)], "id int, question string, parts array<string>")
    made = intents.guarded(frame)
    tree = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in tree.split("\n") if "Filter" in line and "RLIKE" in line] and tree.count("chronolog") == 2  # the question and its parts
    assert [(r["id"], r["pos"], r["reason"] is None, r["fallback"]) for r in made.orderBy("pos").collect()] == [(1, 0, True, False), (1, 1, False, False)]


def test_few_sentences_are_searched_for_what_refuses_them(spark):
    text = "The " + "1 2 3 4 5 6 7 8 9 0 a-b " * 11 + "shop. "  # digits that may begin a number of a card
    frame = spark.createDataFrame([(i, text * 400 + "I live in Lisbon. I might live in Rome. My password is in Oslo.") for i in range(40)], "id long, text string").repartition(4).cache()
    assert frame.count() == 40
    tree = candidates.durable_facts(frame)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in tree.split("\n") if "Filter CASE" in x or "Filter" in x and "RLIKE" in x)
    assert line.index("was\\s+born") < line.index("credential")  # what a rule asks comes before what refuses
    assert {(r["fact"], r["rule"]) for r in candidates.durable_facts(frame).collect()} == {("I live in Lisbon.", "stative-i")}


def test_groups_of_a_pattern_are_read_once(spark):
    frame = spark.createDataFrame([(1, "I have two boats and own 12 melons. The old lamp is worth ten crowns.")], "id long, text string")
    tree = gr.candidates(frame, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in tree.split("\n") if "Generate explode" in x)
    assert line.count("RLIKE") == len(gr.EXTRACTORS)  # a clause that a pattern does not match is read once
    assert [(r["value"], r["unit"]) for r in gr.candidates(frame, ["id"]).where("type = 'count'").orderBy("value").collect()] == [("10", "crowns"), ("12", "melons"), ("2", "boats")]


def test_only_asked_sessions_are_searched(spark, monkeypatch):
    texts = spark.createDataFrame([(1, 1, "user", "I own 3 boats."), (2, 1, "user", "I own 4 boats."), (None, 1, "user", "I own 5 boats.")], "session long, seq long, role string, text string")
    asked = spark.createDataFrame([(7, 2, "count", "How many boats do I own?"), (8, 2, "count", "How many?")], "query_id long, session long, kind string, question string")
    for most in (10, 0):  # by a broadcast, by a shuffle join
        monkeypatch.setattr(gr, "MAX_SESSIONS", most)
        assert [r["text"] for r in gr.asked_texts(texts, asked).collect()] == ["I own 4 boats."]


def test_replies_are_parsed_once(spark):
    frame = spark.createDataFrame([('{"facts": [{"text": "The user owns a bike", "confidence": 1}, {"text": "the user OWNS a bike", "confidence": 1}]}',)], "reply string")
    made = frame.select(replies.facts(F.col("reply")).alias("x"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [x["text"] for x in made.first()["x"]] == ["The user owns a bike"]
