"""Rules against labels written by hand, bundles against plain loops, the verbs, and loaders."""

import collections
import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring, text as tx
from tessera.memory import Memory
from tessera.operators import bundles, candidates, graph, memory, policy, promotion, questions, summaries, temporal
from tessera.sources import datasets, store
from tessera.streaming import sessions


def column(spark, rows, f):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(frame.collect(), key=lambda r: r["i"])]


def test_durable_rules(spark):
    want = {
        "I live in Lisbon.": "stative-i", "My cat is small.": "stative-my", "I moved to Oslo last year.": "changed-attribute", "I switched from Vim to Zed": "changed-attribute",
        "Sou vegetariano": "stative-ml", "Je suis fatigué": None, "I always squash before merging": "stative-i", "I handle all our deployments": "stative-i", "I broke every build today": None,
        "I am running the tests": None, "I am using Python": "stative-i", "My build is failing": None, "I might move to Rome": None, "I don't like rain": None, "Do I live here?": None,
        "I use this file": None, "I have a dentist appointment on Thursday": None, "password is hunter2": None, "ok": None, "You live in Rome": None, "I am on the train": None, "x" * 400: None,
    }
    assert column(spark, list(want), tx.durable_rule) == list(want.values())


def test_secrets_and_retractions(spark):
    secrets = ["sk-abcdefghijkl1234", "ghp_abcdefghijklmnop12", "AKIAABCDEFGHIJKL", "eyJhbGciOiJI.eyJzdWIiOiIx.", "d41d8cd98f00b204e9800998ecf8427e", "4111 1111 1111 1111", "123-45-6789", "my api key", "postgres://u:p@h"]
    assert column(spark, [*secrets, "a plain sentence", "12-34"], tx.is_secret) == [True] * 9 + [False] * 2
    assert column(spark, ["that was wrong", "I was never in Rome", "scratch that", "actually I didn't", "I never eat meat", "I moved on"], tx.is_retraction) == [True] * 4 + [False] * 2


def test_attributes(spark):
    want = {"I live in Boston": "residence", "I live in fear": None, "I drive a Tesla": "vehicle", "I drive a hard bargain": None, "I drive a red car": "vehicle", "I left Nimbus Data and joined Stripe": "employer",
            "call me Ann": "name", "My favorite color is green": "favorite color", "My opinion is mixed": None, "My rule is that it ships": None, "": None}
    assert column(spark, list(want), tx.attribute) == list(want.values())


def test_clauses(spark):
    assert column(spark, ["We use Postgres 16, pgvector needs 0.8 or newer", "We went to Bhilai, India", "I like tea. You like milk; fine", "One, which is two, is three", ""], tx.clauses) == [
        ["We use Postgres 16.", "pgvector needs 0.8 or newer."], ["We went to Bhilai, India"], ["I like tea.", "You like milk;", "fine"], ["One, which is two, is three"], []]


def test_plurals_and_sentences(spark):
    rows = [("tank", 1, "tank"), ("tank", 2, "tanks"), ("box", 2, "boxes"), ("city", 3, "cities"), ("day", 2, "days"), ("top from H&M", 2, "tops from H&M"), ("gaming session", 4, "gaming sessions")]
    frame = spark.createDataFrame(rows, "noun string, n int, want string")
    assert frame.where(tx.plural(F.col("noun"), F.col("n")) != F.col("want")).isEmpty()
    one = spark.range(1).select(tx.fact_sentence(F.lit("user"), F.lit("session"), F.lit(4), F.lit(140.0), F.lit("hours")).alias("x")).first()["x"]
    assert one == "User has 4 sessions totaling 140 hours."


def test_relations_and_candidates(spark):
    t = spark.createDataFrame([(1, "Ada Byron works at Initech and Bo uses Spark. Ann created Orbit"), (2, "token = abcdef123 so I prefer token = abcdef123 daily"), (3, "The standup is at nine"), (4, "We decided to ship. The standup is at nine")], "id long, text string")
    got = {(r["id"], r["subject"], r["predicate"], r["object"]) for r in candidates.relation_triples(t).collect()}
    assert {(1, "Ada Byron", "EMPLOYED_BY", "Initech"), (1, "Bo", "USES", "Spark"), (1, "Ann", "CREATED", "Orbit")} <= got
    kinds = {(r["id"], r["candidate_type"]) for r in candidates.typed(t).collect()}
    assert kinds == {(2, "sensitive_data"), (3, "meeting_episode"), (4, "decision")}


def test_question_routes(spark):
    rows = [("What did you recommend?", None, "assistant_memory_lookup"), ("Where do I live now?", None, "knowledge_update"), ("What is my favourite tea?", None, "preference_profile"),
            ("How long ago was it?", None, "temporal_reasoning"), ("How many in total?", None, "multi_session_aggregate"), ("How many shirts?", "multi-session", "multi_session_aggregate"), ("How many shirts?", None, "fact_lookup"), ("Why?", "odd", "fact_lookup")]
    frame = spark.createDataFrame(rows, "q string, h string, want string")
    assert frame.where(questions.route(F.col("q"), F.col("h")) != F.col("want")).isEmpty()


def test_dates(spark):
    assert column(spark, ["2024-03-05", "2023", "2024-02-30", "soon", None], tx.parsed_date) == [dt.datetime(2024, 3, 5), dt.datetime(2023, 1, 1), None, None, None]
    assert column(spark, ["2023/05/30 (Tue) 21:40", "30.5."], tx.haystack_date) == [dt.datetime(2023, 5, 30, 21, 40), None]


def test_scores(spark):
    row = spark.range(1).select(scoring.sigmoid(F.lit(-800.0)).alias("a"), scoring.sigmoid(F.lit(800.0)).alias("b"), scoring.legacy_recency(F.lit(7.0)).alias("c"), scoring.cost(F.lit("x-small"), F.lit(2000), F.lit(1000)).alias("d"), scoring.compress_fraction(F.lit(0.5), F.lit(0.99)).alias("e")).first()
    assert (row["a"], row["b"]) == (0.0, 1.0) and math.isclose(row["c"], 0.5) and math.isclose(row["d"], 0.0025) and row["e"] == 0.9


def plain_dedupe(items, threshold):
    """Rows (id, vector, value) in order."""
    gone = set()
    for i, (a, v, x) in enumerate(items):
        if a in gone:
            continue
        for b, w, y in items[i + 1 :]:
            if b not in gone and float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= threshold:
                gone.add(a if (x, str(a)) < (y, str(b)) else b)
    return {a for a, _, _ in items} - gone


def test_dedupe_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for q in range(8):
        base = rng.normal(size=(6, 5))
        items = [(100 * q + i, (base[rng.integers(6)] + 0.3 * rng.normal(size=5)), float(rng.integers(4)) / 4) for i in range(20 if q else 5)]
        want[q] = plain_dedupe(items, 0.9) if q else {a for a, _, _ in items}
        rows += [(q, a, r, [float(z) for z in v], x, 0.0) for r, (a, v, x) in enumerate(items)]
    frame = spark.createDataFrame(rows, "query_id int, id int, rank int, v array<double>, importance double, confidence double")
    got = {}
    for r in bundles.dedupe(frame, 0.9).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == want


def plain_summary(text, budget):
    """Sentence by sentence, in the order of their scores."""
    found = [s.strip() for s in re.split("\x01", re.sub(summaries.SENTENCE_END, "\\1\x01\\2", text or "")) if s.strip()]
    words = [[w for w in re.findall(summaries.WORD, s.lower()) if len(w) > 2 and w not in summaries.STOP_WORDS] for s in found]
    counts = collections.Counter(w for ws in words for w in ws)
    if not counts:
        whole = " ".join(found)
        return whole if len(whole.split()) <= budget else whole[: 4 * budget].rstrip() + "…"
    score = [sum(counts[w] for w in ws) / max(counts.values()) / len(ws) ** 0.5 if ws else 0.0 for ws in words]
    score = [round(s + 0.15 * (1 - i / max(1, len(found) - 1)), 9) for i, s in enumerate(score)]
    taken, used = [], 0
    for i in sorted(range(len(found)), key=lambda i: (-score[i], i)):
        cost = len(found[i].split())
        if used < budget and (not taken or used + cost <= budget):
            taken.append(i)
            used += cost
    return " ".join(found[i] for i in sorted(taken))


def test_extractive_summary(spark):
    lake = "Rain fell on the lake all day. The lake rose over the road. Nobody noticed. The road by the lake was closed for rain repairs."
    texts = [lake, "", None, "It is. So it is.", "One two three", lake * 30, "A. B! (C) \"D?\" lake. lake? Lake", "It is. " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for budget in (2, 12, 100):
        got = {r["id"]: r["summary"] for r in summaries.summaries(frame, budget).collect()}
        assert got == {i: plain_summary(t, budget) for i, t in enumerate(texts)}
        if budget == 12:
            assert got[0] == "Nobody noticed. The road by the lake was closed for rain repairs." and got[3] == "It is. So it is."


def test_policies(spark):
    rows = [(1, "sensitive_data", "private", None), (2, "fact", "confidential", None), (3, "code_decision", "private", None), (4, "task", "private", dt.datetime(2024, 1, 10)), (5, "task", "private", None), (6, "temporary_context", "private", None), (7, "meeting_episode", "restricted", None)]
    frame = spark.createDataFrame(rows, "id long, candidate_type string, sensitivity string, valid_until timestamp")
    got = {r["id"]: r for r in policy.merge(frame, F.lit("2024-01-09 00:00:00").cast("timestamp")).collect()}
    assert [got[i]["action"] for i in range(1, 8)] == ["ask_user", "store", "store", "store", "store", "ignore", "ask_user"]
    assert got[2]["policies"] == "sensitivity_v1,default_fact_v1" and got[2]["redact"] and not got[2]["cross_session"]
    assert got[3]["policies"] == "decision_v1,code_v1" and got[3]["projections"] == "canonical,vector,temporal,code_symbol" and got[3]["scope"] == "ltm"
    assert (got[4]["ttl"], got[5]["ttl"]) == (2 * 86400, 7 * 86400) and not got[7]["team"] and got[7]["ttl"] == 30 * 86400
    assert {r["id"]: (r["table"], r["tags"]) for r in policy.routed(policy.merge(frame, F.lit("2024-01-09").cast("timestamp"))).collect()} == {
        1: ("approvals", ""), 2: ("canonical", ""), 3: ("canonical", "code_symbol_index"), 4: ("canonical", "task_queue"), 5: ("canonical", "task_queue"), 7: ("approvals", "")}


def test_decider_sees_the_undecided_only(spark):
    rows = spark.createDataFrame([(1, "ADD"), (2, "UNDECIDED")], "id long, op string")

    def decide(batches):
        for b in batches:
            assert set(b["op"]) <= {"UNDECIDED"}
            yield b.assign(op="NOOP")

    assert {tuple(r) for r in promotion.with_decider(rows, decide, "id long, op string").collect()} == {(1, "ADD"), (2, "NOOP")}
    assert promotion.with_decider(rows, None, "").count() == 2


def test_walk_cuts_and_caps(spark):
    e = spark.createDataFrame([("a", "b", "P", 0.9), ("a", "c", "Q", 0.9), ("a", "d", "P", 0.1), ("b", "x", "P", 0.9)], "source string, target string, predicate string, weight double")
    seed = spark.createDataFrame([("a",)], "id string")
    assert {r["target"] for r in graph.walk(seed, e, 2, ["P"], 0.5).collect()} == {"b", "x"}
    assert [r["depth"] for r in graph.walk(seed, e, 2, cap=3).collect()] == [1, 1, 1]


def test_filters_bite_on_the_supplied_events(spark):
    from tessera.plans import catalog

    sf = "/root/testdata/sf0.01"
    whole = catalog.facts(spark, sf).select("subject", "attribute").distinct().count()
    sizes = {n: catalog.QUERIES[n](spark, sf).count() for n in ("bitemporal_asof_valid", "bitemporal_asof_known", "bitemporal_asof_both", "timeline_window", "valid_interval_filter")}
    assert all(0 < n for n in sizes.values()) and sizes["bitemporal_asof_both"] < whole and sizes["bitemporal_asof_known"] < whole
    ids = {n: {r["id"] for r in catalog.QUERIES[n](spark, sf).select("id").collect()} for n in ("bitemporal_asof_valid", "bitemporal_asof_known", "bitemporal_asof_both")}
    assert len({frozenset(x) for x in ids.values()}) == 3
    assert catalog.QUERIES["current_or_absent"](spark, sf).where("id = -1").count() > 0
    recency = catalog.QUERIES["recency_decay"](spark, sf).agg(F.min("recency"), F.max("recency")).first()
    assert 0 < recency[0] < recency[1] <= 1


def test_promotion_leaves_out_what_earlier_batches_hold(spark, tmp_path):
    schema, source = "event_id long, value double", str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], schema).coalesce(1).write.mode("append").parquet(source)
    for more in ([], [(2, 9.0), (3, 3.0)]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
        sessions.promote_batches(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_tumbling_windows(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a") for h in (0, 0, 1, 5)], "ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = sessions.read_events(spark, str(tmp_path / "in"), rows.schema)
    sessions.run_once(sessions.tumbling(stream, "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {(r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {(0, 2), (1, 1)}


def test_snapshots_are_added(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    for v in (1, 2):
        store.publish(spark.range(v), root, v)
        assert store.current(spark, root).count() == v


def test_verbs(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    t = lambda s: F.lit(s).cast("timestamp")
    texts = spark.createDataFrame([("  I live in Porto  ", dt.datetime(2024, 1, 1)), ("", None), ("I like green tea", None), ("my password is x", None)], "text string, valid_from timestamp")
    m.add(texts, t("2024-01-02"), auto_attribute=True)
    m.add(spark.createDataFrame([("I moved to Berlin", dt.datetime(2024, 3, 1)), ("I like green tea", None)], "text string, valid_from timestamp"), t("2024-03-02"), auto_attribute=True)
    state = {r["text"]: r for r in m.state().collect()}
    assert set(state) == {"I live in Porto", "I like green tea", "I moved to Berlin"} and state["I like green tea"]["access_count"] == 1
    assert m.current("residence", t("2024-02-01")) == "I live in Porto" and m.current("residence", t("2024-04-01")) == "I moved to Berlin" and m.current("employer", t("2024-04-01")) is None
    asked = spark.createDataFrame([(1, "green tea"), (2, "live porto moved berlin")], "query_id int, text string")
    hits = sorted((r["query_id"], r["position"], r["text"]) for r in m.recall(asked, 5).collect())
    assert hits[0] == (1, 1, "I like green tea") and [h[2] for h in hits if h[0] == 2] == ["I moved to Berlin", "I live in Porto"]
    assert m.recall(asked, 0).count() == 0
    # one memory states no valid time, so all are ordered by when they were recorded
    assert [r["text"] for r in m.timeline("berlin").collect()] == ["I moved to Berlin"] and m.timeline("I ", until=t("2024-01-01")).count() == 1
    assert m.forget(t("2024-05-01"), contains="porto").count() == 1 and m.live().count() == 3
    m.forget(t("2024-05-01"), dry_run=False, contains="porto")
    assert m.live().count() == 2
    with pytest.raises(ValueError):
        m.forget(t("2024-05-01"))
    m.backfill_embeddings(lambda rows: rows.select("id", F.array(F.length("text").cast("double")).alias("embedding")), t("2024-05-02"))
    assert m.live().where("embedding is null").isEmpty()


def test_current_version_takes_the_best_place(spark):
    rows = [(1, 1, "a", 10), (1, 2, "b", 11), (1, 3, "a", 12), (1, 4, None, 13), (1, 5, "a", 14)]
    frame = spark.createDataFrame([(q, p, a, i, dt.datetime(2024, 1, 1 + (5 if i == 12 else p)), dt.datetime(2024, 2, 1)) for q, p, a, i in rows], "query_id int, position int, attribute string, id int, valid_from timestamp, created_at timestamp")
    got = {r["id"]: r["position"] for r in memory.current_version_first(frame).collect()}
    assert got == {12: 1, 11: 2, 10: 3, 13: 4, 14: 5}


def test_loaders(spark, tmp_path):
    line = '{"question_id": "q1", "question": "x", "answer": 3, "question_type": "t", "question_date": "2023/05/30 (Tue) 21:40", "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 10:00"], "haystack_sessions": [[{"role": "user", "content": "hi"}], []], "answer_session_ids": ["s1"]}'
    (tmp_path / "q.json").write_text(line + "\n")
    asked = datasets.read_questions(spark, str(tmp_path / "q.json"))
    assert asked.first()["answer"] == "3"
    turns = datasets.haystack_turns(asked).collect()
    assert [(r["session_id"], r["turn"], r["content"], r["session_at"]) for r in turns] == [("s1", 0, "hi", dt.datetime(2023, 5, 20, 2, 21))]
    talk = spark.createDataFrame([("c1", {"session_10": [("Ann", "b", "D10:1")], "session_2": [("Bo", "a", "D2:1")]}, {"session_2": "1 May"})],
                                 "sample_id string, sessions map<string, array<struct<speaker: string, text: string, dia_id: string>>>, dates map<string, string>")
    got = datasets.conversation_turns(talk).orderBy("session_no").collect()
    assert [(r["session_no"], r["session_date"], r["dia_id"]) for r in got] == [(2, "1 May", "D2:1"), (10, None, "D10:1")]


def test_scripted_scenarios_all_pass(spark):
    from tessera.plans import catalog

    done = catalog.QUERIES["scripted_supersession"](spark, "").agg(F.count_if("correct"), F.count(F.lit(1))).first()
    assert tuple(done) == (50, 50)
    assert catalog.QUERIES["scripted_timelines"](spark, "").where("not correct").isEmpty()
    assert temporal is not None
