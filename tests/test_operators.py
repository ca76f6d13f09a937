"""Hand-computed cases and plan shapes."""

import math

from pyspark.sql import functions as F

from tessera.functions import scoring, text as tx
from tessera.operators import evaluation, graph, promotion, retrieval, temporal
from tessera.sources import store
from tessera.sources.tables import facts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_cosine_edge_cases(spark):
    assert one(spark, scoring.cosine(vec(1, 0), vec(-1, 0))) == -1.0
    assert one(spark, scoring.cosine(vec(0, 0), vec(1, 0))) == 0.0
    assert one(spark, scoring.cosine(vec(1), vec(1, 0))) == 0.0
    assert one(spark, scoring.cosine(F.lit(None).cast("array<double>"), vec(1))) == 0.0


def test_recency_values(spark):
    assert math.isclose(one(spark, scoring.recency(F.lit(168.0), F.lit(0))), math.exp(-1))
    assert math.isclose(one(spark, scoring.recency(F.lit(504.0), F.lit(5))), math.exp(-3) * (1 + math.log(6)))
    assert one(spark, scoring.recency(F.lit(24.0), F.lit(50))) == 1.0
    assert one(spark, scoring.recency(F.lit(-5.0), F.lit(0))) == 1.0


def test_decision_ladder(spark):
    op = lambda r, s: one(spark, promotion.decide(F.lit(r), F.lit(s).cast("double")))
    assert [op(True, 0.5), op(True, 0.4), op(False, None), op(False, 0.49), op(False, 0.98), op(False, 0.7)] == ["DELETE", "NOOP", "ADD", "ADD", "NOOP", "UNDECIDED"]


def test_retroactive_correction_wins_by_later_recording(spark):
    f = spark.sql("""select * from values (1, 'u', 'city', 'A', timestamp'2024-01-01', timestamp'2024-01-02'),
      (2, 'u', 'city', 'B', timestamp'2024-01-01', timestamp'2024-02-01'), (3, 'u', 'city', 'C', timestamp'2024-03-01', timestamp'2024-03-02')
      as t(id, subject, attribute, value, valid_from, recorded_at)""")
    assert temporal.as_of(f, valid="2024-02-15").first()["value"] == "B"
    assert temporal.as_of(f, valid="2024-02-15", known="2024-01-15").first()["value"] == "A"
    assert temporal.as_of(f).first()["value"] == "C"
    assert [r["superseded_by"] for r in temporal.intervals(f).orderBy("id").collect()] == [2, 3, None]


def test_walk_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    got = graph.walk(spark.createDataFrame([("a",)], "id string"), e, 5).collect()
    assert {(r["target"], r["depth"]) for r in got} == {("b", 1), ("c", 2)}


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "query_id int, id int, rank int")
    assert [r["id"] for r in retrieval.fuse([a, b], 5).orderBy("position").collect()] == [10, 20]


def test_tokens_keep_accents(spark):
    assert one(spark, tx.tokens(F.lit("Café São, 5 eggs!"))) == ["café", "são", "5", "eggs"]
    assert one(spark, tx.tokens(F.lit("  "))) == []


def test_majority_prefers_answers(spark):
    v = spark.createDataFrame([(1, 1, ""), (1, 2, "x"), (2, 1, "b"), (2, 2, "a")], "question int, pos int, answer string")
    assert {r["question"]: r["answer"] for r in evaluation.majority(v).collect()} == {1: "x", 2: "b"}


def test_filters_reach_the_scan_and_top_k_is_limited_early(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    f = facts(spark, "/root/testdata/sf0.001")
    assert "PushedFilters: [IsNotNull(user_id)" in plan(f.where("subject = 3"))
    assert "WindowGroupLimit" in plan(retrieval.rank_by(f.withColumnRenamed("subject", "query_id"), F.desc("value"), 3))


def test_snapshot_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    store.publish(spark.range(5).toDF("id"), root, 1)
    store.publish(spark.range(7).toDF("id"), root, 2)
    assert store.current(spark, root).count() == 7


def test_idle_sessions_in_a_stream_equal_the_finished_ones_of_a_batch(spark):
    from tessera.plans import catalog
    from tessera.sources.tables import table
    from tessera.streaming import sessions

    sf = "/root/testdata/sf0.001"
    streamed = {(r["user_id"], r["start"], r["end"], r["n"]) for r in catalog.stream_idle_flush(spark, sf).collect()}
    whole = {(r["user_id"], r["start"], r["end"], r["n"]) for r in sessions.batch_sessions(table(spark, sf, "events"), "6 hours").collect()}
    assert streamed and streamed <= whole


def test_a_stream_ends_with_the_sessions_that_are_still_open(spark):
    import duckdb

    from tessera.plans import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    streamed = [(r["user_id"], r["start"], r["end"], r["n"]) for r in catalog.stream_idle_flush(spark, sf).withColumns({c: F.unix_micros(c) for c in ("start", "end")}).collect()]
    assert sorted(streamed) == sorted(con.execute(catalog.ORACLES["batch_idle_sessions"]).fetchall())


def test_an_id_that_comes_again_in_a_later_batch_is_promoted_once(spark, tmp_path):
    from tessera.streaming import sessions

    folder, sink, checkpoint = (f"file://{tmp_path}/{k}" for k in ("in", "sink", "checkpoint"))
    for rows in ([(1, "a"), (2, "a"), (2, "a"), (None, "a")], [(2, "b"), (3, "b"), (None, "b")], [(1, "c"), (3, "c")], [(4, "d")]):
        spark.createDataFrame(rows, "event_id long, value string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("event_id long, value string").parquet(folder)
        sessions.promote_batches(stream, sink, checkpoint)
    got = [(r["event_id"], r["value"], r["batch"]) for r in spark.read.parquet(sink).collect()]
    assert sorted(got, key=str) == [(1, "a", 0), (2, "a", 0), (3, "b", 1), (4, "d", 3), (None, "a", 0)]


def test_promotion_and_snapshot_cover_whole_tables(spark):
    from tessera.plans import catalog
    from tessera.sources.tables import table

    sf = "/root/testdata/sf0.001"
    memories, documents = (table(spark, sf, t).count() for t in ("embeddings", "documents"))
    assert catalog.QUERIES["promotion_decision"](spark, sf).select("id").distinct().count() == memories
    assert catalog.QUERIES["promotion_report"](spark, sf).first()["total"] == memories
    assert {r["n"] for r in catalog.QUERIES["snapshot_publish"](spark, sf).collect()} == {documents}


def test_text_rules_cover_conversations_and_documents(spark):
    from tessera.plans import catalog
    from tessera.plans.literals import SENTENCES
    from tessera.sources.tables import table

    sf = "/root/testdata/sf0.001"
    n = sum(table(spark, sf, t).count() for t in ("conversations", "documents")) + len(SENTENCES)
    assert catalog.QUERIES["secret_and_retraction_flags"](spark, sf).count() == n
    for name in ("capture_label", "attribute_extract", "question_type", "clause_split", "typed_candidates"):
        assert catalog.QUERIES[name](spark, sf).count() > 0
