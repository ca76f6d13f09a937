"""Evidence operators against labels written by hand."""

from pyspark.sql import functions as F

from tessera.functions import replies, text as tx
from tessera.operators import bundles, evidence, memberships, questions, retrieval, transcripts


SAID = [
    ("I bought a red bike yesterday. Then we adopted another cat.", [("bike", "red bike", None, ""), ("cat", "cat", None, "")]),
    ("We had a gaming session for 40 hours", [("session", "gaming session", 40.0, "hours")]), ("I got a lot. I have the time", []), (None, []), ("", []),
    ("She BOUGHT a Dress and bought a dress, then got the boxes", [("dress", "dress", None, ""), ("box", "boxes", None, "")]),
    ("They visited the old churches in Rome for 2.5 days", [("church", "old churches", 2.5, "days")]), ("He had an ox of 12 km, owned the two 33", [("two", "two 33", None, "")]),
    ("We made this berries-and-cream pies with my 3 dollars", []), ("rebought a car", []), ("I joined the gym because 1 year", [("gym", "gym", 1.0, "years")]),
    ("I own a boat\x01 and set up my tent " + "x" * 60 + " 3 hours", [("boat", "boat", None, ""), ("tent", "tent " + "x" * 60 + " 3 hours", None, "")][:1]),
]


def test_memberships(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "id long, text string")
    got = {}
    for r in memberships.memberships(frame).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["predicate"], r["obj"], r["quantity"], r["unit"]))
    assert {i: got.get(i, []) for i in range(len(SAID) - 1)} == {i: want for i, (_, want) in enumerate(SAID[:-1])} and got[len(SAID) - 1][0] == SAID[-1][1][0]
    words = [("parties", "party"), ("ties", "ty"), ("axes", "ax"), ("classes", "class"), ("dishes", "dish"), ("cars", "car"), ("gas", "ga"), ("is", "is"), ("glass", "glass"), ("es", "es"), ("SHIRTS", "shirt")]
    frame = spark.createDataFrame(words, "w string, want string")
    assert frame.where(memberships.singular(F.col("w")) != F.col("want")).collect() == []


def test_support(spark):
    rows = [("business administration", "I hold a degree in Business Administration.", True), ("Lake Aro", "We saw a lake", True), ("Berlin", "I live in Porto", False), ("", "x", False)]
    frame = spark.createDataFrame(rows, "a string, c string, want boolean")
    assert frame.where(evidence.supported(F.col("a"), F.col("c")) != F.col("want")).isEmpty()


def test_claims_leave_out_stamps(spark):
    rows = [(1, 0, "user", "0:02 share\n- (user): I was a baker. Now I row.\n00:00:12\nassistant: well done")]
    got = evidence.claims(spark.createDataFrame(rows, "session int, seq int, role string, text string")).orderBy("line").collect()
    assert [r["claim"] for r in got] == ["I was a baker.", "Now I row.", "well done"]


def test_narrowing(spark):
    items = spark.createDataFrame([(q, i, r, s, q == 4) for q in (1, 2, 3, 4) for i, r, s in ((10, 1, "a"), (11, 2, "b"), (12, 3, "a"))], "query_id int, id int, rank int, session string, spans boolean")
    verified = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.9), (3, "a", 0.2), (4, "a", 0.9)], "query_id int, session string, confidence double")
    got = {(r["query_id"], r["id"]): r["reason"] for r in evidence.narrowed(items, verified).collect()}
    assert {i for q, i in got if q == 1} == {10, 12} and len(got) == 11
    assert [got[q, 10] for q in (1, 2, 3, 4)] == ["narrowed_to_top_session", "top_session_unverified", "top_session_confidence_below_threshold", "multi_session_hint"]


def test_packets(spark):
    rows = [(1, i, i, i % 2 == 0, 0.5 + i / 100) for i in range(20)]
    got = evidence.packets(spark.createDataFrame(rows, "query_id int, id int, pos int, verified boolean, confidence double"), 3).first()
    assert (got["claims"], got["excluded"]) == ([18, 16, 14], 10)


def test_writes(spark):
    rows = [(1, "ADD", False, None), (2, "DELETE", False, 9), (3, "DELETE", False, None), (4, "UPDATE", False, 9), (5, "UPDATE", False, None), (6, "NOOP", True, None), (7, "NOOP", False, None)]
    got = {(r["id"], r["event"], r["target"]) for r in transcripts.writes(spark.createDataFrame(rows, "id long, op string, short boolean, target long")).collect()}
    assert got == {(1, "ADD", None), (2, "INVALIDATE", 9), (2, "ADD", None), (3, "ADD", None), (4, "PATCH", 9), (5, "ADD", None), (7, "ADD", None)}


def test_heuristic_supersession(spark):
    rows = [("u", 1, 1, "Ann uses Spark", ["Spark"]), ("u", 2, 2, "Ann likes tea", ["tea"]), ("u", 3, 3, "Ann switched from Spark", ["Spark"]), ("v", 4, 4, "Bo no longer rows", ["rowing"]), ("u", 5, 5, "Spark again", ["Spark"])]
    got = {r["id"]: (r["op"], r["target"]) for r in questions.heuristic_supersession(spark.createDataFrame(rows, "owner string, id long, seq long, text string, entities array<string>")).collect()}
    assert got == {1: ("NOOP", None), 2: ("NOOP", None), 3: ("DELETE", 1), 4: ("NOOP", None), 5: ("NOOP", None)}


def test_replies(spark):
    frame = spark.createDataFrame([('{"facts": [{"text": "A long enough fact", "confidence": 0.7}, {"text": "a long enough FACT", "confidence": 0.9}]}',), ("none",), (None,)], "r string")
    assert [len(r["x"] or []) for r in frame.select(replies.facts(F.col("r")).alias("x")).collect()] == [1, 0, 0]
    assert [r["x"] for r in frame.select(replies.yes_no(F.col("r"), True).alias("x")).collect()] == [True, True, True]


def test_answer_stages(spark):
    rows = [("Lake Aro", "Lake Aro", "exact"), ("the Lake Aro", "lake aro!", "normalized"), ("10%", "it was 10 percent", "numeric"), ("seven", "7 shirts", "unit"), ("Aro", "It was Aro.", "rule_semantic"), ("x", "yy", "wrong"), (None, "y", "wrong")]
    frame = spark.createDataFrame(rows, "e string, p string, want string")
    assert frame.where(tx.answer_stage(F.col("e"), F.col("p")) != F.col("want")).isEmpty()


def test_chain_and_prune(spark):
    rows = [(s, i, 20) for s in (1, 2) for i in range(2 if s == 1 else 6)]
    frame = spark.createDataFrame(rows, "session int, seq int, tokens int")
    got = {(r["session"], r["seq"]) for r in bundles.chain(frame, 50, 4).collect()}
    assert got == {(1, 0), (1, 1), (2, 4), (2, 5)}
    items = spark.createDataFrame([(1, 1, "LTM", 0.9, 1, 30), (1, 2, "LTM", 0.1, 1, 30), (1, 3, "MTM", 0.0, 1, 30), (1, 4, "MTM", 0.0, 2, 30), (1, 5, "MTM", 0.0, 3, 30), (1, 6, "STM", 0.0, 1, 30)], "query_id int, id int, layer string, value double, created_at int, tokens int")
    kept = lambda budget, turns=False: {r["id"] for r in bundles.prune_to_fit(items, budget, prune_turns=turns).collect()}
    assert kept(200) == {1, 2, 3, 4, 5, 6} and kept(160) == {1, 3, 4, 5, 6} and kept(100) == {4, 5, 6} and kept(10) == {4, 5, 6} and kept(10, True) == {4, 5}


def test_neighbours_by_id_equal_all_pairs(spark):
    ids = [i * 3 % 1009 for i in range(400)]
    memory, asked = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(i,) for i in ids[::9]], "query_id long")
    got = {(r["query_id"], r["id"]) for r in retrieval.neighbours_by_id(asked, memory, 7).collect()}
    want = {(q, i) for q in ids[::9] for i in sorted((x for x in ids if x != q), key=lambda x: (abs(x - q), x))[:7]}
    assert got == want


def test_retrieved(spark):
    """Restricted, expired and vanished hits go; boosts and the rerank of the head decide positions; budgets cut each layer."""
    memory = spark.createDataFrame(
        [(1, "fact", False, False, False, False, "MTM", 10), (2, "user_preference", False, False, False, False, "LTM", 10), (3, "fact", False, False, True, False, "LTM", 1),
         (4, "fact", False, False, False, True, "LTM", 1), (5, "task", True, False, False, False, "LTM", 15), (6, "fact", False, False, False, False, "STM", 5)],
        "id long, candidate_type string, urgent boolean, how boolean, restricted boolean, expired boolean, layer string, tokens int")
    hits = spark.createDataFrame([(7, i, s) for i, s in ((1, 0.9), (2, 0.85), (3, 0.99), (4, 0.98), (5, 0.2), (6, 0.3), (9, 1.0))], "query_id long, id long, score double")
    out = bundles.retrieved(hits, memory, 2, F.lit(0.0), {"LTM": 20, "MTM": 20, "STM": 20}).orderBy("place").collect()
    assert [(r["id"], r["layer"], r["position"]) for r in out] == [(2, "LTM", 1), (1, "MTM", 2), (6, "STM", 4)]  # 5 (0.35) comes third and is beyond its layer's budget
