"""Whole promotion runs: what they add, change, close and hold back; repeats, repairs and lost runs."""

import json

from pyspark.sql import functions as F

from tessera.operators import promotion_run as pr
from tessera.plans.promotions import longer

SCHEMA = "id long, namespace string, at timestamp, reply string"


def reply(*facts):
    return json.dumps({"facts": [{"text": t, "confidence": c, "type": k} for t, c, k in facts]})


def blocks(spark, rows):
    frame = spark.createDataFrame([(i, n, day, r) for i, n, day, r in rows], "id long, namespace string, day int, reply string")
    return frame.select("id", "namespace", F.timestamp_seconds(F.col("day") * 86_400).alias("at"), "reply")


def memory(spark, root):
    rows = pr.memory_rows(pr.stored(spark, root, "events", pr.committed(spark, root))).collect()
    return {(r["namespace"], r["text"]): (r["access_count"], r["invalidated_at"] is not None) for r in rows}


def test_runs(spark, tmp_path):
    root = f"file://{tmp_path}/ltm"
    first = [
        (1, "a", 1, reply(("The user lives in the town of Aro", 0.9, "home"), ("The user may like tea", 0.6, "taste"))), (2, "a", 2, reply((" the USER lives in the town of aro ", 0.8, "home"))),
        (3, "b", 1, reply(("The user lives in the town of Aro", 0.9, "home"))), (4, "a", 3, '{"facts": [{"text": "cut'), (5, "a", 3, None), (6, "a", 3, reply()), (None, "a", 3, reply(("Nobody said this at all", 1, "x"))),
        (7, None, 1, reply(("A fact of no namespace", 1, "home"))), (8, "c", 1, reply(("Scratch that, we were wrong", 1, "home"))), (1, "a", 9, reply(("A second row of a block", 1, "z"))),
    ]
    assert pr.run(blocks(spark, first), root, longer)
    held = {r["id"]: r["reason"] for r in pr.stored(spark, root, "quarantine", pr.committed(spark, root)).collect()}
    assert held == {4: "reply does not parse", 5: "no reply"}
    # equal texts are one row of a namespace, in the words of the newest; what is not sure enough, and a retraction of nothing, is not kept
    assert memory(spark, root) == {("a", "the USER lives in the town of aro"): (1, False), ("b", "The user lives in the town of Aro"): (0, False), (None, "A fact of no namespace"): (0, False)}
    before = memory(spark, root)
    assert pr.run(blocks(spark, first), root, longer) is None and pr.run(blocks(spark, first[::-1]), root, longer) is None  # in any order
    assert memory(spark, root) == before and len(pr.committed(spark, root)) == 1

    second = [
        (4, "a", 4, reply(("Mended: the user owns a bike", 1, "things"))), (10, "a", 5, reply(("The user lives in the town of Lund", 1, "home"))), (11, "b", 5, reply(("That was wrong: the user lives in the town of Aro", 1, "home"))),
        (12, None, 5, reply(("a fact of no namespace", 1, "home"))),
    ]
    assert pr.run(blocks(spark, first[:3] + first[4:] + second), root, longer)
    assert memory(spark, root) == {
        ("a", "The user lives in the town of Lund"): (1, False), ("a", "Mended: the user owns a bike"): (0, False),
        ("b", "The user lives in the town of Aro"): (0, True), (None, "A fact of no namespace"): (0, False)}
    report = {r["run"]: r for r in pr.reports(spark, root, 2.0).collect()}
    assert [report[1][c] for c in ("blocks", "quarantined", "add", "update", "delete", "noop", "asked", "tokens")] == [4, 0, 1, 1, 1, 1, 1, 16] and report[1]["cost"] == 0.032


def test_lost_run_and_no_decider(spark, tmp_path):
    root = f"file://{tmp_path}/ltm"
    one = blocks(spark, [(1, "a", 1, reply(("The user lives in the town of Aro", 0.9, "home")))])
    assert pr.run(one, root)
    # a run that was lost before its line: its files are there, no reader takes them, and the blocks are promoted again
    for kind in pr.KINDS:
        pr.stored(spark, root, kind, pr.committed(spark, root)).write.parquet(f"{root}/{kind}/lost")
    assert memory(spark, root) == {("a", "The user lives in the town of Aro"): (0, False)}
    assert pr.run(one.unionByName(blocks(spark, [(2, "a", 2, reply(("The user lives in the town of Lund", 1, "home")))])), root)
    last = pr.stored(spark, root, "decisions", pr.committed(spark, root)[-1:]).collect()
    assert [(r["op"], r["by_rule"], r["target"] is None) for r in last] == [("NOOP", False, False)]


def test_empty(spark, tmp_path):
    assert pr.run(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/ltm") is None
