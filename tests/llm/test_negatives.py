"""Hard negatives against a plain loop over all rows, with ties, windows below zero and vectors of odd kinds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score long"


def brute_force(table, is_anchor, n_positives=5, n_negatives=5, percent=80):
    rows = []
    for i, label, v in table:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, label, [max(-(1 << 25), min(1 << 25, math.floor(256 * x))) if abs(256 * x) < 1e300 else int(math.copysign(1 << 25, x)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:n_positives]:
            fits = [(t, n) for t, n, m in scored if m != label and percent * -s <= 100 * -t <= 100 * -s][:n_negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, table, modulus):
    frame = spark.createDataFrame([(*r, 3) for r in table], SCHEMA)
    rows = negatives.mine(negatives.prepared(frame), F.col("vec_id") % modulus == 0)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows.collect())


def test_ties_nulls_and_repeats(spark):
    rng = random.Random(2)
    table = [(i, rng.randrange(3), [rng.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(rng.choice((3, 4, 4)))]) for i in range(300)]
    table += [(300, None, [1.0]), (301, 1, None), (302, 1, [1.0, None]), (303, 1, [float("nan")]), (304, 1, [float("inf")]), (None, 1, [1.0]), (305, 1, []), (306, 2, [1e308, -3.0]), (40, 1, [1.0, 1.0]), (41, 1, [1.0, 1.0]), (41, 1, [1.0, 1.0])]
    table += [(1000 + i, i % 3, [0.5, 0.5, 0.5]) for i in range(150)]  # a third of the rows are one vector
    assert mined(spark, table, 20) == brute_force(table, lambda i: i % 20 == 0)


def test_nothing_to_find(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])], 5) == []
    assert mined(spark, [(5, 1, [1.0]), (6, 2, [1.0])], 5) == []  # no positive
    assert mined(spark, [(5, 1, [1.0]), (6, 1, [1.0])], 5) == []  # no negative
    assert mined(spark, [(5, 1, []), (6, 1, []), (7, 2, [])], 5) == [(5, 6, 1, 7, 0, 0)]


def test_lists_are_skipped(spark):
    """Far groups of vectors: bounds leave most lists unvisited and the answer whole; chunks of a list share its rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    table = [(i, int(rng.integers(3)), (centres[i % 20] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1500)]
    assert mined(spark, table, 100) == brute_force(table, lambda i: i % 100 == 0)
    frame = spark.createDataFrame([(*r, 3) for r in table], SCHEMA)
    index = negatives.build(negatives.prepared(frame))
    lower, upper = index.bounds(np.floor(256 * np.array(table[0][2]))[None, :])
    assert (upper[0] < lower[0].max()).mean() > 0.5


@pytest.mark.parametrize("chunk_rows", [7])
def test_many_chunks(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 3)
    table = [(i, i % 2, [1.0, 1.0] if i % 3 else [i / 200, 1 - i / 200]) for i in range(200)]
    assert mined(spark, table, 10) == brute_force(table, lambda i: i % 10 == 0)
    index = negatives.build(negatives.prepared(spark.createDataFrame([(*r, 3) for r in table], SCHEMA)))
    sizes = [len(r["ids"]) // 8 for r in index.lists.collect()]
    assert sum(sizes) == 200 and max(sizes) < 40  # dealt at random, the hot vector too


def test_no_side_of_a_join_is_gathered_on_the_driver(spark, monkeypatch):
    """Packed rows and repeated asks look small by their files; no join may broadcast them."""
    monkeypatch.setattr(negatives, "NEAREST_ROWS", 3)
    rows = spark.createDataFrame([(i, i % 3, [float((i * 7 + j) % 11) / 11 for j in range(4)]) for i in range(60)], "vec_id long, label int, embedding array<double>")
    joins = []
    join = type(rows).join

    def seen(self, other, *a, **b):
        joins.append(join(self, other, *a, **b))
        return joins[-1]

    monkeypatch.setattr(type(rows), "join", seen)  # the class of this session's frames
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        found = negatives.mine(negatives.prepared(rows), F.col("vec_id") % 20 == 0)
        plans = [j._jdf.queryExecution().sparkPlan().toString() for j in joins]
        assert found.count() > 0 and sum("BroadcastHashJoin" in p for p in plans) == 1  # sizes and radii of lists only
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    x = np.arange(40.0).reshape(10, 4)
    assert negatives.nearest(x, x[::3]).tolist() == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert negatives.nearest(x[:0], x).tolist() == []
