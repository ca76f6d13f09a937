"""Block-wise scores against plain loops: cosines with ties and missing vectors, trigram overlap, packed blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import blocks, retrieval
from tessera.sources.shared import written


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


@pytest.mark.parametrize("same_kind", [False, True])
def test_cosines(spark, monkeypatch, same_kind):
    monkeypatch.setattr(blocks, "MEMORY_ROWS", 37)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 5)
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-2, 3)) for _ in range(rng.choice((3, 3, 3, 2)))]) for i in range(200)] + [(200, 1, None), (201, 1, []), (202, 0, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, kind int, v array<double>")
    asked = frame.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("kind").alias("query_kind"))
    got = {}
    for r in retrieval.knn(asked, frame, 6, same_kind).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["kind"], round(r["score"], 6)))
    for q, kind, v in rows:
        if q % 7 == 0:
            scored = sorted((-round(cosine(v, w), 12), i, k) for i, k, w in rows if i != q and (k == kind or not same_kind))[:6]
            assert got[q] == [(i, k, round(-s, 6) + 0.0) for s, i, k in scored]
    assert retrieval.knn(asked.limit(0), frame, 3).count() == 0 == retrieval.knn(asked, frame.limit(0), 3).count()


def grams_of(text):
    found = set()
    for w in __import__("regex").findall(r"[\p{L}\p{N}]+", text.lower()):
        padded = f"  {w} "
        found |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return found


@pytest.mark.parametrize("often", [1, 4, 1000])
def test_trigrams(spark, monkeypatch, often):
    monkeypatch.setattr(blocks, "OFTEN", often)
    monkeypatch.setattr(blocks, "WIDE", 8)
    monkeypatch.setattr(blocks, "TALL", 3)
    monkeypatch.setattr(blocks, "HELD", 16)
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abéÉ日9") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, "!?"), (62, "a_b")]
    frame = spark.createDataFrame(rows, "id long, text string")
    held = blocks.with_grams(frame)
    counted = {r["id"]: r["n"] for r in frame.where("text is not null").select("id", F.size(tx.trigrams(F.col("text"))).alias("n")).collect()}
    assert {r["id"]: len(r["grams"]) for r in held.collect()} == counted == {i: len(grams_of(t)) for i, t in rows if t is not None}
    got = {}
    for r in retrieval.trigram_topk(held.where("id % 4 = 0").withColumnRenamed("id", "query_id"), held, 5, 0.2).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q, t in rows:
        if q % 4 == 0 and t is not None:
            scored = []
            for i, u in rows:
                both = len(grams_of(t) & grams_of(u)) if u else 0
                if both and both / len(grams_of(t) | grams_of(u)) >= 0.2:
                    scored.append((-both / len(grams_of(t) | grams_of(u)), i))
            assert got.get(q, []) == [(i, -s) for s, i in sorted(scored)[:5]]


def test_index(spark):
    """Every row is indexed; all lists visited is exact search; the share that is visited finds nine in ten."""
    from tessera.operators import index
    from tessera.plans import catalog, memory  # noqa: F401  (the catalogue first)
    from tessera.sources.tables import vectors

    v = vectors(spark, "/root/testdata/sf0.01")
    lists = index.build(v)
    table = spark.read.parquet(lists.path)
    assert sorted(i for r in table.collect() for i in r["ids"]) == sorted(r["id"] for r in v.select("id").collect())
    recall = memory.recall_approximate(spark, "/root/testdata/sf0.01").agg(F.avg("recall"), F.count("recall")).first()
    assert recall[0] >= 0.9 and recall[1] == 25
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    plan = index.search(q, lists, index.probes_for(lists, memory.PROBED), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_index_of_odd_rows(spark, monkeypatch):
    from tessera.operators import index

    monkeypatch.setattr(index, "BLOCK_ROWS", 10)
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(100, None), (101, []), (102, [0.0, 0.0])] + [(200 + i, [float(i % 3), 1.0]) for i in range(50)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    lists = index.build(frame)
    sizes = [len(r["ids"]) for r in spark.read.parquet(lists.path).collect()]
    assert sum(sizes) == 150 and max(sizes) < 40 and index.build(frame.limit(0)) is None
    q = spark.createDataFrame([(1, [1.0, 2.0]), (500, [0.0, 1.0])], "query_id long, q array<double>")
    got = {}
    for r in index.search(q, lists, 50, 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got[1] == [0, 2, 3] and got[500] == [200, 203, 206]


def test_a_task_hands_on_the_best_of_all_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MEMORY_ROWS", 5)
    rows = spark.createDataFrame([(i, i % 3, [math.cos(i), math.sin(i)], [i % 40, 40 + i % 3]) for i in range(400)], "id long, kind int, v array<double>, grams array<long>").coalesce(1)
    asked = rows.where("id % 50 = 0")
    tasks = 2 * spark.sparkContext.defaultParallelism
    near = blocks.cosines(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), rows.select("id", "kind", "v"), 1, False)
    alike = blocks.jaccards(asked.select(F.col("id").alias("query_id"), F.col("grams").alias("asked")), rows.select("id", "grams"), 1, 0.25)
    assert 8 <= near.count() <= 8 * tasks and 8 <= alike.count() <= 8 * tasks  # of 80 blocks
    assert {r["score"] for r in alike.groupBy("query_id").agg(F.max("score").alias("score")).collect()} == {1.0}


def test_batches_of_packed_rows_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    found = written(spark.range(100).coalesce(1).mapInArrow(sizes, "n long"), blocks.PAIRS)
    assert max(r["n"] for r in found.collect()) <= blocks.PAIRS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    joined = list(blocks.gathered(iter([pa.RecordBatch.from_pydict({"x": list(range(3))})] * 5), 6))
    assert [b.num_rows for b in joined] == [6, 6, 3]


def coded_tile(held, lists):
    n, bits, who, rest = held.bits(lists)
    block = blocks.Coded.__new__(blocks.Coded)
    block.n, block.bits, block.rest, block.ends = n, np.packbits(bits, axis=1, bitorder="little"), rest, np.searchsorted(who, np.arange(len(n) + 1))
    block.groups = np.vstack([(bits.astype(int) @ np.eye(blocks.KINDS, dtype=int)[held.kind]).astype(np.int32).T, np.diff(block.ends).astype(np.int32)[None]])
    return block.tile(0, len(n))


@pytest.mark.parametrize("wide", [64, 512])
def test_few_pairs_of_texts_are_counted(monkeypatch, wide):
    """Texts of other kinds and sizes, and those that cannot be among the best, leave by a bound; what stays is as if all were counted."""
    monkeypatch.setattr(blocks, "WIDE", wide)
    rng = random.Random(3)
    sets = [frozenset(rng.sample(range(200 * (i % 3), 200 * (i % 3) + 260), rng.choice((20, 60, 120)))) for i in range(300)]
    sets += [s - {min(s)} for s in sets[:60]] + [frozenset(), frozenset({10_000}), frozenset(range(20_000, 40_000)), frozenset(range(20_001, 40_001))]
    lists = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
    held = blocks.book(lists.slice(0, 100))
    met = []
    plain = blocks.counted
    monkeypatch.setattr(blocks, "counted", lambda q, m, r, c: met.append(len(r)) or plain(q, m, r, c))
    r, c, score = blocks.alike(coded_tile(held, lists), coded_tile(held, lists), np.full(len(sets), 0.25), 2)
    got = {}
    for q, i, x in sorted(zip(r.tolist(), c.tolist(), score.tolist()), key=lambda x: (x[0], -x[2], x[1])):
        got.setdefault(q, []).append((i, x))
    for q, a in enumerate(sets):
        scored = sorted((-len(a & b) / len(a | b), i) for i, b in enumerate(sets) if a & b and len(a & b) / len(a | b) >= 0.25)
        assert got.get(q, [])[:2] == [(i, -s) for s, i in scored[:2]]
    assert sum(met) < len(sets) ** 2 / 8 or wide == 64  # there most grams have no bit


def test_grams_of_memory_are_made_once(spark, monkeypatch):
    """However many broadcasts the queries take; empty lists, equal scores and repeated texts among them."""
    for name, value in {"MEMORY_ROWS": 3, "QUERY_ROWS": 4, "TOGETHER": 2, "TALL": 5, "SCORED": 3, "WIDE": 24, "CODED": 2, "HELD": 8}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(40), rng.choice((1, 3, 8, 9)))) for _ in range(90)]
    rows = [(i, s) for i, s in enumerate(sets + sets[:20] + [[]])]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(rows, "id long, grams array<long>")
    asked = frame.where("id % 3 = 0").select(F.col("id").alias("query_id"), "grams")
    got = {}
    for r in retrieval.trigram_topk(asked, frame.mapInArrow(count, frame.schema), 4, 0.25).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q, a in rows:
        if q % 3 == 0:
            both = {i: len({*a} & {*b}) for i, b in rows}
            scored = sorted((-both[i] / (len(a) + len(b) - both[i]), i) for i, b in rows if both[i] and both[i] / (len(a) + len(b) - both[i]) >= 0.25)
            assert got.get(q, []) == [(i, -s) for s, i in scored[:4]]
    assert made.value == len(rows)
    assert retrieval.trigram_topk(asked.limit(0), frame, 3, 0.25).count() == 0 == retrieval.trigram_topk(asked, frame.limit(0), 3, 0.25).count()
