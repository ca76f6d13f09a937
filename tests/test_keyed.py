"""The stream with keyed state against batch eviction: events out of order, several micro-batches, a restart, repeated turns."""

import random

from pyspark.sql import functions as F

from tessera.operators import bundles
from tessera.streaming import keyed

SCHEMA = "session long, seq long, importance string, summary boolean, text string"


def test_stream_equals_batch_eviction(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, q, rng.choice(("LOW", "NORMAL", "HIGH", "CRITICAL", None)), rng.random() < 0.1, f"t{s}/{q}") for s in range(6) for q in range(rng.choice((2, 5, 30)))]
    rng.shuffle(rows)
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    third = len(rows) // 3 + 1
    for i in range(3):  # each part starts the query anew
        part = rows[i * third : (i + 1) * third] + rows[:3]  # some turns arrive again
        if i != 1:
            part = rows[i * third : (i + 1) * third]
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        keyed.run_once(keyed.evictions(stream, 4), sink, checkpoint)
    turns = spark.createDataFrame(rows, SCHEMA)
    gone = spark.read.schema(keyed.EVICTED).parquet(sink).dropDuplicates(["session", "seq"])
    kept = sorted(tuple(r) for r in turns.join(gone, ["session", "seq"], "left_anti").select("session", "seq").collect())
    want = sorted(tuple(r) for r in bundles.evict(turns.fillna({"importance": "CRITICAL"}), 4).select("session", "seq").collect())
    assert kept == want and gone.where(F.col("text") != F.concat(F.lit("t"), "session", F.lit("/"), "seq")).isEmpty()
    before = gone.count()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    keyed.run_once(keyed.evictions(stream, 4), sink, checkpoint)  # nothing new: a restart changes nothing
    assert spark.read.parquet(sink).dropDuplicates(["session", "seq"]).count() == before
