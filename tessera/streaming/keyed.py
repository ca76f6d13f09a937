"""Bounded state for each session: a stream of turns whose store holds the turns that a session keeps, and no more.

Turns enter the state of their session in any order. While it holds more than its limit, the turn of least importance leaves
(see ``operators.bundles.evict``) and is emitted. What is kept is the last of one order of turns, so the outcome does not
depend on the order of arrival, on micro-batches or on restarts. A turn that arrives again (same seq) replaces itself. With
``ttl_ms`` the store forgets turns of that age; Spark then runs micro-batches without data as well, so such a query is for
triggers that go on, not for ``run_once``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.shared import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLASSES = {"LOW": 0, "NORMAL": 0, "HIGH": 1}
EVICTED = "session long, seq long, importance string, summary boolean, text string"


def order_of(seq: int, importance: str | None, summary: bool) -> tuple[int, int]:
    """The place of a turn: the first of a session's turns leaves first."""
    return (3 if summary else CLASSES.get(importance, 2)), seq


class Keeper(StatefulProcessor):
    """The turns that a session keeps, one entry a turn."""

    def __init__(self, limit: int, ttl_ms: int | None):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "seq long, importance string, summary boolean, text string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r) for r in self.kept.get()}
        for batch in rows:
            for r in batch[["seq", "importance", "summary", "text"]].itertuples(index=False):
                held[int(r.seq)] = (int(r.seq), r.importance, bool(r.summary), r.text)
            if len(held) > 2 * self.limit + 1000:  # a long run of input: what cannot stay goes at once
                yield self.out(key, held)
        gone = self.out(key, held)
        self.kept.put(list(held.values()))
        if len(gone):
            yield gone

    def out(self, key, held: dict) -> pd.DataFrame:
        """Turns beyond the limit, taken from ``held``."""
        first = sorted(held.values(), key=lambda t: order_of(*t[:3]))[: max(0, len(held) - self.limit)]
        for t in first:
            del held[t[0]]
        return pd.DataFrame([(key[0], *t) for t in first], columns=["session", "seq", "importance", "summary", "text"]).astype({"session": "int64", "seq": "int64"})

    def close(self) -> None:
        pass


def evictions(turns: DataFrame, limit: int, ttl_ms: int | None = None) -> DataFrame:
    """The turns that leave the state of their session, as they leave. ``turns``: session, seq, importance, summary, text."""
    ship(turns.sparkSession)
    return turns.groupBy("session").transformWithStateInPandas(Keeper(limit, ttl_ms), EVICTED, "append", "ProcessingTime" if ttl_ms else "None")


def run_once(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything available, with the state in RocksDB; a restart with the same checkpoint goes on from its state."""
    spark = df.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
