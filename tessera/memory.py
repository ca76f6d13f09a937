"""The verbs of a memory over DataFrames: add, remember, recall, current, timeline, forget, backfill_embeddings.

A memory is an event log in a shared folder. Every write appends a batch of events; the state is a fold of them, so a
batch that is written again changes nothing. One text is one memory of a namespace: restating it reinforces it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import memory as ops
from tessera.operators import retrieval
from tessera.sources.shared import shared_folder

EVENTS = (
    "id string, namespace string, op string, batch long, pos long, text string, attribute string, importance double, "
    "valid_from timestamp, at timestamp, embedding array<double>"
)
TOPICAL_WINDOW = 3


class Memory:
    def __init__(self, spark: SparkSession, path: str, namespace: str = "default"):
        self.spark, self.path, self.namespace = spark, path, namespace

    # ---- writing ----
    def _batch(self) -> int:
        return (self.events().agg(F.max("batch")).first()[0] or 0) + 1  # one row

    def events(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(self.path)

    def _append(self, rows: DataFrame, op: str, at: Column) -> None:
        given = {f.split()[0]: f.split()[1] for f in EVENTS.split(", ")}
        made = {"namespace": F.lit(self.namespace), "op": F.lit(op), "batch": F.lit(self._batch()).cast("long"), "at": at.cast("timestamp")}
        missing = {c: F.lit(None).cast(t) for c, t in given.items() if c not in rows.columns and c not in made}
        rows.withColumns(made | missing).select(*given).write.mode("append").parquet(self.path)

    def add(self, texts: DataFrame, at: Column, *, auto_attribute: bool = False, split: bool = False) -> None:
        """Facts (text, and if they are there pos, attribute, importance, valid_from), trimmed, empty ones left out, cut to the
        longest fact; ``split`` stores the statements of a text apart."""
        rows = texts
        for name, default in (("pos", F.monotonically_increasing_id()), ("attribute", F.lit(None).cast("string")), ("importance", F.lit(0.5)), ("valid_from", F.lit(None).cast("timestamp"))):
            if name not in rows.columns:
                rows = rows.withColumn(name, default)
        rows = ops.clean(rows)
        if split:
            rows = rows.withColumn("text", F.explode(tx.clauses(F.col("text"))))
        if auto_attribute:
            rows = rows.withColumn("attribute", F.coalesce("attribute", tx.attribute(F.col("text"))))
        self._append(rows.where(~tx.is_secret(F.col("text"))).withColumn("id", F.md5(F.concat(F.lit(f"{self.namespace}\0"), "text"))), "ADD", at)

    remember = add

    def backfill_embeddings(self, embed: Callable[[DataFrame], DataFrame], at: Column) -> None:
        """Vectors for memories without one: ``embed`` maps (id, text) to (id, embedding)."""
        self._append(embed(self.live().where("embedding is null").orderBy("created_at", "id").select("id", "text")), "EMBED", at)

    def forget(self, at: Column, dry_run: bool = True, **policy) -> DataFrame:
        """What a policy (see ``operators.memory.forget``) matches; closed at ``at`` unless it is a dry run."""
        gone = ops.forget(self.live(), **policy)
        if not dry_run:
            matched, folder = gone.select("id"), shared_folder(self.spark)
            matched.write.parquet(folder)  # decided once, before the log that decides it grows
            self._append(self.spark.read.schema(matched.schema).parquet(folder), "INVALIDATE", at)
        return gone

    # ---- reading ----
    def state(self) -> DataFrame:
        """One row a memory."""
        order = F.struct("batch", "pos")
        add, own = F.col("op") == "ADD", self.events().where(F.col("namespace") == self.namespace)
        first = lambda c: F.min_by(F.when(add, F.col(c)), F.when(add & F.col(c).isNotNull(), order)).alias(c)
        folded = own.groupBy("namespace", "id").agg(
            *[first(c) for c in ("text", "attribute", "valid_from")], F.max(F.when(add, F.col("importance"))).alias("importance"),
            F.min(F.when(add, F.col("at"))).alias("created_at"), F.max(F.when(add, F.col("at"))).alias("last_access"), (F.count_if(add) - 1).alias("access_count"),
            F.min_by("embedding", F.when(F.col("embedding").isNotNull(), order)).alias("embedding"), F.min(F.when(F.col("op") == "INVALIDATE", F.col("at"))).alias("invalidated_at"))
        w = Window.partitionBy("namespace", "attribute").orderBy("valid_from", "created_at", "id")
        closed = F.when(F.col("attribute").isNotNull() & F.col("valid_from").isNotNull(), F.lead("valid_from").over(w))
        return folded.where("text is not null").withColumn("valid_to", closed).withColumn("layer", F.lit("LTM"))

    def live(self) -> DataFrame:
        return ops.live(self.state(), self.namespace)

    def recall(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """(query_id, id, position, text): the k memories nearest to each query's words, the current version of an
        attribute first."""
        k, rows = min(max(k, 0), ops.MAX_RECALL), self.live()
        hits = retrieval.bm25(queries, rows.select("id", "text"), max(k, 1)).where(F.col("rank") <= k).withColumnRenamed("rank", "position")
        return ops.current_version_first(hits.join(rows.select("id", "text", "attribute", "valid_from", "created_at"), "id")).select("query_id", "id", "position", "text")

    def current(self, attribute: str, as_of: Column) -> str | None:
        """The value of an attribute at a time: by its tag; only if nothing is tagged at all, the newest of the first
        topical hits."""
        rows = self.live()
        tagged = rows.where(F.col("attribute") == attribute).withColumn("value", F.col("text"))
        found = ops.current(tagged, ["attribute"], as_of).first()
        if found or not rows.where("attribute is not null").isEmpty():
            return found["value"] if found else None
        asked = self.spark.range(1).select(F.lit(1).alias("query_id"), F.lit(attribute).alias("text"))
        head = self.recall(asked, TOPICAL_WINDOW).join(rows.select("id", "valid_from", "created_at"), "id").where(ops.effective_time() <= as_of)
        newest = head.withColumn("clock", ops.comparable_clock(["query_id"])).orderBy(F.desc("clock"), "position").first()
        return newest["text"] if newest else None

    def timeline(self, entity: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Every version that mentions an entity, oldest first by the clock that all of them state."""
        rows = self.live().where(F.contains(F.lower("text"), F.lit(entity.lower()))).withColumn("clock", ops.comparable_clock(["namespace"]))
        bounds = [ops.effective_time() >= since] if since is not None else []
        bounds += [ops.effective_time() <= until] if until is not None else []
        return reduce(DataFrame.where, bounds, rows).orderBy("clock", "id")
