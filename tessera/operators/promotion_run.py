"""One promotion run: unprocessed blocks -> facts -> neighbours -> decisions -> events, committed together.

A run writes four tables of its own (events of the memory, processed blocks, blocks in quarantine, decisions) and then
adds one line to the manifest. Readers take the runs that the manifest names, so a run that is lost half-way leaves
nothing behind, and the next one starts where the last whole run ended. Files are only ever added; one writer at a time.

A block is (id, namespace, at, reply); its reply is the answer of an extractor, JSON with facts. Blocks whose reply does
not parse go to quarantine with a digest of the reply and are tried again when that changes, so a run over the same
blocks writes nothing. Of rows that share an id the smallest one counts; rows without an id are left out. Facts are those
of ``replies.facts`` with the confidence of promotion. Equal texts of a namespace, in any case and with any outer space,
are one memory row with a count of restatements. A null namespace is a namespace of its own.

Nothing but names of runs and counts reaches the driver. Blocks and facts meet memory by keys that are unique there, so
no key multiplies rows; a frequent one is spread by the adaptive join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.functions import text as tx
from tessera.operators import promotion
from tessera.sources.shared import written
from tessera.sources.store import commit, committed, runs_of

PROMOTE_FROM = 0.75
KINDS = {
    "events": "id string, namespace string, type string, text string, op string, at timestamp, fact string",
    "processed": "id long",
    "quarantine": "id long, digest string, reason string",
    "decisions": "fact string, block long, namespace string, type string, text string, at timestamp, op string, target string, similarity double, tokens long, by_rule boolean",
}


def stored(spark: SparkSession, root: str, kind: str, runs: list[str]) -> DataFrame:
    return runs_of(spark, f"{root}/{kind}", runs, KINDS[kind])


def memory_rows(events: DataFrame) -> DataFrame:
    """The fold of all events: text of the newest PATCH or ADD, closed by the first INVALIDATE, restatements counted."""
    clock = F.struct("at", "fact")
    stated = F.col("op").isin("ADD", "PATCH")
    return events.groupBy("id").agg(
        F.first("namespace", True).alias("namespace"), F.first("type", True).alias("type"), F.max_by(F.when(stated, F.col("text")), F.when(stated, clock)).alias("text"),
        (F.count_if(F.col("op") == "ADD") - 1).alias("access_count"), F.min(F.when(F.col("op") == "ADD", F.col("at"))).alias("created_at"),
        F.max(F.when(stated, F.col("at"))).alias("updated_at"), F.min(F.when(F.col("op") == "INVALIDATE", F.col("at"))).alias("invalidated_at"))


def same_attribute(found: DataFrame, memory: DataFrame) -> DataFrame:
    """(fact, target, target_text, similarity): the newest live row of a fact's namespace and type, and the share of words
    that both hold. One row of memory a key."""
    newest = memory.groupBy("namespace", "type").agg(F.max_by(F.struct("id", "text"), F.struct("updated_at", "id")).alias("m"))
    key = F.col("f.namespace").eqNullSafe(F.col("m.namespace")) & F.col("f.type").eqNullSafe(F.col("m.type"))
    both = found.alias("f").join(newest.alias("m"), key)
    a, b = F.array_distinct(tx.tokens(F.col("f.text"))), F.array_distinct(tx.tokens(F.col("m.m.text")))
    share = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
    return both.select("f.fact", F.col("m.m.id").alias("target"), F.col("m.m.text").alias("target_text"), F.coalesce(share, F.lit(0.0)).alias("similarity"))


def _facts(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("id", "namespace", "at", F.posexplode_outer("facts").alias("n", "x")).where("n is not null")
    return rows.where(F.col("x.confidence") >= PROMOTE_FROM).select(
        F.concat_ws("/", F.col("id").cast("string"), F.col("n").cast("string")).alias("fact"), F.col("id").alias("block"), "namespace", "at", "x.text", "x.type")


def _events(decided: DataFrame) -> DataFrame:
    """ADD under a key made of the text; PATCH and INVALIDATE of the target."""
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("n"), "namespace"), F.lit("")), F.lit("\x01"), F.lower(tx.strip(F.col("text")))))
    event = F.when(F.col("op") == "UPDATE", "PATCH").when(F.col("op") == "DELETE", "INVALIDATE").when(F.col("op") == "ADD", "ADD")
    rows = decided.withColumn("event", event).where((F.col("event") == "ADD") | (F.col("event").isNotNull() & F.col("target").isNotNull()))
    return rows.select(F.when(F.col("event") == "ADD", key).otherwise(F.col("target")).alias("id"), "namespace", "type", "text", F.col("event").alias("op"), "at", "fact")


def run(blocks: DataFrame, root: str, decider: Callable[[Column, Column], Column] | None = None,
        neighbours: Callable[[DataFrame, DataFrame], DataFrame] = same_attribute) -> str | None:
    """Promote what is not processed yet; the name of the run, or None if there was nothing to do. ``decider`` gives the
    operation of what the rules leave open, from the fact and its neighbour; without one that is a NOOP."""
    spark = blocks.sparkSession
    runs = committed(spark, root)
    old = {kind: stored(spark, root, kind, runs) for kind in KINDS}
    name = uuid.uuid4().hex

    def put(df: DataFrame, kind: str) -> DataFrame:
        df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in KINDS[kind].split(", ")]).write.parquet(f"{root}/{kind}/{name}")
        return stored(spark, root, kind, [name])

    new = promotion.unprocessed(blocks.where("id is not null"), old["processed"])
    one = new.groupBy("id").agg(F.min(F.struct("namespace", "at", "reply")).alias("x")).select("id", "x.*")
    reply = F.col("reply")
    fresh = written(one.select(  # replies are parsed once, for quarantine, blocks and facts
        "id", "namespace", "at", reply.isNull().alias("silent"), replies.parsed(reply, replies.FACTS)["facts"].isNotNull().alias("whole"), F.sha2(F.coalesce(reply, F.lit("")), 256).alias("digest"),
        replies.facts(reply).alias("facts")))
    broken = fresh.where("not whole").join(old["quarantine"].select("id", "digest").distinct(), ["id", "digest"], "left_anti")
    waiting = put(broken.withColumn("reason", F.when(F.col("silent"), "no reply").otherwise("reply does not parse")), "quarantine")
    done = put(fresh.where("whole"), "processed")
    if done.isEmpty() and waiting.isEmpty():
        return None  # the folders of this run are in no manifest
    found = _facts(fresh.where("whole"))
    live = memory_rows(old["events"]).where("invalidated_at is null")
    near = neighbours(found, live)
    both = found.join(near, "fact", "left")
    op = promotion.decide(F.coalesce(tx.is_retraction(F.col("text")), F.lit(False)), F.col("similarity"))
    asked = both.withColumns({"rule": op, "tokens": F.when(op == "UNDECIDED", tx.word_count(F.col("text")) + tx.word_count(F.col("target_text"))).otherwise(0).cast("long")})
    opened = F.lit("NOOP") if decider is None else F.coalesce(decider(F.col("text"), F.col("target_text")), F.lit("NOOP"))
    decided = asked.withColumns({"op": F.when(F.col("rule") == "UNDECIDED", opened).otherwise(F.col("rule")), "by_rule": F.col("rule") != "UNDECIDED"})
    put(_events(put(decided, "decisions")), "events")
    commit(spark, root, len(runs), name)
    return name


def reports(spark: SparkSession, root: str, price: float = 0.0) -> DataFrame:
    """One row a run: blocks, quarantine, operations, tokens given to the decider, and their price a thousand."""
    parts = []
    for number, name in enumerate(committed(spark, root)):
        n = lambda op: F.count_if(F.col("op") == op).alias(op.lower())
        ops = stored(spark, root, "decisions", [name]).agg(
            n("ADD"), n("UPDATE"), n("DELETE"), n("NOOP"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(~F.col("by_rule")).alias("asked"))
        blocks = stored(spark, root, "processed", [name]).agg(F.count(F.lit(1)).alias("blocks"))
        held = stored(spark, root, "quarantine", [name]).agg(F.count(F.lit(1)).alias("quarantined"))
        parts.append(blocks.crossJoin(held).crossJoin(ops).select(F.lit(number).cast("long").alias("run"), "*", (F.col("tokens") / 1000 * price).alias("cost")))  # one row each
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole
