"""Reads and writes of a memory table: live rows, both clocks, tags, forgetting, sessions, and the order of recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FACT_CHARS = 8000
MAX_RECALL = 100


def live(rows: DataFrame, namespace: str | None = None, layers: list[str] | None = None) -> DataFrame:
    """What every read starts from."""
    rows = rows.where("invalidated_at is null")
    if namespace is not None:
        rows = rows.where(F.col("namespace") == namespace)
    return rows.where(F.col("layer").isin(layers)) if layers else rows


def effective_time() -> Column:
    return F.coalesce("valid_from", "created_at")


def comparable_clock(keys: list[str]) -> Column:
    """Valid time where all rows of a group state one, else the time of recording."""
    return F.when(F.bool_and(F.col("valid_from").isNotNull()).over(Window.partitionBy(*keys)), F.col("valid_from")).otherwise(F.col("created_at"))


def after_key(rows: DataFrame, created_at: Column, row_id: Column) -> DataFrame:
    """The page that follows a (created_at, id)."""
    return rows.where(F.struct("created_at", "id") > F.struct(created_at.alias("created_at"), row_id.alias("id")))


def scope(rows: DataFrame, text: str) -> DataFrame:
    """Rows of "session:<id>", "since:<timestamp>" or "global"."""
    kind, _, value = text.partition(":")
    if kind == "session":
        return rows.where(F.col("subject") == F.lit(value))
    if kind == "since":
        return rows.where(F.col("created_at") >= F.lit(value).cast("timestamp"))
    if kind == "global":
        return rows
    raise ValueError(f"not a scope: {text}")


def clean(rows: DataFrame, text: str = "text") -> DataFrame:
    """Texts trimmed and cut to the longest fact; empty ones go."""
    body = F.left(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(MAX_FACT_CHARS))
    return rows.withColumn(text, body).where(F.col(text) != "")


def clamp_k(k: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MAX_RECALL), k))


def forget(rows: DataFrame, *, unused_since: Column | None = None, superseded_only: bool = False, contains: str | None = None, max_importance: float | None = None,
           max_access: int | None = None, limit: int | None = None) -> DataFrame:
    """Live rows that meet every stated condition, coldest first. ``contains`` is a pattern of ``like``, in any case.
    A policy without a condition would forget all and is refused."""
    if unused_since is None and not superseded_only and contains is None and max_importance is None and max_access is None:
        raise ValueError("state what to forget")
    rows = rows.where("invalidated_at is null").withColumn("cold", F.coalesce("last_access", "created_at"))
    if unused_since is not None:
        rows = rows.where(F.col("cold") < unused_since)
    if superseded_only:
        rows = rows.where("valid_to is not null")
    if contains is not None:
        rows = rows.where(F.col("text").ilike(f"%{contains}%"))
    if max_importance is not None:
        rows = rows.where(F.coalesce("importance", F.lit(0.0)) <= max_importance)
    if max_access is not None:
        rows = rows.where(F.coalesce("access_count", F.lit(0)) <= max_access)
    return rows.orderBy("cold", "id").limit(limit) if limit is not None else rows


def apply_forget(rows: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """``rows`` with those of ``gone`` closed at ``at``; closing twice changes nothing."""
    marks = gone.select("id", F.lit(True).alias("_gone"))
    closed = F.when(F.col("_gone") & F.col("invalidated_at").isNull(), at).otherwise(F.col("invalidated_at"))
    return rows.join(marks, "id", "left").withColumn("invalidated_at", closed).drop("_gone")


def by_tag(rows: DataFrame, tag: Column, as_of: Column) -> DataFrame:
    """Live rows with a tag, valid at a time, newest valid time first, rows without one last."""
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    w = Window.partitionBy("tag").orderBy(F.desc_nulls_last("valid_from"), F.desc("created_at"), "id")
    return rows.where((F.col("tag") == tag) & F.col("invalidated_at").isNull() & valid).withColumn("rank", F.row_number().over(w))


def current(rows: DataFrame, attribute_keys: list[str], as_of: Column) -> DataFrame:
    """The value that each key has at a time: of the rows that have begun, those not closed if there are any, and of them
    the newest by the clock that all of them state."""
    begun = rows.where("invalidated_at is null").where(effective_time() <= as_of)
    open_rows = begun.withColumn("_open", F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    w = Window.partitionBy(*attribute_keys)
    head = open_rows.withColumn("_any", F.bool_or("_open").over(w)).where("_open or not _any")
    return head.withColumn("_clock", comparable_clock(attribute_keys)).groupBy(*attribute_keys).agg(F.max_by(F.struct("id", "value"), F.struct("_clock", "id")).alias("x")).select(*attribute_keys, "x.*")


def append_and_clear(events: DataFrame) -> DataFrame:
    """The turns that a session still has: those after its last CLEAR, without the deleted ones."""
    last = F.max(F.when(F.col("op") == "CLEAR", F.col("seq"))).over(Window.partitionBy("session"))
    gone = F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).over(Window.partitionBy("session", "id"))
    return events.withColumns({"_clear": last, "_gone": gone}).where((F.col("op") == "APPEND") & (F.col("seq") > F.coalesce("_clear", F.lit(-1))) & (F.col("seq") > F.coalesce("_gone", F.lit(-1)))).drop("_clear", "_gone")


def bump_access(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Access counts and last accesses with those of a log (id, at) added."""
    seen = log.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    return rows.join(seen, "id", "left").withColumns({
        "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_access": F.greatest("last_access", "_at")}).drop("_n", "_at")


def first_sessions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One session for each key: the first that was made."""
    return rows.groupBy(*keys).agg(F.min("id").alias("session_id"), F.count(F.lit(1)).alias("n"))


def current_version_first(hits: DataFrame) -> DataFrame:
    """(query_id, position, ...): within each query, the newest hit of an attribute takes the best position of the hits
    with that attribute, and the others follow in their order. Hits without an attribute stay."""
    group = ["query_id", "attribute"]
    w = Window.partitionBy(*group)
    newest = F.max(F.struct("_clock", (-F.col("position")).alias("p"))).over(w)
    rows = hits.withColumn("_clock", comparable_clock(group)).withColumn("_newest", (-newest["p"]) == F.col("position"))
    rows = rows.withColumn("_slots", F.sort_array(F.collect_list("position").over(w)))  # at most the hits of one query
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_newest"), "position"))
    moved = F.when(F.col("attribute").isNull(), F.col("position")).otherwise(F.element_at("_slots", turn))
    return rows.withColumn("position", moved).drop("_clock", "_newest", "_slots")


def merge_lists(lists: list[DataFrame], cap: int | None = None) -> DataFrame:
    """(query_id, id, position): the lists (query_id, id, rank) one after another, the first of each id."""
    rows = lists[0].select("query_id", "id", F.lit(0).alias("k"), "rank")
    for k, more in enumerate(lists[1:], 1):
        rows = rows.unionByName(more.select("query_id", "id", F.lit(k).alias("k"), "rank"))
    firsts = rows.groupBy("query_id", "id").agg(F.min(F.struct("k", "rank")).alias("x"))
    out = firsts.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("x", "id"))).select("query_id", "id", "position")
    return out.where(F.col("position") <= cap) if cap is not None else out
