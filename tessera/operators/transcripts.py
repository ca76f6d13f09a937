"""Transcripts of sessions: views, prompts, rolling back, and the writes that decisions make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agent_view(turns: DataFrame, agents: int = 3) -> DataFrame:
    """A shared transcript as one agent sees it: its own turns, the user's, and those of others; no system turns."""
    voice = F.when(F.col("role") == "user", "user").when(F.pmod("seq", F.lit(2)) == 1, "self").otherwise("other")
    agent = F.concat(F.lit("agent"), F.pmod("session", F.lit(agents)).cast("string"))
    return turns.where("role <> 'system'").withColumns({"agent": agent, "voice": voice})


def rolled_back(turns: DataFrame) -> DataFrame:
    """Whether the newest turn of a session is the user's, and how many turns are left without it."""
    back = F.max_by("role", "seq") == "user"
    return turns.groupBy("session").agg(F.max("seq").alias("last"), back.alias("rolled_back"), (F.count(F.lit(1)) - back.cast("int")).alias("left_turns"))


def rendered(turns: DataFrame, system: str | None = None) -> DataFrame:
    """(session, prompt): the turns in order, after an optional system prompt."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    body = F.array_join(lines, "\n")
    return turns.groupBy("session").agg((F.concat(F.lit(f"system: {system}\n"), body) if system else body).alias("prompt"))


def writes(decisions: DataFrame) -> DataFrame:
    """(id, event, target) of decisions (id, op, short, target). A contradicted fact is closed and the new one stored; an
    UPDATE or DELETE without a target, or a NOOP that was not decided by a rule, stores the fact as it is."""
    op, target = F.col("op"), F.col("target")
    of = lambda event, t: F.struct(F.lit(event).alias("event"), t.alias("target"))
    none = F.lit(None).cast("long")
    events = F.array(
        F.when((op == "DELETE") & target.isNotNull(), of("INVALIDATE", target)), F.when((op == "UPDATE") & target.isNotNull(), of("PATCH", target)),
        F.when(op.isin("ADD", "DELETE") | ((op == "NOOP") & ~F.col("short")) | ((op == "UPDATE") & target.isNull()), of("ADD", none)))
    return decisions.select("id", F.inline(F.filter(events, lambda e: e.isNotNull())))
