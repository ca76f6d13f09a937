"""Handling policies: one static table joined on candidate type, then merged for each candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (policy, priority, candidate types, action, scope, ttl seconds, on_expiry, redact, encrypt, cross-session, team, keep raw evidence,
#: update, conflict, projections). ``sensitivity_v1`` also takes candidates by their level and asks the user about restricted ones;
#: ``task_urgency_v1`` expires a day after the deadline, else in 7 days.
POLICIES = [
    ("sensitivity_v1", 100, ["sensitive_data"], "store", "ltm", None, "archive", True, True, False, False, False, "ignore_duplicate", "ask_user", ["canonical"]),
    ("correction_v1", 85, ["correction"], "supersede", "ltm", None, "mark_expired", False, False, True, False, True, "supersede", "supersede_old", ["canonical", "vector", "temporal"]),
    ("decision_v1", 80, ["decision", "code_decision"], "store", "ltm", None, "mark_expired", False, False, True, False, True, "supersede", "supersede_old", ["canonical", "vector", "temporal"]),
    ("task_urgency_v1", 75, ["task", "deadline"], "store", "task_store", None, "compact", False, False, True, False, True, "append_only", "keep_both", ["canonical", "task_queue", "temporal"]),
    ("user_preference_v1", 70, ["user_preference"], "store", "ltm", None, "mark_expired", False, False, True, False, True, "versioned", "keep_both", ["canonical", "vector"]),
    ("procedural_v1", 65, ["procedure"], "store", "ltm", None, "mark_expired", False, False, True, False, True, "merge", "trust_newer", ["canonical", "vector"]),
    ("code_v1", 65, ["code_symbol", "code_decision"], "store", "code_index", None, "mark_expired", False, False, True, False, True, "versioned", "trust_newer", ["code_symbol", "canonical", "vector"]),
    ("meeting_v1", 60, ["meeting_episode"], "store", "episode_store", 30 * 86400, "compact", False, False, True, True, True, "append_only", "keep_both", ["raw_evidence", "canonical", "temporal"]),
    ("default_fact_v1", 10, ["fact", "document_knowledge", "unknown"], "store", "ltm", None, "mark_expired", False, False, True, False, True, "versioned", "mark_conflict", ["canonical", "vector"]),
]
FIELDS = [("policy", "string"), ("priority", "int"), ("candidate_type", "string"), ("action", "string"), ("scope", "string"), ("ttl", "long"), ("on_expiry", "string"), ("redact", "boolean"),
          ("encrypt", "boolean"), ("cross_session", "boolean"), ("team", "boolean"), ("evidence", "boolean"), ("update", "string"), ("conflict", "string"), ("projections", "array<string>")]
TYPES = ["fact", "user_preference", "task", "deadline", "decision", "code_decision", "procedure", "code_symbol", "meeting_episode",
         "correction", "document_knowledge", "sensitive_data", "temporary_context", "unknown"]
SENSITIVITY = {"public": 0, "private": 1, "confidential": 2, "restricted": 3}
#: Projections that become a marker tag of the canonical row, and the tag.
MARKERS = {"task_queue": "task_queue", "code_symbol": "code_symbol_index", "raw_evidence": "evidence_store"}
GRACE_SECONDS, DEFAULT_TASK_SECONDS = 24 * 3600, 7 * 86400


def policy_table(spark: SparkSession) -> DataFrame:
    def one(p, kind):
        values = [p[0], p[1], kind, *p[3:]]
        return F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v).cast(t)).alias(n) for v, (n, t) in zip(values, FIELDS)])

    return spark.range(1).select(F.inline(F.array(*[one(p, t) for p in POLICIES for t in p[2]])))


def restricted():
    return (F.col("sensitivity") == "restricted") | (F.col("candidate_type") == "sensitive_data")


def match(candidates: DataFrame, now, require_approval: bool = True) -> DataFrame:
    """The plan of every policy that supports a candidate (id, candidate_type, sensitivity, valid_until): by type, and the
    sensitivity policy by level."""
    table = F.broadcast(policy_table(candidates.sparkSession))  # the static table above
    by_type = candidates.join(table, "candidate_type")
    levels = [k for k, v in SENSITIVITY.items() if v >= SENSITIVITY["confidential"]]
    by_level = candidates.where(F.col("sensitivity").isin(levels) & (F.col("candidate_type") != "sensitive_data")).join(
        table.where("policy = 'sensitivity_v1'").drop("candidate_type"))  # one row
    plans = by_type.unionByName(by_level)
    sensitive, task = F.col("policy") == "sensitivity_v1", F.col("policy") == "task_urgency_v1"
    seconds = lambda x: F.floor(F.unix_micros(x) / 1_000_000)
    due = F.when(F.col("valid_until").isNotNull(), seconds("valid_until") + GRACE_SECONDS).otherwise(seconds(now) + DEFAULT_TASK_SECONDS)
    return plans.withColumns({
        "action": F.when(sensitive & restricted() & F.lit(require_approval), "ask_user").otherwise(F.col("action")),
        "approval": sensitive & restricted(),
        "expires": F.when(task, due).when(F.col("ttl").isNotNull(), seconds(now) + F.col("ttl")),
        "ttl": F.when(task, F.greatest(F.lit(0), due - seconds(now))).otherwise(F.col("ttl"))})


def inferred():
    """How sensitive a plan's privacy says its candidate is."""
    level = F.when(F.col("encrypt") | F.col("approval"), "restricted").when(F.col("redact") | ~F.col("cross_session"), "confidential").otherwise("private")
    return F.element_at(F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv]), level)


def merge(candidates: DataFrame, now) -> DataFrame:
    """One plan a candidate: the highest priority leads; what restricts privacy is OR, what shares is AND, the shortest life
    wins, a question to the user stays, projections are those of all plans in their order. Without a policy: ignore."""
    order = F.struct("priority", "policy")
    matched = match(candidates, now).withColumn("_level", inferred())
    top = F.max(order).over(Window.partitionBy("id"))
    matched = matched.withColumn("_base", order == top)
    steps = F.reverse(F.array_sort(F.collect_list(F.struct("priority", "policy", "projections"))))  # at most one a policy
    plans = matched.groupBy("id").agg(
        F.max_by(F.struct("action", "scope", "on_expiry", "update", "conflict"), order).alias("base"),
        F.bool_or((F.col("action") == "ask_user") & ~F.col("_base")).alias("asked"),
        *[F.bool_or(c).alias(c) for c in ("approval", "redact", "encrypt")], *[F.bool_and(c).alias(c) for c in ("cross_session", "team", "evidence")],
        F.min("ttl").alias("ttl"), F.min("expires").alias("expires"), steps.alias("steps"), F.max(F.when(~F.col("_base"), F.col("_level"))).alias("level"))
    names = F.array(*[F.lit(k) for k, _ in sorted(SENSITIVITY.items(), key=lambda kv: kv[1])])
    flag = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return candidates.join(plans, "id", "left").select(
        "id", "candidate_type", F.when(F.col("asked"), "ask_user").otherwise(F.coalesce("base.action", F.lit("ignore"))).alias("action"),
        F.coalesce("base.scope", F.lit("ltm")).alias("scope"), F.coalesce("base.on_expiry", F.lit("mark_expired")).alias("on_expiry"),
        F.coalesce("base.update", F.lit("ignore_duplicate")).alias("update"), F.coalesce("base.conflict", F.lit("keep_both")).alias("conflict"),
        flag("approval", False), flag("redact", False), flag("encrypt", False), flag("cross_session", True), flag("team", False), flag("evidence", True), "ttl", "expires",
        F.concat_ws(",", F.transform("steps", lambda x: x["policy"])).alias("policies"),
        F.concat_ws(",", F.array_distinct(F.flatten(F.transform("steps", lambda x: x["projections"])))).alias("projections"),
        F.element_at(names, F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)) + 1).alias("derived_sensitivity"))


def routed(plans: DataFrame) -> DataFrame:
    """(id, table, tag): where a plan goes. Questions go to the approvals, ignored candidates nowhere; others have one
    canonical row, with all its marker tags in one expression, so that no later projection can lose them."""
    kept = plans.where("action <> 'ignore'").withColumn("_p", F.split("projections", ","))
    tags = F.filter(F.array(*[F.when(F.array_contains("_p", k), F.lit(v)) for k, v in MARKERS.items()]), lambda x: x.isNotNull())
    canonical = F.arrays_overlap("_p", F.array(*map(F.lit, ("canonical", "vector", "temporal"))))
    return kept.where((F.col("action") == "ask_user") | canonical).select(
        "id", F.when(F.col("action") == "ask_user", "approvals").otherwise("canonical").alias("table"),
        F.when(F.col("action") == "ask_user", "").otherwise(F.concat_ws(",", tags)).alias("tags"))


def sensitivity(candidate_type, toxic):
    return F.when(toxic == 1, "confidential").when(candidate_type == "sensitive_data", "restricted").otherwise("private")


def redacted(text, redact, candidate_type):
    return F.when(redact, F.concat(F.lit("[redacted "), candidate_type, F.lit("]"))).otherwise(text)
