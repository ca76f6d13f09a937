"""URL filters by a sort-merge range join (native: DataFrame functions only).

Reversed host labels and the path make a key, so that a rule covers one interval of keys. Keys of rules and of
addresses are sorted together into ranges and swept once; the sweep holds the stack of rules that are open at the last
rule seen. Intervals nest or are disjoint, so the rules that cover an address are all on that stack. A range begins
with the stack of the last rule before it.

A rule fits its host and all subdomains where the path starts with the rule's path. Hosts and paths are two
prefixes, so each address is looked up once for each suffix of its host (as many as its labels). Distinct
(host, path) pairs are looked up, not rows; they are dealt by ranges of the key and then of host and path, so neither a
host with a third of all addresses nor a key that all hosts of a domain share fills a task, and no rule is copied.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. Repeated rows
each get their result. Among fitting rules the longest (host and path together) wins, then the longer host,
then ``block``. An empty rule set or table is fine, and a url may have any
length. Input columns may have any name; those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.work import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
SEPARATOR = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark, rules=None) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules if h])
    return spark.range(1).select(F.inline(rows)) if rules else spark.range(0).selectExpr("'' host", "'' path", "'' verdict")


def reversed_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(SEPARATOR), path)


def nested(rules: DataFrame) -> DataFrame:
    """Rules as (key, stack): the rules that cover a rule, outermost first, itself last. A rule covers another of its
    host if its path is a prefix of the other's, so each rule looks up the prefixes of its path: rows grow with the
    lengths of the paths, not with the square of a host's rules."""
    one = rules.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max("verdict").alias("_v"))
    me = F.struct(F.length(F.concat("_h", "_p")).alias("n"), F.length("_h").alias("h"), F.col("_p").alias("path"),
                  F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))
    keyed = one.select("_h", "_p", me.alias("_me"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("_p")), lambda i: F.left(F.col("_p"), i))
    asks = one.select("_h", F.col("_p").alias("_own"), F.explode(prefixes).alias("_p"))
    found = asks.join(keyed, ["_h", "_p"]).groupBy("_h", "_own").agg(F.array_sort(F.collect_list("_me")).alias("stack"))
    return found.select(reversed_key(F.col("_h"), F.col("_own")).alias("key"), "stack")


def in_ranges(points: DataFrame) -> DataFrame:
    """``points`` plus the range of each: neighbours in the order of keys share one. Points of one key are ordered by host and
    path, a rule's before them (it has no host), so that many under one key are cut too. A table, so that ranges stay
    what they are."""
    return written(points.repartitionByRange("key", "host", "path").withColumn("range", F.spark_partition_id()))


def range_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` plus host, path, rule (null without one) and verdict."""
    host, path = host_and_path(F.col(f"`{url}`"))
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), host.alias("host"), path.alias("path"))
    pairs = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    asked = pairs.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_suffix"))
    asked = asked.select("host", "path", reversed_key(F.col("_suffix"), F.col("path")).alias("key"))
    ruled = nested(rules)
    points = asked.withColumn("stack", F.lit(None).cast(ruled.schema["stack"].dataType)).unionByName(
        ruled.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "stack"))
    ranged = in_ranges(points)
    last_rule = ranged.where("stack is not null").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    # one row a range: the stack that is open where it begins is that of the last rule in the ranges before
    before = F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    begins = ranged.select("range").distinct().join(last_rule, "range", "left").withColumn("stack", before).select(
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit("").alias("key"), "stack", "range")
    order = Window.partitionBy("range").orderBy(F.col("key"), F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.unionByName(begins).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("host is not null and open is not null")
    suffix = F.substring_index("key", SEPARATOR, 1)
    open_hosts = swept.withColumn("_rev", suffix).withColumn("best", F.expr(
        "array_max(filter(open, x -> startswith(path, x.path) and length(_rev) = x.h "
        "and array_join(reverse(split(_rev, '[.]')), '.') = left(x.rule, x.h)))"))
    best = open_hosts.where("best is not null").groupBy("host", "path").agg(F.max("best").alias("best"))
    # a table of its own, so that the join can split an address with many rows
    best = written(best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("_verdict")))
    return rows.join(best, ["host", "path"], "left").select(
        *[F.col("_row").getField(c).alias(c) for c in kept], "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
