"""What a text states: durable facts, typed candidates, relations and replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import text as tx


def durable_facts(texts: DataFrame) -> DataFrame:
    """(id, pos, fact, rule): durable sentences of each (id, text), the first of equal ones."""
    s = texts.select("id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "fact")).withColumn("rule", tx.durable_rule(F.col("fact"))).where("rule is not null")
    w = Window.partitionBy("id", F.rtrim(F.lower("fact"), F.lit("."))).orderBy("pos")
    return s.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def typed(texts: DataFrame) -> DataFrame:
    """(id, candidate_type, span): credentials first; spans that hold one are left out, and a text is a meeting only if it
    has no credential, task or decision. All work is inside the row."""
    text = F.col("text")
    hidden = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for _, p in fx.SECRET_SPANS])))
    rows = texts.withColumn("_hidden", hidden)
    of = lambda kind, array: F.transform(array, lambda x: F.struct(F.lit(kind).alias("candidate_type"), x.alias("span")))
    found = []
    for kind, pattern in fx.CANDIDATES:
        free = F.filter(tx.spans(text, pattern), lambda x: ~F.exists(F.col("_hidden"), lambda h: F.contains(F.lower(x), F.lower(h))))
        found.append(of(kind, free))
    rows = rows.withColumn("_found", F.flatten(F.array(*found)))
    firsts = F.filter("_found", lambda x, i: ~F.exists(F.slice(F.col("_found"), 1, i), lambda y: y["span"] == x["span"]))
    rows = rows.withColumn("_found", firsts)
    meets = text.rlike(fx.MEETING) & (F.size("_hidden") == 0) & ~F.exists("_found", lambda x: x["candidate_type"].isin("decision", "task"))
    secret = of("sensitive_data", F.col("_hidden"))
    meeting = F.when(meets, of("meeting_episode", F.array(F.left(text, F.lit(200)))))
    every = F.concat(secret, F.col("_found"), F.coalesce(meeting, F.slice(secret, 1, 0)))
    return rows.select("id", F.inline(every))


def relation_triples(texts: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, confidence), each triple of a text once in any case."""
    rows = texts.select("id", F.posexplode(tx.relations(F.col("text"))).alias("pos", "x"))
    w = Window.partitionBy("id", F.lower("x.subject"), "x.predicate", F.lower("x.object")).orderBy("pos")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("id", "x.*", F.lit(0.6).alias("confidence"))


def replaced_mentions(texts: DataFrame) -> DataFrame:
    """(announcement, stale, entity): texts that mention, as a word, what another text says it has moved away from. Words
    meet in a join; texts that announce a replacement themselves are not stale."""
    said = texts.select("id", F.explode(tx.sentences(F.col("text"))).alias("s")).where(F.col("s").rlike(fx.REPLACES))
    said = said.select(F.col("id").alias("announcement"), F.explode(F.regexp_extract_all("s", F.lit(fx.REPLACES), F.lit(1))).alias("entity"))
    said = said.select("announcement", F.lower("entity").alias("entity")).distinct()
    wanted = said.select("entity").distinct()
    words = texts.select(F.col("id").alias("stale"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("entity"))
    words = words.join(wanted, "entity", "left_semi").join(said.select(F.col("announcement").alias("stale")).distinct(), "stale", "left_anti")
    return said.join(words, "entity").select("announcement", "stale", "entity")
