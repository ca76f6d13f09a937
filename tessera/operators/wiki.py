"""Pages of what users state about themselves, kept page by page, and turns ranked by words and points.

A fact is (owner, topic, fact_key, text, as_of, seq). A page is one owner's topic, as a table of lines, so that no page is a
cell: section (current or older), fact_key and as_of order them, and ``line`` is the text. Of the facts with one key the
newest is current; a fact without a date is the oldest, and of equal dates the first said counts. Repeated rows are kept.

``refresh`` adds facts to a log and makes again the pages that they touch. A page is read from the newest run that has it;
a run counts once its line is in the manifest, so a lost run changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import text as tx
from tessera.sources.store import commit, committed, runs_of

FACT = "owner long, topic string, fact_key string, text string, as_of date, seq long"
LINE = "owner long, topic string, section string, fact_key string, as_of date, seq long, line string"
PAGE = ["owner", "topic"]


def routed(text: Column) -> Column:
    """The topic that a text's terms name, in order."""
    return tx.first_label(F.lower(text), fx.TOPIC_TERMS, "misc")


def facts(turns: DataFrame) -> DataFrame:
    """Facts of the user's turns (owner, seq, role, text, as_of, hint); the hint names the shop that a session is about."""

    def value(patterns: tuple[str, ...]) -> Column:
        first = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in patterns])
        return F.trim(first)

    bare = lambda x: F.btrim(x, F.lit('"'))
    said = {
        "spotify_playlist": lambda v: F.concat(F.lit('The user created a Spotify playlist called "'), bare(v), F.lit('".')),
        "commute_duration": lambda v: F.concat(F.lit("The user's daily commute takes "), v, F.lit(".")),
        "target_coupon_redeemed": lambda v: F.when(F.lower("hint") == "target", F.concat(
            F.lit("The user redeemed a $"), F.regexp_extract("text", fx.COUPON_AMOUNT, 1), F.lit(" "), F.regexp_replace(v, fx.COUPON_TIME, ""), F.lit(" coupon at Target."))),
        "degree": lambda v: F.concat(F.lit("The user graduated with a degree in "), v, F.lit(".")),
        "theater_play": lambda v: F.when(F.contains(F.lower("text"), F.lit("play")), F.concat(F.lit('The user attended the play "'), bare(v), F.lit('" at the local community theater.'))),
    }
    rows = F.array(*[F.struct(F.lit(topic).alias("topic"), F.lit(key).alias("fact_key"), said[key](value(patterns)).alias("text")) for key, topic, patterns in fx.WIKI_FACTS])
    return turns.where("role = 'user'").withColumn("x", F.explode(F.filter(rows, lambda x: x["text"].isNotNull()))).select("owner", "x.*", "as_of", "seq")


def lines(stated: DataFrame) -> DataFrame:
    """The lines of all pages that these facts make. The newest fact of a key is found by a map-side aggregate."""
    order = F.struct(F.coalesce("as_of", F.lit("0001-01-01").cast("date")).alias("d"), (-F.col("seq")).alias("s"))
    newest = stated.groupBy(*PAGE, "fact_key").agg(F.max(order).alias("_m"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*PAGE, "fact_key")]
    both = stated.withColumn("_o", order).alias("f").join(newest.alias("n"), same)
    section = F.when(F.col("_o") == F.col("_m"), "Current Facts").otherwise("Older Facts")
    low = F.concat(F.lower(F.left("f.text", F.lit(1))), F.substr("f.text", F.lit(2)))
    line = F.when(F.col("f.as_of").isNotNull(), F.concat(F.lit("- As of "), F.date_format("f.as_of", "yyyy-MM-dd"), F.lit(", "), low)).otherwise(F.concat(F.lit("- "), F.col("f.text")))
    return both.select("f.owner", "f.topic", section.alias("section"), "f.fact_key", "f.as_of", "f.seq", line.alias("line"))


def refresh(new: DataFrame, root: str) -> str | None:
    """Add facts to the log, and make the pages again that they touch; None if there are no facts."""
    spark = new.sparkSession
    runs, name = committed(spark, root), uuid.uuid4().hex
    topic = F.coalesce("topic", routed(F.concat_ws(" ", "fact_key", "text")))
    new.withColumn("topic", topic).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in FACT.split(", ")]).write.parquet(f"{root}/facts/{name}")
    added = runs_of(spark, f"{root}/facts", [name], FACT)
    if added.isEmpty():
        return None
    touched = added.select(*[F.col(c).alias(f"_{c}") for c in PAGE]).distinct()
    of_page = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAGE]
    lines(runs_of(spark, f"{root}/facts", [*runs, name], FACT).join(touched, of_page, "left_semi")).write.parquet(f"{root}/pages/{name}")
    commit(spark, root, len(runs), name)
    return name


def pages(spark: SparkSession, root: str) -> DataFrame:
    """The lines of every page, from the newest run that made it."""
    parts = [runs_of(spark, f"{root}/pages", [r], LINE).withColumn("_run", F.lit(i)) for i, r in enumerate(committed(spark, root))]
    if not parts:
        return spark.createDataFrame([], LINE)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    newest = every.groupBy(*[F.col(c).alias(f"_{c}") for c in PAGE]).agg(F.max("_run").alias("_newest"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAGE] + [F.col("_run") == F.col("_newest")]
    return every.join(newest, same, "left_semi").drop("_run")


def words(text: Column) -> Column:
    every = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.array_except(every, F.array(*[F.lit(w) for w in fx.LEXICAL_STOP_WORDS])), lambda w: F.length(w) > 2)


def lexical(asked: Column, turn: Column, asked_words: Column, turn_words: Column) -> Column:
    """The share of the question's words that a turn has, and points for what it is likely to be about; 0 for a question
    without words."""
    score = F.size(F.array_intersect(asked_words, turn_words)) / F.size(asked_words)
    for q, t, unless, points in fx.LEXICAL_BOOSTS:
        hit = F.lower(asked).rlike(q) & F.lower(turn).rlike(t)
        score = score + F.when(hit & ~F.lower(turn).rlike(unless) if unless else hit, points).otherwise(0.0)
    return F.when(F.size(asked_words) > 0, score).otherwise(0.0)


def ranked(questions: DataFrame, turns: DataFrame, k: int) -> DataFrame:
    """(query_id, place, seq, score): the best ``k`` turns of a question's own session, earlier ones first among equals. A
    question meets the turns of its session only; ``k`` rows a question leave each task."""
    q = questions.select("query_id", "session", "question", words(F.coalesce("question", F.lit(""))).alias("qw"))
    t = turns.select("session", "seq", "role", F.coalesce("text", F.lit("")).alias("text"), words(F.coalesce("text", F.lit(""))).alias("tw"))
    role = F.when(F.coalesce("role", F.lit("user")) == "user", fx.USER_POINTS).when(F.col("role") == "assistant", fx.ASSISTANT_POINTS).otherwise(0.0)
    score = F.round(fx.LEXICAL_WEIGHT * lexical(F.col("question"), F.col("text"), F.col("qw"), F.col("tw")) + role, 9)
    scored = q.join(t, "session").select("query_id", "seq", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
