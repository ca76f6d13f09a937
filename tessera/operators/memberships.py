"""Countable things that texts say were acquired, owned or done: phrases found by one pattern, then cut, named and measured
by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verbs of having and doing, words that end a noun phrase, and words that name nothing countable.
VERBS = (
    r"bought|buy|buying|purchased|purchase|got|gotten|added|add|acquired|acquire|adopted|adopt|received|receive|made|make|built|build|set\s+up|fixed|fix|replaced|replace"
    r"|serviced|service|installed|install|ordered|order|attended|attend|completed|complete|collected|collect|own|owns|owned|have|has|had|visited|visit|joined|join|signed\s+up\s+for"
)
ENDS = ("from of for in at on with to about by yesterday today tomorrow when while because so since after before during last this that which who and but then now again also too "
        "very really just").split()
NO_HEADS = ("it them one ones thing things lot lots bit couple few some any time times today yesterday tomorrow week weekend day morning night year month while now then here there way "
            "ways idea ideas look go plan chance moment place home house work job life fun this that these those i you we they he she").split()
PHRASE = rf"\b(?:{VERBS})\s+(?:a|an|another|one|my|the|this|that)\s+([A-Za-z0-9][\w'-]*(?:\s+[A-Za-z0-9][\w'-]*){{0,4}})"
MEASURE = r"(?i)\b(\d+(?:\.\d+)?)\s+(hours?|hrs?|minutes?|mins?|days?|weeks?|months?|years?|miles?|km|dollars?)\b"
#: Characters after a phrase that may hold its measure.
TAIL_CHARS = 40
#: Endings of plurals, tried in order: (words that end so, what is replaced, by what).
PLURALS = ((r"^.+ies$", "ies$", "y"), (r"(?:ch|sh|ss|.x)es$", "es$", ""), (r"^.+[^s]s$", "s$", ""))
MARK = "\u0001"


def singular(word: Column) -> Column:
    out = low = F.lower(word)
    for whole, ending, by in reversed(PLURALS):
        out = F.when(low.rlike(whole), F.regexp_replace(low, ending, by)).otherwise(out)
    return out


def memberships(texts: DataFrame) -> DataFrame:
    """(id, pos, predicate, obj, quantity, unit) of each (id, text): each head noun and object once, at its first phrase."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), MARK, " "), f"(?i){PHRASE}", f"{MARK}$0")
    parts = texts.select("id", F.split(marked, MARK).alias("p")).select("id", "p", F.posexplode(F.slice("p", 2, F.size("p"))).alias("pos", "part"))
    begins = parts.select(
        "id", "pos", F.regexp_extract("part", f"(?i)^{PHRASE}", 1).alias("np"),
        F.concat(F.regexp_replace("part", f"(?i)^{PHRASE}", ""), F.array_join(F.slice("p", F.col("pos") + 3, F.size("p")), "")).alias("after"))
    words = F.split("np", r"\s+")
    end = F.array_position(F.transform(words, lambda w: F.lower(w).isin(ENDS)), True)
    cut = begins.select("id", "pos", "np", "after", F.when(end > 0, F.slice(words, F.lit(1), (end - 1).cast("int"))).otherwise(words).alias("words"))
    named = F.filter("words", lambda w: w.rlike("[A-Za-z]{2,}"))
    heads = cut.where(F.size(named) > 0).select(
        "id", "pos", F.lower(F.array_join("words", " ")).alias("obj"), singular(F.regexp_replace(F.element_at(named, -1), "[^A-Za-z'-]", "")).alias("predicate"),
        F.concat_ws(" ", "np", F.left("after", F.lit(TAIL_CHARS))).alias("around"))
    said = heads.where((F.length("predicate") >= 3) & ~F.col("predicate").isin(NO_HEADS))
    size, unit = F.regexp_extract("around", MEASURE, 1), F.regexp_extract("around", MEASURE, 2)
    measured = F.struct("pos", F.when(size != "", size.cast("double")).alias("quantity"), F.when(size != "", F.concat(singular(unit), F.lit("s"))).otherwise("").alias("unit"))
    first = said.groupBy("id", "predicate", "obj").agg(F.min(measured).alias("f"))
    return first.select("id", "f.pos", "predicate", "obj", "f.quantity", "f.unit")

