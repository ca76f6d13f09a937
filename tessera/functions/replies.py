"""Replies of models as rows: JSON inside other text, broken JSON, verdicts. No reply is trusted further than it parses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scoring import clamp01
from tessera.functions.text import let, strip

MIN_CONFIDENCE, MIN_CHARS, MAX_CHARS = 0.6, 10, 500
FACTS = "struct<facts: array<struct<text: string, confidence: string, type: string>>>"
ITEMS = "struct<facts: array<struct<predicate: string, object: string, quantity: string, unit: string>>>"
RELATIONS = "struct<relations: array<struct<subject: string, predicate: string, object: string, confidence: string>>>"
VERDICT = "struct<supported: boolean, confidence: string>"
#: A flat object and its fields in broken JSON, and the intents.
OBJECT = r"\{[^{}]*\}"
STRING = r'"((?:[^"\\]|\\.)*)"'
INTENTS = ("recall", "store", "update", "delete", "chat")


def json_part(reply: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


def parsed(reply: Column, schema: str) -> Column:
    """Null where the JSON does not parse."""
    return F.from_json(json_part(reply), schema, {"mode": "PERMISSIVE"})


def quantity(text: Column) -> Column:
    """The first number in a text."""
    return F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def facts(reply: Column) -> Column:
    """Facts that are neither trivial nor long and sure enough, the first of each in any case."""
    rows = F.transform(parsed(reply, FACTS)["facts"], lambda x: F.struct(
        strip(F.coalesce(x["text"], F.lit(""))).alias("text"), clamp01(F.coalesce(x["confidence"].try_cast("double"), F.lit(0.0))).alias("confidence"), x["type"].alias("type")))
    good = F.filter(rows, lambda x: F.length(x["text"]).between(MIN_CHARS, MAX_CHARS) & (x["confidence"] >= MIN_CONFIDENCE))
    return let(good, lambda g: F.filter(g, lambda x, i: ~F.exists(F.slice(g, 1, i), lambda y: F.lower(y["text"]) == F.lower(x["text"]))))


def relations(reply: Column) -> Column:
    """Triples with all parts, the predicate in capitals, each once in any case."""
    rows = F.transform(parsed(reply, RELATIONS)["relations"], lambda x: F.struct(
        strip(F.coalesce(x["subject"], F.lit(""))).alias("subject"), F.upper(strip(F.coalesce(x["predicate"], F.lit("")))).alias("predicate"),
        strip(F.coalesce(x["object"], F.lit(""))).alias("object"), clamp01(F.coalesce(x["confidence"].try_cast("double"), F.lit(0.5))).alias("confidence")))
    good = F.filter(rows, lambda x: (x["subject"] != "") & (x["predicate"] != "") & (x["object"] != ""))
    same = lambda x, y: (F.lower(y["subject"]) == F.lower(x["subject"])) & (y["predicate"] == x["predicate"]) & (F.lower(y["object"]) == F.lower(x["object"]))
    return let(good, lambda g: F.filter(g, lambda x, i: ~F.exists(F.slice(g, 1, i), lambda y: same(x, y))))


def structured(reply: Column) -> Column:
    """Countable facts; where the whole is broken, those of its flat objects that hold a predicate and an object."""
    of = lambda p, o, q, u: F.struct(p.alias("predicate"), o.alias("object"), quantity(q).alias("quantity"), F.coalesce(u, F.lit("")).alias("unit"))
    whole = F.transform(parsed(reply, ITEMS)["facts"], lambda x: of(x["predicate"], x["object"], x["quantity"], x["unit"]))
    field = lambda blob, name: F.regexp_extract(blob, rf'"{name}"\s*:\s*{STRING}', 1)
    number = lambda blob: F.regexp_extract(blob, r'"quantity"\s*:\s*("?-?[0-9]+(?:\.[0-9]+)?"?|null)', 1)
    saved = F.filter(F.transform(F.regexp_extract_all(reply, F.lit(OBJECT), F.lit(0)), lambda b: of(field(b, "predicate"), field(b, "object"), number(b), field(b, "unit"))),
                     lambda x: (x["predicate"] != "") & (x["object"] != ""))
    return F.coalesce(whole, saved)


def yes_no(reply: Column, fallback: bool = False) -> Column:
    """yes or no as a word; both or neither give the fallback."""
    yes, no = reply.rlike(r"(?i)\byes\b"), reply.rlike(r"(?i)\bno\b")
    return F.when(reply.isNull() | (yes == no), F.lit(fallback)).otherwise(yes)


def verdict(reply: Column) -> Column:
    """(supported, confidence); null if the reply does not say."""
    v = parsed(reply, VERDICT)
    return F.when(v["supported"].isNotNull(), F.struct(v["supported"].alias("supported"), clamp01(F.coalesce(v["confidence"].try_cast("double"), F.lit(0.0))).alias("confidence")))


def intent(reply: Column) -> Column:
    """The first word, if it is an intent."""
    word = F.element_at(F.split(F.btrim(F.lower(strip(reply)), F.lit(".,!?\"'`")), r"\s+"), 1)
    return F.when(word.isin(*INTENTS), word)
