"""What a question asks for, and whether its parts still ask for it. Column expressions over rows of questions: no shuffle.

Empty and null questions have no relation, open no gate, and are of the generic type. A decomposition whose every part
drifts is replaced by the question itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import text as tx

MAX_PARTS = 4


def parsed(question: Column) -> list[Column]:
    """(relation, shape, constraints): the first rule that matches, and the slots that the question fills (a map)."""
    relation = tx.first_label(question, [(r, p) for r, _, p in fx.INTENTS], None)
    shape = tx.first_label(question, [(s, p) for _, s, p in fx.INTENTS], None)

    def slot(of: str, name: str, pattern: str, group: int) -> Column:
        value = F.lower(F.trim(F.regexp_extract(question, pattern, group)))
        value = F.regexp_replace(value, "s+$", "") if name == "item" else value
        return F.when((relation == of) & (value != ""), F.struct(F.lit(name).alias("key"), value.alias("value")))

    filled = F.filter(F.array(*[slot(*s) for s in fx.SLOTS]), lambda x: x.isNotNull())
    return [relation.alias("relation"), shape.alias("shape"), F.map_from_entries(filled).alias("constraints")]


def gates(question: Column) -> list[Column]:
    low = F.coalesce(F.lower(question), F.lit(""))

    def opened(phrases: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | F.contains(low, F.lit(p))
        return found

    return [opened(phrases).alias(name) for name, phrases in fx.GATES.items()]


def parts(reply: Column, question: Column) -> Column:
    """The first ``MAX_PARTS`` different lines of a decomposer's reply, without numbers and bullets. The question itself, if
    there are none, or if it asks for one fact of the user's own and yet was cut up."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, fx.BULLET, "")))
    some = tx.let(F.filter(lines, lambda x: x != ""), lambda whole: F.slice(F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, 1, i), lambda y: F.lower(y) == F.lower(x))), 1, MAX_PARTS))
    one = F.lit(True)
    for p in fx.ONE_FACT:
        one = one & question.rlike(p)
    for p in fx.NOT_ONE_FACT:
        one = one & ~question.rlike(p)
    return tx.let(some, lambda s: F.when((F.size(s) == 0) | ((F.size(s) > 1) & one), F.array(question)).otherwise(s))


def words(text: Column) -> Column:
    """Distinct words that say what a question is about."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'\-]+|\d+"), F.lit(0))
    return F.filter(F.array_except(every, F.array(*[F.lit(w) for w in fx.QUESTION_STOP_WORDS])), lambda w: F.length(w) > 1)


def relations(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(rf"\b(?:{'|'.join(w)})\b"), F.lit(r)) for r, w in sorted(fx.RELATION_WORDS.items())]), lambda r: r.isNotNull())


def scopes(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(fx.SCOPE), F.lit(0))))


def facets(text: Column) -> Column:
    """What two questions are compared by."""
    return F.struct(
        tx.first_label(text, fx.QUESTION_TYPES, "generic_fact").alias("type"), relations(text).alias("relations"), words(text).alias("words"), scopes(text).alias("scopes"))


def drift(a: Column, b: Column) -> Column:
    """Why a part with facets ``b`` no longer asks what the question with facets ``a`` does; null if it does."""
    none = lambda x: F.size(x) == 0
    apart = lambda x, y: ~F.arrays_overlap(x, y)
    anchors = F.array_except(a["words"], F.array(*[F.lit(w) for w in fx.NO_ANCHORS]))
    narrow = F.exists(b["scopes"], lambda s: s.rlike(r"^\d{4}$|before|after|since"))
    return (
        F.when((a["type"] != b["type"]) & ~a["type"].isin(*fx.COMPOSED), "answer_type_changed")
        .when(~none(a["relations"]) & ~none(b["relations"]) & apart(a["relations"], b["relations"]), "relation_changed")
        .when(~none(a["words"]) & apart(a["words"], b["words"]), "object_dropped")
        .when(~none(anchors) & apart(anchors, b["words"]), "object_anchor_dropped")
        .when(~none(a["scopes"]) & none(b["scopes"]), "temporal_dropped")
        .when(~none(a["scopes"]) & apart(a["scopes"], b["scopes"]), "temporal_changed")
        .when(none(a["scopes"]) & narrow, "temporal_added_specific")
        .when(apart(a["words"], b["words"]) & apart(a["relations"], b["relations"]), "different_fact"))


def guarded(questions: DataFrame, asked: str = "question", cut: str = "parts") -> DataFrame:
    """The rows of ``questions`` once for each part: pos, part, reason (null: kept), and fallback (all drifted, so that the
    question itself is asked). Blank parts are no parts."""
    real = F.filter(F.transform(F.col(cut), lambda x: F.trim(x)), lambda x: x != "")
    same = lambda p: F.lower(p) == F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    seen = F.transform(real, lambda p: F.struct(p.alias("part"), facets(p).alias("f")))  # facets once a part, before they are compared
    judged = F.transform("_p", lambda x, i: F.struct(i.cast("long").alias("pos"), x["part"].alias("part"), F.when(~same(x["part"]), drift(F.col("_a"), x["f"])).alias("reason")))
    rows = questions.withColumns({"_a": facets(F.coalesce(asked, F.lit(""))), "_p": seen}).withColumn("_j", judged)
    own = [F.col(f"`{c}`") for c in questions.columns if c != cut]
    # an inner generator would be given a filter that computes all of _j once more
    return rows.select(*own, F.expr("not exists(_j, x -> x.reason is null)").alias("fallback"), F.inline_outer("_j")).where("pos is not null")
