"""Answers of models: what is left after their scaffold, whether it has the shape that a question asks for, and whether what
was said supports it. Checks are column expressions in order; the first that fails is the reason, null is a pass.

A null answer is an empty one. Support meets an answer with the claims of its own session only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import text as tx

ECHO, ENOUGH_WORDS, LONG_WORDS, INTRO_TAIL = 0.7, 2, 25, 3


def normalised(text: Column) -> Column:
    """Lower case, without apostrophes, other signs as blanks, blanks single."""
    bare = F.regexp_replace(F.lower(text), "['’ʼ`]", "")
    return F.btrim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def is_scaffold(text: Column) -> Column:
    norm = normalised(text)
    tail = F.regexp_replace(F.regexp_replace(text, fx.INTRO, ""), r"[^\p{L}\p{N}_\s]", "")
    intro = text.rlike(fx.INTRO) & (tx.word_count(tail) <= INTRO_TAIL)
    return (norm == "") | norm.rlike(rf"^(?:{fx.SCAFFOLD_ALONE})$") | norm.rlike(rf"^(?:{fx.SCAFFOLD})(?: .{{1,2}})?$") | text.rlike(fx.ROLE_PREFIX) | intro


def is_refusal(text: Column) -> Column:
    return (text == "") | text.rlike(fx.REFUSAL)


def is_prose(text: Column) -> Column:
    return text.rlike(fx.ANALYSIS) | (tx.word_count(text) > LONG_WORDS)


def is_echo(answer: Column, question: Column) -> Column:
    """The question again, whole or in most of its words."""
    a, q = normalised(answer), normalised(question)
    stop = F.array(*[F.lit(w) for w in fx.ECHO_STOP_WORDS])
    aw, qw = F.array_except(F.split(a, " "), stop), F.array_except(F.split(q, " "), stop)
    most = (F.size(aw) > ENOUGH_WORDS) & (F.size(F.array_intersect(aw, qw)) >= ECHO * F.size(aw))
    return F.coalesce((a != "") & (q != "") & (F.contains(q, a) | F.contains(a, q) | most), F.lit(False))


def _field(text: Column) -> Column:
    return tx.strip(F.coalesce(F.when(text.rlike(r"(?s)^\{.*\}$"), F.get_json_object(text, "$.final_answer")), text))


def _after_label(text: Column) -> Column:
    body = F.regexp_extract(text, fx.SUB_ANSWER, 1)
    rest = tx.strip(F.regexp_replace(text, fx.MATCHING_FACTS, "$1"))
    return F.when(body != "", body).when(rest != "", rest).otherwise(text)


def _last_plain(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), tx.strip), lambda x: x != "")
    plain = F.filter(lines, lambda x: ~F.concat(x, F.lit(" ")).rlike(r"^[-•*]\s+"))
    return F.when((F.size(plain) > 0) & (F.size(plain) < F.size(lines)), F.element_at(plain, -1)).otherwise(text)


def _without_period(text: Column) -> Column:
    short = F.regexp_replace(text, r"\s*\.\z", "")
    return F.when((F.length(text) <= 60) & (short != ""), short).otherwise(text)


CLEANING = (lambda reply: tx.strip(F.coalesce(reply, F.lit(""))), _field, _after_label, _last_plain, _without_period)


def cleaned(reply: Column) -> Column:
    """The answer in a reply: a field of JSON, what follows the last label, or the last line that is no evidence."""
    return reduce(lambda text, step: step(text), CLEANING, reply)


def with_cleaned(rows: DataFrame, reply: str, name: str) -> DataFrame:
    """``rows`` with ``cleaned`` as a column, a step at a time: each step reads the one before several times, so that one
    expression of all of them would take every step hundreds of times."""
    return reduce(lambda df, step: df.withColumn(name, step(F.col(name))), CLEANING, rows.withColumn(name, F.col(reply)))


def shape_fault(answer: Column, question_type: Column) -> Column:
    low = F.lower(answer)
    number, unit = low.rlike(fx.NUMBER_SHAPE), low.rlike(fx.UNIT_SHAPE)
    place = ~answer.rlike(fx.EVENT_START) & (answer.rlike(fx.NAME_SHAPE) | low.rlike(fx.PLACE_WORDS))
    name = answer.rlike(fx.NAME_SHAPE) & (tx.word_count(answer) <= 12)
    return (
        F.when(answer == "", "empty_answer").when(is_scaffold(answer), "answer_is_scaffold").when(is_prose(answer), "answer_is_analysis_prose").when(is_refusal(answer), "answer_is_idk")
        .when((question_type == "count") & ~number, "count_missing_number").when((question_type == "duration") & ~(number & unit), "duration_missing_unit_or_number")
        .when((question_type == "date_time") & ~low.rlike(fx.DATE_SHAPE), "datetime_missing_date_phrase").when((question_type == "location") & ~place, "location_not_place_shaped")
        .when(question_type.isin("person", "entity_name") & ~name, "entity_or_person_not_named").when((question_type == "preference") & low.rlike(fx.ADVICE_START), "preference_is_generic_advice"))


def single(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def support_words(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(r"[a-z0-9'\-]+"), F.lit(0))
    return F.filter(F.array_except(every, F.array(*[F.lit(w) for w in fx.QUESTION_STOP_WORDS])), lambda w: F.length(w) > 1)


def claim_faults(answers: DataFrame, claims: DataFrame, key: str = "answer_id") -> DataFrame:
    """The answers (key, session, answer) with ``claim_fault``: why the claims (session, claim) of the session do not carry
    an answer. It stands in a claim, or half of its words do. A key names one answer. What an answer says of itself is looked
    at once and first: only answers that pass meet claims word by word, and refusals meet them to be counted."""
    x = F.col("answer")
    bare = tx.strip(x)
    alone = (
        F.when(x == "", "empty_answer").when(is_refusal(x), "answer_is_idk").when(is_scaffold(x), "answer_is_scaffold")
        .when(bare.rlike(fx.BOLD_LINE) | bare.rlike(fx.LABEL_LINE), "answer_is_heading").when(bare.rlike(fx.REQUEST), "answer_is_user_request")
        .when(x.rlike(fx.TIMESTAMP_JUNK), "answer_is_timestamp_junk").when(is_prose(x), "answer_is_analysis_prose"))
    a = answers.withColumn("_alone", alone).withColumn("_a", F.when(F.col("_alone").isNull(), single(x))).withColumn("_aw", support_words(F.col("_a")))
    c = claims.where("claim is not null").select(F.col("session").alias("_s"), single(F.col("claim")).alias("_c")).withColumn("_cw", support_words(F.col("_c")))
    meets = (F.col("session") == F.col("_s")) & (F.col("_alone").isNull() | (F.col("_alone") == "answer_is_idk"))
    enough = F.size(F.array_intersect("_aw", "_cw")) >= F.greatest(F.lit(1), F.floor(F.size("_aw") / 2))
    carried = F.when(F.col("_s").isNotNull(), F.when(F.col("_alone").isNotNull(), True).otherwise(F.contains("_c", "_a") | enough))
    # the rows of an answer lie together after the join on its session
    seen = a.join(c.hint("merge"), meets, "left").groupBy(*[F.col(f"`{n}`") for n in answers.columns], "_alone").agg(F.bool_or(carried).alias("_carried"))
    held = F.col("_carried")
    fault = (
        F.when((F.col("_alone") == "answer_is_idk") & held.isNotNull(), "answer_is_idk_with_claims").when(F.col("_alone").isNotNull(), F.col("_alone"))
        .when(held.isNull(), "no_supporting_claims").when(~held, "unsupported_by_claim"))
    return seen.withColumn("claim_fault", fault).drop("_carried", "_alone")
