"""Queries of answers: cleaned, held against the shape of their question, and against what their session's turns said."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.operators import answers as an
from tessera.plans.catalog import query, sql_text
from tessera.plans.rules import STRIP
from tessera.sources.dialogues import ANSWERED_SQL, TURNS_SQL, answered, dialogues


def _hit(pattern: str, column: str = "answer") -> str:
    return f"regexp_matches({column}, '{sql_text(pattern)}')"


def _words(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '[^ \t\n\r\f]+'))"


def _case(*rules) -> str:
    return "case " + " ".join(f"when {test} then '{label}'" for test, label in rules) + " end"


FIELD = "case when regexp_matches(x, '(?s)^\\{.*\\}$') then json_extract_string(x, '$.final_answer') end"
CLEAN = rf"""an as ({ANSWERED_SQL}), c1 as (select answer_id, session, question_type, {STRIP.format("coalesce(reply, '')")} as x from an), c2 as (select * replace ({STRIP.format(f'coalesce({FIELD}, x)')} as x) from c1),
 c3 as (select * replace (case when regexp_extract(x, '{fx.SUB_ANSWER}', 1) <> '' then regexp_extract(x, '{fx.SUB_ANSWER}', 1) else coalesce(nullif({STRIP.format(f"regexp_replace(x, '{fx.MATCHING_FACTS}', '" + chr(92) + "1')")}, ''), x) end as x) from c2),
 c4 as (select *, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: y <> '') as ls from c3), c5 as (select *, list_filter(ls, lambda y: not regexp_matches(y || ' ', '^[-•*]\s+')) as pl from c4),
 c6 as (select answer_id, session, question_type, case when len(pl) > 0 and len(pl) < len(ls) then pl[-1] else x end as x from c5),
 cl as (select answer_id, session, question_type, case when length(x) <= 60 and regexp_replace(x, '\s*\.\z', '') <> '' then regexp_replace(x, '\s*\.\z', '') else x end as answer from c6)"""
NORM = "trim(regexp_replace(regexp_replace(lower(answer), '[''’ʼ`]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
TAIL = f"regexp_replace(regexp_replace(answer, '{sql_text(fx.INTRO)}', ''), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
SCAFFOLD = f"({NORM} = '' or regexp_matches({NORM}, '^(?:{fx.SCAFFOLD_ALONE})$') or regexp_matches({NORM}, '^(?:{fx.SCAFFOLD})(?: .{{1,2}})?$') or {_hit(fx.ROLE_PREFIX)} or {_hit(fx.INTRO)} and {_words(TAIL)} <= {an.INTRO_TAIL})"
PROSE = f"({_hit(fx.ANALYSIS)} or {_words('answer')} > {an.LONG_WORDS})"
REFUSAL = f"(answer = '' or {_hit(fx.REFUSAL)})"
SHAPE = _case(
    ("answer = ''", "empty_answer"), (SCAFFOLD, "answer_is_scaffold"), (PROSE, "answer_is_analysis_prose"), (REFUSAL, "answer_is_idk"), (f"question_type = 'count' and not {_hit(fx.NUMBER_SHAPE, 'lower(answer)')}", "count_missing_number"),
    (f"question_type = 'duration' and not ({_hit(fx.NUMBER_SHAPE, 'lower(answer)')} and {_hit(fx.UNIT_SHAPE, 'lower(answer)')})", "duration_missing_unit_or_number"),
    (f"question_type = 'date_time' and not {_hit(fx.DATE_SHAPE, 'lower(answer)')}", "datetime_missing_date_phrase"),
    (f"question_type = 'location' and ({_hit(fx.EVENT_START)} or not ({_hit(fx.NAME_SHAPE)} or {_hit(fx.PLACE_WORDS, 'lower(answer)')}))", "location_not_place_shaped"),
    (f"question_type in ('person', 'entity_name') and not ({_hit(fx.NAME_SHAPE)} and {_words('answer')} <= 12)", "entity_or_person_not_named"), (f"question_type = 'preference' and {_hit(fx.ADVICE_START, 'lower(answer)')}", "preference_is_generic_advice"))


def _cleaned(spark, d):
    return an.with_cleaned(answered(spark, d), "reply", "answer").select("answer_id", "session", "question_type", "answer")


@query(f"with {CLEAN} select answer_id, answer, {SHAPE} as fault from cl")
def answer_shapes(spark, d):
    return _cleaned(spark, d).select("answer_id", "answer", an.shape_fault(F.col("answer"), F.col("question_type")).alias("fault"))


def _single(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '\s+', ' ', 'g'))"


def _support(column: str) -> str:
    stop = "['" + "', '".join(fx.QUESTION_STOP_WORDS) + "']"
    return f"list_filter(list_distinct(regexp_extract_all({column}, '[a-z0-9''\\-]+')), lambda w: length(w) > 1 and not list_contains({stop}, w))"


LADDER = _case(
    ("answer = ''", "empty_answer"), (f"{REFUSAL} and carried is null", "answer_is_idk"), (REFUSAL, "answer_is_idk_with_claims"), (SCAFFOLD, "answer_is_scaffold"),
    (f"{_hit(fx.BOLD_LINE, STRIP.format('answer'))} or {_hit(fx.LABEL_LINE, STRIP.format('answer'))}", "answer_is_heading"), (_hit(fx.REQUEST, STRIP.format("answer")), "answer_is_user_request"),
    (_hit(fx.TIMESTAMP_JUNK), "answer_is_timestamp_junk"), (PROSE, "answer_is_analysis_prose"), ("carried is null", "no_supporting_claims"), ("not carried", "unsupported_by_claim"))


@query(f"""with {CLEAN}, a as (select *, {_single('answer')} as av from cl), aa as (select *, {_support('av')} as aw from a), c as (select session, {_single('text')} as cv from ({TURNS_SQL}) where text is not null), cc as (select *, {_support('cv')} as cw from c),
 s as (select answer_id, bool_or(contains(cv, av) or len(list_intersect(aw, cw)) > 0 and len(list_intersect(aw, cw)) >= len(aw) // 2) as carried from aa join cc using (session) group by answer_id)
 select cl.answer_id, {LADDER} as fault from cl left join s on s.answer_id = cl.answer_id""")
def answer_support(spark, d):
    claims = dialogues(spark, d).select("session", F.col("text").alias("claim"))
    return an.claim_faults(_cleaned(spark, d), claims).select("answer_id", F.col("claim_fault").alias("fault"))
