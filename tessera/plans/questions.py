"""Queries of the intents of questions, the gates they open, and the guard of their parts, over a question for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.operators import intents
from tessera.plans.catalog import query, sql_text
from tessera.plans.rules import case
from tessera.sources.dialogues import WONDER_SQL, wonderings

ASKED = f"w as ({WONDER_SQL})"


def _hit(pattern: str, column: str) -> str:
    return f"regexp_matches({column}, '{sql_text(pattern)}')"


def _rule(field: int) -> str:
    return "case " + " ".join(f"when {_hit(i[2], 'question')} then '{i[field]}'" for i in fx.INTENTS) + " end"


def _slot(relation: str, name: str, pattern: str, group: int) -> str:
    value = f"lower(trim(regexp_extract(question, '{sql_text(pattern)}', {group})))"
    value = f"regexp_replace({value}, 's+$', '')" if name == "item" else value
    return f"case when relation = '{relation}' and {value} <> '' then '{name}=' || {value} end"


@query(f"with {ASKED}, r as (select *, {_rule(0)} as relation, {_rule(1)} as shape from w) select query_id, relation, shape, concat_ws(';', {', '.join(_slot(*s) for s in fx.SLOTS)}) as constraints from r")
def question_intents(spark, d):
    rows = wonderings(spark, d).select("query_id", *intents.parsed(F.col("question")))
    said = F.transform(F.map_entries("constraints"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("constraints", F.array_join(said, ";"))


@query(f"with {ASKED} select query_id, " + ", ".join("(" + " or ".join(f"contains(lower(question), '{p}')" for p in phrases) + f") as {name}" for name, phrases in fx.GATES.items()) + " from w")
def question_gates(spark, d):
    return wonderings(spark, d).select("query_id", *intents.gates(F.col("question")))


ONE = " and ".join([_hit(p, "question") for p in fx.ONE_FACT] + [f"not {_hit(p, 'question')}" for p in fx.NOT_ONE_FACT])
PARTS = rf"""{ASKED}, l as (select query_id, question, trim(regexp_replace(unnest(string_split(reply, chr(10))), '{fx.BULLET}', '')) as part, unnest(range(1, len(string_split(reply, chr(10))) + 1)) as n from w),
 d as (select *, row_number() over (partition by query_id order by n) as k, count(*) over (partition by query_id) as many from
  (select * from l where part <> '' qualify row_number() over (partition by query_id, lower(part) order by n) = 1)),
 cut as (select w.query_id, w.question, case when d.many is null or d.many > 1 and {ONE.replace('question', 'w.question')} then [w.question] else d.every end as parts from w
  left join (select query_id, any_value(many) as many, list(part order by k) filter (where k <= {intents.MAX_PARTS}) as every from d group by query_id) d on d.query_id = w.query_id)"""


@query(f"with {PARTS} select query_id, len(parts)::int as n, array_to_string(parts, '|') as parts from cut")
def question_parts(spark, d):
    made = intents.parts(F.col("reply"), F.col("question"))
    return wonderings(spark, d).withColumn("p", made).select("query_id", F.size("p").alias("n"), F.array_join("p", "|").alias("parts"))


STOP = "['" + "', '".join(fx.QUESTION_STOP_WORDS) + "']"
NO_ANCHOR = "['" + "', '".join(fx.NO_ANCHORS) + "']"


def _facets(column: str, letter: str) -> str:
    words = f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z][a-z''\\-]+|\\d+')), lambda x: length(x) > 1 and not list_contains({STOP}, x))"
    named = "list_filter([" + ", ".join(f"case when {_hit(chr(92) + 'b(?:' + '|'.join(w) + ')' + chr(92) + 'b', f'lower({column})')} then '{r}' end" for r, w in fx.RELATION_WORDS.items()) + "], lambda x: x is not null)"
    return f"{case(fx.QUESTION_TYPES, chr(39) + 'generic_fact' + chr(39), column)} as {letter}_type, {named} as {letter}_rel, {words} as {letter}_words, regexp_extract_all(lower({column}), '{sql_text(fx.SCOPE)}') as {letter}_scopes"


@query(rf"""with {PARTS}, s as (select query_id, question, unnest(parts) as part, unnest(range(0, len(parts))) as pos from cut), x as (select *, {_facets('question', 'a')}, {_facets('part', 'b')} from s where trim(part) <> ''),
 j as (select query_id, pos, part, case when lower(part) = lower(question) then null
  when a_type <> b_type and a_type not in ('{"', '".join(fx.COMPOSED)}') then 'answer_type_changed' when len(a_rel) > 0 and len(b_rel) > 0 and not list_has_any(a_rel, b_rel) then 'relation_changed'
  when len(a_words) > 0 and not list_has_any(a_words, b_words) then 'object_dropped'
  when len(list_filter(a_words, lambda x: not list_contains({NO_ANCHOR}, x))) > 0 and not list_has_any(list_filter(a_words, lambda x: not list_contains({NO_ANCHOR}, x)), b_words) then 'object_anchor_dropped'
  when len(a_scopes) > 0 and len(b_scopes) = 0 then 'temporal_dropped' when len(a_scopes) > 0 and not list_has_any(a_scopes, b_scopes) then 'temporal_changed'
  when len(a_scopes) = 0 and len(list_filter(b_scopes, lambda x: regexp_matches(x, '^\d{{4}}$|before|after|since'))) > 0 then 'temporal_added_specific'
  when not list_has_any(a_words, b_words) and not list_has_any(a_rel, b_rel) then 'different_fact' end as reason from x)
 select query_id, pos, part, reason, bool_and(reason is not null) over (partition by query_id) as fallback from j""")
def decomposition_guard(spark, d):
    made = intents.parts(F.col("reply"), F.col("question"))
    return intents.guarded(wonderings(spark, d).withColumn("parts", made)).select("query_id", "pos", "part", "reason", "fallback")
