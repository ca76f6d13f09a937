"""Queries of grounded candidates: extraction, ranking, verification and what is read from them, over dialogues made of order
rows and over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import grounding as gr
from tessera.plans.catalog import query, sql_text
from tessera.sources.dialogues import ASK_SQL, TURNS_SQL, dialogues, questions
from tessera.sources.tables import turns


def _in(words) -> str:
    return "(" + ", ".join(f"'{sql_text(w)}'" for w in words) + ")"


def _tried(i: int, x: gr.Extractor) -> str:
    p = sql_text(x.pattern)
    all_of = lambda g: f"regexp_extract_all(clause, '{p}', {g})"
    return (f"select session, seq, role, clause_no, clause, {i} as rule, unnest(range(0, len({all_of(0)}))) as n, '{x.type}' as type, '{x.relation}' as relation, trim(unnest({all_of(x.value)})) as value, "
            f"{f'lower(unnest({all_of(x.extra)}))' if x.extra else chr(39) * 2} as extra, trim(unnest({all_of(0)})) as span, {f'unnest({all_of(1)})' if x.type == 'count' else chr(39) * 2} as frame, {x.confidence}::double as c0 from cl")


def _map(d: dict) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


CANDIDATES = rf"""b as (select session, seq, role, regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '{gr.TITLE}', '\1 ', 'g') as body from dt),
 c0 as (select session, seq, role, string_split(regexp_replace(regexp_replace(body, '{gr.ENDS}', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) as x from b),
 cl as (select * from (select session, seq, role, unnest(range(0, len(x))) as clause_no, unnest(x) as clause from c0) where clause <> ''),
 f as ({' union all '.join(_tried(i, x) for i, x in enumerate(gr.EXTRACTORS))}),
 g as (select *, case when type = 'count' and frame <> '' then 0.8 else c0 end as cf, split_part(clause, span, 1) as h0, regexp_matches(clause, '{gr.HYPOTHETICAL}') as if_only, regexp_matches(clause, '{gr.COMPLETED}') as completed from f),
 h as (select *, case when type = 'duration' then regexp_replace(h0, '{gr.SPENT}.*$', '') when type = 'location' then regexp_replace(h0, '{gr.COMPLETED}.*$', '') else '' end as head from g),
 s1 as (select *, list_reverse(regexp_extract_all(head, '{sql_text(gr.WORD)}')) as back, regexp_extract_all(head, '{sql_text(gr.NOUN_PHRASE)}', 1) as phrases from h),
 s2 as (select *, coalesce(list_position(list_transform(back, lambda w: lower(w) not in {_in(gr.NOISE)}), true), 0) as st from s1),
 s3 as (select *, case when st > 0 then back[st:] else []::varchar[] end as rest from s2),
 s4 as (select *, coalesce(list_position(list_transform(rest, lambda w: lower(w) in {_in(gr.NOISE + gr.VERBS)}), true), 0) as sp from s3),
 s5 as (select *, rest[1:least(4, case when sp > 0 then sp - 1 else len(rest) end)] as kept from s4),
 s6 as (select *, array_to_string(list_reverse(kept), ' ') as said, len(list_filter(kept, lambda w: lower(w) not in {_in(gr.PRONOUNS)})) = 0 as hollow from s5),
 s7 as (select *, case when type in ('duration', 'location') then case when hollow then coalesce(phrases[-1], said) else said end
   when type in ('value', 'amount') then regexp_replace(regexp_replace(extra, '^(?:the|an?|my|our|their)\s+', ''), '\s+(?:in|on|at|from|to|with|by|for|of|during|since|until)$', '') else '' end as subject,
   case when type = 'duration' and if_only then 'hypothetical_duration' when type = 'location' and if_only then 'looking_at' when type = 'location' and completed and cf < 0.9 then 'got_at' else relation end as rel,
   case when type = 'duration' and if_only then 0.4 when type = 'location' and if_only then case when cf = 0.9 then 0.4 else 0.3 end else cf end as confidence,
   regexp_replace(extra, 's$', '') as single, split_part(regexp_replace(lower(value), '\s+', ' ', 'g'), ' ', 1) as w1 from s6),
 s8 as (select * exclude (value, relation), rel as relation, case when type in ('count', 'duration') then
   case when regexp_matches(lower(value), 'half$') then case when regexp_matches(w1, '^\d') then w1 else {_map(gr.NUMBER_WORDS)}[w1] end || '.5' else case when regexp_matches(w1, '^\d') then w1 else {_map(gr.NUMBER_WORDS)}[w1] end end else value end as value,
   case when type = 'count' then extra when type = 'duration' then coalesce({_map(gr.LONG_UNITS)}[single], single) when type = 'preference' and regexp_matches(span, '{sql_text(gr.DISLIKE)}') then 'dislike' when type = 'preference' then 'like' else '' end as unit from s7),
 s9 as (select *, [lower(value), case when type = 'count' then single when type = 'duration' then unit || lower(subject) else '' end, case when type in ('old_fact', 'new_fact') then clause_no || ',' || n else '' end] as same
   from s8 where value is not null and value <> '' and (type <> 'count' or length(single) >= 4 and single not in {_in(gr.NO_UNITS)})),
 cand as (select session, seq, role, type, clause_no, relation, value, unit, span, subject, clause, confidence from s9 qualify row_number() over (partition by session, seq, role, type, same order by clause_no, rule, n) = 1)"""
SPOKEN = f"dt as (select conv_id as session, turn as seq, role, text from conversations union all select -1 - session, seq, role, text from ({TURNS_SQL}))"
KEY = ["session", "seq", "role"]
OUT = ["session", "seq", "role", "type", "clause_no", "relation", "value", "unit", "span", "subject", "confidence"]


@query(f"with {SPOKEN}, {CANDIDATES} select session, seq, role, type, clause_no::int as clause_no, relation, value, unit, span, subject, confidence from cand")
def grounded_candidates(spark, d):
    """Typed candidates of all turns of conversations and dialogues (whose sessions are below zero here)."""
    made = dialogues(spark, d).withColumn("session", -1 - F.col("session"))
    return gr.candidates(turns(spark, d).select(*KEY, "text").unionByName(made), KEY).select(*OUT)


WORDS_OF = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z''-]+'), lambda z: z not in {_in(gr.QUESTION_STOPS)}))"
KIND_TYPE = "case " + " ".join(f"when kind = '{k}' then '{t}'" for k, t in gr.TYPE_OF_KIND.items()) + " end"
ANCHORS = lambda table, add: " + ".join(f"case when contains(lower(question), '{k}') and contains(lower(clause || ' ' || subject), '{a}') then {add} else 0 end" for k, words in table.items() for a in words)
RANKED = rf"""dt as ({TURNS_SQL}), {CANDIDATES}, qs as ({ASK_SQL}), q0 as (select *, {WORDS_OF('question')} as q from qs),
 j as (select query_id, kind, question, q, cand.*, {WORDS_OF('subject')} as sw, {WORDS_OF('span')} as pw, {WORDS_OF('value')} as vw, list_filter([{', '.join(f"case when list_contains(q, '{w}') then '{r}' end" for w, r in gr.RELATION_OF_WORD.items())}], lambda z: z is not null) as implied,
   regexp_matches(lower(question), '\b(?:i|my|me|mine)\b') as personal, {KIND_TYPE} as wanted from q0 join cand using (session)),
 sc as (select *, len(list_intersect(q, sw)) as hits, round(2.0::double * len(list_intersect(q, sw)) + len(list_intersect(q, pw)) + 0.5::double * len(list_intersect(q, vw)) + 0.2::double * confidence
   + case when relation in {_in(gr.FACTUAL)} then 0.5 when relation in {_in(gr.HYPOTHETICALS)} then -0.5 else 0 end + case when len(implied) = 0 then 0 when list_contains(implied, relation) then 0.7 else -0.3 end
   + case when type = wanted then 0.2 else 0 end + {ANCHORS(gr.NEAR, 0.6)} + {ANCHORS(gr.FAR, -0.5)} + case when personal and role = 'user' then 0.4 when personal and role = 'assistant' then -0.2 else 0 end, 6) as score from j),
 rk as (select *, row_number() over (partition by query_id order by score desc, clause_no, type, value, seq) as rank from sc where score > 0)"""


@query(f"with {RANKED} select query_id, rank::int as rank, seq, type, value, subject, score from rk")
def candidate_ranking(spark, d):
    return _ranked(spark, d).select("query_id", "rank", "seq", "type", "value", "subject", "score")


def _ranked(spark, d):
    asked = questions(spark, d)
    return gr.ranked(gr.candidates(gr.asked_texts(dialogues(spark, d), asked), KEY), asked)


VERIFIED = rf"""{RANKED}, a0 as (select *, relation in {_in(gr.FACTUAL)} as fact, {WORDS_OF("clause || ' ' || span")} as ground, max(case when len(sw) > 0 then hits end) over (partition by query_id, type) as most from rk),
 vf as (select *, case when len(q) > 0 and len(list_intersect(q, ground)) = 0 then 'span_no_overlap' when subject <> '' and len(q) > 0 and hits = 0 then 'subject_mismatch'
   when (wanted is not null and type <> wanted) or {' or '.join(rf"(regexp_matches(lower(question), '\b{w}\b') and type not in {_in(t)})" for w, t in gr.TYPES_OF_WORD.items())}
     or {' or '.join(rf"(regexp_matches(lower(question), '\b{w}\b') and relation in ('paid', 'is_worth') and relation <> '{r}')" for w, r in gr.RELATION_OF_WORD.items() if r in ('paid', 'is_worth'))} then 'answer_type_mismatch'
   when not regexp_matches(question, '{gr.IF_ONLY}') and relation in {_in(gr.HYPOTHETICALS)} and (regexp_matches(question, '{gr.DONE}') or confidence < 0.35) then 'hypothetical_relation'
   when len(sw) > 0 and len(q) > 0 and most > hits then 'weaker_question_overlap'
   when len(sw) > 0 and len(q) > 0 and exists (select 1 from a0 o where o.query_id = a0.query_id and o.type = a0.type and o.hits = a0.hits and o.fact and not a0.fact and len(list_intersect(o.sw, a0.sw)) > 0) then 'weaker_relation'
   when len(sw) > 0 and len(q) > 0 and exists (select 1 from a0 o where o.query_id = a0.query_id and o.type = a0.type and o.hits = a0.hits and o.fact = a0.fact and o.confidence > a0.confidence + 0.15 and len(list_intersect(o.sw, a0.sw)) > 0) then 'weaker_confidence'
   else 'ok' end as reason from a0)"""


@query(f"with {VERIFIED} select query_id, rank::int as rank, type, value, reason from vf")
def candidate_verification(spark, d):
    return gr.verified(_ranked(spark, d)).select("query_id", "rank", "type", "value", "reason")


MARKED = rf"(regexp_matches(clause, '(?i)\b(?:{sql_text(gr.NEW)})\b')::int - regexp_matches(clause, '(?i)\b(?:{gr.OLD})\b')::int)"
FIRST_SEEN = lambda unit, n: f"array_to_string(coalesce((select list(v order by r) from (select lower(value) as v, min(rank) as r from vf p where p.query_id = hd.query_id and rank <= {gr.TOP_FACTS} and type = 'preference' and unit = '{unit}' and role = 'user' group by 1 order by r limit {n})), []), ', ')"


@query(rf"""with {VERIFIED}, hd as (select query_id, kind, arg_max(value, (confidence, length(unit), -rank)) filter (type = 'count' and confidence >= {gr.MIN_COUNT_CONFIDENCE} and length(regexp_replace(lower(unit), 's$', '')) >= 3 and contains(lower(question), regexp_replace(lower(unit), 's$', ''))) as count_a,
   arg_max(value, (confidence, -rank)) filter (rank <= {gr.TOP_CLAIMS} and type = 'date') as date_a, arg_max(value, ({MARKED}, seq, -rank)) filter (rank <= {gr.TOP_CLAIMS}) as update_a,
   coalesce(arg_min(value, rank) filter (rank <= {gr.TOP_FACTS} and reason = 'ok'), max(clause) filter (rank = 1 and len(list_filter(string_split_regex(clause, '\s+'), lambda z: z <> '')) <= {gr.LONGEST_CLAIM})) as fact_a from vf group by 1, 2)
 select query_id, kind, case kind when 'count' then count_a when 'date' then date_a when 'update' then update_a when 'preference' then 'likes ' || {FIRST_SEEN('like', gr.LIKES_SHOWN)} || '; avoids ' || {FIRST_SEEN('dislike', gr.AVOIDS_SHOWN)} else fact_a end as answer from hd""")
def reasoning_heads(spark, d):
    return gr.answers(gr.verified(_ranked(spark, d)))


@query(rf"""with dt as ({TURNS_SQL}), qs as ({ASK_SQL}), n as (select *, sum((role = 'assistant')::int) over (partition by session order by seq) as replies from dt), m as (select query_id, n.session, seq, replies, len(list_intersect({WORDS_OF('question')}, {WORDS_OF('text')})) as shared from n join qs using (session) where role = 'user'),
 a as (select * from m where shared > 0 qualify row_number() over (partition by query_id order by shared desc, seq) <= {gr.ANCHORS}), x as (select distinct query_id, session, unnest([replies + 1, replies + 2]) as replies from a)
 select query_id, n.seq, text from x join n using (session, replies) where role = 'assistant'""")
def assistant_head(spark, d):
    return gr.assistant_replies(dialogues(spark, d), questions(spark, d))
