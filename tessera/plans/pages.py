"""Queries of the pages of what customers state, kept in two refreshes, and of turns ranked for a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.operators import wiki
from tessera.plans.catalog import query, sql_text
from tessera.sources.dialogues import ASK_SQL, STATED_SQL, TURNS_SQL, dialogues, questions, statements
from tessera.sources.shared import shared_folder


def _first(key: str) -> str:
    patterns = next(p for k, _, p in fx.WIKI_FACTS if k == key)
    return "trim(coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{sql_text(p)}', 1), '')" for p in patterns) + "))"


SAID = {
    "spotify_playlist": f"""'The user created a Spotify playlist called "' || trim({_first('spotify_playlist')}, '"') || '".'""", "commute_duration": f"'The user''s daily commute takes ' || {_first('commute_duration')} || '.'",
    "target_coupon_redeemed": f"case when lower(hint) = 'target' then 'The user redeemed a $' || regexp_extract(text, '{sql_text(fx.COUPON_AMOUNT)}', 1) || ' ' || regexp_replace({_first('target_coupon_redeemed')}, '{sql_text(fx.COUPON_TIME)}', '') || ' coupon at Target.' end",
    "degree": f"'The user graduated with a degree in ' || {_first('degree')} || '.'", "theater_play": f"""case when contains(lower(text), 'play') then 'The user attended the play "' || trim({_first('theater_play')}, '"') || '" at the local community theater.' end""",
}
STATED = f"st as ({STATED_SQL}), fa as (select * from (" + " union all ".join(f"select owner, '{topic}' as topic, '{key}' as fact_key, {SAID[key]} as text, as_of, seq from st where role = 'user'" for key, topic, _ in fx.WIKI_FACTS) + ") where text is not null)"


@query(f"with {STATED} select * from fa")
def content_facts(spark, d):
    return wiki.facts(statements(spark, d))


@query(f"with st as ({STATED_SQL}) select seq, case " + " ".join(f"when regexp_matches(lower(text), '{terms}') then '{topic}'" for topic, terms in fx.TOPIC_TERMS) + " else 'misc' end as topic from st")
def content_topics(spark, d):
    return statements(spark, d).select("seq", wiki.routed(F.col("text")).alias("topic"))


@query(f"""with {STATED}, k as (select *, row_number() over (partition by owner, topic, fact_key order by coalesce(as_of, date '0001-01-01') desc, seq) = 1 as newest from fa)
 select owner, topic, case when newest then 'Current Facts' else 'Older Facts' end as section, fact_key, as_of, seq, case when as_of is not null then '- As of ' || strftime(as_of, '%Y-%m-%d') || ', ' || lower(text[1]) || text[2:] else '- ' || text end as line from k""")
def content_pages(spark, d):
    """Two refreshes: facts of odd customers and early dates, then the others; pages that the second does not touch stay."""
    root, stated = shared_folder(spark), wiki.facts(statements(spark, d))
    early = F.coalesce(F.col("as_of") < "1999-01-01", F.lit(False)) | (F.pmod("owner", F.lit(2)) == 1)
    wiki.refresh(stated.where(early), root)
    wiki.refresh(stated.where(~early), root)
    return wiki.pages(spark, root)


def _points() -> str:
    one = lambda q, t, u, p: f"case when regexp_matches(lower(question), '{q}') and regexp_matches(lower(text), '{t}')" + (f" and not regexp_matches(lower(text), '{u}')" if u else "") + f" then {p}::double else 0 end"
    return " + ".join(one(*b) for b in fx.LEXICAL_BOOSTS)


def _words(column: str) -> str:
    stop = "['" + "', '".join(fx.LEXICAL_STOP_WORDS) + "']"
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z0-9]+')), lambda x: length(x) > 2 and not list_contains({stop}, x))"


K = 3


@query(f"""with q as (select *, {_words('question')} as qw from ({ASK_SQL})), t as (select *, {_words('text')} as tw from ({TURNS_SQL})),
 s as (select query_id, seq, round({fx.LEXICAL_WEIGHT}::double * case when len(qw) > 0 then len(list_intersect(qw, tw))::double / len(qw) + {_points()} else 0 end
  + case role when 'user' then {fx.USER_POINTS}::double when 'assistant' then {fx.ASSISTANT_POINTS}::double else 0 end, 9) as score from q join t using (session))
 select *, row_number() over (partition by query_id order by score desc, seq) as place from s qualify place <= {K}""")
def lexical_turns(spark, d):
    return wiki.ranked(questions(spark, d), dialogues(spark, d), K)
