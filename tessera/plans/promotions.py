"""Queries of whole promotion runs over replies made of event rows: a first run, a second with more blocks, and a repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.operators import promotion_run as pr
from tessera.plans.catalog import FACTS, KNOWN, query, sql_text, us
from tessera.plans.memory import at
from tessera.sources.shared import shared_folder
from tessera.sources.tables import facts

SURE = ("0.5", "0.7", "0.8", "0.9", "1")
PRICE = 0.5
#: What an event says (text for both engines): a plain fact, one in other words, or one that takes an earlier one back.
SAID = """case when id % 10 = 3 then concat('That was wrong: the last ', attribute, ' of user ', cast(subject as string), ' came to ', cast(cast(floor(value / 100) as bigint) as string), ' hundred crowns')
 when id % 4 = 1 then concat('A ', attribute, ' near ', cast(cast(floor(value) as bigint) as string), ' was seen by the shop today')
 else concat('the last ', attribute, ' of user ', cast(subject as string), ' came to ', cast(cast(floor(value / 100) as bigint) as string), ' hundred crowns') end"""


def said_blocks(spark, d):
    """A block an event; a seventh of the replies is cut off."""
    sure = F.element_at(F.array(*[F.lit(s) for s in SURE]), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    whole = F.concat(F.lit('Here: {"facts": [{"text": "'), F.expr(SAID), F.lit('", "confidence": '), sure, F.lit(', "type": "'), F.col("attribute"), F.lit('"}]}'))
    return facts(spark, d).select("id", F.concat(F.lit("u"), F.col("subject").cast("string")).alias("namespace"), F.col("recorded_at").alias("at"), F.when(F.pmod("id", F.lit(7)) == 0, F.left(whole, F.lit(25))).otherwise(whole).alias("reply"))


def longer(fact, target):
    """The decider of these queries: a fact no shorter than its neighbour takes its place."""
    return F.when(F.length(fact) >= F.length(target), "UPDATE").otherwise("NOOP")


def promoted(spark, d) -> str:
    """The folder after a run over the blocks known by ``KNOWN``, a run over all of them, and a repeat that finds nothing."""
    root, blocks = shared_folder(spark), said_blocks(spark, d)
    pr.run(blocks.where(F.col("at") <= at(KNOWN)), root, longer)
    pr.run(blocks, root, longer)
    pr.run(blocks, root, longer)
    return root


WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
RUNS = rf"""{FACTS}, said as (select id, 'u' || subject as ns, attribute as type, recorded_at as tm, recorded_at <= timestamp '{KNOWN}' as early, id % 7 = 0 as broken, {SAID.replace(' as string', ' as varchar')} as text,
 (['0.5', '0.7', '0.8', '0.9', '1'])[id % 5 + 1]::double as sure from f),
 g as (select *, id || '/0' as fact, md5('n' || ns || chr(1) || lower(text)) as key, regexp_matches(text, '{sql_text(fx.RETRACTION)}') as back from said where not broken and sure >= 0.75),
 e1 as (select key as id, ns, type, text, 'ADD' as op, tm, fact from g where early and not back),
 m1 as (select id, ns, type, arg_max(text, (tm, fact)) as text, max(tm) as moved from e1 group by id, ns, type),
 newest as (select ns, type, arg_max(id, (moved, id)) as target, arg_max(text, (moved, id)) as target_text from m1 group by ns, type),
 near as (select g.*, target, target_text, case when target is not null then len(list_intersect({WORDS.format('g.text')}, {WORDS.format('target_text')}))::double / len(list_distinct(list_concat({WORDS.format('g.text')}, {WORDS.format('target_text')}))) end as sim
  from g left join newest n on g.ns = n.ns and g.type = n.type where not early),
 ruled as (select *, case when back and coalesce(sim, 0) >= 0.5 then 'DELETE' when back then 'NOOP' when sim is null or sim < 0.5 then 'ADD' when sim > 0.97 then 'NOOP' else 'UNDECIDED' end as rule from near),
 dec as (select *, case when rule <> 'UNDECIDED' then rule when length(text) >= length(target_text) then 'UPDATE' else 'NOOP' end as done from ruled),
 ev as (select * from e1 union all select key, ns, type, text, 'ADD', tm, fact from dec where done = 'ADD'
  union all select target, ns, type, text, 'PATCH', tm, fact from dec where done = 'UPDATE' union all select target, ns, type, text, 'INVALIDATE', tm, fact from dec where done = 'DELETE')"""


@query(f"""with {RUNS} select id, any_value(ns) as namespace, any_value(type) as type, arg_max(text, (tm, fact)) filter (where op in ('ADD', 'PATCH')) as text, count(*) filter (where op = 'ADD') - 1 as access_count,
 epoch_us(min(tm) filter (where op = 'ADD')) as created_at, epoch_us(max(tm) filter (where op in ('ADD', 'PATCH'))) as updated_at, epoch_us(min(tm) filter (where op = 'INVALIDATE')) as invalidated_at from ev group by id""")
def promotion_run(spark, d):
    root = promoted(spark, d)
    rows = pr.memory_rows(pr.stored(spark, root, "events", pr.committed(spark, root)))
    return rows.select("id", "namespace", "type", "text", "access_count", us("created_at"), us("updated_at"), us("invalidated_at"))


N_WORDS = r"len(regexp_extract_all({}, '[^ ]+'))"


@query(f"""with {RUNS}, o as (select 0 as run, case when back then 'NOOP' else 'ADD' end as op, 0 as tokens, false as asked from g where early
  union all select 1, done, case when rule = 'UNDECIDED' then {N_WORDS.format('text')} + {N_WORDS.format('target_text')} else 0 end, rule = 'UNDECIDED' from dec),
 s as (select case when early then 0 else 1 end as run, broken from said)
 select r.run::bigint as run, (select count(*) from s where s.run = r.run and not broken) as blocks, (select count(*) from s where s.run = r.run and broken) as quarantined,
 (select count(*) from o where o.run = r.run and op = 'ADD') as "add", (select count(*) from o where o.run = r.run and op = 'UPDATE') as "update", (select count(*) from o where o.run = r.run and op = 'DELETE') as "delete",
 (select count(*) from o where o.run = r.run and op = 'NOOP') as noop, (select coalesce(sum(tokens), 0)::bigint from o where o.run = r.run) as tokens, (select count(*) from o where o.run = r.run and asked) as asked,
 (select coalesce(sum(tokens), 0)::bigint from o where o.run = r.run) / 1000 * {PRICE}::double as cost from (values (0), (1)) as r(run)""")
def promotion_run_report(spark, d):
    return pr.reports(spark, promoted(spark, d), PRICE)
