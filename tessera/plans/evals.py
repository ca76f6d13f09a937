"""Queries of answers, counted facts, scripted scenarios, scores, dates, transcripts and bundles under a budget."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import scoring as sc
from tessera.functions import text as tx
from tessera.operators import bundles, evaluation, questions, summaries, synthesis, temporal, transcripts
from tessera.plans.catalog import FACTS, NOW, SF, SYNTH, TURNS, _structured, query, sql_text
from tessera.plans.literals import values
from tessera.plans.memory import NODES
from tessera.plans.rules import SENTS, TEXTS, WORDS, case, has, sentences
from tessera.sources import datasets
from tessera.sources.shared import shared_folder
from tessera.sources.tables import facts, nodes, table, turns

# ---- counted facts and questions ----
QUESTIONS = [
    (1, "How many tanks do I have?"), (2, "How many purchases did I make?"), (3, "How much did I spend on gift orders?"), (4, "How long is my commute?"),
    (5, "number of postcards I sent"), (6, "How many games have I played this year?"), (7, "What did we play?"), (8, "How many owns and played?"), (9, "How many purchases and returns?"), (10, "number of returns so far"),
]
COUNTED = f"{SF}, cf as (with {SYNTH.format('')})"
ASKS = f"qs(question_id, question) as {values(QUESTIONS)}"
STEM = "regexp_replace({}, 's$', '')"
NAMED = f"len(list_filter(regexp_extract_all(lower(predicate), '[a-z]+'), lambda z: length(z) >= 3 and len(list_filter(regexp_extract_all(lower(question), '[a-z0-9_]+'), lambda y: {STEM.format('z')} = y or {STEM.format('z')} = {STEM.format('y')})) > 0)) > 0"


def _questions(spark):
    return spark.sql(f"select * from {values(QUESTIONS)} as q(question_id, question)")


@query(f"with {COUNTED}, {ASKS}, b as (select *, {NAMED} as named from cf, qs), k as (select *, bool_or(named) over w as has_named, row_number() over (partition by question_id, subject order by members desc, predicate) as k from b window w as (partition by question_id, subject)) select question_id, subject, predicate, members from k where named or (not has_named and members >= 2 and k <= 6)")
def relevant_summaries(spark, d):
    return questions.relevant(synthesis.summarise(_structured(spark, d)), _questions(spark)).select("question_id", "subject", "predicate", "members")


@query(f"""with {COUNTED}, {ASKS}, a as (select * from cf, qs where {NAMED} and not {has(fx.SCOPED, 'question')} and ({has(fx.COUNT_INTENT, 'question')} or {has(fx.MONEY_SUM, 'question')}) qualify count(*) over (partition by question_id, subject) = 1),
 x as (select question_id, subject, case when total is not null and ({has(fx.MONEY_SUM, 'question')} or {has(fx.SUM_INTENT, 'question')}) then trim(total::varchar || ' ' || coalesce(unit, '')) when {has(fx.COUNT_INTENT, 'question')} and members >= 2 then members::varchar end as answer from a) select * from x where answer is not null""")
def route_count_answer(spark, d):
    return questions.count_answers(synthesis.summarise(_structured(spark, d)), _questions(spark))


PLURAL = "case when regexp_matches({0}, '(?i)(s|x|z|ch|sh)$') then {0} || 'es' when regexp_matches({0}, '(?i)[^aeiou]y$') then left({0}, length({0}) - 1) || 'ies' else {0} || 's' end"


@query(f"""with {COUNTED}, w as (select *, string_split(predicate, ' ') as ws from cf), h as (select *, coalesce(list_position(list_transform(ws[2:], lambda z: list_contains({list(fx.PREPOSITIONS)!r}, lower(z))), true), 0) as p from w),
 n as (select *, case when p > 0 then p else len(ws) end as i from h), x as (select *, case when members = 1 then predicate else array_to_string(list_concat(list_concat(ws[1:i - 1], [{PLURAL.format('ws[i]')}]), ws[i + 1:]), ' ') end as noun from n)
 select subject, predicate, upper(left(subject, 1)) || substr(subject, 2) || ' has ' || members || ' ' || noun || case when total is not null and coalesce(unit, '') <> '' then ' totaling ' || total || ' ' || unit else '' end || '.' as sentence from x""")
def fact_sentences(spark, d):
    s = synthesis.summarise(_structured(spark, d))
    return s.select("subject", "predicate", tx.fact_sentence(F.col("subject"), F.col("predicate"), F.col("members"), F.col("total"), F.col("unit")).alias("sentence"))


HINTS = "case id % 7 when 0 then 'single-session-user' when 1 then 'single-session-assistant' when 2 then 'single-session-preference' when 3 then 'knowledge-update' when 4 then 'multi-session' when 5 then 'temporal-reasoning' end"


@query(f"""with {TEXTS}, {SENTS}, q as (select id as tid, pos, s, length(s) as id from s where contains(s, '?')), h as (select *, {HINTS} as hint from q)
 select tid as id, pos, coalesce({case(fx.ROUTES)}, case hint when 'single-session-user' then 'fact_lookup' when 'single-session-assistant' then 'assistant_memory_lookup' when 'single-session-preference' then 'preference_profile' when 'knowledge-update' then 'knowledge_update' when 'multi-session' then 'multi_session_aggregate' when 'temporal-reasoning' then 'temporal_reasoning' end, 'fact_lookup') as mode from h""")
def task_route(spark, d):
    names = F.array(*map(F.lit, ("single-session-user", "single-session-assistant", "single-session-preference", "knowledge-update", "multi-session", "temporal-reasoning")))
    s = sentences(spark, d).where(F.col("s").contains("?"))
    hint = F.get(names, F.pmod(F.length("s"), F.lit(7)))
    return s.select("id", "pos", questions.route(F.col("s"), hint).alias("mode"))


def scripted_answers(n: int = 240) -> list[tuple[int, str, str, str]]:
    """(id, expected, predicted, stage): answers of each kind, by a rule, with the stage stated by hand."""
    words = ["two", "seven", "twelve", "thirty", "nineteen", "four"]
    digits = ["2", "7", "12", "30", "19", "4"]
    out = []
    for i in range(n):
        k, c = i // 12, f"Lake {chr(65 + i // 12 % 26)}oria"
        w, g = words[k % 6], digits[k % 6]
        cases = [
            (c, c, "exact"), (f"the {c}", c.lower() + "!", "normalized"), (f"{w} dogs", f"{g} dogs", "normalized"), (f"{w} and a half hours", f"{g}.5 hours", "normalized"),
            (f"{g}%", f"about {g} percent", "numeric"), (g, f"I counted {g} of them", "numeric"), (w, f"{g} shirts", "unit"), (c, f"It was {c} again", "rule_semantic"),
            (f"My trip to {c}", c, "rule_semantic"), ("I don't know", "That is not mentioned", "rule_semantic"), (c, "Mount Elsewhere", "wrong"), ("", c, "wrong"),
        ]
        out.append((i, *cases[i % 12]))
    return out


ANSWERS = scripted_answers()


@query(f"with x(id, expected, predicted, stage) as {values(ANSWERS)} select id, stage from x")
def answer_stages(spark, d):
    rows = spark.sql(f"select * from {values([a[:3] for a in ANSWERS])} as x(id, expected, predicted)")
    return rows.select("id", tx.answer_stage(F.col("expected"), F.col("predicted")).alias("stage"))


# ---- scripted scenarios: 50 supersessions and 20 timelines ----
ATTRIBUTES = {
    "city": ["Aro", "Belmar", "Corvo", "Dunlin", "Estra", "Fenwick", "Gallo", "Harrow", "Islet", "Juna", "Kolb"],
    "employer": ["Lumen Ltd", "Morrow", "Nadir", "Ostrea", "Pallas", "Quern", "Ravel", "Sable", "Tamarind", "Umbra", "Vesper"],
    "marital status": ["single", "engaged", "married", "separated", "divorced", "remarried", "widowed", "single again", "engaged again", "married again", "settled"],
    "diet": ["omnivore", "pescatarian", "vegetarian", "vegan", "keto", "paleo", "halal", "kosher", "raw", "mixed", "low salt"],
    "vehicle": ["bike", "scooter", "van", "sedan", "truck", "jeep", "tram pass", "motorcycle", "coupe", "wagon", "minibus"],
    "hobby": ["pottery", "chess", "rowing", "origami", "bouldering", "birding", "weaving", "fencing", "sailing", "juggling", "baking"],
}


def supersessions(n: int = 50) -> tuple[list[tuple], list[tuple]]:
    """(scenario, turn, attribute, value) turns, noise with no attribute, and (scenario, current, stale)."""
    rng, rows, expected = random.Random(7), [], []
    for k in range(n):
        name = list(ATTRIBUTES)[k % 6]
        start = k // 6
        chain, turn = ATTRIBUTES[name][start : start + (3 if name == "marital status" else 2)], 0
        for value in chain:
            for _ in range(rng.randint(1, 3)):
                rows.append((k, turn, None, f"small talk {rng.randint(0, 99)}"))
                turn += 1
            rows.append((k, turn, name, value))
            turn += 1
        expected.append((k, chain[-1], ",".join(chain[:-1])))
    return rows, expected


def timelines() -> tuple[list[tuple], list[tuple]]:
    """(scenario, valid_from, recorded_at, value) updates and (scenario, as_of, expected): 15 points in time, recorded a
    day later, and 5 corrections of the past, recorded long after."""
    updates, expected = [], []
    for k in range(15):
        chain = ATTRIBUTES[list(ATTRIBUTES)[k % 6]][k % 5 : k % 5 + 3]
        for i, value in enumerate(chain):
            updates.append((k, f"202{i + 2}-0{1 + k % 9}-1{k % 10}", f"202{i + 2}-0{1 + k % 9}-2{k % 10}", value))
        year = 2022 + k % 3
        expected.append((k, f"{year}-12-01", chain[k % 3]) if k % 5 else (k, "2021-06-01", None))
    for k in range(15, 20):
        first, second = ATTRIBUTES["city"][k - 15], ATTRIBUTES["city"][k - 10]
        updates += [(k, "2023-05-01", "2023-05-02", first), (k, "2022-03-01" if k % 2 else "2023-05-01", "2024-08-09", second)]
        expected.append((k, "2022-07-01" if k % 2 else "2023-09-01", second))
    return updates, expected


SUPERSEDED, CURRENT = supersessions()
UPDATES, AS_OF = timelines()


@query(f"with x(scenario, current, stale) as {values(CURRENT)} select scenario, current, stale, true as correct from x")
def scripted_supersession(spark, d):
    rows = spark.sql(f"select cast(scenario as long) subject, cast(turn as long) id, attribute, value, timestamp_seconds(turn) valid_from, timestamp_seconds(turn) recorded_at from {values(SUPERSEDED)} as x(scenario, turn, attribute, value)")
    said = temporal.intervals(rows.where("attribute is not null"))
    want = spark.sql(f"select scenario, current as wanted from {values([c[:2] for c in CURRENT])} as x(scenario, current)")
    now = said.groupBy("subject").agg(F.max(F.when(F.col("valid_to").isNull(), F.col("value"))).alias("current"),
                                      F.array_sort(F.collect_list(F.when(F.col("valid_to").isNotNull(), F.struct("id", "value")))).alias("old"))
    out = now.join(want, F.col("subject") == F.col("scenario")).withColumn("stale", F.concat_ws(",", F.transform("old", lambda x: x["value"])))
    return out.select("scenario", "current", "stale", (F.col("current") == F.col("wanted")).alias("correct"))


@query(f"with x(scenario, as_of, expected) as {values(AS_OF)} select scenario, expected as value, true as correct from x")
def scripted_timelines(spark, d):
    rows = spark.sql(f"select cast(scenario as long) subject, 'a' attribute, cast(row_number() over (order by scenario, recorded_at) as long) id, value, cast(valid_from as timestamp) valid_from, cast(recorded_at as timestamp) recorded_at from {values(UPDATES)} as x(scenario, valid_from, recorded_at, value)")
    asked = spark.sql(f"select cast(scenario as long) ask_id, cast(scenario as long) subject, 'a' attribute, cast(as_of as timestamp) t from {values(AS_OF)} as x(scenario, as_of, expected)")
    want = spark.sql(f"select scenario, expected from {values(AS_OF)} as x(scenario, as_of, expected)")
    got = temporal.as_of_join(asked, rows, "t")
    return got.join(want, F.col("ask_id") == F.col("scenario")).select("scenario", "value", F.col("value").eqNullSafe(F.col("expected")).alias("correct"))


# ---- scores ----
@query(f"""with {NODES} select id, round(exp(-(id % 90) * ln(2.0::double) / 7), 9) as legacy, round((id % 50) / 50.0::double + 0.2::double * importance + 0.1::double * exp(-(id % 90) * ln(2.0::double) / 7) + case when id % 3 = 0 then 0.05::double else 0.0::double end, 9) as composite,
 round(1 / (1 + exp(-((id % 41) - 20)::double)), 9) as sigmoid, round(importance + 0.1::double * confidence, 9) as value, case when importance >= 0.875 then 1.0::double when importance >= 0.625 then 0.75::double when importance >= 0.375 then 0.5::double else 0.25::double end as level,
 greatest(0.05::double, least(0.95::double, greatest(0.5::double, least(importance, 0.9::double)))) as fraction, round(case id % 4 when 0 then (id % 1000) / 1000.0::double * 0.01::double + access_count / 1000.0::double * 0.03::double when 1 then (id % 1000) / 1000.0::double * 0.0005::double + access_count / 1000.0::double * 0.0015::double else 0.0::double end, 12) as cost from nd""")
def score_functions(spark, d):
    n = nodes(spark, d)
    days, arg = F.pmod("id", F.lit(90)).cast("double"), (F.pmod("id", F.lit(41)) - 20).cast("double")
    model = F.element_at(F.array(F.lit("x-large-1"), F.lit("x-small"), F.lit("other"), F.lit("free")), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    return n.select(
        "id", F.round(sc.legacy_recency(days), 9).alias("legacy"),
        F.round(sc.legacy_composite(F.pmod("id", F.lit(50)) / 50.0, F.col("importance"), sc.legacy_recency(days), F.pmod("id", F.lit(3)) == 0), 9).alias("composite"),
        F.round(sc.sigmoid(arg), 9).alias("sigmoid"), F.round(sc.value_score(F.col("importance"), F.col("confidence")), 9).alias("value"),
        sc.importance_value(sc.importance_level(F.col("importance"))).alias("level"), sc.compress_fraction(F.lit(0.5), F.col("importance")).alias("fraction"),
        F.round(sc.cost(model, F.pmod("id", F.lit(1000)), F.col("access_count")), 12).alias("cost"))


@query("select vec_id as id, round(list_sum(list_transform(embedding::double[], lambda z: z * z)) / list_sum(list_transform(embedding::double[], lambda z: z * z)), 9) as norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding::double[], lambda z: z * z))), 9) as first from embeddings")
def unit_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), sc.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return v.select("id", F.round(sc.dot(F.col("u"), F.col("u")), 9).alias("norm"), F.round(F.col("u")[0], 9).alias("first"))


# ---- texts ----
@query(rf"with {TEXTS} select id, md5(replace(replace(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')), '<', '('), '>', ')')) as quoted, {has(fx.UPDATE_MARKERS, 'text')} as update from t where text is not null")
def quoted_memory(spark, d):
    from tessera.plans.rules import texts

    rows = texts(spark, d).where("text is not null")
    return rows.select("id", F.md5(tx.defanged(F.col("text"))).alias("quoted"), F.col("text").rlike(fx.UPDATE_MARKERS).alias("update"))


@query(rf"""with x as (select doc_id as id, text, left(text, 199) as c from documents where text is not null), y as (select *, case when contains(c, ' ') then length(c) - instr(reverse(c), ' ') else 0 end as b from x)
 select id, case when length(text) <= 200 then text when b > 100 then left(c, b) || '…' else c || '…' end as short, case when {WORDS.format('text')} <= 40 then text else rtrim(left(text, 160), ' ') || '…' end as tokens from y""")
def shortened_texts(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select(F.col("doc_id").alias("id"), tx.cut_at_word(F.col("text"), 200).alias("short"), tx.cut_to_tokens(F.col("text"), 40).alias("tokens"))


DATES = [(1, "2024-03-05", "2024-03-05 00:00:00"), (2, "2023", "2023-01-01 00:00:00"), (3, "2024-02-30", None), (4, "soon", None), (5, "2024-03-05T07:08", "2024-03-05 07:08:00"), (6, " 2021-12-31 ", "2021-12-31 00:00:00"), (7, "20245", None), (8, None, None)]
HAY = [(1, "2023/05/30 (Tue) 21:40", "2023-05-30 21:40:00"), (2, "2023/05/30", "2023-05-30 00:00:00"), (3, "30.05.2023", None), (4, "2023/13/01 (Mon) 10:00", None), (5, "", None)]


@query(f"with a(id, text, want) as {values(DATES)}, b(id, text, want) as {values(HAY)} select 'd' || id as id, epoch_us(want::timestamp) as at from a union all select 'h' || id, epoch_us(want::timestamp) from b union all select 'e' || event_id, epoch_us(ts) // 86400000000 * 86400000000 from events")
def parsed_dates(spark, d):
    read = lambda rows, letter, f: spark.sql(f"select * from {values([r[:2] for r in rows])} as x(id, text)").select(F.concat(F.lit(letter), "id").alias("id"), F.unix_micros(f(F.col("text"))).alias("at"))
    e = table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.unix_micros(tx.parsed_date(F.date_format("ts", "yyyy-MM-dd"))).alias("at"))
    return read(DATES, "d", tx.parsed_date).unionByName(read(HAY, "h", tx.haystack_date)).unionByName(e)


@query(f"with {FACTS} select id, datediff('day', valid_from::date, recorded_at::date)::int as days, round_even(datediff('day', valid_from::date, recorded_at::date) / 7.0, 0)::int as weeks, row_number() over (partition by subject order by valid_from, id)::int as place from f")
def date_deltas(spark, d):
    days = F.datediff("recorded_at", "valid_from")
    return facts(spark, d).select("id", days.alias("days"), F.bround(days / 7.0, 0).cast("int").alias("weeks"), F.row_number().over(Window.partitionBy("subject").orderBy("valid_from", "id")).alias("place"))


# ---- promotion ----
@query(f"""with {NODES}, b as (select id as seq, subject as owner, attribute, case when id % 4 = 0 then 'I now use ' || attribute else attribute || ' noted' end as text from nd),
 m as (select *, id % 4 = 0 as marker from (select *, seq as id from b)) select m.id, case when m.marker and max(o.id) is not null then 'DELETE' else 'NOOP' end as op, case when m.marker then max(o.id) end as target from m left join m o on m.marker and not o.marker and o.owner = m.owner and o.attribute = m.attribute and o.seq < m.seq group by m.id, m.marker""")
def heuristic_supersession(spark, d):
    n = nodes(spark, d)
    said = F.when(F.pmod("id", F.lit(4)) == 0, F.concat(F.lit("I now use "), "attribute")).otherwise(F.concat("attribute", F.lit(" noted")))
    return questions.heuristic_supersession(n.select(F.col("subject").alias("owner"), "id", F.col("id").alias("seq"), said.alias("text"), F.array("attribute").alias("entities")))


OPS = "o as (select id, case id % 6 when 0 then 'ADD' when 1 then 'NOOP' when 2 then 'DELETE' when 3 then 'UPDATE' when 4 then 'NOOP' else 'DELETE' end as op, id % 6 = 4 as short, case when id % 5 <> 0 then id - 1 end as target from nd)"


@query(f"""with {NODES}, {OPS} select id, 'INVALIDATE' as event, target from o where op = 'DELETE' and target is not null union all select id, 'PATCH', target from o where op = 'UPDATE' and target is not null
 union all select id, 'ADD', null from o where op = 'ADD' or op = 'DELETE' or (op = 'NOOP' and not short) or (op = 'UPDATE' and target is null)""")
def decided_writes(spark, d):
    """What a decision writes: a fact is never dropped but for a true duplicate."""
    names = F.array(*map(F.lit, ("ADD", "NOOP", "DELETE", "UPDATE", "NOOP", "DELETE")))
    o = nodes(spark, d).select("id", F.element_at(names, (F.pmod("id", F.lit(6)) + 1).cast("int")).alias("op"), (F.pmod("id", F.lit(6)) == 4).alias("short"), F.when(F.pmod("id", F.lit(5)) != 0, F.col("id") - 1).alias("target"))
    return transcripts.writes(o)


# ---- transcripts ----
@query(f"with {TURNS} select session, seq, 'agent' || (session % 3) as agent, case when role = 'user' then 'user' when seq % 2 = 1 and role <> 'user' then 'self' else 'other' end as voice from t where role <> 'system'")
def shared_transcript_view(spark, d):
    return transcripts.agent_view(turns(spark, d)).select("session", "seq", "agent", "voice")


@query(f"with {TURNS} select session, max(seq) as last, arg_max(role, seq) = 'user' as rolled_back, count(*) - (arg_max(role, seq) = 'user')::int as left_turns from t group by session")
def roll_back_last_user(spark, d):
    return transcripts.rolled_back(turns(spark, d))


@query(f"with {TURNS}, x as (select 0 as k, session, -1 as seq, 'system' as role, 'Be brief.' as content from t group by session union all select 1, session, seq, role, coalesce(text, '') from t) select session, string_agg(role || ': ' || content, chr(10) order by k, seq) as prompt from x group by session")
def rendered_prompt(spark, d):
    return transcripts.rendered(turns(spark, d), "Be brief.")


EVICTION = f"with {TURNS}, x as (select *, (['LOW', 'NORMAL', 'HIGH', 'CRITICAL'])[(session + seq) % 4 + 1] as importance, seq % 6 = 5 as summary from t), r as (select *, row_number() over (partition by session order by case when summary then 3 when importance in ('LOW', 'NORMAL') then 0 when importance = 'HIGH' then 1 else 2 end, seq) as k, count(*) over (partition by session) as n from x) select session, seq from r where k > n - 4"
IMPORTANCE = ("LOW", "NORMAL", "HIGH", "CRITICAL")


def _weighed(t):
    names = F.array(*map(F.lit, IMPORTANCE))
    return t.withColumns({"importance": F.element_at(names, (F.pmod(F.col("session") + F.col("seq"), F.lit(4)) + 1).cast("int")), "summary": F.pmod("seq", F.lit(6)) == 5})


@query(EVICTION)
def importance_eviction(spark, d):
    return bundles.evict(_weighed(turns(spark, d)), 4).select("session", "seq")


@query(EVICTION)
def stream_keyed_eviction(spark, d):
    """The same turns kept by a stream whose state holds four turns a session."""
    from tessera.sources.shared import shared_folder
    from tessera.streaming import keyed

    schema = table(spark, d, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversation[s].parquet")
    said = _weighed(stream.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")).select("session", "seq", "importance", "summary", "text")
    sink = shared_folder(spark)
    keyed.run_once(keyed.evictions(said, 4), sink, shared_folder(spark))
    gone = spark.read.schema(keyed.EVICTED).parquet(sink)
    return turns(spark, d).select("session", "seq").join(gone, ["session", "seq"], "left_anti")


@query(f"""with {NODES}, i as (select subject as query_id, id, layer, round(importance + 0.1::double * confidence, 9) as value, created_at, 5 + id % 20 as tokens from nd where invalidated_at is null),
 s as (select *, sum(tokens) over (partition by query_id) - 150 as ov, row_number() over (partition by query_id, layer order by created_at desc, id desc) as newest from i),
 o as (select *, case when layer = 'LTM' then 1 when layer = 'MTM' and newest > 2 then 2 end as step from s),
 p as (select *, sum(tokens) over (partition by query_id order by step nulls last, case when step = 1 then value end nulls first, created_at, id rows unbounded preceding) - tokens as before from o)
 select query_id, id from p where not (step is not null and ov > 0 and before < ov)""")
def layered_prune(spark, d):
    n = nodes(spark, d).where("invalidated_at is null")
    items = n.select(F.col("subject").alias("query_id"), "id", "layer", F.round(sc.value_score(F.col("importance"), F.col("confidence")), 9).alias("value"), "created_at", (5 + F.pmod("id", F.lit(20))).alias("tokens"))
    return bundles.prune_to_fit(items, 150).select("query_id", "id")


@query(rf"""with recursive d as (select doc_id as id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '{summaries.SENTENCE_END}', '\1' || chr(1) || '\2', 'g'), chr(1)) as x from documents),
 f as (select id, list_filter(list_transform(x, lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '') as found from d), s as (select id, len(found) as n, unnest(range(0, len(found))) as i, unnest(found) as sentence from f),
 w as (select id, i, unnest(list_filter(regexp_extract_all(lower(sentence), '{sql_text(summaries.WORD)}'), lambda z: length(z) > 2 and z not in {tuple(summaries.STOP_WORDS)})) as word from s),
 c as (select id, word, count(*) as c from w group by all), top as (select id, max(c) as top from c group by id), sc as (select id, i, sum(c) as total, count(*) as words from w join c using (id, word) group by all),
 r as (select s.id, s.i, len(list_filter(string_split_regex(sentence, '\s+'), lambda z: z <> '')) as cost,
  row_number() over (partition by s.id order by round(coalesce(total::double / top / sqrt(words), 0) + {summaries.EARLY} * (1 - i::double / greatest(1, n - 1)), 9) desc, i) as k from s left join sc using (id, i) left join top using (id)),
 g as (select id, k, i, cost as used, true as taken from r where k = 1
  union all select r.id, r.k, r.i, case when used < 60 and used + cost <= 60 then used + cost else used end, used < 60 and used + cost <= 60 from g join r on r.id = g.id and r.k = g.k + 1),
 o as (select g.id, string_agg(found[i + 1], ' ' order by i) as summary from g join f on f.id = g.id where taken group by g.id), j as (select id, array_to_string(found, ' ') as whole from f)
 select j.id, case when top.id is not null then o.summary when len(list_filter(string_split_regex(whole, '\s+'), lambda z: z <> '')) <= 60 then whole else regexp_replace(left(whole, 240), '\s+$', '') || '…' end as summary
 from j left join o using (id) left join top using (id)""")
def extractive_summaries(spark, d):
    return summaries.summaries(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 60)


# ---- data sets in and out ----
QA_ROWS = f"with {TURNS}, s as (select session as q, session % 4 as g, seq, role, coalesce(text, '') as text from t)"


@query(f"{QA_ROWS} select 'q' || g as question_id, 's' || q as session_id, epoch_us(timestamp '2023-05-01 10:00:00' + to_days((q % 20)::int)) as session_at, row_number() over (partition by q order by seq)::int - 1 as turn, role, text as content from s")
def haystack_loader(spark, d):
    """Questions with their sessions as nested JSON, and read back as one row a turn."""
    path = shared_folder(spark, "qa")
    t = turns(spark, d).withColumn("content", F.coalesce("text", F.lit("")))
    day = F.date_format(F.date_add(F.lit("2023-05-01").cast("date"), F.pmod("session", F.lit(20)).cast("int")), "yyyy/MM/dd")
    sessions = t.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    sessions = sessions.withColumns({"g": F.pmod("session", F.lit(4)), "date": F.concat(day, F.lit(" (Mon) 10:00"))})
    whole = sessions.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("session", "date", "turns"))).alias("x"))
    whole.select(
        F.concat(F.lit("q"), F.col("g").cast("string")).alias("question_id"), F.lit("what?").alias("question"), F.lit("7").alias("answer"), F.lit("multi-session").alias("question_type"), F.lit("2023/06/01 (Thu) 09:00").alias("question_date"),
        F.transform("x", lambda s: F.concat(F.lit("s"), s["session"].cast("string"))).alias("haystack_session_ids"), F.transform("x", lambda s: s["date"]).alias("haystack_dates"),
        F.transform("x", lambda s: s["turns"]).alias("haystack_sessions"), F.array(F.lit("s1")).alias("answer_session_ids")).write.json(path)
    return datasets.haystack_turns(datasets.read_questions(spark, path)).withColumn("session_at", F.unix_micros("session_at"))


RESULTS = "r as (select doc_id as id, lang as kind, quality = 1 as correct, toxic = 1 as failed, doc_id % 400 as ms from documents join labels using (doc_id))"


@query(f"with {RESULTS}, p as (select count(*) as n, avg(correct::int::double) as accuracy, avg(ms::double) as mean_ms, median(ms)::double as median_ms, count(*) filter (where not correct) as failures from r) select n, round(accuracy, 9) as accuracy, round(mean_ms, 9) as mean_ms, median_ms, failures from p")
def result_sink(spark, d):
    """Metrics as JSON and failures as CSV, read back."""
    path = shared_folder(spark, "results")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), (F.col("quality") == 1).alias("correct"), F.pmod("doc_id", F.lit(400)).alias("ms"))
    datasets.write_results(rows, path)
    metrics, failures = datasets.read_results(spark, path)
    return metrics.crossJoin(F.broadcast(failures.agg(F.count(F.lit(1)).alias("failures"))))  # one row each


@query(f"with {RESULTS} select count(*) as n, count(*) filter (where id % 10 = 0) as invalid from r")
def trace_sink(spark, d):
    """One JSON line a row; lines that miss a field or have the wrong type are invalid."""
    path = shared_folder(spark, "trace")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.when(F.pmod("doc_id", F.lit(10)) != 0, F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("question_id"), F.lit("x").alias("answer"), F.col("quality").alias("latency_ms"))
    rows.write.json(path)
    checked = datasets.checked_traces(spark, path)
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("invalid"))


@query(f"with {FACTS}, x as (select *, row_number() over (partition by attribute order by value, id) as k, count(*) over (partition by attribute) as n from f) select attribute, count(*) as n, round(avg(value), 6) as mean, max(value) filter (where k = greatest(1, (n * 95) // 100)) as p95 from x group by attribute")
def latency_report(spark, d):
    return evaluation.latency(facts(spark, d).select("attribute", "id", "value"), ["attribute"], "value")
