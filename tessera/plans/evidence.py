"""Queries of replies, claims, sessions, packets, failures, bundles under a budget, and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.functions import text as tx
from tessera.operators import bundles, evidence, memory, retrieval
from tessera.operators import memberships as phrases
from tessera.plans.catalog import ASKED, KNN, NOW, TURNS, VALID, _queries, _texts, query, sql_text
from tessera.plans.literals import values
from tessera.plans.memory import NODES, RANKED, at
from tessera.plans.rules import TEXTS, texts
from tessera.sources.tables import nodes, table, turns, vectors

# ---- replies: what a reply says is stated by hand; documents are replies that say nothing ----
FACT_REPLIES = [
    (1, 'Sure: {"facts": [{"text": "The user lives in Aro", "confidence": 0.9, "type": "place"}, {"text": "THE USER LIVES IN ARO", "confidence": 1}, {"text": "short", "confidence": 1}]} done'),
    (2, '{"facts": [{"text": "The user owns a red bike", "confidence": "0.7"}, {"text": "The user may like tea", "confidence": 0.3}, {"text": "The user has two cats", "confidence": 7}]}'), (3, "no json here"), (4, '{"facts": []}'), (5, '{"facts": [{"text": "broken'),
]
FACT_ROWS = [("r1", "The user lives in Aro", 0.9, "place"), ("r2", "The user owns a red bike", 0.7, None), ("r2", "The user has two cats", 1.0, None)]
RELATION_REPLIES = [(1, '{"relations": [{"subject": "Ada", "predicate": "uses", "object": "Spark", "confidence": 2}, {"subject": "ADA", "predicate": "USES", "object": "spark"}, {"subject": "", "predicate": "x", "object": "y"}]}'), (2, '{"relations": [{"subject": "Bo", "predicate": "made", "object": "Orbit"}]}')]
RELATION_ROWS = [("r1", "Ada", "USES", "Spark", 1.0), ("r2", "Bo", "MADE", "Orbit", 0.5)]
ITEM_REPLIES = [(1, '```json\n{"facts": [{"predicate": "tank", "object": "goldfish tank", "quantity": null, "unit": ""}, {"predicate": "gaming session", "object": "Monday", "quantity": 2, "unit": "hours"}]}\n```'),
                (2, '{"facts": [{"predicate": "top", "object": "a "blue" top", "quantity": null}, {"predicate": "lemon", "object": "lemon", "quantity": "3 kg", "unit": "kg"}'), (3, "nothing")]
ITEM_ROWS = [("r1", "tank", "goldfish tank", None, ""), ("r1", "gaming session", "Monday", 2.0, "hours"), ("r2", "top", "a ", None, ""), ("r2", "lemon", "lemon", 3.0, "kg")]
VERDICTS = [
    (1, "Yes, it is.", True, None, None, None), (2, "No.", False, None, None, None), (3, "yes and no", False, None, None, None), (4, "Yes, well known", True, None, None, None),
    (5, '```\n{"supported": true, "confidence": 0.8}\n```', False, True, 0.8, None), (6, '{"supported": false, "confidence": 4}', False, False, 1.0, None), (7, '{"confidence": 1}', False, None, None, None),
    (8, "Recall!", False, None, None, "recall"), (9, "store it", False, None, None, "store"), (10, "maybe", False, None, None, None),
]


def _replies(spark, d, rows, made):
    """Replies of models: those stated by hand, and one for each event, made of its columns by ``made`` (some are broken)."""
    literal = spark.sql(f"select * from {values([r[:2] for r in rows])} as x(id, reply)").select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "reply")
    return literal.unionByName(table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), made.alias("reply")))


@query(f"""with x(id, text, confidence, type) as {values(FACT_ROWS)} select id, text, confidence::double as confidence, type from x union all
 select 'e' || event_id, 'The user ' || user_id || ' did ' || event_type, (event_id % 5) / 4.0::double, 'event' from events where event_id % 5 >= 3 and event_id % 7 <> 0""")
def parsed_facts(spark, d):
    """Facts of replies: events of which a fifth is sure enough twice, said twice in other letters, a seventh of them cut off."""
    sure = F.element_at(F.array(*[F.lit(str(i / 4)) for i in range(5)]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    fact = lambda t: F.concat(F.lit('{"text": "'), t, F.lit('", "confidence": '), sure, F.lit(', "type": "event"}'))
    said = F.concat(F.lit("The user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"))
    whole = F.concat(F.lit('Here: {"facts": ['), fact(said), F.lit(", "), fact(F.upper(said)), F.lit("]} done"))
    return _replies(spark, d, FACT_REPLIES, F.when(F.pmod("event_id", F.lit(7)) == 0, F.left(whole, F.lit(25))).otherwise(whole)).select("id", F.inline(replies.facts(F.col("reply"))))


@query(f"""with x(id, subject, predicate, object, confidence) as {values(RELATION_ROWS)} select id, subject, predicate, object, confidence::double as confidence from x union all
 select 'e' || event_id, 'u' || user_id, upper(event_type), 'item ' || event_id % 9, least(1.0::double, event_id % 3 * 0.75::double) from events where event_id % 7 <> 0""")
def parsed_relations(spark, d):
    part = F.concat(F.lit('{"subject": "u'), F.col("user_id").cast("string"), F.lit('", "predicate": "'), F.col("event_type"), F.lit('", "object": "item '), F.pmod("event_id", F.lit(9)).cast("string"),
                    F.lit('", "confidence": '), (F.pmod("event_id", F.lit(3)) * 0.75).cast("string"), F.lit("}"))
    whole = F.concat(F.lit('{"relations": ['), part, F.lit(', {"subject": "", "predicate": "x", "object": "y"}, '), part, F.lit("]}"))
    return _replies(spark, d, RELATION_REPLIES, F.when(F.pmod("event_id", F.lit(7)) == 0, "no relations").otherwise(whole)).select("id", F.inline(replies.relations(F.col("reply"))))


@query(f"""with x(id, predicate, object, quantity, unit) as {values(ITEM_ROWS)} select id, predicate, object, quantity::double as quantity, unit from x union all
 select 'e' || event_id, event_type, 'thing ' || event_id % 9, (event_id % 50)::double, 'hours' from events where event_id % 7 <> 0""")
def parsed_countables(spark, d):
    whole = F.concat(F.lit('```json\n{"facts": [{"predicate": "'), F.col("event_type"), F.lit('", "object": "thing '), F.pmod("event_id", F.lit(9)).cast("string"), F.lit('", "quantity": '), F.pmod("event_id", F.lit(50)).cast("string"), F.lit(', "unit": "hours"}]}\n```'))
    return _replies(spark, d, ITEM_REPLIES, F.when(F.pmod("event_id", F.lit(7)) == 0, "nothing to count").otherwise(whole)).select("id", F.inline(replies.structured(F.col("reply"))))


@query(f"""with x(id, reply, yes, supported, confidence, intent) as {values(VERDICTS)} select 'r' || id as id, yes, supported, confidence::double as confidence, intent from x union all
 select 'e' || event_id, event_id % 4 = 0, case when event_id % 4 = 2 then event_id % 3 = 0 end, case when event_id % 4 = 2 then event_id % 5 / 4.0::double end, case when event_id % 4 = 3 then 'recall' end from events""")
def parsed_verdicts(spark, d):
    """Answers yes or no, verdicts as JSON and intents; events give one of each kind in turn."""
    n = lambda k: F.pmod("event_id", F.lit(k))
    verdict = F.concat(F.lit('{"supported": '), (n(3) == 0).cast("string"), F.lit(', "confidence": '), (n(5) / 4.0).cast("string"), F.lit("}"))
    made = F.when(n(4) == 0, F.concat(F.lit("Yes, by user "), F.col("user_id").cast("string"))).when(n(4) == 1, "No, it is not.").when(n(4) == 2, verdict).otherwise("Recall.")
    r, c = _replies(spark, d, VERDICTS, made), F.col("reply")
    return r.select("id", replies.yes_no(c).alias("yes"), replies.verdict(c)["supported"].alias("supported"), replies.verdict(c)["confidence"].alias("confidence"), replies.intent(c).alias("intent"))


PHRASE = "(?i)" + sql_text(phrases.PHRASE)
SINGULAR = "case " + " ".join(f"when regexp_matches({{0}}, '{w}') then regexp_replace({{0}}, '{e}', '{b}')" for w, e, b in phrases.PLURALS) + " else {0} end"


@query(rf"""with {TEXTS}, m as (select id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '{PHRASE}', chr(1) || '\0', 'g'), chr(1)) as p from t),
 k as (select id, p, unnest(range(2, len(p) + 1)) as k from m), b as (select id, k - 2 as pos, regexp_extract(p[k], '^{PHRASE}', 1) as np, regexp_replace(p[k], '^{PHRASE}', '') || array_to_string(p[k + 1:], '') as after from k),
 w as (select *, string_split_regex(np, '\s+') as ws from b), e as (select *, coalesce(list_position(list_transform(ws, lambda z: lower(z) in {tuple(phrases.ENDS)}), true), 0) as stop from w),
 c as (select *, case when stop > 0 then ws[1:stop - 1] else ws end as words, list_filter(words, lambda z: regexp_matches(z, '[A-Za-z]{{2,}}')) as named from e),
 h as (select id, pos, lower(array_to_string(words, ' ')) as obj, lower(regexp_replace(named[-1], '[^A-Za-z''-]', '', 'g')) as head, np || ' ' || left(after, {phrases.TAIL_CHARS}) as around from c where len(named) > 0),
 s as (select id, pos, obj, {SINGULAR.format('head')} as predicate, regexp_extract(around, '{phrases.MEASURE}', 1) as size, lower(regexp_extract(around, '{phrases.MEASURE}', 2)) as unit from h),
 r as (select *, row_number() over (partition by id, predicate, obj order by pos) as k from s where length(predicate) >= 3 and predicate not in {tuple(phrases.NO_HEADS)})
 select id, pos::int as pos, predicate, obj, case when size <> '' then size::double end as quantity, case when size <> '' then ({SINGULAR.format('unit')}) || 's' else '' end as unit from r where k = 1""")
def local_structured_facts(spark, d):
    return phrases.memberships(texts(spark, d))


@query("""with a as (select doc_id as id, 'LANG' as type, lang as name, 0.8::double as c from documents where doc_id % 3 <> 0 union all select doc_id, 'SOURCE', source, 0.6 from documents), b as (select doc_id as id, 'LANG' as type, upper(lang) as name, 0.9::double as c from documents where doc_id % 2 = 0 union all select doc_id, 'TEXT', left(text, 5), 0.5 from documents where doc_id % 4 = 1 and text is not null)
 select coalesce(a.id, b.id) as id, coalesce(a.type, b.type) as type, coalesce(a.name, b.name) as name, greatest(coalesce(a.c, 0), coalesce(b.c, 0)) as confidence, a.name is not null as located from a full join b on a.id = b.id and a.type = b.type and lower(trim(a.name)) = lower(trim(b.name))""")
def entity_merge(spark, d):
    """Two extractors' entities: the first has the places, the second adds, and the surer one counts."""
    docs = table(spark, d, "documents")
    ent = lambda rows, kind, name, c: rows.select(F.col("doc_id").alias("id"), F.lit(kind).alias("type"), name.alias("name"), F.lit(c).alias("confidence"))
    first = ent(docs.where("doc_id % 3 <> 0"), "LANG", F.col("lang"), 0.8).unionByName(ent(docs, "SOURCE", F.col("source"), 0.6))
    second = ent(docs.where("doc_id % 2 = 0"), "LANG", F.upper("lang"), 0.9).unionByName(ent(docs.where("doc_id % 4 = 1 and text is not null"), "TEXT", F.left("text", F.lit(5)), 0.5))
    keyed = lambda df, p: df.select("id", "type", F.lower(F.trim("name")).alias("key"), F.col("name").alias(f"{p}_name"), F.col("confidence").alias(f"{p}_c"))
    both = keyed(first, "a").join(keyed(second, "b"), ["id", "type", "key"], "full")
    return both.select("id", "type", F.coalesce("a_name", "b_name").alias("name"), F.greatest(F.coalesce("a_c", F.lit(0.0)), F.coalesce("b_c", F.lit(0.0))).alias("confidence"), F.col("a_name").isNotNull().alias("located"))


# ---- claims and sessions ----
CLAIMS = rf"""l as (select session, seq, role, unnest(range(0, len(x))) as line, unnest(x) as raw from (select session, seq, role, string_split(coalesce(text, ''), chr(10)) as x from t)),
 b as (select *, regexp_replace(raw, '(?i)^\s*-\s+(?:turn\s+[0-9]+\s+)?(?:\((?:user|assistant|system)\):\s*)?|^\s*(?:user|assistant|system)\s*:\s*', '') as body from l where not regexp_matches(raw, '{sql_text(evidence.STAMP)}')),
 p as (select session, seq, role, line, unnest(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as part from b),
 c as (select session, seq, role, line, regexp_replace(part, '^\s+|\s+$', '', 'g') as claim from p), cl as (select * from c where length(claim) >= 4 and not regexp_matches(claim, '{sql_text(evidence.STAMP)}'))"""


@query(f"with {TURNS}, {CLAIMS} select session, seq, line::int as line, role, claim from cl")
def claim_extract(spark, d):
    return evidence.claims(turns(spark, d)).select("session", "seq", "line", "role", "claim")


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9'']+'), lambda z: length(z) > 1))"
PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with {TURNS}, {CLAIMS}, q as (select session, left(text, 30) as answer from t where seq = 0), j as (select cl.session, seq, line, claim, answer, {TOKENS.format('answer')} as ta, {TOKENS.format('claim')} as tc from cl join q using (session))
 select session, seq, line::int as line, claim, {PLAIN.format('answer')} <> '' and (contains({PLAIN.format('claim')}, {PLAIN.format('answer')}) or (len(ta) > 0 and len(list_intersect(ta, tc)) >= greatest(1, len(ta) // 2))) as supported from j where answer is not null""")
def span_support(spark, d):
    t = turns(spark, d)
    q = t.where("seq = 0 and text is not null").select("session", F.left("text", F.lit(30)).alias("answer"))
    return evidence.claims(t).join(q, "session").select("session", "seq", "line", "claim", evidence.supported(F.col("answer"), F.col("claim")).alias("supported"))


SESSIONS = f"{RANKED}, it as (select query_id, id, rank, kind % 3 as session, query_id % 3 = 0 as spans from k30), v as (select query_id, kind % 3 as session, 0.3::double + id % 5 / 10.0::double as confidence from k30 where id % 4 = 0 and rank <= 12)"


def _items(spark, d):
    h = retrieval.knn(_queries(spark, d).drop("query_kind"), vectors(spark, d), 30).withColumn("session", F.pmod("kind", F.lit(3)))
    return h.withColumn("spans", F.pmod("query_id", F.lit(3)) == 0), h.where("id % 4 = 0 and rank <= 12").select("query_id", "session", (0.3 + F.pmod("id", F.lit(5)) / 10.0).alias("confidence"))


@query(f"""with {SESSIONS}, x as (select *, arg_min(session, rank) over (partition by query_id) as top, (select count(distinct session) from it i where i.query_id = it.query_id) as n from it), b as (select query_id, session as top, max(confidence) as best from v group by all),
 r as (select x.query_id, id, session, x.top, case when spans then 'multi_session_hint' when n = 1 then 'single_session_only' when best is null then 'top_session_unverified' when best < 0.5 then 'top_session_confidence_below_threshold' else 'narrowed_to_top_session' end as reason from x left join b on x.query_id = b.query_id and x.top = b.top)
 select query_id, id, reason from r where reason <> 'narrowed_to_top_session' or session = top""")
def session_narrowing(spark, d):
    items, verified = _items(spark, d)
    return evidence.narrowed(items, verified)


@query(f"with {RANKED}, c as (select query_id, id, rank as pos, id % 3 = 0 as verified, 0.5::double + id % 6 / 20.0::double as confidence from k30), k as (select *, row_number() over (partition by query_id order by verified desc, confidence desc, pos) as k from c) select query_id, coalesce(string_agg(id::varchar, ',' order by k) filter (where verified and k <= 6), '') as claims, count(*) filter (where not verified) as excluded from k group by query_id")
def evidence_packets(spark, d):
    h = retrieval.knn(_queries(spark, d).drop("query_kind"), vectors(spark, d), 30)
    c = h.select("query_id", "id", F.col("rank").alias("pos"), (F.pmod("id", F.lit(3)) == 0).alias("verified"), (0.5 + F.pmod("id", F.lit(6)) / 20.0).alias("confidence"))
    return evidence.packets(c).withColumn("claims", F.concat_ws(",", F.transform("claims", lambda x: x.cast("string"))))


FAILS = """x as (select doc_id as id, case doc_id % 5 when 0 then '2024-01-02' when 1 then 'a, b and c' when 2 then '[error: x' when 3 then 'Lake Aro' else 'it was on the hill, by the road, far away' end as answer, case when doc_id % 17 = 0 then 'timeout' end as error,
 (['single-session-user', 'single-session-assistant', 'multi-session', 'temporal-reasoning', 'knowledge-update'])[doc_id % 7 % 5 + 1] as question_type, case when doc_id % 19 = 0 then []::varchar[] else ['s' || doc_id % 4, 's' || doc_id % 6] end as expected, ['s' || doc_id % 3, 's9'] as retrieved,
 case when doc_id % 23 = 0 then 'A' end as expected_route, case when doc_id % 2 = 0 then 'B' else 'A' end as route, case when doc_id % 3 = 0 then 'assistant' else 'user' end as matched_role, case when doc_id % 4 = 0 then 'I used to live there' else 'now' end as matched_text from documents)"""


def _fails(spark, d):
    n = F.col("doc_id")
    m = lambda k: F.pmod(n, F.lit(k))
    s = lambda k: F.concat(F.lit("s"), m(k).cast("string"))
    kinds = F.array(*map(F.lit, ("single-session-user", "single-session-assistant", "multi-session", "temporal-reasoning", "knowledge-update")))
    answers = F.array(*map(F.lit, ("2024-01-02", "a, b and c", "[error: x", "Lake Aro", "it was on the hill, by the road, far away")))
    return table(spark, d, "documents").select(
        n.alias("id"), F.element_at(answers, (m(5) + 1).cast("int")).alias("answer"), F.when(m(17) == 0, "timeout").alias("error"), F.element_at(kinds, (F.pmod(m(7), F.lit(5)) + 1).cast("int")).alias("question_type"),
        F.when(m(19) == 0, F.array().cast("array<string>")).otherwise(F.array(s(4), s(6))).alias("expected"), F.array(s(3), F.lit("s9")).alias("retrieved"), F.when(m(23) == 0, "A").alias("expected_route"),
        F.when(m(2) == 0, "B").otherwise("A").alias("route"), F.when(m(3) == 0, "assistant").otherwise("user").alias("matched_role"), F.when(m(4) == 0, "I used to live there").otherwise("now").alias("matched_text"))


@query(f"""with {FAILS} select id, case when error is not null or starts_with(answer, '[error:') then 'llm_error' when len(expected) = 0 then 'other' when len(list_intersect(expected, retrieved)) = 0 then 'missing_fact' when expected_route <> route then 'wrong_route'
 when question_type = 'single-session-assistant' and matched_role <> 'assistant' or question_type = 'single-session-user' and matched_role = 'assistant' then 'wrong_role'
 when question_type = 'multi-session' and not (contains(answer, ',') or contains(answer, ' and ') or contains(answer, ' across ') or contains(answer, ' total') or contains(answer, ' altogether')) and len(string_split(answer, ' ')) <= 6 then 'missing_aggregation'
 when question_type = 'temporal-reasoning' and answer = '2024-01-02' then 'missing_temporal_computation' when question_type = 'knowledge-update' and contains(matched_text, 'used to') then 'stale_fact' else 'wrong_span' end as bucket from x""")
def failure_classes(spark, d):
    rows = _fails(spark, d)
    return rows.select("id", evidence.failure(rows).alias("bucket"))


@query(f"with {FAILS}, y as (select id, expected, list_filter(list_distinct(expected), lambda z: not list_contains(retrieved, z)) as missing from x) select id, len(expected)::int as n_expected, (len(expected) - len(missing))::int as n_found, case when len(expected) > 0 then (len(expected) - len(missing)) / len(expected)::double else 0.0 end as partial_recall, array_to_string(list_sort(missing), ',') as missing from y")
def recall_diagnostics(spark, d):
    return evidence.recall_diagnostics(_fails(spark, d)).select("id", "n_expected", "n_found", "partial_recall", F.concat_ws(",", F.array_sort("missing")).alias("missing"))


# ---- retrieval of other kinds ----
@query(f"""with {KNN}, dense as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as r from hits qualify r <= 20),
 tagged as (select q.vec_id as query_id, e.vec_id as id, row_number() over (partition by q.vec_id order by e.vec_id desc) as r from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 20 = 0 qualify r <= 20),
 third as (select query_id, id, row_number() over (partition by query_id order by id % 7, id) as r from hits where kind = query_kind qualify r <= 20), u as (select *, 0 as c from dense union all select *, 1 from tagged union all select *, 2 from third),
 z as (select query_id, id, sum(1.0::double / (60 + r)) as rrf, min((c, r)) as seen from u group by all) select query_id, id, position::int as position from (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, seen, id) as position from z) where position <= 10""")
def rrf_many_channels(spark, d):
    """Any number of channels; ties go to the hit that appears first."""
    q, v = _queries(spark, d), vectors(spark, d)
    dense = retrieval.knn(q.drop("query_kind"), v, 20)
    first = lambda *order: v.select("id", "kind").withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where("_k <= 21")
    mates = lambda *order: q.join(first(*order), F.col("kind") == F.col("query_kind")).where("id <> query_id")  # noqa: E731  (the first of a kind, but for the query itself)
    tagged = retrieval.rank_by(mates(F.desc("id")), F.desc("id"), 20)
    third = retrieval.rank_by(mates(F.pmod("id", F.lit(7)), "id"), F.pmod("id", F.lit(7)), 20)
    return retrieval.fuse_first_seen([dense, tagged, third], 10).select("query_id", "id", "position")


@query(f"""with q(query_id, text) as {values(ASKED)}, qt as (select query_id, unnest(string_split(lower(text), ' ')) as tok from q), s as (select query_id, doc_id as id, count(*) as score from qt join documents on list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), tok) group by all)
 select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from s qualify rank <= 4""")
def token_count_topk(spark, d):
    """Documents by how many of the query's words they hold."""
    q = spark.sql(f"select * from {values(ASKED)} as q(query_id, text)").select("query_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    held = _texts(spark, d).select("id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word"))
    scored = held.join(q, "word").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"))
    return retrieval.rank_by(scored, F.desc("score"), 4).select("query_id", "id", "score", "rank")


@query(f"with {NODES}, r as (select subject as query_id, id, round(importance + 0.1::double * confidence, 9) as score, 5 + id % 20 as tokens from nd where invalidated_at is null), k as (select *, sum(tokens) over (partition by query_id order by score desc, id rows unbounded preceding) as used from r) select query_id, id, used::bigint as used from k where used <= 60")
def context_augment(spark, d):
    """The best memories of an owner, as long as they fit."""
    from tessera.functions import scoring as sc

    n = nodes(spark, d).where("invalidated_at is null")
    rows = n.select(F.col("subject").alias("query_id"), "id", F.round(sc.value_score(F.col("importance"), F.col("confidence")), 9).alias("score"), (5 + F.pmod("id", F.lit(20))).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where("used <= 60").select("query_id", "id", "used")


@query(f"with {TURNS}, r as (select *, row_number() over (partition by session order by seq desc) as k from t) select session, count(*) filter (where k <= 2) as kept, count(*) filter (where k > 2) as folded, sum(tokens) filter (where k <= 2)::bigint as kept_tokens, (sum(tokens) - sum(tokens) filter (where k <= 2))::bigint as saved from r group by session".replace("filter (where k <= 2)::bigint", "filter (where k <= 2)"))
def trim_savings(spark, d):
    """What keeping the last turns and folding the others saves."""
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    r = turns(spark, d).withColumn("k", k)
    kept = F.sum(F.when(F.col("k") <= 2, F.col("tokens")))
    return r.groupBy("session").agg(F.count_if(F.col("k") <= 2).alias("kept"), F.count_if(F.col("k") > 2).alias("folded"), kept.alias("kept_tokens"), (F.sum("tokens") - kept).alias("saved"))


@query(f"""with {TURNS}, a as (select session, sum(tokens) as total, count(*) as n from t group by session), x as (select t.*, total, row_number() over (partition by t.session order by seq desc) as k, sum(tokens) over (partition by t.session order by seq desc rows unbounded preceding) as run from t join a using (session)),
 one as (select *, case when total <= 60 or k <= 4 then 1 else 0 end as s1 from x), b as (select session, sum(tokens) filter (where s1 = 1) as t1 from one group by session) select one.session, seq from one join b using (session) where s1 = 1 and (t1 <= 60 or run <= 60)""")
def optimizer_chain(spark, d):
    """Trim to the last four turns, then cut to the budget; a bundle that fits is left alone by what follows."""
    return bundles.chain(turns(spark, d), 60, 4).select("session", "seq")


@query(f"with {NODES} select id, case when retracted then 'retracted' when created_at + interval 20 day < timestamp '{NOW}' and layer = 'STM' then 'expired' else 'kept' end as state from nd")
def retention_expiry(spark, d):
    return nodes(spark, d).select("id", F.when(F.col("retracted"), "retracted").when((F.col("layer") == "STM") & (F.expr("created_at + interval 20 day") < at(NOW)), "expired").otherwise("kept").alias("state"))


@query("with r as (select doc_id as id, quality, toxic, n_chars, doc_id % 5 = 0 as no_answer from documents join labels using (doc_id)) select count(*) as n_cases, count(*) filter (where no_answer) as n_abstention, round(avg(quality::double) filter (where not no_answer), 9) as evidence_precision, round(avg(toxic::double) filter (where not no_answer), 9) as noise_ratio, round(avg((toxic = 1)::int::double) filter (where no_answer), 9) as abstention_correctness from r")
def noise_metrics(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("no_answer", F.pmod("doc_id", F.lit(5)) == 0)
    mean = lambda c, where: F.round(F.avg(F.when(where, F.col(c).cast("double"))), 9)
    asked = ~F.col("no_answer")
    return r.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("no_answer")).alias("n_abstention"), mean("quality", asked).alias("evidence_precision"), mean("toxic", asked).alias("noise_ratio"),
                 mean("toxic", F.col("no_answer")).alias("abstention_correctness"))


@query(f"with {RANKED}, s as (select query_id, kind % 3 as session, min(rank) as pos from k30 group by 1, 2) select query_id, session, row_number() over (partition by query_id order by pos)::int as place from s")
def ordered_sessions(spark, d):
    """The sessions of each query's hits, once each, in the order in which they first appear."""
    s = _items(spark, d)[0].groupBy("query_id", "session").agg(F.min("rank").alias("pos"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).select("query_id", "session", "place")


@query(f"with {TURNS} select session, coalesce(string_agg(text, chr(10) order by seq) filter (where role = 'user'), '') as asked, coalesce(string_agg(text, chr(10) order by seq) filter (where role <> 'user'), '') as answered from t group by session")
def prompt_sections(spark, d):
    part = lambda where: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where & F.col("text").isNotNull(), F.struct("seq", "text")))), lambda x: x["text"]), "\n")
    return turns(spark, d).groupBy("session").agg(part(F.col("role") == "user").alias("asked"), part(F.col("role") != "user").alias("answered"))


@query(f"with {NODES}, fe as (select id, subject, attribute, value, coalesce(valid_from, created_at) as e from nd where invalidated_at is null and coalesce(valid_from, created_at) <= timestamp '{VALID}'), m as (select subject, attribute, count(*) as n, avg(value) as mean from fe group by all) select attribute, count(*) as owners, sum(n)::bigint as facts, round(avg(mean), 6) as mean from m group by attribute")
def ingest_report(spark, d):
    rows = memory.live(nodes(spark, d)).where(memory.effective_time() <= at(VALID)).groupBy("subject", "attribute").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("facts"), F.round(F.avg("mean"), 6).alias("mean"))


