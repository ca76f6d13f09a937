"""Queries of the memory table: reads, writes, forgetting, clocks, sessions, the graph of entities, and recall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scoring as sc
from tessera.operators import bundles, graph, index, memory, retrieval, temporal
from tessera.plans.catalog import FACTS, KNN, KNOWN, NOW, ORACLES, QUERIES, TURNS, VALID, _queries, query, us
from tessera.sources import store
from tessera.sources.shared import shared_folder
from tessera.sources.tables import edges, facts, nodes, table, turns, vectors

NODES = f"""{FACTS}, nd as (select id, namespace, subject, attribute, value, tag, importance, access_count, (['STM', 'MTM', 'LTM'])[id % 3 + 1] as layer, 0.5::double + (id % 5) * 0.1::double as confidence,
 attribute || ' is ' || floor(value)::bigint as text, recorded_at as created_at, case when id % 11 <> 0 then f.valid_from end as valid_from, lead(f.valid_from) over (partition by subject, attribute order by f.valid_from, recorded_at, id) as valid_to,
 case when id % 7 = 0 then recorded_at + interval 3 day end as invalidated_at, case when id % 4 = 0 then recorded_at + interval 1 day end as last_access, id % 35 = 0 as retracted from f)"""
LIVE = "select * from nd where invalidated_at is null"


def at(x: str):
    return temporal.at(x)


@query(f"with {NODES} select id, layer, importance from ({LIVE}) where namespace = 'ns1' and layer in ('MTM', 'LTM')")
def live_rows(spark, d):
    return memory.live(nodes(spark, d), "ns1", ["MTM", "LTM"]).select("id", "layer", "importance")


@query(f"with {NODES} select id from nd where created_at <= timestamp '{KNOWN}' and (invalidated_at is null or invalidated_at > timestamp '{KNOWN}')")
def known_at_rows(spark, d):
    return nodes(spark, d).where(temporal.known_at(at(KNOWN), "created_at")).select("id")


@query(f"with {NODES} select id from nd where valid_from <= timestamp '{VALID}' and timestamp '{VALID}' < valid_to")
def strict_interval_rows(spark, d):
    return nodes(spark, d).where((F.col("valid_from") <= at(VALID)) & (at(VALID) < F.col("valid_to"))).select("id")


@query(f"with {NODES} select id from nd where (created_at, id) > (timestamp '{VALID}', 5000)")
def keyset_after(spark, d):
    return memory.after_key(nodes(spark, d), at(VALID), F.lit(5000).cast("long")).select("id")


@query(f"with {NODES} select id from nd where created_at >= timestamp '{VALID}' and confidence >= 0.75")
def promotion_scope(spark, d):
    return memory.scope(nodes(spark, d), f"since:{VALID}").where("confidence >= 0.75").select("id")


HYGIENE = r"left(regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), 8000)"


@query(f"select doc_id as id, length({HYGIENE}) as n, md5({HYGIENE}) as digest from documents where {HYGIENE} <> ''")
def input_hygiene(spark, d):
    rows = memory.clean(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("select doc_id as id, greatest(0, least(100, doc_id % 300 - 100))::bigint as k from documents")
def clamped_k(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), memory.clamp_k(F.pmod("doc_id", F.lit(300)) - 100).cast("long").alias("k"))


@query("select doc_id as id from documents where text ilike '%a_t%e%'")
def substring_search(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%a_t%e%")).select(F.col("doc_id").alias("id"))


COLD = f"select id, coalesce(last_access, created_at) as cold from ({LIVE}) where coalesce(last_access, created_at) < timestamp '2024-02-05' and valid_to is not null and text ilike '%c%k%' and importance <= 0.6 and access_count <= 3"


@query(f"with {NODES} select id, epoch_us(cold) as cold from ({COLD}) order by cold, id limit 100")
def forget_policy(spark, d):
    gone = memory.forget(nodes(spark, d), unused_since=at("2024-02-05"), superseded_only=True, contains="c%k", max_importance=0.6, max_access=3, limit=100)
    return gone.select("id", us("cold"))


@query(f"with {NODES}, gone as ({COLD}) select namespace, count(*) as n, count(*) filter (where case when id in (select id from gone) and invalidated_at is null then true else invalidated_at is not null end) as closed from nd group by namespace")
def forget_apply(spark, d):
    rows = nodes(spark, d)
    gone = memory.forget(rows, unused_since=at("2024-02-05"), superseded_only=True, contains="c%k", max_importance=0.6, max_access=3)
    return memory.apply_forget(rows, gone, at(NOW)).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.count("invalidated_at").alias("closed"))


@query(f"with {NODES} select id, rank::int as rank from (select *, row_number() over (partition by tag order by valid_from desc nulls last, created_at desc, id) as rank from ({LIVE}) where tag = (select min(tag) from nd) and (valid_from is null or valid_from <= timestamp '{VALID}') and (valid_to is null or valid_to > timestamp '{VALID}'))")
def tag_lookup(spark, d):
    rows = nodes(spark, d)
    first = rows.agg(F.min("tag").alias("tag")).first()["tag"]
    return memory.by_tag(rows, F.lit(first), at(VALID)).select("id", "rank")


@query(f"""with {NODES}, b as (select *, valid_to is null or valid_to > timestamp '{VALID}' as open from ({LIVE}) where coalesce(valid_from, created_at) <= timestamp '{VALID}'),
 h as (select * from (select *, bool_or(open) over (partition by subject, attribute) as has_open from b) where open or not has_open),
 c as (select *, case when bool_and(valid_from is not null) over (partition by subject, attribute) then valid_from else created_at end as clock from h)
 select subject, attribute, arg_max(id, (clock, id)) as id, arg_max(value, (clock, id)) as value from c group by all""")
def current_value(spark, d):
    return memory.current(nodes(spark, d), ["subject", "attribute"], at(VALID))


@query(f"""with {NODES}, e as (select * from ({LIVE}) where contains(lower(text), 'click')), c as (select *, case when bool_and(valid_from is not null) over (partition by subject) then valid_from else created_at end as clock from e)
 select id, subject, row_number() over (partition by subject order by clock, id)::int as position from c where coalesce(valid_from, created_at) >= timestamp '2024-01-08' and coalesce(valid_from, created_at) <= timestamp '2024-02-10'""")
def entity_timeline(spark, d):
    rows = memory.live(nodes(spark, d)).where(F.contains(F.lower("text"), F.lit("click"))).withColumn("clock", memory.comparable_clock(["subject"]))
    inside = rows.where((memory.effective_time() >= at("2024-01-08")) & (memory.effective_time() <= at("2024-02-10")))
    return inside.select("id", "subject", F.row_number().over(Window.partitionBy("subject").orderBy("clock", "id")).alias("position"))


@query(f"with {NODES} select id, row_number() over (partition by subject order by invalidated_at desc, id)::int as position from nd where invalidated_at is not null and not retracted")
def superseded_history(spark, d):
    rows = nodes(spark, d).where("invalidated_at is not null and not retracted")
    return rows.select("id", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("invalidated_at"), "id")).alias("position"))


STM = f"{FACTS}, l as (select subject as session, id as seq, subject || '/' || (id % 40) as id, case when id % 97 = 0 then 'CLEAR' when id % 13 = 0 then 'DELETE' else 'APPEND' end as op from f)"


@query(f"with {STM}, x as (select *, max(seq) filter (where op = 'CLEAR') over (partition by session) as c, max(seq) filter (where op = 'DELETE') over (partition by session, id) as g from l) select session, id, seq from x where op = 'APPEND' and seq > coalesce(c, -1) and seq > coalesce(g, -1)")
def stm_append_clear(spark, d):
    f = facts(spark, d)
    op = F.when(F.pmod("id", F.lit(97)) == 0, "CLEAR").when(F.pmod("id", F.lit(13)) == 0, "DELETE").otherwise("APPEND")
    log = f.select(F.col("subject").alias("session"), F.col("id").alias("seq"), F.concat_ws("/", F.col("subject").cast("string"), F.pmod("id", F.lit(40)).cast("string")).alias("id"), op.alias("op"))
    return memory.append_and_clear(log).select("session", "id", "seq")


@query(f"with {NODES}, l as (select id, created_at + interval 5 day as seen from nd where id % 4 = 1 union all select id, created_at + interval 1 hour from nd where id % 6 = 1), s as (select id, count(*) as n, max(seen) as seen from l group by id) select nd.id, (access_count + coalesce(n, 0))::bigint as access_count, epoch_us(case when seen is null then last_access when last_access is null then seen else greatest(last_access, seen) end) as last_access from nd left join s using (id)")
def access_stats_bump(spark, d):
    rows = nodes(spark, d)
    log = rows.where("id % 4 = 1").select("id", F.expr("created_at + interval 5 day").alias("at")).unionByName(rows.where("id % 6 = 1").select("id", F.expr("created_at + interval 1 hour").alias("at")))
    return memory.bump_access(rows, log).select("id", F.col("access_count").cast("long").alias("access_count"), us("last_access"))


@query(f"with {FACTS} select subject, attribute, min(id) as session_id, count(*) as n from f group by all")
def session_get_or_create(spark, d):
    return memory.first_sessions(facts(spark, d), ["subject", "attribute"])


@query(f"with {TURNS}, s as (select session as sid, session % 7 as owner, session % 3 as agent from t group by all) select t.session, seq from t join s on session = sid where sid = 3 or (owner = 2 and agent = 1)")
def session_or_join(spark, d):
    t = turns(spark, d)
    s = t.select(F.col("session").alias("sid"), F.pmod("session", F.lit(7)).alias("owner"), F.pmod("session", F.lit(3)).alias("agent")).distinct()
    return t.join(s, F.col("session") == F.col("sid")).where("sid = 3 or (owner = 2 and agent = 1)").select("session", "seq")


@query("select doc_id as id, sha256(source || chr(0) || text) as key, row_number() over (partition by source, text order by doc_id) > 1 as hit from documents where text is not null")
def prompt_cache(spark, d):
    key = F.sha2(F.concat("source", F.lit("\0"), "text"), 256)
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), key.alias("key"))
    return rows.withColumn("hit", F.row_number().over(Window.partitionBy("key").orderBy("id")) > 1)


@query("select 1::bigint as version, count(*) as n from documents union all select 2, 0")
def clear_all(spark, d):
    """A store is emptied by publishing an empty snapshot; older versions stay readable."""
    root = shared_folder(spark, "store")
    rows = table(spark, d, "documents").select("doc_id", "source")
    counts = []
    for version, state in ((1, rows), (2, rows.where("false"))):
        store.publish(state, root, version)
        counts.append(store.current(spark, root).agg(F.lit(version).cast("long").alias("version"), F.count(F.lit(1)).alias("n")))
    return counts[0].unionByName(counts[1])


@query(f"with {NODES} select namespace, id % 50 as id, max(id) as seq from nd group by all")
def event_log_append(spark, d):
    """Two batches of events appended to the log, and the fold of what is there."""
    path = shared_folder(spark, "log")
    rows = nodes(spark, d).select("namespace", F.pmod("id", F.lit(50)).alias("key"), F.col("id").alias("seq"), F.col("created_at").alias("at"), "value")
    for part in (rows.where("seq % 2 = 0"), rows.where("seq % 2 <> 0")):
        store.append(part.withColumnRenamed("key", "id"), path)
    return store.fold_upserts(spark.read.parquet(path)).select("namespace", "id", "seq")


@query(f"with {NODES} select namespace, count(*) as total, count(*) filter (where invalidated_at is null) as live from nd group by namespace")
def live_count(spark, d):
    return nodes(spark, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("invalidated_at").isNull()).alias("live"))


@query(f"with {NODES}, a as (select 'ADD' as op, count(*) as n from nd where id % 3 = 0 union all select 'NOOP', count(*) from nd where id % 3 <> 0) select op, sum(n)::bigint as n from a group by op")
def audit_sink(spark, d):
    """Decisions appended to an audit table in two batches, and read back."""
    path = shared_folder(spark, "audit")
    rows = nodes(spark, d).select("id", F.when(F.pmod("id", F.lit(3)) == 0, "ADD").otherwise("NOOP").alias("op"))
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")):
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select vec_id, embedding::double[] as v, label from embeddings where vec_id % 20 <> 0), n as (select vec_id as id, embedding::double[] as q, label from embeddings where vec_id % 20 = 0)
 select n.id, max(list_cosine_similarity(q, v)) >= 0.3 as duplicate, round(max(list_cosine_similarity(q, v)), 9) as sim from n join s on n.label = s.label group by n.id""")
def mtm_dedupe_on_write(spark, d):
    """New blocks against the stored ones of their kind: a near enough neighbour makes a block a duplicate."""
    v = vectors(spark, d)
    new = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("kind").alias("query_kind"))
    best = retrieval.knn(new, v.where("id % 20 <> 0"), 1, same_kind=True)
    return best.select(F.col("query_id").alias("id"), (F.col("score") >= 0.3).alias("duplicate"), F.round("score", 9).alias("sim"))


# ---- intervals and supersession ----
@query(f"with {FACTS}, i as (select *, lead(valid_from) over (partition by subject, attribute order by valid_from, recorded_at, id) as vt from f), a as (select id as ask_id, subject, attribute, recorded_at as t from f where id % 20 = 0) select ask_id, i.id as fact_id from a join i on a.subject = i.subject and a.attribute = i.attribute and i.valid_from <= t and (vt is null or t < vt)")
def interval_join(spark, d):
    f = facts(spark, d)
    asked = f.where("id % 20 = 0").select(F.col("id").alias("ask_id"), "subject", "attribute", F.col("recorded_at").alias("t"))
    return temporal.as_of_join(asked, f, "t").where("fact_id is not null").select("ask_id", "fact_id")


@query(f"with {FACTS}, i as (select attribute, valid_from, lead(valid_from) over (partition by subject, attribute order by valid_from, recorded_at, id) as nx from f) select attribute, count(*) as n, count(nx) as superseded, round(avg((epoch_us(nx) - epoch_us(valid_from)) / 3600000000.0::double), 6) as mean_lag_hours from i group by attribute")
def supersession_lag(spark, d):
    i = temporal.intervals(facts(spark, d)).withColumn("lag", (F.unix_micros("valid_to") - F.unix_micros("valid_from")) / 3_600_000_000.0)
    return i.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.count("valid_to").alias("superseded"), F.round(F.avg("lag"), 6).alias("mean_lag_hours"))


@query(f"with {FACTS} select id, round(exp(-((epoch_us(max(valid_from) over (partition by subject)) - epoch_us(valid_from)) / 3600000000.0::double) / 168.0::double), 9) as recency from f")
def relative_recency(spark, d):
    newest = F.max("valid_from").over(Window.partitionBy("subject"))
    age = (F.unix_micros(newest) - F.unix_micros("valid_from")) / 3_600_000_000.0
    return facts(spark, d).select("id", F.round(F.exp(-age / sc.TAU_HOURS), 9).alias("recency"))


# ---- graph of entities ----
LINKS = "e as (select 'c' || c_custkey as source, 'n' || c_nationkey as target, 'LIVES' as predicate from customer union all select 's' || s_suppkey, 'n' || s_nationkey, 'LIVES' from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey, 'IN' from nation), nodes as (select 'n' || n_nationkey as id, n_name as name, n_nationkey % 5 <> 0 as live from nation union all select 'r' || r_regionkey, r_name, true from region)"


def _entities(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    return n.select(key("n", "n_nationkey"), F.col("n_name").alias("name"), (F.pmod("n_nationkey", F.lit(5)) != 0).alias("live")).unionByName(
        r.select(key("r", "r_regionkey"), F.col("r_name").alias("name"), F.lit(True).alias("live")))


def _links(spark, d):
    return edges(spark, d).where("predicate in ('LIVES', 'IN')").where("source not like 'r%'")


@query(f"with {LINKS} select source, target, name from e join nodes on target = id where live")
def live_edges(spark, d):
    return graph.live_edges(_links(spark, d), _entities(spark, d)).select("source", "target", "name")


@query(f"with {LINKS}, one as (select source as seed, target, 1 as depth, name from e join nodes on target = id where live and source like 'c%'), two as (select seed, e.target, 2, n.name from one join e on e.source = one.target join nodes n on n.id = e.target where n.live) select seed, target, depth::int as depth, name from (select * from one union all select * from two)")
def walk_hydrated(spark, d):
    links, entities = _links(spark, d), _entities(spark, d)
    seeds = links.where("source like 'c%'").select(F.col("source").alias("id")).distinct()
    return graph.walk(seeds, graph.live_edges(links, entities).drop("name"), 2, cap=500).join(entities.select(F.col("id").alias("target"), "name"), "target").select("seed", "target", "depth", "name")


# ---- recall ----
RANKED = f"{KNN}, k30 as (select query_id, id, kind, score, row_number() over (partition by query_id order by score desc, id) as rank from hits qualify rank <= 30)"


@query(f"with {RANKED}, p as (select a.query_id, a.id as a, b.id as b, list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as sim from k30 a join k30 b on a.query_id = b.query_id and a.rank < b.rank join embeddings x on x.vec_id = a.id join embeddings y on y.vec_id = b.id) select query_id, a, b, round(sim, 9) as sim from p where sim >= 0.25")
def bundle_pairs(spark, d):
    """Pairs of a query's hits that are alike; a bundle has a stated size, so its pairs are bounded."""
    return bundles.pairs(_bundle(spark, d), 0.25).select("query_id", "a", "b", F.round("sim", 9).alias("sim"))


def _bundle(spark, d):
    v = vectors(spark, d)
    hits = retrieval.knn(_queries(spark, d).drop("query_kind"), v, 30)
    return hits.join(v.select("id", "v"), "id").withColumns({"importance": F.pmod("id", F.lit(100)) / 100.0, "confidence": 0.5 + F.pmod("id", F.lit(5)) * 0.1})


@query()
def semantic_dedupe_greedy(spark, d):
    return bundles.dedupe(_bundle(spark, d), 0.25, 10).select("query_id", "id", "rank")


@query(f"""with {RANKED}, h as (select query_id, id, rank, case when id % 3 = 0 then null else kind % 4 end as attribute, case when id % 5 = 0 then null else timestamp '2024-01-01' + to_days((id % 60)::int) end as vf, timestamp '2024-03-01' + to_days((id % 37)::int) as ca from k30),
 c as (select *, case when bool_and(vf is not null) over (partition by query_id, attribute) then vf else ca end as clock from h),
 n as (select *, rank = min(rank) filter (where clock = mx) over (partition by query_id, attribute) as newest from (select *, max(clock) over (partition by query_id, attribute) as mx from c)),
 s as (select *, row_number() over (partition by query_id, attribute order by rank) as slot, row_number() over (partition by query_id, attribute order by newest desc, rank) as turn from n)
 select a.query_id, a.id, (case when a.attribute is null then a.rank else b.rank end)::int as position from s a join s b on a.query_id = b.query_id and a.attribute is not distinct from b.attribute and a.turn = b.slot""")
def current_version_reorder(spark, d):
    h = retrieval.knn(_queries(spark, d).drop("query_kind"), vectors(spark, d), 30)
    rows = h.select("query_id", "id", F.col("rank").alias("position"), F.when(F.pmod("id", F.lit(3)) != 0, F.pmod("kind", F.lit(4))).alias("attribute"),
                    F.when(F.pmod("id", F.lit(5)) != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(60)).cast("int")).cast("timestamp")).alias("valid_from"),
                    F.date_add(F.lit("2024-03-01").cast("date"), F.pmod("id", F.lit(37)).cast("int")).cast("timestamp").alias("created_at"))
    return memory.current_version_first(rows).select("query_id", "id", "position")


@query(f"with {RANKED}, l as (select query_id, id, 0 as k, rank from k30 where kind % 2 = 0 union all select query_id, id, 1, rank from k30), x as (select query_id, id, min((k, rank)) as m from l group by all) select query_id, id, position::int as position from (select *, row_number() over (partition by query_id order by m, id) as position from x) where position <= 16")
def merge_ordered_lists(spark, d):
    h = retrieval.knn(_queries(spark, d).drop("query_kind"), vectors(spark, d), 30)
    return memory.merge_lists([h.where("kind % 2 = 0"), h], 16)


#: The share of an index's lists that a query visits: vectors without clusters need most of them for a recall of 0.9.
PROBED = 0.7


@query()
def recall_approximate(spark, d):
    """Recall of the approximate index against exact search, for each query with an id divisible by 20."""
    q, v = _queries(spark, d).drop("query_kind"), vectors(spark, d)
    lists = index.build(v)
    return index.recall(index.search(q, lists, index.probes_for(lists, PROBED), 10), retrieval.knn(q, v, 10))


@query(f"with {KNN} select query_id, id, rank::int as rank, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, id) rank from hits) where rank <= 10")
def knn_index_all_lists(spark, d):
    """The index with all lists visited is exact search."""
    lists = index.build(vectors(spark, d))
    return index.search(_queries(spark, d), lists, len(lists.centroids), 10).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


@query(f"with {KNN}, r as (select query_id, kind = query_kind as ok, row_number() over (partition by query_id order by score desc, id) as rank from hits), b as (select query_id, " + ", ".join(f"max((ok and rank <= {k})::int) as r{k}" for k in (1, 4, 16)) + " from r group by query_id) select avg(r1::double) as r1, avg(r4::double) as r4, avg(r16::double) as r16 from b")
def recall_at_levels(spark, d):
    q = _queries(spark, d)
    hits = retrieval.knn(q.drop("query_kind"), vectors(spark, d), 16).join(q.select("query_id", "query_kind"), "query_id")
    best = hits.groupBy("query_id").agg(*[F.max(((F.col("kind") == F.col("query_kind")) & (F.col("rank") <= k)).cast("int")).alias(f"r{k}") for k in (1, 4, 16)])
    return best.agg(*[F.avg(f"r{k}").alias(f"r{k}") for k in (1, 4, 16)])


GATED = f"""{RANKED}, g as (select *, id % 100 / 100.0::double as importance, case id % 6 when 0 then 'user_preference' when 1 then 'task' when 2 then 'procedure' else 'fact' end as ct, id % 4 = 0 as urgent, id % 13 = 0 as restricted, id % 17 = 0 as expired,
 (['STM', 'MTM', 'LTM'])[id % 3 + 1] as layer from k30), b as (select *, least(1.0::double, score + case when ct = 'user_preference' then 0.10::double else 0.0::double end + case when ct = 'task' and urgent then 0.15::double else 0.0::double end + case when ct = 'procedure' and query_id % 2 = 0 then 0.10::double else 0.0::double end) as boosted from g where not restricted and not expired)"""


def _gated(spark, d):
    h = retrieval.knn(_queries(spark, d).drop("query_kind"), vectors(spark, d), 30)
    kind = F.element_at(F.array(*map(F.lit, ("user_preference", "task", "procedure", "fact", "fact", "fact"))), (F.pmod("id", F.lit(6)) + 1).cast("int"))
    layer = F.element_at(F.array(*map(F.lit, ("STM", "MTM", "LTM"))), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    rows = h.withColumns({"candidate_type": kind, "layer": layer, "urgent": F.pmod("id", F.lit(4)) == 0, "how": F.pmod("query_id", F.lit(2)) == 0,
                          "restricted": F.pmod("id", F.lit(13)) == 0, "expired": F.pmod("id", F.lit(17)) == 0})
    return bundles.boosted(bundles.gate(rows))


@query(f"with {GATED} select query_id, id, round(boosted, 9) as score from b")
def gate_and_boost(spark, d):
    return _gated(spark, d).select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"with {GATED}, p as (select *, row_number() over (partition by query_id order by round(boosted, 9) desc, id) as position from b) select query_id, id, row_number() over (partition by query_id order by position > 10, case when position <= 10 then -(id % 7) end, position)::int as position from p")
def rerank_head(spark, d):
    """The first 10 in the order of an injected score, the tail as it was."""
    return bundles.rerank(_gated(spark, d), 10, F.pmod("id", F.lit(7)).cast("double")).select("query_id", "id", "position")


@query(f"""with {GATED}, p as (select *, row_number() over (partition by query_id order by round(boosted, 9) desc, id) as position, 5 + id % 20 as tokens from b),
 u as (select *, sum(tokens) over (partition by query_id, layer order by position rows unbounded preceding) as used from p)
 select query_id, id, layer, row_number() over (partition by query_id order by case layer when 'LTM' then 1 when 'MTM' then 2 else 3 end, position)::int as place from u where used <= case layer when 'LTM' then 60 else 40 end""")
def assemble_by_layer(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    rows = _gated(spark, d).withColumn("position", F.row_number().over(w)).withColumn("tokens", 5 + F.pmod("id", F.lit(20)))
    return bundles.assemble(rows, {"LTM": 60, "MTM": 40, "STM": 40}).select("query_id", "id", "layer", "place")


@query(f"""with h as ({ORACLES['hybrid_retrieve']}), g as (select *, case id % 6 when 0 then 'user_preference' when 1 then 'task' when 2 then 'procedure' else 'fact' end as ct, (['STM', 'MTM', 'LTM'])[id % 3 + 1] as layer, 5 + id % 20 as tokens from h where id % 13 <> 0 and id % 17 <> 0),
 b as (select *, round(least(1.0::double, score + case when ct = 'user_preference' then 0.10::double else 0 end + case when ct = 'task' and id % 4 = 0 then 0.15::double else 0 end + case when ct = 'procedure' and id % 5 = 0 then 0.10::double else 0 end), 9) as boosted from g),
 p as (select *, row_number() over (partition by query_id order by boosted desc, id) as p from b), r as (select *, row_number() over (partition by query_id order by p > 5, case when p <= 5 then -(id % 7) end, p) as position from p),
 u as (select *, sum(tokens) over (partition by query_id, layer order by position rows unbounded preceding) as used from r)
 select query_id, id, layer, position::int as position, boosted as score, row_number() over (partition by query_id order by case layer when 'LTM' then 1 when 'MTM' then 2 else 3 end, position)::int as place from u where used <= case layer when 'LTM' then 40 else 25 end""")
def retrieve_pipeline(spark, d):
    """One call from queries to a context: both channels, fusion and score, then hydration, gate, boosts, rerank and assembly."""
    n = lambda k: F.pmod("id", F.lit(k))
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (n(k) + 1).cast("int"))
    attributes = vectors(spark, d).select(
        "id", pick(("user_preference", "task", "procedure", "fact", "fact", "fact"), 6).alias("candidate_type"), pick(("STM", "MTM", "LTM"), 3).alias("layer"), (n(4) == 0).alias("urgent"),
        (n(5) == 0).alias("how"), (n(13) == 0).alias("restricted"), (n(17) == 0).alias("expired"), (5 + n(20)).alias("tokens"))
    out = bundles.retrieved(QUERIES["hybrid_retrieve"](spark, d).select("query_id", "id", "score"), attributes, 5, n(7).cast("double"), {"LTM": 40, "MTM": 25, "STM": 25})
    return out.select("query_id", "id", "layer", "position", F.round("score", 9).alias("score"), "place")
