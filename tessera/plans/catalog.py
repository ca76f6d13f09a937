"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as sc
from tessera.functions import text as tx
from tessera.operators import blocks, budget, evaluation, graph, policy, promotion, retrieval, synthesis, temporal
from tessera.plans.literals import ANSWERS, STRUCTURED, VOTES, values
from tessera.sources import store
from tessera.sources.shared import shared_folder
from tessera.sources.tables import edges, facts, table, turns, vectors

FLAGSHIP = "hybrid_retrieve"
QUERIES, ORACLES = {}, {}
#: Events lie in January 2024 and are recorded until the end of February.
VALID, KNOWN = "2024-01-15 00:00:00", "2024-01-20 00:00:00"
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


def us(c: str):
    return F.unix_micros(c).alias(c)


FACTS = """f as (select event_id as id, 'ns' || (user_id % 3) as namespace, user_id as subject, event_type as attribute, value, ts as valid_from,
 ts + to_days(((event_id * 37) % 30)::int) as recorded_at, (event_id % 100) / 100.0::double as importance, (event_id % 5)::int as access_count,
 json_extract_string(props, '$.k') as tag, props from events)"""
TURNS = r"""t as (select conv_id as session, turn as seq, role, text, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::bigint as tokens from conversations)"""
LATEST = """select subject, attribute, id, value, epoch_us(valid_from) as valid_from, epoch_us(recorded_at) as recorded_at from
 (select *, row_number() over (partition by subject, attribute order by valid_from desc, recorded_at desc, id desc) k from f where {}) where k = 1"""


def _facts_out(df: DataFrame) -> DataFrame:
    return df.select("subject", "attribute", "id", "value", us("valid_from"), us("recorded_at"))


# ---- bi-temporal ----
@query(f"with {FACTS} " + LATEST.format(f"valid_from <= timestamp '{VALID}'"))
def bitemporal_asof_valid(spark, d):
    return _facts_out(temporal.as_of(facts(spark, d), valid=VALID))


@query(f"with {FACTS} " + LATEST.format(f"recorded_at <= timestamp '{KNOWN}'"))
def bitemporal_asof_known(spark, d):
    return _facts_out(temporal.as_of(facts(spark, d), known=KNOWN))


@query(f"with {FACTS} " + LATEST.format(f"valid_from <= timestamp '{VALID}' and recorded_at <= timestamp '{KNOWN}'"))
def bitemporal_asof_both(spark, d):
    return _facts_out(temporal.as_of(facts(spark, d), VALID, KNOWN))


@query(f"with {FACTS} select id, epoch_us(valid_from) as valid_from, epoch_us(lead(valid_from) over w) as valid_to, lead(id) over w as superseded_by from f window w as (partition by subject, attribute order by valid_from, recorded_at, id)")
def validity_intervals(spark, d):
    return temporal.intervals(facts(spark, d)).select("id", us("valid_from"), us("valid_to"), "superseded_by")


@query(f"with {FACTS}, i as (select *, lead(id) over (partition by subject, attribute order by valid_from, recorded_at, id) nx from f) select attribute, count(*) as n, count(*) filter (where nx is not null) as superseded, avg((nx is not null)::int::double) as ratio from i group by attribute")
def supersession_ratio(spark, d):
    gone = F.col("superseded_by").isNotNull()
    return temporal.intervals(facts(spark, d)).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("superseded"), F.avg(gone.cast("int")).alias("ratio"))


@query(f"with {FACTS}, i as (select *, lead(valid_from) over (partition by subject, attribute order by valid_from, recorded_at, id) vt from f) select id, subject, attribute, value from i where valid_from <= timestamp '{VALID}' and (vt is null or vt > timestamp '{VALID}')")
def valid_interval_filter(spark, d):
    return temporal.intervals(facts(spark, d)).where(temporal.valid_at(temporal.at(VALID))).select("id", "subject", "attribute", "value")


@query(f"with {FACTS} select id, subject, attribute, value, epoch_us(valid_from) as valid_from from f where valid_from >= timestamp '2024-01-10' and valid_from < timestamp '2024-01-12'")
def timeline_window(spark, d):
    return temporal.timeline(facts(spark, d), "2024-01-10", "2024-01-12").select("id", "subject", "attribute", "value", us("valid_from"))


@query(f"with {FACTS}, a as (select id as ask_id, subject, attribute, recorded_at as t from f where id % 20 = 0) select ask_id, a.subject, a.attribute, arg_max(f.id, (f.valid_from, f.recorded_at, f.id)) as fact_id, arg_max(f.value, (f.valid_from, f.recorded_at, f.id)) as value from a left join f on a.subject = f.subject and a.attribute = f.attribute and f.valid_from <= a.t group by all")
def asof_join_queries(spark, d):
    f = facts(spark, d)
    asked = f.where("id % 20 = 0").select(F.col("id").alias("ask_id"), "subject", "attribute", F.col("recorded_at").alias("t"))
    return temporal.as_of_join(asked, f, "t")


@query(f"with {FACTS} select user_id.subject as subject, coalesce(x.id, -1) as id from (select distinct subject from f) user_id left join (select subject, arg_max(id, (valid_from, recorded_at, id)) id from f where attribute = (select min(attribute) from f) and valid_from <= timestamp '2024-01-03' group by subject) x using (subject)")
def current_or_absent(spark, d):
    f = facts(spark, d)
    first = f.agg(F.min("attribute").alias("attribute"))
    one = f.join(F.broadcast(first), "attribute", "left_semi")  # one row
    found = temporal.as_of(one, valid="2024-01-03 00:00:00", keys=("subject",)).select("subject", "id")
    return f.select("subject").distinct().join(found, "subject", "left").select("subject", F.coalesce("id", F.lit(-1)).alias("id"))


@query(f"with {FACTS} select id, epoch_us(valid_from) as valid_from, importance from f where valid_from < timestamp '2024-01-12' and importance <= 0.3 and access_count <= 1 order by valid_from, id limit 100")
def prune_dry_run(spark, d):
    rows = facts(spark, d).withColumn("last_access", F.lit(None).cast("timestamp"))
    return temporal.prune(rows, "2024-01-12", 0.3, 1, 100).select("id", us("valid_from"), "importance")


@query(f"with {FACTS} select id, subject, rank from (select *, row_number() over (partition by subject order by importance desc, valid_from desc, id desc)::int as rank from f) where rank > 20")
def per_user_cap(spark, d):
    return temporal.over_cap(facts(spark, d), "subject", 20).select("id", "subject", "rank")


# ---- event log ----
def _log(spark, d):
    return facts(spark, d).select("namespace", F.concat_ws("/", F.col("subject").cast("string"), "attribute").alias("id"), F.col("id").alias("seq"), F.col("valid_from").alias("at"), "value", "tag",
                                  F.when(F.pmod("id", F.lit(7)) == 0, "INVALIDATE").when(F.pmod("id", F.lit(3)) == 0, "PATCH").otherwise("ADD").alias("op"))


LOG = f"{FACTS}, l as (select namespace, subject || '/' || attribute as id, id as seq, valid_from as happened, value, tag, case when id % 7 = 0 then 'INVALIDATE' when id % 3 = 0 then 'PATCH' else 'ADD' end as op from f)"


@query(f"with {LOG} select namespace, id, max(seq) as seq, arg_max(value, seq) as value, epoch_us(arg_max(happened, seq)) as updated_at, epoch_us(min(happened)) as created_at from l group by namespace, id")
def upsert_fold(spark, d):
    return store.fold_upserts(_log(spark, d)).select("namespace", "id", "seq", "value", us("updated_at"), us("created_at"))


@query(f"with {LOG}, p as (select *, case when seq % 2 = 0 then value end as v2, case when seq % 3 = 0 then tag end as t2 from l) select namespace, id, arg_max(v2, seq) filter (where v2 is not null) as value, arg_max(t2, seq) filter (where t2 is not null) as tag from p group by namespace, id")
def patch_fold(spark, d):
    p = _log(spark, d).withColumns({"value": F.when(F.pmod("seq", F.lit(2)) == 0, F.col("value")), "tag": F.when(F.pmod("seq", F.lit(3)) == 0, F.col("tag"))})
    return store.fold_patches(p, ["value", "tag"])


@query(f"with {LOG} select namespace, id, epoch_us(min(happened) filter (where op = 'INVALIDATE')) as invalidated_at from l group by namespace, id")
def invalidate_idempotent(spark, d):
    return store.fold_invalidations(_log(spark, d)).select("namespace", "id", us("invalidated_at"))


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("namespace"), F.col("lang").alias("kind"), "text", "n_chars")


@query("select source as namespace, text, count(*) - 1 as access_count, max(n_chars) as last_access, min(doc_id) as id from documents group by all")
def touch_duplicate_fold(spark, d):
    return store.touch_duplicates(_texts(spark, d), "text", "n_chars")


@query("select doc_id as id, source as namespace, row_number() over (partition by source, md5(text) order by n_chars desc, doc_id)::int as rank from documents")
def live_text_dedupe(spark, d):
    return store.live_text_dedupe(_texts(spark, d), "text", [F.desc("n_chars"), F.col("id")]).select("id", "namespace", "rank")


@query("select d.doc_id as id from documents d left join embeddings e on e.vec_id = d.doc_id where e.vec_id is null and d.text <> '' order by n_chars, doc_id limit 50")
def missing_embeddings(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return _texts(spark, d).where("text <> ''").join(have, "id", "left_anti").orderBy("n_chars", "id").limit(50).select("id")


@query("select d.doc_id as id, coalesce(len(e.embedding), 0)::int as dim from documents d left join embeddings e on e.vec_id = d.doc_id")
def fill_embeddings(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"))
    return _texts(spark, d).select("id").join(have, "id", "left").select("id", F.coalesce("dim", F.lit(0)).alias("dim"))


def _published(spark, state):
    root = shared_folder(spark, "store")
    store.publish(state, root, 1)
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(state, "row").unionByName(count(store.current(spark, root), "snapshot"))


@query("select 'row' as kind, count(*) as n from documents union all select 'snapshot', count(*) from documents")
def snapshot_publish(spark, d):
    return _published(spark, _texts(spark, d))


# ---- tags ----
@query(f"with {FACTS} select id from f where json_extract_string(props, '$.k') = (select min(json_extract_string(props, '$.k')) from events)")
def tag_containment(spark, d):
    f = facts(spark, d)
    return f.join(F.broadcast(f.agg(F.min("tag").alias("tag"))), "tag", "left_semi").select("id")  # one row


@query(f"with {FACTS} select id, tag is not null as has_k, json_extract_string(props, '$.missing') is not null as has_missing from f")
def tag_key_exists(spark, d):
    return facts(spark, d).select("id", F.col("tag").isNotNull().alias("has_k"), F.get_json_object("props", "$.missing").isNotNull().alias("has_missing"))


@query(f"with {FACTS} select id, coalesce(tag, 'default') as k, case when id % 2 = 0 then 'seen' end as mark from f")
def tag_set_if_absent(spark, d):
    has = F.create_map(F.lit("k"), F.col("tag"))
    tags = F.map_concat(F.map_filter(has, lambda _, v: v.isNotNull()), F.when(F.col("tag").isNull(), F.create_map(F.lit("k"), F.lit("default"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return facts(spark, d).withColumn("tags", tags).select("id", F.col("tags")["k"].alias("k"), F.when(F.pmod("id", F.lit(2)) == 0, "seen").alias("mark"))


# ---- vectors and retrieval ----
def _queries(spark, d):
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("kind").alias("query_kind"))


KNN = """q as (select vec_id as query_id, embedding::double[] as q, label as query_kind from embeddings where vec_id % 20 = 0),
 hits as (select query_id, vec_id as id, label as kind, query_kind, list_cosine_similarity(q, embedding::double[]) as score from q, embeddings where vec_id <> query_id)"""


ALL_KNN = KNN.replace(" where vec_id % 20 = 0", "")


@query(f"with {KNN} select query_id, id, rank::int as rank, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, id) rank from hits) where rank <= 10")
def knn_cosine_topk(spark, d):
    return retrieval.knn(_queries(spark, d).drop("query_kind"), vectors(spark, d), 10).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


@query(f"with {KNN} select query_id, id, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) rank from hits where kind = query_kind) where rank <= 5")
def knn_within_kind(spark, d):
    return retrieval.knn(_queries(spark, d), vectors(spark, d), 5, same_kind=True).select("query_id", "id", "rank")


GRAM = r"""g as (select doc_id, list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) as grams from documents where text is not null)"""


@query(f"with {GRAM}, p as (select a.doc_id as query_id, b.doc_id as id, len(list_intersect(a.grams, b.grams)) as c, len(a.grams) as na, len(b.grams) as nb from g a, g b where a.doc_id % 20 = 0), s as (select *, c / (na + nb - c)::double as score from p where c > 0) select query_id, id, rank::int as rank, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, id) rank from s where score >= 0.25) where rank <= 5")
def trigram_topk(spark, d):
    rows, asked = (blocks.with_grams(t) for t in (_texts(spark, d), _texts(spark, d).where("id % 20 = 0")))
    asked = asked.withColumnRenamed("id", "query_id")
    return retrieval.trigram_topk(asked, rows, 5, 0.25).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


ASKED = [(1, "the and tion"), (2, "der die das licensed"), (3, "que de la"), (4, "apache")]


@query(f"""with q(query_id, text) as {values(ASKED)}, docs as (select doc_id as id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as t from documents), st as (select count(*) as n, avg(len(t)) as av from docs),
 tk as (select id, len(t) as l, unnest(t) as term from docs), tf as (select id, l, term, count(*) as tf from tk group by all), df as (select term, count(*) as df from tf group by term),
 qt as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from q),
 s as (select query_id, id, sum(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * l / av))) as score from qt join tf using (term) join df using (term), st group by all)
 select query_id, id, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s) where rank <= 10""")
def bm25_topk(spark, d):
    asked = spark.sql(f"select * from {values(ASKED)} as q(query_id, text)")
    return retrieval.bm25(asked, _texts(spark, d), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""with {KNN}, dense as (select query_id, id, row_number() over (partition by query_id order by score desc, id) r1 from hits qualify r1 <= 30),
 near as (select query_id, id, row_number() over (partition by query_id order by abs(id - query_id), id) r2 from hits qualify r2 <= 30),
 u as (select query_id, id, r1 as r from dense union all select query_id, id, r2 from near), z as (select query_id, id, sum(1.0::double / (60 + r)) as rrf, min(r) as best from u group by all)
 select query_id, id, position::int as position, round(rrf, 9) as rrf from (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, best, id) position from z) where position <= 10""")
def rrf_two_channel(spark, d):
    q, m = _queries(spark, d).drop("query_kind"), vectors(spark, d)
    dense = retrieval.knn(q, m, 30)
    # the 30 nearest ids lie within 30 places on either side
    near = retrieval.neighbours_by_id(q.select("query_id"), m.select("id"), 30)
    return retrieval.fuse([dense, near], 10).select("query_id", "id", "position", F.round("rrf", 9).alias("rrf"))


@query(f"""with {KNN}, {GRAM}, m as (select vec_id as id, (vec_id % 100) / 100.0::double as importance, (vec_id % 500)::double as age, (vec_id % 5) as acc from embeddings join g on doc_id = vec_id),
 dense as (select query_id, id, row_number() over (partition by query_id order by score desc, id) r from hits where id in (select id from m) and query_id in (select id from m) qualify r <= 30),
 p as (select a.doc_id as query_id, b.doc_id as id, len(list_intersect(a.grams, b.grams)) as c, len(a.grams) as na, len(b.grams) as nb from g a, g b where a.doc_id in (select query_id from q) and a.doc_id in (select id from m) and b.doc_id in (select id from m)),
 lex as (select * from (select query_id, id, row_number() over (partition by query_id order by c / (na + nb - c)::double desc, id) r from p where c > 0 and c / (na + nb - c)::double >= 0.05) where r <= 30 and id <> query_id),
 u as (select * from dense union all select * from lex), z as (select query_id, id, sum(1.0::double / (60 + r)) rrf, min(r) best from u group by all),
 zz as (select * from (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, best, id) position from z) where position <= 30),
 n as (select zz.*, min(rrf) over w lo, max(rrf) over w hi, importance, age, acc from zz join m using (id) window w as (partition by query_id)),
 s as (select query_id, id, greatest(0.0::double, least(1.0::double, 0.45::double * (case when hi = lo then 1.0 else (rrf - lo) / (hi - lo) end) + 0.25::double * importance + 0.2::double * least(1.0::double, exp(-age / 168.0::double) * (1.0::double + ln(1.0::double + acc))) + 0.1::double)) as score from n)
 select query_id, id, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s) where rank <= 10""")
def hybrid_retrieve(spark, d):
    v = vectors(spark, d)
    t = _texts(spark, d).join(v.select("id"), "id", "left_semi")
    m = v.join(blocks.with_grams(t), "id").withColumns({
        "importance": F.pmod("id", F.lit(100)) / 100.0, "age_hours": F.pmod("id", F.lit(500)).cast("double"), "access_count": F.pmod("id", F.lit(5))})
    q = v.where("id % 20 = 0").join(blocks.with_grams(t.where("id % 20 = 0")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "grams")
    return retrieval.hybrid(q, m, 10, 30).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"with {KNN}, r as (select *, row_number() over (partition by query_id order by score desc, id) rank from hits), t as (select query_id, count(*) filter (where kind = query_kind) as n_rel from hits group by query_id) select t.query_id, (count(*) filter (where rank <= 10 and kind = query_kind) / least(n_rel, 10))::double as recall from t join r using (query_id) group by t.query_id, n_rel")
def recall_at_k(spark, d):
    q, m = _queries(spark, d), vectors(spark, d)
    hits = retrieval.knn(q.drop("query_kind"), m, 10).join(q.select("query_id", "query_kind"), "query_id").withColumn("relevant", F.col("kind") == F.col("query_kind"))
    kinds = m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = q.join(kinds, F.col("kind") == F.col("query_kind")).select("query_id", (F.col("n") - 1).alias("n_relevant"))
    return evaluation.recall_at(hits, 10, total)


# ---- scores ----
@query(f"with {FACTS}, a as (select id, importance, access_count, (epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 3600000000.0::double as age from f) select id, round(least(1.0::double, exp(-greatest(age, 0.0::double) / 168.0::double) * (1.0::double + ln(1.0::double + access_count))), 9) as recency, round(pow(2.0::double, -age / 168.0::double), 9) as half_life from a")
def recency_decay(spark, d):
    f = facts(spark, d).withColumn("age", (F.unix_micros(temporal.at(NOW)) - F.unix_micros("valid_from")) / 3_600_000_000.0)
    return f.select("id", F.round(sc.recency(F.col("age"), F.col("access_count")), 9).alias("recency"), F.round(sc.half_life(F.col("age")), 9).alias("half_life"))


@query(f"with {FACTS}, a as (select id, importance, value, least(1.0::double, exp(-greatest((epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 3600000000.0::double, 0.0::double) / 168.0::double) * (1.0::double + ln(1.0::double + access_count))) as rec, min(value) over w lo, max(value) over w hi, case id % 3 when 0 then 'STM' when 1 then 'MTM' else 'LTM' end as layer from f window w as (partition by subject)), s as (select *, least(1.0::double, greatest(0.0::double, 0.45::double * (case when hi = lo then 1.0 else (value - lo) / (hi - lo) end) + 0.25::double * importance + 0.2::double * rec + 0.1::double)) as score from a) select id, round(score, 9) as score, round(score * case layer when 'STM' then 1.05::double when 'LTM' then 1.1::double else 1.0::double end, 9) as boosted from s")
def composite_score(spark, d):
    w = Window.partitionBy("subject")
    f = facts(spark, d).withColumn("relevance", sc.minmax(F.col("value"), F.min("value").over(w), F.max("value").over(w), 1.0))
    layer = F.element_at(F.array(F.lit("STM"), F.lit("MTM"), F.lit("LTM")), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    age = (F.unix_micros(temporal.at(NOW)) - F.unix_micros("valid_from")) / 3_600_000_000.0
    f = f.withColumn("score", sc.composite(F.col("relevance"), F.col("importance"), sc.recency(age, F.col("access_count")), F.lit(1.0)))
    return f.select("id", F.round("score", 9).alias("score"), F.round(sc.layer_boost(F.col("score"), layer), 9).alias("boosted"))


@query(f"with {FACTS} select id, case when importance >= 0.875 then 'CRITICAL' when importance >= 0.625 then 'HIGH' when importance >= 0.375 then 'NORMAL' else 'LOW' end as level from f")
def importance_levels(spark, d):
    return facts(spark, d).select("id", sc.importance_level(F.col("importance")).alias("level"))


@query(f"with {TURNS}, s as (select session, sum(tokens)::bigint + 512 as total from t group by session), r as (select *, least(1024, total // 4)::bigint as reserve from s) select session, total, reserve, ((total - reserve) // 3)::bigint as stm, (total - reserve - 2 * ((total - reserve) // 3))::bigint as ltm from r")
def budget_split(spark, d):
    s = turns(spark, d).groupBy("session").agg((F.sum("tokens") + 512).alias("total")).withColumn("b", sc.budget_split(F.col("total")))
    return s.select("session", "total", "b.reserve", "b.stm", "b.ltm")


# ---- graph ----
EDGES = "e as (select 'n' || n_nationkey as source, 'r' || n_regionkey as target from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'o' || o_orderkey, 'c' || o_custkey from orders union all (select distinct 'o' || l_orderkey, 'p' || l_partkey from lineitem) union all (select distinct 'o' || l_orderkey, 's' || l_suppkey from lineitem) union all select 'r' || n_regionkey, 'n' || min(n_nationkey) from nation group by n_regionkey)"


@query(f"with recursive {EDGES}, w as (select 'o' || o_orderkey as seed, 'o' || o_orderkey as target, 0 as depth, ['o' || o_orderkey] as path from orders union all select seed, e.target, depth + 1, list_append(path, e.target) from w join e on e.source = w.target where depth < 5 and not list_contains(path, e.target)) select seed, target, depth::int as depth, array_to_string(path, '>') as path from w where depth > 0")
def graph_walk_cycle_guard(spark, d):
    seeds = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.walk(seeds, edges(spark, d), 5).select("seed", "target", "depth", F.concat_ws(">", "path").alias("path"))


HITS = "h as (select r_regionkey as query_id, 'c' || c_custkey as id, row_number() over (partition by r_regionkey order by c_acctbal desc, c_custkey) as rank from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey qualify rank <= 20)"


@query(f"with {EDGES}, {HITS} select distinct h.query_id, e.target as id, 0.0::double as score from h join e on e.source = h.id where rank <= 5 and not exists (select 1 from h x where x.query_id = h.query_id and x.id = e.target)")
def graph_expand(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    hits = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_acctbal", "c_custkey")
    return graph.expand(retrieval.rank_by(hits, F.desc("c_acctbal"), 20, ("c_custkey",)), edges(spark, d), 5)


# ---- budgets ----
RUN = "select *, sum(tokens) over (partition by session order by seq desc rows unbounded preceding) as running, row_number() over (partition by session order by seq desc) as position from t"


@query(f"with {TURNS} select session, seq, running::bigint as running from ({RUN}) where running <= 60")
def stm_window_budget(spark, d):
    return budget.within_budget(turns(spark, d), 60).select("session", "seq", "running")


@query(f"with {TURNS} select session, seq, running::bigint as running from ({RUN}) where position = 1 or (running <= 40 and running - tokens < 40)")
def mtm_recent_budget(spark, d):
    return budget.within_budget_keep_first(turns(spark, d), 40).select("session", "seq", "running")


@query(f"with {TURNS} select session, seq, position::int as position from ({RUN}) where position <= 3")
def stm_recent_n(spark, d):
    return budget.last_n(turns(spark, d), 3).select("session", "seq", "position")


@query(f"with {TURNS} select session, count(*) as turns, sum(tokens)::bigint as tokens, sum(tokens) / 3584.0::double as utilization, greatest(0, 3584 - sum(tokens))::bigint as remaining from t group by session")
def stm_stats(spark, d):
    return budget.stats(turns(spark, d), 4096, 512).withColumn("remaining", F.col("remaining").cast("long"))


@query(f"with {TURNS}, x as (select *, (session * 31 + seq * 17) % 100 as score, sum(tokens) over (partition by session) - 80 as over_by from t), y as (select *, sum(tokens) over (partition by session order by score, seq rows unbounded preceding) - tokens as before from x) select session, seq from y where not (over_by > 0 and before < over_by)")
def score_prune_to_fit(spark, d):
    items = turns(spark, d).withColumn("score", F.pmod(F.col("session") * 31 + F.col("seq") * 17, F.lit(100)))
    return budget.prune_to_fit(items, 80).select("session", "seq")


@query(f"with {TURNS} select session, count(*) as folded, substr(string_agg(text, ' | ' order by seq), 1, 200) as summary from ({RUN}) where position > 2 group by session")
def stm_trim_concat(spark, d):
    return budget.trim(turns(spark, d), 2, 200)


@query(f"with {TURNS} select session, seq, sum(tokens) over w::bigint as window_tokens, count(*) over w as window_turns from t window w as (partition by session order by seq rows between 2 preceding and 2 following)".replace("over w::bigint", "over w"))
def evidence_window_rows(spark, d):
    return budget.evidence_window(turns(spark, d), 2).select("session", "seq", "window_tokens", "window_turns")


@query(f"with {TURNS}, x as (select *, row_number() over (partition by session order by tokens desc, seq) / count(*) over (partition by session)::double as share from t) select session, seq, case when share <= 0.15 then 1 when share <= 0.40 then 2 else 3 end as tier from x")
def rank_position_tiers(spark, d):
    return budget.position_tiers(turns(spark, d).withColumn("score", F.col("tokens"))).select("session", "seq", "tier")


@query(f"with {TURNS} select role, count(*) as turns, sum(tokens)::bigint as tokens from t group by rollup(role)")
def tier_breakdown(spark, d):
    return turns(spark, d).rollup("role").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))


@query(f"with {TURNS}, s as (select session, max(tokens) as best from t group by session), r as (select *, row_number() over (order by best desc, session) as session_rank from s), x as (select t.session, t.seq, session_rank, row_number() over (partition by t.session order by tokens desc, seq) as turn_rank from t join r using (session) where session_rank <= 4) select session, seq, session_rank::int as session_rank, turn_rank::int as turn_rank from x where turn_rank <= 2")
def session_aware_topk(spark, d):
    t = turns(spark, d)
    best = t.groupBy("session").agg(F.max("tokens").alias("best")).orderBy(F.desc("best"), "session").limit(4)  # the top-k of the report
    ranked = best.withColumn("session_rank", F.row_number().over(Window.orderBy(F.desc("best"), "session")))
    w = Window.partitionBy("session").orderBy(F.desc("tokens"), "seq")
    return t.join(F.broadcast(ranked), "session").withColumn("turn_rank", F.row_number().over(w)).where("turn_rank <= 2").select("session", "seq", "session_rank", "turn_rank")


@query(f"with {TURNS}, s as (select session, sum(tokens)::bigint as total from t group by session) select session, total, case when total <= 60 then 'long' when total <= 200 then 'auto' else 'topk' end as mode from s")
def mode_by_fit(spark, d):
    s = turns(spark, d).groupBy("session").agg(F.sum("tokens").alias("total"))
    return s.withColumn("mode", F.when(F.col("total") <= 60, "long").when(F.col("total") <= 200, "auto").otherwise("topk"))


@query("select conv_id as session, turn as seq, text from conversations where text is not null and trim(text) <> '' qualify row_number() over (partition by conv_id, lower(trim(text)) order by turn) = 1")
def assemble_bundle_dedupe(spark, d):
    t = turns(spark, d).where("text is not null and trim(text) <> ''").withColumn("key", F.lower(F.trim("text")))
    return t.withColumn("k", F.row_number().over(Window.partitionBy("session", "key").orderBy("seq"))).where("k = 1").select("session", "seq", "text")


# ---- policies ----
def _candidates(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    names = F.array(*[F.lit(t) for t in policy.TYPES])
    kind = F.element_at(names, (F.pmod("doc_id", F.lit(len(policy.TYPES))) + 1).cast("int"))
    until = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.timestamp_micros(F.unix_micros(temporal.at(VALID)) + F.pmod("doc_id", F.lit(60)) * 86_400_000_000))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").select(F.col("doc_id").alias("id"), kind.alias("candidate_type"), "toxic", "text", until.alias("valid_until"))
    return rows.withColumn("sensitivity", policy.sensitivity(F.col("candidate_type"), F.col("toxic")))


CAND = f"c as (select doc_id as id, ({policy.TYPES!r})[doc_id % {len(policy.TYPES)} + 1] as candidate_type, case when toxic = 1 then 'confidential' when doc_id % {len(policy.TYPES)} = 11 then 'restricted' else 'private' end as sensitivity, text, case when doc_id % 2 = 0 then timestamp '{VALID}' + to_days((doc_id % 60)::int) end as until from documents join labels using (doc_id))"
# written out by hand: what each policy returns
PLAN = f"""p as (
 select id, 'sensitivity_v1' as policy, 100 as priority, case when sensitivity = 'restricted' or candidate_type = 'sensitive_data' then 'ask_user' else 'store' end as action, 'ltm' as scope, 'archive' as on_expiry, 'ignore_duplicate' as upd, 'ask_user' as con,
  sensitivity = 'restricted' or candidate_type = 'sensitive_data' as approval, true as redact, true as encrypt, false as xs, false as team, false as ev, null::bigint as ttl, null::bigint as expires, ['canonical'] as proj from c where candidate_type = 'sensitive_data' or sensitivity in ('confidential', 'restricted')
 union all select id, 'correction_v1', 85, 'supersede', 'ltm', 'mark_expired', 'supersede', 'supersede_old', false, false, false, true, false, true, null, null, ['canonical', 'vector', 'temporal'] from c where candidate_type = 'correction'
 union all select id, 'decision_v1', 80, 'store', 'ltm', 'mark_expired', 'supersede', 'supersede_old', false, false, false, true, false, true, null, null, ['canonical', 'vector', 'temporal'] from c where candidate_type in ('decision', 'code_decision')
 union all select id, 'task_urgency_v1', 75, 'store', 'task_store', 'compact', 'append_only', 'keep_both', false, false, false, true, false, true, greatest(0, epoch(coalesce(until + interval 1 day, timestamp '{NOW}' + interval 7 day))::bigint - epoch(timestamp '{NOW}')::bigint), epoch(coalesce(until + interval 1 day, timestamp '{NOW}' + interval 7 day))::bigint, ['canonical', 'task_queue', 'temporal'] from c where candidate_type in ('task', 'deadline')
 union all select id, 'user_preference_v1', 70, 'store', 'ltm', 'mark_expired', 'versioned', 'keep_both', false, false, false, true, false, true, null, null, ['canonical', 'vector'] from c where candidate_type = 'user_preference'
 union all select id, 'procedural_v1', 65, 'store', 'ltm', 'mark_expired', 'merge', 'trust_newer', false, false, false, true, false, true, null, null, ['canonical', 'vector'] from c where candidate_type = 'procedure'
 union all select id, 'code_v1', 65, 'store', 'code_index', 'mark_expired', 'versioned', 'trust_newer', false, false, false, true, false, true, null, null, ['code_symbol', 'canonical', 'vector'] from c where candidate_type in ('code_symbol', 'code_decision')
 union all select id, 'meeting_v1', 60, 'store', 'episode_store', 'compact', 'append_only', 'keep_both', false, false, false, true, true, true, 2592000, epoch(timestamp '{NOW}')::bigint + 2592000, ['raw_evidence', 'canonical', 'temporal'] from c where candidate_type = 'meeting_episode'
 union all select id, 'default_fact_v1', 10, 'store', 'ltm', 'mark_expired', 'versioned', 'mark_conflict', false, false, false, true, false, true, null, null, ['canonical', 'vector'] from c where candidate_type in ('fact', 'document_knowledge', 'unknown'))"""


@query(f"with {CAND}, {PLAN} select id, policy, priority, action, approval, ttl, expires from p")
def policy_match(spark, d):
    return policy.match(_candidates(spark, d), temporal.at(NOW)).select("id", "policy", "priority", "action", "approval", "ttl", "expires")


MERGED = f"""{CAND}, {PLAN}, g as (select id, arg_max(action, priority) as action, arg_max(scope, priority) as scope, arg_max(on_expiry, priority) as on_expiry, arg_max(upd, priority) as upd, arg_max(con, priority) as con,
 bool_or(approval) as approval, bool_or(redact) as redact, bool_or(encrypt) as encrypt, bool_and(xs) as xs, bool_and(team) as team, bool_and(ev) as ev, min(ttl) as ttl, min(expires) as expires, string_agg(policy, ',' order by priority desc) as policies,
 list_reduce(list(proj order by priority desc), lambda x, y: list_concat(x, list_filter(y, lambda z: not list_contains(x, z)))) as proj from p group by id),
 plan as (select c.id, c.candidate_type, coalesce(action, 'ignore') as action, coalesce(scope, 'ltm') as scope, coalesce(on_expiry, 'mark_expired') as on_expiry, coalesce(upd, 'ignore_duplicate') as upd, coalesce(con, 'keep_both') as con, coalesce(approval, false) as approval,
 coalesce(redact, false) as redact, coalesce(encrypt, false) as encrypt, coalesce(xs, true) as xs, coalesce(team, false) as team, coalesce(ev, true) as ev, ttl, expires, coalesce(policies, '') as policies, coalesce(proj, []) as proj, text from c left join g using (id))"""


@query(f"with {MERGED} select id, candidate_type, action, scope, on_expiry, upd as \"update\", con as \"conflict\", approval, redact, encrypt, xs as cross_session, team, ev as evidence, ttl, expires, policies, array_to_string(proj, ',') as projections, 'private' as derived_sensitivity from plan")
def policy_merge(spark, d):
    return policy.merge(_candidates(spark, d), temporal.at(NOW))


@query(f"""with {MERGED} select id, case action when 'ask_user' then 'approvals' else 'canonical' end as "table", case when action = 'ask_user' then '' else array_to_string(list_filter([case when list_contains(proj, 'task_queue') then 'task_queue' end, case when list_contains(proj, 'code_symbol') then 'code_symbol_index' end, case when list_contains(proj, 'raw_evidence') then 'evidence_store' end], lambda z: z is not null), ',') end as tags from plan where action <> 'ignore'""")
def policy_projections(spark, d):
    return policy.routed(policy.merge(_candidates(spark, d), temporal.at(NOW)))


@query(f"with {MERGED} select scope, action, count(*) as n, sum((length(case when redact then '[redacted ' || candidate_type || ']' else text end)))::bigint as chars from plan group by all")
def policy_route(spark, d):
    c = _candidates(spark, d)
    plans = policy.merge(c, temporal.at(NOW)).join(c.select("id", "text"), "id")
    stored = policy.redacted(F.col("text"), F.col("redact"), F.col("candidate_type"))
    return plans.groupBy("scope", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(stored)).alias("chars"))


@query(f"with {CAND}, {PLAN} select c.id, case when bool_or(encrypt or approval) then 'restricted' when bool_or(redact or not xs) then 'confidential' else 'private' end as sensitivity from c left join p using (id) group by c.id")
def derived_sensitivity(spark, d):
    """How sensitive all the plans of a candidate say it is."""
    c = _candidates(spark, d)
    level = policy.match(c, temporal.at(NOW)).groupBy("id").agg(F.max(policy.inferred()).alias("level"))
    names = F.array(*[F.lit(k) for k in policy.SENSITIVITY])
    return c.join(level, "id", "left").select("id", F.element_at(names, F.coalesce("level", F.lit(1)) + 1).alias("sensitivity"))


@query(f"with {MERGED} select id as candidate_id, action, policies, len(string_split(policies, ','))::int as n from plan")
def decision_traces(spark, d):
    """Every evaluation leaves a trace, appended to a table."""
    path = shared_folder(spark, "traces")
    plans = policy.merge(_candidates(spark, d), temporal.at(NOW))
    plans.select(F.col("id").alias("candidate_id"), "action", "policies", F.size(F.split("policies", ",")).alias("n")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


# ---- promotion ----
@query(f"with {TURNS} select session, seq from t where not exists (select 1 from t p where p.session = t.session and p.seq = t.seq and p.seq % 3 = 0)")
def unprocessed_scan(spark, d):
    key = F.concat_ws("/", F.col("session").cast("string"), F.col("seq").cast("string"))
    t = turns(spark, d).withColumn("id", key)
    return promotion.unprocessed(t, t.where("seq % 3 = 0")).select("session", "seq")


@query("select doc_id as id from documents a where exists (select 1 from documents b where b.source = a.source and b.text = a.text and b.doc_id < a.doc_id)")
def restatement_check(spark, d):
    first = _texts(spark, d).groupBy("namespace", F.md5("text").alias("key")).agg(F.min("id").alias("first"))
    return _texts(spark, d).withColumn("key", F.md5("text")).join(first, ["namespace", "key"]).where("first < id").select("id")


DECIDE = f"{ALL_KNN}, best as (select query_id as id, greatest(0.0::double, least(1.0::double, (max(score) - 0.25::double) * 4.5::double)) as sim from hits group by query_id), x as (select id, sim, id % 2 = 1 as retraction from best), dd as (select id, round(sim, 9) as sim, case when retraction and sim >= 0.5 then 'DELETE' when retraction then 'NOOP' when sim < 0.5 then 'ADD' when sim > 0.97 then 'NOOP' else 'UNDECIDED' end as op from x)"


def _decided(spark, d):
    asked = vectors(spark, d).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    hits = retrieval.knn(asked, vectors(spark, d), 1)
    # cosines of these vectors, stretched over the scale on which the decider's thresholds lie
    sim = sc.clamp01((F.col("score") - 0.25) * 4.5)
    return hits.select(F.col("query_id").alias("id"), F.round(sim, 9).alias("sim"), promotion.decide(F.pmod("query_id", F.lit(2)) == 1, sim).alias("op"))


@query(f"with {DECIDE} select * from dd")
def promotion_decision(spark, d):
    return _decided(spark, d)


@query(f"""with {DECIDE} select count(*) filter (where op = 'ADD') as "add", count(*) filter (where op = 'DELETE') as "delete", count(*) filter (where op = 'NOOP') as noop, count(*) filter (where op = 'UNDECIDED') as undecided, count(*) as total from dd""")
def promotion_report(spark, d):
    return promotion.report(_decided(spark, d))


@query(f"with {TURNS} select session, count(*) as waiting, count(*) >= 5 as fires from t group by session")
def trigger_accumulation(spark, d):
    return promotion.accumulated(turns(spark, d), 5)


@query("select distinct lower(d.lang) as entity from documents d where lower(d.lang) not in (select lower(n_name) from nation)")
def trigger_new_entity(spark, d):
    return promotion.new_entities(table(spark, d, "documents").select(F.col("lang").alias("text")), table(spark, d, "nation").select(F.col("n_name").alias("text")))


# ---- synthesis ----
SF = f"sf as (select pos, subject, predicate, obj, quantity::bigint as quantity, unit, occurred_at::timestamp as occurred_at from {values(STRUCTURED)} as s(pos, subject, predicate, obj, quantity, unit, occurred_at) union all select 100 + l_orderkey * 10 + l_linenumber, 'c' || o_custkey, case l_returnflag when 'A' then 'purchase' when 'N' then 'gift order' else 'return from shop' end, case when l_linenumber % 2 = 0 then 'Part  ' else 'part ' end || l_partkey % 40, l_quantity::bigint, case when l_linenumber % 3 = 0 then '' else 'pieces' end, case when l_orderkey % 9 = 0 then null else l_shipdate end from lineitem join orders on l_orderkey = o_orderkey)"


def _structured(spark, d):
    """Structured facts: what customers bought, and literals."""
    literal = spark.sql(f"select cast(pos as long) pos, subject, predicate, obj, cast(quantity as long) quantity, unit, cast(occurred_at as timestamp) occurred_at from {values(STRUCTURED)} as s(pos, subject, predicate, obj, quantity, unit, occurred_at)")
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    even = lambda n: F.pmod("l_linenumber", F.lit(n)) == 0
    return literal.unionByName(rows.select(
        (100 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.when(F.col("l_returnflag") == "A", "purchase").when(F.col("l_returnflag") == "N", "gift order").otherwise("return from shop").alias("predicate"),
        F.concat(F.when(even(2), "Part  ").otherwise("part "), F.pmod("l_partkey", F.lit(40)).cast("string")).alias("obj"), F.col("l_quantity").cast("long").alias("quantity"),
        F.when(even(3), "").otherwise("pieces").alias("unit"), F.when(F.pmod("l_orderkey", F.lit(9)) != 0, F.col("l_shipdate")).alias("occurred_at")))


SYNTH = r"""m as (select subject, predicate, regexp_replace(lower(trim(obj)), '[ \t\n\r]+', ' ', 'g') as member, min(pos) as pos, arg_min(quantity, (pos, quantity, unit)) as quantity, arg_min(unit, (pos, quantity, unit)) as unit from sf {} group by all) select subject, predicate, count(*) as members, sum(quantity)::bigint as total, arg_min(unit, (pos, unit)) filter (where unit <> '') as unit from m group by all"""


@query(f"with {SF}, " + SYNTH.format(""))
def synth_count_sum(spark, d):
    return synthesis.summarise(_structured(spark, d))


@query(f"with {SF}, " + SYNTH.format("where occurred_at >= timestamp '1999-01-01'"))
def synth_scoped(spark, d):
    return synthesis.summarise(_structured(spark, d), since="1999-01-01")


@query(f"with {FACTS} select id, row_number() over (partition by subject, attribute order by valid_from desc, id desc) = 1 as is_current from f")
def newest_per_key(spark, d):
    return synthesis.newest_per_key(facts(spark, d)).select("id", "is_current")


@query(f"with {TURNS}, m as (select session, role, max(tokens) as m from t group by all) select role, sum(m)::bigint as total, count(*) as sessions from m group by role")
def max_per_session_sum(spark, d):
    return synthesis.max_per_session_sum(turns(spark, d))


@query(f"select doc_id as id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))::int as tokens, regexp_matches(text, '{sql_text(tx.SECRET)}') as secret from documents")
def document_tokens(spark, d):
    return _texts(spark, d).select("id", F.size(tx.tokens(F.col("text"))).alias("tokens"), F.col("text").rlike(tx.SECRET).alias("secret"))


# ---- evaluation ----
@query("with r as (select *, row_number() over (partition by lang order by n_chars, doc_id) k, count(*) over (partition by lang) n from documents) select lang, max(n_chars) filter (where k = ceil(50 * n / 100.0)) as p50, max(n_chars) filter (where k = ceil(95 * n / 100.0)) as p95 from r group by lang")
def percentiles_nearest_rank(spark, d):
    rows = table(spark, d, "documents").select("lang", "n_chars", F.col("doc_id").alias("id"))
    return evaluation.nearest_rank(rows, ["lang"], "n_chars", [50, 95])


@query("select lang, count(*) as n, avg(quality::double) as accuracy from documents join labels using (doc_id) group by rollup(lang)")
def metrics_by_type(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("accuracy"))


BUCKETS = ["correct", "retrieval_miss", "toxic", "never"]
BUCKET = "case when toxic = 1 then 'toxic' when quality = 0 then 'retrieval_miss' else 'correct' end"


@query(f"with b(bucket) as (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in BUCKETS)}), l as (select {BUCKET} as bucket from labels) select bucket, count(l.bucket) as n from b left join l using (bucket) group by bucket")
def failure_buckets(spark, d):
    return evaluation.histogram(table(spark, d, "labels").select(F.expr(BUCKET).alias("bucket")), "bucket", BUCKETS)


@query(rf"with v as (select question::bigint as question, pos::bigint as pos, answer from {values(VOTES)} as t(question, pos, answer) union all select 100 + l_partkey, l_orderkey * 10 + l_linenumber, case l_linenumber % 3 when 0 then ' ' || l_returnflag || ' ' when 1 then lower(l_returnflag) else '' end from lineitem), c as (select question, regexp_replace(lower(trim(answer)), '[ \t\n\r]+', ' ', 'g') as k, count(*) as n, min(pos) as pos from v group by all) select question, arg_max(k, (k <> '', n, -pos)) as answer from c group by question")
def majority_vote(spark, d):
    literal = spark.sql(f"select cast(question as long) question, cast(pos as long) pos, answer from {values(VOTES)} as v(question, pos, answer)")
    kind = F.pmod("l_linenumber", F.lit(3))
    answer = F.when(kind == 0, F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).when(kind == 1, F.lower("l_returnflag")).otherwise("")
    rows = table(spark, d, "lineitem").select((100 + F.col("l_partkey")).alias("question"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"), answer.alias("answer"))
    return evaluation.majority(literal.unionByName(rows))


NORM = r"regexp_replace(lower(trim({0})), '[ \t\n\r]+', ' ', 'g')"
TOK = r"list_distinct(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'))"


@query(f"with x as (select 's' || id as id, answer, gold from {values(ANSWERS)} as t(id, answer, gold) union all select 'c' || conv_id || '/' || turn, text, left(lag(text) over (partition by conv_id order by turn), 40) from conversations), y as (select *, {NORM.format('answer')} as a, {NORM.format('gold')} as g from x), z as (select *, {TOK.format('a')} as ta, {TOK.format('g')} as tg from y) select id, case when answer = gold then 'exact' when a = g then 'normalized' when g <> '' and contains(a, g) then 'contained' when len(list_intersect(ta, tg)) / greatest(1, len(list_distinct(list_concat(ta, tg)))) >= 0.7 then 'overlap' else 'none' end as verdict from z")
def answer_ladder(spark, d):
    literal = spark.sql(f"select concat('s', id) id, answer, gold from {values(ANSWERS)} as x(id, answer, gold)")
    t = turns(spark, d).withColumn("gold", F.left(F.lag("text").over(Window.partitionBy("session").orderBy("seq")), F.lit(40)))
    rows = literal.unionByName(t.select(F.concat(F.lit("c"), F.col("session").cast("string"), F.lit("/"), F.col("seq").cast("string")).alias("id"), F.col("text").alias("answer"), "gold"))
    return rows.select("id", evaluation.answer_match(F.col("answer"), F.col("gold")).alias("verdict"))


@query("select lang as kind, doc_id as id from documents qualify row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) <= 5")
def stratified_sample(spark, d):
    w = Window.partitionBy("kind").orderBy(F.md5(F.col("id").cast("string")), "id")
    return _texts(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("kind", "id")


# ---- streaming: rows only ----
def _stream_folders(spark):
    return [shared_folder(spark, k) for k in ("sink", "checkpoint")]


def _event_stream(spark, d):
    from tessera.streaming import sessions

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.streaming.schemaInference", "false")
    return sessions.read_events(spark, f"{d}/event[s].parquet", schema)


@query()
def stream_idle_flush(spark, d):
    from tessera.streaming import sessions

    sink, checkpoint = _stream_folders(spark)
    sessions.run_once(sessions.idle_sessions(_event_stream(spark, d), "6 hours", "1 hour"), sink, checkpoint)
    flushed = spark.read.parquet(sink)
    return flushed.unionByName(sessions.still_open(table(spark, d, "events"), flushed, "6 hours"))


@query("with s as (select user_id, ts, case when ts >= lag(ts) over w + interval 6 hours or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, epoch_us(min(ts)) as \"start\", epoch_us(max(ts) + interval 6 hours) as \"end\", count(*) as n from g group by user_id, k")
def batch_idle_sessions(spark, d):
    from tessera.streaming import sessions

    return sessions.batch_sessions(table(spark, d, "events"), "6 hours").select("user_id", us("start"), us("end"), "n")


@query()
def stream_promote(spark, d):
    from tessera.streaming import sessions

    sink, checkpoint = _stream_folders(spark)
    sessions.promote_batches(_event_stream(spark, d).select("event_id", "user_id", "value"), sink, checkpoint)
    return spark.read.parquet(sink)


from tessera.plans import answers, evals, evidence, grounding, memory, pages, promotions, questions, rules  # noqa: E402, F401  (registers its queries)
