"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audit, exact, extraction, jaccard, language, lm, negatives, packing, quality, tokenfile, tokens, urls, warc
from tessera.llm.work import documents, pages


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = warc.typed_records(pages(spark, sf_dir).select("page_id", "url", "html"))
    return warc.records(warc.read(warc.write(warc.chunked(typed))))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    decoded = tokens.decode(tokens.encode(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def remainder(modulus: int):
    """crc32(doc_id as text) mod ``modulus``; a null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % modulus


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, counts, total, _ = lm.fit(docs.where(remainder(10) != 0))
    scored = lm.score(docs, model, counts, total)
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = language.fit(docs.select("doc_id", "text", "lang").where(remainder(5) != 0))
    asked = docs.select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    return language.predict(asked, learned).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.range_join(pages(spark, sf_dir).select("page_id", "url"), urls.rules_frame(spark, urls.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(documents(spark, sf_dir).select("doc_id", "text")).drop("cls")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact.decisions(docs, exact.copy_groups(docs))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(tokenfile.write(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("word_bpe_49k.json")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.prepared(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir).select("doc_id", "source", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(pages(spark, sf_dir).select("page_id", "url", "html"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_score": op5_lm_score,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_output": op10_token_output,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_html_extraction": op13_html_extraction,
}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_FAILS = rf"""
  (n >= {quality.MIN_LINE_WORDS} and (
     length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= {quality.MAX_MARKS_PER_WORD} * n
     or length(regexp_replace(line, '[^!]', '', 'g')) >= {quality.MAX_MARKS_PER_WORD} * n))
  or (n <= {quality.MAX_NAVIGATION_WORDS} and regexp_matches(line, '{quality.NAVIGATION}'))
  or {" or ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)}
"""

ORACLES = {
    "op2_warc": f"""
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select *, min(page_id) over (partition by h) as f from p)
select page_id, n::bigint as payload_bytes, sha256(h) as payload_digest,
       case when n >= {warc.MIN_REVISIT} and page_id <> f then 'revisit' else 'response' end as record_type,
       case when n >= {warc.MIN_REVISIT} and page_id <> f then f end as refers_to
from g
""",
    "op4_quality_rules": rf"""
with w as (
  select row_number() over () rid, doc_id, coalesce(text, '') as body, {_WORDS.format('text')} as words from documents
), lines as (
  select rid, line, len({_WORDS.format('line')}) as n from (select rid, unnest(string_split(body, chr(10))) as line from w)
), ln as (select * from lines where n > 0),
perline as (
  select rid, count(*) - count(distinct line) as n_dup_lines,
         coalesce(sum(n) filter (where {_FAILS}), 0) as n_removed from ln group by rid
), win as (
  select rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] as g
  from (select rid, words, unnest(generate_series(1, len(words) - 2)) as i from w)
), rep as (select rid, i from (select *, count(*) over (partition by rid, g) c from win) where c > 1),
cov as (select rid, count(distinct p) as n_repeat from (select rid, unnest([i, i+1, i+2]) as p from rep) group by rid),
base as (
  select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words,
         coalesce(n_removed, 0) as n_removed
  from w left join perline using (rid) left join cov using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) as base_failed,
       not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
         and n_removed <= {quality.MAX_LOST} * n_words as kept
from base
""",
    "op7_url_filters": f"""
with rules(rhost, rpath, v) as (values {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}),
u as (
  select row_number() over () rid, page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), hp as (
  select rid, page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{urls.UPPER}', '{urls.LOWER}') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), m as (
  select rid, rhost || rpath as rule, v,
         row_number() over (partition by rid order by length(rhost || rpath) desc, length(rhost) desc, v desc) as k
  from hp join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(v, '{urls.DEFAULT}') as verdict
from hp left join (select * from m where k = 1) using (rid)
""",
    "op9_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
""",
    "op11_hard_negatives": f"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor({negatives.SCALE} * x::double)::bigint for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
),
a as (select * from e where vec_id % 100 = 0),
s as (
  select a.vec_id as anchor_id, e.vec_id, e.label = a.label as same, list_dot_product(a.v::double[], e.v::double[])::bigint as score
  from a join e on e.vec_id <> a.vec_id
),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and {negatives.LEAST_PERCENT} * p.score <= 100 * s.score and s.score <= p.score
  where p.k <= {negatives.POSITIVES}
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {negatives.NEGATIVES}
""",
    "op12_filter_audit": rf"""
with d as (select *, coalesce(text, '') as body, {_WORDS.format('text')} as words, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by 1),
m as (
  select coalesce(source, '') as part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
         [len(words) < {audit.MIN_WORDS}, 100 * len(list_distinct(words)) < {audit.MIN_DISTINCT_PERCENT} * len(words),
          100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {audit.MAX_CAPITALS_PERCENT} * length(body),
          regexp_matches(body, '{audit.SYMBOLS}'), coalesce(doc_id > first, false)] as fails
  from d left join l using (doc_id)
),
c as (select part, fails, count(*) as n, sum(good) as good, sum(bad) as bad from m group by 1, 2),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 3, 4, 5]) as i),
o as (
  select [a.i, b.i, c.i, d.i, e.i] as o, a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
  where b.i <> a.i and c.i not in (a.i, b.i) and d.i not in (a.i, b.i, c.i) and e.i not in (a.i, b.i, c.i, d.i)
),
s as (select *, unnest([1, 2, 3, 4, 5]) as step from o),
r as (
  select part, filter_order, step, o[step] as filter, n, good, bad, fails[o[step]] as now,
         list_bool_or([false] || [fails[o[j]] for j in range(1, step)]) as gone,
         len([1 for j in range(1, 6) if fails[j]]) as n_fails from c, s
),
a as (
  select part, filter_order, step::int as step, any_value(filter) as filter, sum(n) filter (where not gone and not now)::bigint as kept,
         coalesce(sum(n) filter (where not gone and now), 0)::bigint as removed, coalesce(sum(n) filter (where gone and now), 0)::bigint as redundant,
         coalesce(sum(n) filter (where now and n_fails = 1), 0)::bigint as unique_fails, coalesce(sum(good) filter (where not gone and now), 0)::bigint as good_lost,
         coalesce(sum(bad) filter (where not gone and now), 0)::bigint as toxic_lost
  from r group by 1, 2, 3
)
select * exclude (filter) replace (coalesce(kept, 0) as kept), sum(removed) over (partition by part, filter)::bigint as shapley from a
""",
}
