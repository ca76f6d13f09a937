"""Queries of the text rules, over every text of conversations and documents and over literals, so that each rule fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed as fx
from tessera.functions import text as tx
from tessera.operators import candidates
from tessera.plans.catalog import query, sql_text
from tessera.plans.literals import SENTENCES, values
from tessera.sources.tables import table

TEXTS = f"t(id, text) as (select 'c' || conv_id || '/' || turn, text from conversations union all select 'd' || doc_id, text from documents union all select 's' || id, text from {values(SENTENCES)} as l(id, text))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"len(regexp_extract_all({}, '[^ \t\n\r\f]+'))"
PARTS = rf"parts as (select id, unnest(range(1, len(x) + 1)) as pos, unnest(x) as part from (select id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) as x from t))"
SENTS = f"{PARTS}, s as (select id, pos, {STRIP.format('part')} as s from parts where {STRIP.format('part')} <> '')"


def plain(column: str) -> str:
    """Letters beyond ASCII as x: the SQL engine knows word borders of ASCII only."""
    return rf"regexp_replace({column}, '[\x{{AA}}\x{{B5}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{2AF}}\x{{370}}-\x{{1FFF}}\x{{3040}}-\x{{D7FF}}]', 'x', 'g')"


def has(pattern: str, column: str = "s") -> str:
    return f"regexp_matches({plain(column) if pattern.isascii() else column}, '{sql_text(pattern)}')"


def case(rules, default: str = "null", column: str = "s") -> str:
    return "case " + " ".join(f"when {has(p, column)} then '{label}'" for label, p in rules) + f" else {default} end"


def texts(spark, d):
    name = lambda letter, *parts: F.concat(F.lit(letter), *[F.lit(p) if p == "/" else F.col(p).cast("string") for p in parts]).alias("id")
    literal = spark.sql(f"select * from {values(SENTENCES)} as s(id, text)")
    return (table(spark, d, "conversations").select(name("c", "conv_id", "/", "turn"), "text")
            .unionByName(table(spark, d, "documents").select(name("d", "doc_id"), "text")).unionByName(literal.select(name("s", "id"), "text")))


def sentences(spark, d):
    return texts(spark, d).select("id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query(f"with {TEXTS} select id, {has(tx.SECRET, 'text')} as secret, {has(fx.RETRACTION, 'text')} as retraction from t")
def secret_and_retraction_flags(spark, d):
    return texts(spark, d).select("id", tx.is_secret(F.col("text")).alias("secret"), tx.is_retraction(F.col("text")).alias("retraction"))


PHRASE = r"lower(regexp_replace(" + STRIP.format(f"regexp_extract(s, '{sql_text(fx.POSSESSIVE)}', 1)") + r", '\s+', ' ', 'g'))"
OWN = f"""case when {has(fx.POSSESSIVE)} and not regexp_matches({STRIP.format(f"regexp_extract(s, '{sql_text(fx.POSSESSIVE)}', 2)")}, '{sql_text(fx.CLAUSE_VALUE)}')
 and not list_contains({list(fx.OPINIONS)!r}, list_extract(string_split({PHRASE}, ' '), -1)) and length({PHRASE}) >= 3 then {PHRASE} end"""
ATTRIBUTE = f"coalesce({case(fx.ATTRIBUTES)}, {OWN})"


@query(f"with {TEXTS}, {SENTS} select id, pos, {ATTRIBUTE} as attribute from s where {ATTRIBUTE} is not null")
def attribute_extract(spark, d):
    return sentences(spark, d).select("id", "pos", tx.attribute(F.col("s")).alias("attribute")).where("attribute is not null")


REFUSED = f"length(s) > {fx.MAX_CHARS} or ends_with(s, '?') or {WORDS.format('s')} < {fx.MIN_WORDS} or {has(tx.SECRET)} or {has(fx.UNCERTAIN)} or {has(fx.NEGATED)} or ({has(fx.PROGRESSIVE)} and not {has(fx.STATIVE_PROGRESSIVE)}) or " + " or ".join(map(has, fx.REJECTED))
RULE = f"case when {REFUSED} then null else coalesce({case(fx.STATIVE)}, case when {ATTRIBUTE} is not null then 'changed-attribute' end) end"


@query(f"with {TEXTS}, {SENTS}, r as (select id, pos, s, {RULE} as rule from s) select id, s as fact, rule from r where rule is not null qualify row_number() over (partition by id, rtrim(lower(s), '.') order by pos) = 1")
def capture_label(spark, d):
    return candidates.durable_facts(texts(spark, d)).select("id", "fact", "rule")


@query(f"with {TEXTS}, {SENTS} select id, pos, {case(fx.QUESTION_TYPES, chr(39) + 'generic_fact' + chr(39))} as question_type, {has(fx.MULTI_SESSION)} as multi_session from s where contains(s, '?')")
def question_type(spark, d):
    s = sentences(spark, d).where(F.col("s").contains("?"))
    return s.select("id", "pos", tx.first_label(F.col("s"), fx.QUESTION_TYPES, "generic_fact").alias("question_type"), F.col("s").rlike(fx.MULTI_SESSION).alias("multi_session"))


ALONE = f"({WORDS.format('c')} >= 3 and not {has(fx.SUBORDINATOR, 'c')} and {has(fx.VERB, 'c')} and ({has(fx.SUBJECT, 'c')} or {WORDS.format('c')} >= 4))"


@query(rf"""with {TEXTS}, p as (select id, unnest(range(1, len(x) + 1)) as pos, unnest(x) as part from (select id, string_split(regexp_replace({STRIP.format('text')}, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) as x from t)),
 s as (select id, pos, {STRIP.format('part')} as s from p where {STRIP.format('part')} <> ''),
 c as (select id, pos, s, list_transform(string_split(s, ','), lambda z: {STRIP.format('z')}) as cs from s),
 k as (select *, len(cs) > 1 and len(list_filter(cs, lambda c: {ALONE})) = len(cs) as apart from c)
 select id, unnest(case when apart then list_transform(cs, lambda z: case when regexp_matches(z, '[.!?]$') then z else z || '.' end) else [s] end) as clause from k""")
def clause_split(spark, d):
    return texts(spark, d).select("id", F.explode(tx.clauses(F.col("text"))).alias("clause"))


SPAN = "list_transform(regexp_extract_all(text, '{}'), lambda z: trim(z, ' .,;:''\"'))"
FOUND = " union all ".join(
    f"select id, {i} as k, '{kind}' as candidate_type, unnest(range(1, len(x) + 1)) as pos, unnest(x) as span from (select id, {SPAN.format(sql_text(p))} as x from t)" for i, (kind, p) in enumerate(fx.CANDIDATES, 1))
HIDDEN = " union all ".join(f"select id, unnest(regexp_extract_all(text, '{sql_text(p)}')) as span, 'secret:{label}' as label, {i} as k from t" for i, (label, p) in enumerate(fx.SECRET_SPANS))


@query(f"""with {TEXTS}, hidden as ({HIDDEN}), secrets as (select id, span, min(k) as k, arg_min(label, k) as label from hidden group by id, span),
 found as (select * from ({FOUND}) as z where span <> '' qualify row_number() over (partition by id, k, lower(span) order by pos) = 1),
 free as (select * from found f where not exists (select 1 from secrets h where h.id = f.id and contains(lower(f.span), lower(h.span)))),
 firsts as (select id, candidate_type, span from free qualify row_number() over (partition by id, span order by k, pos) = 1),
 meet as (select id, 'meeting_episode' as candidate_type, left(text, 200) as span from t where {has(fx.MEETING, 'text')} and id not in (select id from secrets) and id not in (select id from firsts where candidate_type in ('decision', 'task')))
 select id, 'sensitive_data' as candidate_type, span from secrets union all select * from firsts union all select * from meet""")
def typed_candidates(spark, d):
    return candidates.typed(texts(spark, d)).select("id", "candidate_type", "span")


@query()
def relation_extract(spark, d):
    return candidates.relation_triples(texts(spark, d))


@query(rf"with {TEXTS}, {SENTS} select id, pos, lower(regexp_extract(s, '{sql_text(fx.REPLACES)}', 1)) as replaced from s where {has(fx.REPLACES)}")
def replacement_entity(spark, d):
    replaced = F.lower(F.regexp_extract("s", fx.REPLACES, 1))
    return sentences(spark, d).where(F.col("s").rlike(fx.REPLACES)).select("id", "pos", replaced.alias("replaced"))


@query(rf"with {TEXTS}, {SENTS}, a as (select id, unnest(regexp_extract_all(s, '{sql_text(fx.REPLACES)}', 1)) as entity from s where {has(fx.REPLACES)}), w as (select distinct id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) as word from t), r as (select distinct id, lower(entity) as entity from a) select r.id as announcement, w.id as stale, entity from r join w on w.word = r.entity and w.id <> r.id and w.id not in (select id from r)")
def replacement_join(spark, d):
    return candidates.replaced_mentions(texts(spark, d))
