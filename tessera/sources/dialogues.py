"""Dialogues out of the order tables: each order is a turn of its customer's session, so that statements, questions and the
right answers follow from rows. One text serves both engines; it keeps to functions that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table

PLACES, NAMES, THINGS, JOBS = ("Aro", "Porto", "Lund", "Bergen"), ("Ada", "Bo", "Cy", "Dee"), ("bikes", "lamps", "kettles", "clocks"), ("baker", "rower", "welder", "tailor")


def pick(words: tuple[str, ...], number: str) -> str:
    return "case " + f"({number}) % {len(words)}" + "".join(f" when {i} then '{w}'" for i, w in enumerate(words)) + " end"


def joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


K = "(o_orderkey + o_custkey)"
N, THING, PLACE, OTHER, NAME, JOB, NEW_JOB = (
    f"cast(2 + {K} % 7 as string)", pick(THINGS, K), pick(PLACES, K), pick(PLACES, f"{K} + 1"), pick(NAMES, K), pick(JOBS, K), pick(JOBS, f"{K} + 1"))
DAY = "cast(cast(o_orderdate as date) as string)"
TURN = [
    joined("'I have '", N, "' '", THING, "' at home. The new shelf took '", N, "' hours to build, that one only took two hours.'"),
    joined("'My friend '", NAME, "' visited Lake '", PLACE, "' on '", DAY, "'. It was great!'"),
    joined("'I used to live in '", PLACE, "'. Now I live in '", OTHER, "'.'"),
    joined("'I love green tea, and I hate '", THING, "'.'"),
    joined("'I paid '", "cast(100 + o_custkey % 900 as string)", "' dollars for the '", THING, "' painting. The '", THING, "' painting is worth triple what I paid.'"),
    joined("'You might consider the University of '", PLACE, "' for that degree.'"),
    joined("'I got my degree at '", PLACE, "' College on March '", N, "', 2021.'"),
    joined("'We watched \"The '", PLACE, "' Story\" with Dr. '", NAME, "' last week.'"),
    joined("'I bought two and a half '", THING, "' at Target yesterday, and I own '", N, "' '", THING, "' now.'"),
    joined("'Sure, here are 3 ideas. Try the '", PLACE, "' Market in May.'"),
    joined("'The drive to '", PLACE, "' took '", N, "' minutes on '", DAY, "'.'"),
    joined("'I previously worked as a '", JOB, "'. I just started as a '", NEW_JOB, "'.'"),
]
TURNS_SQL = f"select o_custkey as session, o_orderkey as seq, case when o_orderkey % 12 in (5, 9) then 'assistant' else 'user' end as role, case o_orderkey % 12 {' '.join(f'when {i} then {t}' for i, t in enumerate(TURN))} end as text from orders"
C = "c_custkey"
ASK = [
    ("count", joined("'How many '", pick(THINGS, C), "' do I have at home?'")), ("duration", "'How long did the new shelf take to build?'"), ("location", "'Where did I get my degree?'"),
    ("value", joined("'What is the '", pick(THINGS, C), "' painting worth?'")), ("amount", joined("'How much did I pay for the '", pick(THINGS, C), "' painting?'")),
    ("update", "'Where do I live now?'"), ("person", joined("'Who visited Lake '", pick(PLACES, C), "'?'")), ("date", joined("'When did my friend visit Lake '", pick(PLACES, C), "'?'")), ("preference", "'What do I love or hate?'"),
]
#: Questions of the customers whose key is divisible by 20: a stated set.
ASK_SQL = " union all ".join(f"select {C} * 10 + {i} as query_id, {C} as session, '{kind}' as kind, {text} as question from customer where {C} % 20 = 0" for i, (kind, text) in enumerate(ASK))

KIN, OCCASION = pick(("sister", "brother", "mother", "friend"), K), pick(("birthday", "wedding", "graduation", "anniversary"), f"{K} + 1")
WONDER = [
    "'What was my previous occupation?'", joined("'What role did I have before '", PLACE, "'?'"), "'What did I used to work as?'", "'Which job did I do for a living in the past, and where?'", "'What degree did I graduate with?'",
    joined("'What did I buy for my '", KIN, "chr(39)", "'s '", OCCASION, "'?'"), joined("'How much is the '", THING, "' painting worth in terms of what I paid?'"), joined("'How many '", THING, "' did I pack for '", PLACE, "'?'"),
    joined("'When did I go to the '", PLACE, "' reunion dinner?'"), "'Where do I currently live, and since when?'", joined("'How many '", THING, "' did I bring on my vacation to '", PLACE, "'?'"), joined("'Who visited Lake '", PLACE, "' in 2021?'"),
    joined("'Can you recommend a '", JOB, "' for my '", KIN, "'?'"), "''",
]
REPLY = {
    0: joined("'1. What did the '", THING, "' painting cost?'", "chr(10)", "'2) How many '", THING, "' did I pack in 2021?'", "chr(10)", "'- Where did I get my degree?'", "chr(10)", "' '", "chr(10)", "'2) how many '", THING, "' did I pack in 2021?'"),
    1: joined("'Which job did I do?'", "chr(10)", "'Who visited Lake '", PLACE, "'?'", "chr(10)", "'When did I live in '", PLACE, "'?'", "chr(10)", "'Who visited Lake '", OTHER, "' in 2021?'", "chr(10)", "'One too many?'"),
    2: joined("'* What is the '", THING, "' painting worth?'", "chr(10)", "'* How much did I pay for the '", THING, "' painting?'", "chr(10)", "'* Where do I live now?'"),
    3: "''", 4: joined("'WHAT DID I USED TO WORK AS?'", "chr(10)", "'Which '", JOB, "' did my '", KIN, "' like in the past?'"),
}
#: A question an order, and what a decomposer made of it.
WONDER_SQL = (f"select o_orderkey as query_id, case o_orderkey % {len(WONDER)} {' '.join(f'when {i} then {t}' for i, t in enumerate(WONDER))} end as question, "
              f"case {K} % {len(REPLY)} {' '.join(f'when {i} then {t}' for i, t in REPLY.items())} end as reply from orders")

#: What customers state about themselves; the session's shop and date come with a turn.
STATED = [
    joined("'I play the playlist on Spotify that I created, called \"'", PLACE, "' Nights\", every day.'"), joined("'My daily commute takes '", N, "'0 minutes, each way.'"), joined("'I redeemed a $'", N, "' coupon on '", THING, "' last week.'"),
    joined("'I finished my degree in '", JOB, "' studies, at last.'"), joined("'We saw a production of The '", PLACE, "' Story? It is a play.'"), joined("'For my commute, which takes '", N, "' hours, I have music. My degree in '", THING, "' helps.'"), "'Where is the camping trip?'",
]
STATED_SQL = (f"select o_custkey as owner, o_orderkey as seq, case when o_orderkey % 11 = 5 then 'assistant' else 'user' end as role, case o_orderkey % {len(STATED)} {' '.join(f'when {i} then {t}' for i, t in enumerate(STATED))} end as text, "
              f"case when o_orderkey % 6 <> 0 then cast(o_orderdate as date) end as as_of, case when {K} % 3 = 0 then 'Walmart' else 'Target' end as hint from orders")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, seq, role, text, as_of, hint)."""
    return spark.sql(STATED_SQL.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))

TOWN, MATTER, WHO = pick(PLACES, "c_custkey"), pick(THINGS, "c_custkey"), pick(NAMES, "c_custkey")
ANSWERED = [
    joined("'7 '", MATTER), joined("'Matching facts: x'", "chr(10)", "'Sub-answer: '", TOWN), joined("'I don'", "chr(39)", "'t know.'"), joined("'Based on the evidence, it is '", TOWN), "'  '", "'user'", "'turn 1 (user): hi'", "'Sure!'",
    joined("chr(123)", "'\"final_answer\": \" '", TOWN, "' Market. \"'", "chr(125)"), "'Matching facts: a b'", joined("'- one'", "chr(10)", "'* two'", "chr(10)", "'The '", TOWN, "' Market.'"), "'forty minutes'", "'you should try tea'", "'last week'", "'a market'",
    "'Can you help me?'", "'110 for'", "'**Birthday**'", "'Topic: tea'", joined("'We bought '", MATTER, "' at home.'"), "'Candidates: 1'", joined("'I used to live in '", TOWN), joined("'My friend '", WHO, "' visited the lake'"), "'Sure, here are three good ideas for your next trip'",
]
TYPES = ("count", "duration", "date_time", "location", "person", "preference", "knowledge_update", "generic_fact")
#: Answers of a model to each customer, one of each form.
ANSWERED_SQL = " union all ".join(f"select c_custkey * {len(ANSWERED)} + {i} as answer_id, c_custkey as session, {pick(TYPES, f'c_custkey + {i}')} as question_type, {a} as reply from customer" for i, a in enumerate(ANSWERED))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, session, question_type, reply)."""
    return spark.sql(ANSWERED_SQL.replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))


def wonderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question, reply of a decomposer)."""
    return spark.sql(WONDER_SQL.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, role, text)."""
    return spark.sql(TURNS_SQL.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, session, kind, question)."""
    return spark.sql(ASK_SQL.replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))
