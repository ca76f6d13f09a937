"""Grounded candidates: typed values out of texts with the clause and the subject that they belong to, ranked for questions
and verified. Extractors are a table of patterns that one pass over the clauses of a text tries."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.sources.shared import written

#: Number words, units, words without meaning as a unit, stores, months and days, frames of the extractors.
UNITS_OF_TEN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
NUMBER_WORDS = {w: i for i, w in enumerate(UNITS_OF_TEN)} | {w: 10 * i for i, w in enumerate("thirty forty fifty sixty seventy eighty ninety hundred".split(), 3)}
NUMBER = rf"\d+(?:\.\d+)?|(?:{'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))})(?:\s+and\s+a\s+half)?"
TIME_UNITS = r"seconds?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|yrs?"
LONG_UNITS = {"min": "minute", "hr": "hour", "sec": "second", "yr": "year"}
NO_UNITS = ("thing stuff item type kind rule way time place part side fact scale fold version level stage step more less other another also even once twice such etc "
            "second minute hour day week month year min hr sec yr").split()
STORES = ("trader joe's|whole foods|apple store|home depot|best buy|mcdonald's|starbucks|chipotle|walmart|wegmans|safeway|costco|kroger|publix|amazon|uniqlo|lowe's|target|aldi|ikea|zara|nike|h&m|gap")
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
KIN = "friend|partner|wife|husband|boss|colleague|doctor|teacher|son|daughter|mom|dad|mother|father|brother|sister"
HAVE = "have|own|bought|brought|got|hold|keep|maintain|attended|visited|adopted|read|watched|saw|played|completed|did|tried|made"
LIKES = r"i\s+(?:like|love|prefer|enjoy|favou?r|dislike|hate|avoid|don't\s+like|am\s+a\s+fan\s+of)|my\s+favou?rite\s+(?:thing|food|colou?r|hobby|movie|book|music|sport|band|artist)\s+is"
DISLIKE = r"(?i)dislike|hate|avoid|don't"
HYPOTHETICAL = r"(?i)\b(?:considering|thinking about|looking at|might|may|could|planning|going to|would|options?|alternative|either|or|vs|versus|instead)\b"
COMPLETED = r"(?i)\b(?:got|earned|received|completed|finished|graduated|attended|visited|went\s+to|live[ds]?\s+in|moved\s+to|work(?:ed|s)?\s+at|studied\s+at|met\s+at|bought\s+at)\b"
SPENT = r"(?i)\b(?:took|takes|lasted|lasts|spent|spend)\b"
OLD = r"used\s+to|previously|formerly|originally|back\s+then|before(?:hand)?|i\s+(?:was|had)|until\s+(?:recently|last)"
NEW = r"now|currently|these\s+days|just\s+(?:started|moved|switched)|as\s+of\s+(?:today|now)|i\s+just|i\s+(?:am|'m)\s+now"
NOISE = "i we you they the a an my our their and but or so then very really just also only".split()
VERBS = "took takes lasted lasts is was are were got get earn earned did do have has".split()
PRONOUNS = "it this that these those one ones thing stuff they them".split()
NOUN_PHRASE = r"\b(?:[Tt]he|[Aa]n?|[Mm]y|[Oo]ur|[Tt]heir)\s+((?:[A-Za-z][A-Za-z'-]+\s+){0,3}[A-Za-z][A-Za-z'-]+)"
FACTUAL = "count_of duration_of got_at located_at is_called is_worth paid prefer named changed_to is".split()
HYPOTHETICALS = "considering looking_at planning thinking_about might option alternative".split()
QUESTION_STOPS = ("a an the and or but of for to in on at by with from as is are was were be been i me my you your we us our they them this that it its if then what which who whose where when "
                  "why how do does did have has had can could should would will many much few several long").split()


class Extractor(NamedTuple):
    type: str
    pattern: str
    value: int  # the group of the value
    confidence: float
    relation: str = ""
    extra: int = 0  # the group of a unit or a subject
    needs: str = ""  # what every match holds, where that is found much faster than the pattern


EXTRACTORS = (
    Extractor("count", rf"(?i)\b((?:i\s+(?:{HAVE})\s+)?)({NUMBER})\s+([a-z][a-z-]*)\b", 2, 0.5, extra=3),
    Extractor("duration", rf"(?i)\b({NUMBER})\s*-?\s*({TIME_UNITS})\b", 1, 0.7, "duration_of", 2),
    Extractor("date", r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 1, 0.95),
    Extractor("date", rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?)\b", 1, 0.9),
    Extractor("date", rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})(?:\s+\d{{4}})?)\b", 1, 0.9),
    Extractor("date", rf"(?i)\b({MONTHS})\b", 1, 0.55),
    Extractor("date", rf"(?i)\b({DAYS}|mon|tue|wed|thu|fri|sat|sun)\b", 1, 0.5),
    Extractor("date", rf"(?i)\b(last\s+(?:week|month|year|{DAYS}))\b", 1, 0.6),
    Extractor("location", rf"(?i)\b({STORES})\b", 1, 0.9, "located_at"),
    Extractor("location", r"\b(?:at|from|to|in|near|visited|shopped\s+at|went\s+to)\s+((?:the\s+)?[A-Z][A-Za-z0-9'&-]*(?:\s+(?:of\s+)?[A-Z0-9][A-Za-z0-9'&-]*){0,4})", 1, 0.55, "located_at"),
    Extractor("person", rf"\b(?:[Mm]y\s+(?:{KIN})\s+(?:is\s+called\s+|named\s+|is\s+)?|(?:[Dd]r|[Mm]rs?|[Mm]s|[Mm]iss|[Pp]rof|[Pp]rofessor)\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1, 0.75),
    Extractor("entity", r"[\"“]([A-Z][\w' ,.:!?-]{1,80})[\"”]", 1, 0.85),
    Extractor("entity", r"\b((?:[A-Z][a-z']+\s+){1,4}[A-Z][a-z']+)\b", 1, 0.5),
    Extractor("preference", rf"(?i)\b(?:{LIKES})\s+([a-z0-9 '&-]{{1,80}})(?:[.,!;?]|$)", 1, 0.8),
    Extractor("value", r"(?i)\b((?:the\s+)?[a-z][a-z -]{1,40}?)\s+(?:is\s+worth|are\s+worth|appraised\s+at|valued\s+at|costs?)\s+([^.,!;?]{1,80})", 2, 0.8, "is_worth", 1, r"(?i)\s(?:is\s+worth|are\s+worth|appraised\s+at|valued\s+at|costs?)\s"),
    Extractor("value", r"(?i)\b((?:the\s+)?[a-z][a-z -]{1,40}?)\s+(?:sold\s+for|fetched)\s+([^.,!;?]{1,80})", 2, 0.8, "sold_for", 1, r"(?i)\s(?:sold\s+for|fetched)\s"),
    Extractor("amount", r"(?i)\bi\s+(?:paid|spent)\s+(\$?\d[\d.,]*\s*(?:dollars|usd|euros?|pounds?)?)\s+(?:for\s+)?((?:the\s+|an?\s+|my\s+)?[a-z][a-z-]+(?:\s+[a-z][a-z-]+){0,3})", 1, 0.7, "paid", 2),
    Extractor("old_fact", rf"(?i)\b(?:{OLD})\s+([^.,!;?]{{1,200}})", 1, 0.7),
    Extractor("new_fact", rf"(?i)\b(?:{NEW})\s+([^.,!;?]{{1,200}})", 1, 0.7),
)
MARK = "\u0001"
TITLE = r"\b(Dr|Mr|Mrs|Ms|Prof)\.\s"
ENDS = r"([.!?])\s+"
WORD = "[A-Za-z][A-Za-z'-]+"


def number(text: Column) -> Column:
    """Digits of a number in digits or words; null for other words."""
    words = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, str(n))])
    first = F.substring_index(F.regexp_replace(F.lower(text), r"\s+", " "), " ", 1)
    plain = F.when(first.rlike(r"^\d"), first).otherwise(F.element_at(words, first))
    return F.when(F.lower(text).rlike(r"half$"), F.concat(plain, F.lit(".5"))).otherwise(plain)


def subject_before(head: Column) -> Column:
    """The noun phrase at the end of ``head``: up to four words before a verb or a word without content; where it is a pronoun
    or missing, the last phrase with an article."""
    inside = lambda w, words: F.lower(w).isin(words)
    back = F.reverse(F.regexp_extract_all(head, F.lit(WORD), F.lit(0)))

    def content(words: Column) -> Column:
        start = F.array_position(F.transform(words, lambda w: ~inside(w, NOISE)), True)
        return F.when(start > 0, F.slice(words, start.cast("int"), F.size(words))).otherwise(F.array().cast("array<string>"))

    def before_verb(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda w: inside(w, NOISE + VERBS)), True)
        return F.slice(rest, F.lit(1), F.least(F.lit(4), F.when(stop > 0, stop - 1).otherwise(F.size(rest))).cast("int"))

    def said(kept: Column) -> Column:
        words = F.array_join(F.reverse(kept), " ")
        last = let(F.regexp_extract_all(head, F.lit(NOUN_PHRASE), F.lit(1)), lambda phrases: F.when(F.size(phrases) > 0, F.element_at(phrases, -1)))
        return F.when(F.forall(kept, lambda w: inside(w, PRONOUNS)), F.coalesce(last, words)).otherwise(words)

    return let(let(let(back, content), before_verb), said)


def candidates(texts: DataFrame, key: list[str]) -> DataFrame:
    """``key`` plus (clause_no, type, relation, value, unit, span, subject, clause, confidence): what each text says, once."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), MARK, " "), TITLE, "$1 ")
    clauses = F.split(F.regexp_replace(F.regexp_replace(body, ENDS, f"$1{MARK}"), r"\n+", MARK), MARK)
    rows = texts.select(*key, F.posexplode(clauses).alias("clause_no", "clause")).where("clause <> ''")

    def tried(i: int, x: Extractor) -> Column:
        """What an extractor finds in a clause, its groups read once; null where its pattern does not match."""
        group = lambda g, name: F.regexp_extract_all("clause", F.lit(x.pattern), F.lit(g)).alias(name)
        cells = [group(0, "span"), group(x.value, "value")] + ([group(x.extra, "extra")] if x.extra else []) + ([group(1, "frame")] if x.type == "count" else [])
        matches = F.transform(F.arrays_zip(*cells), lambda m, n: F.struct(
            F.lit(i).alias("rule"), n.alias("n"), F.lit(x.type).alias("type"), F.lit(x.relation).alias("relation"), F.trim(m["value"]).alias("value"),
            (F.lower(m["extra"]) if x.extra else F.lit("")).alias("extra"), F.trim(m["span"]).alias("span"),
            (F.when(m["frame"] != "", 0.8).otherwise(x.confidence) if x.type == "count" else F.lit(x.confidence)).alias("confidence")))
        return F.when(F.col("clause").rlike(x.needs or x.pattern), matches)

    every = F.flatten(F.array_compact(F.array(*[tried(i, x) for i, x in enumerate(EXTRACTORS)])))
    found = rows.select(*key, "clause_no", "clause", F.explode(every).alias("x")).select(*key, "clause_no", "clause", "x.*")
    kind = F.col("type")
    head = F.split_part("clause", F.col("span"), F.lit(1))
    from_verb = lambda pattern: F.regexp_replace(head, pattern + ".*$", "")
    subject = (F.when(kind == "duration", subject_before(from_verb(SPENT))).when(kind == "location", subject_before(from_verb(COMPLETED)))
               .when(kind.isin("value", "amount"), F.regexp_replace(F.regexp_replace("extra", r"^(?:the|an?|my|our|their)\s+", ""), r"\s+(?:in|on|at|from|to|with|by|for|of|during|since|until)$", "")).otherwise(""))
    if_only = F.col("clause").rlike(HYPOTHETICAL)
    relation = (F.when((kind == "duration") & if_only, "hypothetical_duration").when((kind == "location") & if_only, "looking_at")
                .when((kind == "location") & F.col("clause").rlike(COMPLETED) & (F.col("confidence") < 0.9), "got_at").otherwise(F.col("relation")))
    confidence = F.when((kind == "duration") & if_only, 0.4).when((kind == "location") & if_only, F.when(F.col("confidence") == 0.9, 0.4).otherwise(0.3)).otherwise(F.col("confidence"))
    digits = number(F.col("value"))
    single = F.regexp_replace("extra", "s$", "")
    long = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LONG_UNITS.items() for x in p]), single), single)
    unit = F.when(kind == "count", F.col("extra")).when(kind == "duration", long).when((kind == "preference") & F.col("span").rlike(DISLIKE), "dislike").when(kind == "preference", "like").otherwise("")
    value = F.when(kind.isin("count", "duration"), digits).otherwise(F.col("value"))
    said = found.select(*key, "clause_no", "rule", "n", "type", relation.alias("relation"), value.alias("value"), unit.alias("unit"), "span", subject.alias("subject"), "clause", confidence.alias("confidence"), single.alias("_single"))
    sound = said.where("value is not null and value <> ''").where((kind != "count") | (F.length("_single") >= 4) & ~F.col("_single").isin(NO_UNITS))
    changes = kind.isin("old_fact", "new_fact")
    same = F.concat_ws(MARK, F.lower("value"), F.when(kind == "count", F.col("_single")).otherwise(F.when(kind == "duration", F.concat("unit", F.lower("subject"))).otherwise("")), F.when(changes, F.concat_ws(",", "clause_no", "n")).otherwise(""))
    cells = ["clause_no", "rule", "n", "relation", "value", "unit", "span", "subject", "clause", "confidence"]
    first = sound.groupBy(*key, "type", same.alias("_same")).agg(F.min(F.struct(*cells)).alias("x"))
    return first.select(*key, "type", *[f"x.{c}" for c in cells if c not in ("rule", "n")])


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]+"), F.lit(0)), lambda w: ~w.isin(QUESTION_STOPS)))


#: What words of a question ask for.
TYPE_OF_KIND = {"count": "count", "duration": "duration", "date": "date", "location": "location", "person": "person", "preference": "preference"}
RELATION_OF_WORD = {"pay": "paid", "paid": "paid", "spent": "paid", "spend": "paid", "worth": "is_worth", "value": "is_worth", "valued": "is_worth", "cost": "is_worth", "took": "duration_of",
                    "take": "duration_of", "lasted": "duration_of", "got": "got_at", "earn": "got_at", "earned": "got_at", "graduated": "got_at"}
TYPES_OF_WORD = {"worth": ("value",), "value": ("value",), "valued": ("value",), "cost": ("value", "amount"), "costs": ("value", "amount"), "pay": ("amount", "value"), "paid": ("amount", "value"),
                 "spent": ("amount", "value"), "spend": ("amount", "value"), "long": ("duration",), "lasted": ("duration",), "took": ("duration",), "where": ("location",), "when": ("date",), "who": ("person", "entity")}
DONE = r"(?i)\b(?:did|got|have|had|finished|completed|earned|received|graduated|took|spent|paid|wrote|made|bought|won)\b"
IF_ONLY = r"(?i)\b(?:considering|thinking|might|planning|looking\s+at)\b"
NEAR = {"degree": ("degree", "graduated", "graduation", "bachelor", "master"), "job": ("job", "occupation", "work", "career", "role"), "gift": ("gift", "present", "bought for"), "pack": ("pack", "packed", "luggage", "suitcase")}
FAR = {"degree": ("recipe", "surgery", "shopping"), "job": ("recipe", "surgery", "shopping list"), "gift": ("surgery", "groceries", "recipe", "appointment")}
ORDER = ("clause_no", "type", "value", "seq")


#: Asked sessions up to which texts are filtered where they are read.
MAX_SESSIONS = 500_000


def asked_texts(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """The texts of sessions that a question is asked about: no other candidate can meet one. Sessions are counted: few are
    broadcast."""
    asked = questions.select("session").distinct()
    return texts.join(F.broadcast(asked) if asked.count() <= MAX_SESSIONS else asked, "session", "left_semi")


def ranked(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates of each question's session with their score and rank, those with a score above 0. A question meets the
    candidates of its own session only."""
    rows = questions.select("query_id", "session", "kind", "question", content_words(F.col("question")).alias("q")).join(found, "session")
    hits = lambda c: F.size(F.array_intersect(F.col("q"), content_words(F.col(c))))
    implied = F.array_compact(F.array(*[F.when(F.array_contains("q", w), r) for w, r in RELATION_OF_WORD.items()]))
    low, text = F.lower("question"), F.lower(F.concat_ws(" ", "clause", "subject"))
    anchors = lambda table, add: reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(k)) & F.contains(text, F.lit(a)), add).otherwise(0.0) for k, words in table.items() for a in words])
    personal = low.rlike(r"\b(?:i|my|me|mine)\b")
    kind_type = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in TYPE_OF_KIND.items()])
    score = (
        2.0 * hits("subject") + hits("span") + 0.5 * hits("value") + 0.2 * F.col("confidence")
        + F.when(F.col("relation").isin(FACTUAL), 0.5).when(F.col("relation").isin(HYPOTHETICALS), -0.5).otherwise(0.0)
        + F.when(F.size(implied) == 0, 0.0).when(F.array_contains(implied, F.col("relation")), 0.7).otherwise(-0.3)
        + F.when(F.col("type") == kind_type, 0.2).otherwise(0.0) + anchors(NEAR, 0.6) + anchors(FAR, -0.5)
        + F.when(personal & (F.col("role") == "user"), 0.4).when(personal & (F.col("role") == "assistant"), -0.2).otherwise(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ORDER)
    return rows.withColumn("score", F.round(score, 6)).where("score > 0").withColumn("rank", F.row_number().over(order))


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``ranked``) plus reason: ``ok``, or the first of five checks that fails. The last is against the other
    candidates of the question with the same type. One that shares more words with the question wins; with as many, and a
    subject word in common, a fact beats a possibility and then the surer one wins. Groups by type and by subject word hold
    the best of each, so candidates are never paired."""
    words = content_words(F.col("subject"))
    spoken = rows.withColumns({"_words": words, "_hits": F.size(F.array_intersect("q", words)), "_fact": F.col("relation").isin(FACTUAL).cast("int")})
    most = F.max(F.when(F.size("_words") > 0, F.col("_hits"))).over(Window.partitionBy("query_id", "type"))
    keyed = written(spoken.withColumn("_most", most))  # read twice, and texts are not searched twice
    by_word = Window.partitionBy("query_id", "type", "_hits", "_word")
    lost = F.when((F.max("_fact").over(by_word) == 1) & (F.col("_fact") == 0), "weaker_relation").when(
        F.max("confidence").over(Window.partitionBy("query_id", "type", "_hits", "_word", "_fact")) > F.col("confidence") + 0.15, "weaker_confidence")
    beaten = keyed.select("query_id", "rank", "type", "_hits", "_fact", "confidence", F.explode("_words").alias("_word")).withColumn("_lost", lost)
    beaten = beaten.groupBy("query_id", "rank").agg(F.max("_lost").alias("_lost"))
    ground = F.size(F.array_intersect("q", content_words(F.concat_ws(" ", "clause", "span"))))
    low = F.lower("question")
    has = lambda w: low.rlike(rf"\b{w}\b")
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
    kind_type = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in TYPE_OF_KIND.items()])
    wrong_type = (kind_type.isNotNull() & (F.col("type") != kind_type)) | any_of([has(w) & ~F.col("type").isin(list(t)) for w, t in TYPES_OF_WORD.items()])
    wrong_relation = any_of([has(w) & F.col("relation").isin("paid", "is_worth") & (F.col("relation") != r) for w, r in RELATION_OF_WORD.items() if r in ("paid", "is_worth")])
    only = F.col("relation").isin(HYPOTHETICALS)
    unreal = ~F.col("question").rlike(IF_ONLY) & only & (F.col("question").rlike(DONE) | (F.col("confidence") < 0.35))
    subject = (F.size("_words") > 0) & (F.size("q") > 0)
    reason = (F.when((F.size("q") > 0) & (ground == 0), "span_no_overlap").when((F.col("subject") != "") & (F.size("q") > 0) & (F.col("_hits") == 0), "subject_mismatch")
              .when(wrong_type | wrong_relation, "answer_type_mismatch").when(unreal, "hypothetical_relation")
              .when(subject & (F.col("_most") > F.col("_hits")), "weaker_question_overlap").when(subject & F.col("_lost").isNotNull(), F.col("_lost")).otherwise("ok"))
    return keyed.join(beaten, ["query_id", "rank"], "left").withColumn("reason", reason).drop("_words", "_hits", "_fact", "_most", "_lost")


TOP_FACTS, TOP_CLAIMS, LONGEST_CLAIM = 8, 6, 20
LIKES_SHOWN, AVOIDS_SHOWN = 5, 3
MIN_COUNT_CONFIDENCE = 0.6


def answers(rows: DataFrame) -> DataFrame:
    """(query_id, kind, answer) from ``verified`` rows, one plan for each kind of question, all in one aggregation: counts take the
    surest number whose unit the question names, dates the most specific one, updates the newest statement that is marked
    as current, preferences likes and avoids, and the others the first verified value, else a short leading claim."""
    top = lambda n: F.col("rank") <= n
    best = lambda where, *order: F.max(F.when(where, F.struct(*order, "value")))["value"]
    back = (-F.col("rank")).alias("back")
    single = F.regexp_replace(F.lower("unit"), "s$", "")
    named = (F.col("type") == "count") & (F.col("confidence") >= MIN_COUNT_CONFIDENCE) & (F.length(single) >= 3) & F.contains(F.lower("question"), single)
    marked = F.col("clause").rlike(rf"(?i)\b(?:{NEW})\b").cast("int") - F.col("clause").rlike(rf"(?i)\b(?:{OLD})\b").cast("int")
    fact = F.min(F.when(top(TOP_FACTS) & (F.col("reason") == "ok"), F.struct("rank", "value")))["value"]
    claim = F.max(F.when(top(1) & (F.size(F.array_remove(F.split("clause", r"\s+"), "")) <= LONGEST_CLAIM), F.col("clause")))
    said = lambda unit, n: F.concat_ws(", ", F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(
        top(TOP_FACTS) & (F.col("type") == "preference") & (F.col("unit") == unit) & (F.col("role") == "user"), F.struct("rank", F.lower("value").alias("v"))))), lambda x: x["v"])), 1, n))
    grouped = rows.groupBy("query_id", "kind").agg(
        best(named, "confidence", F.length("unit").alias("len"), back).alias("count"), best(top(TOP_CLAIMS) & (F.col("type") == "date"), "confidence", back).alias("date"),
        best(top(TOP_CLAIMS), marked.alias("marked"), "seq", back).alias("update"), F.concat(F.lit("likes "), said("like", LIKES_SHOWN), F.lit("; avoids "), said("dislike", AVOIDS_SHOWN)).alias("preference"),
        F.coalesce(fact, claim).alias("fact"))
    by_kind = reduce(lambda a, k: F.when(F.col("kind") == k, F.col(k)).otherwise(a), ("count", "date", "update", "preference"), F.col("fact"))
    return grouped.select("query_id", "kind", by_kind.alias("answer"))


ANCHORS, REPLIES = 3, 2


def assistant_replies(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, seq, text): the next two assistant turns after each of the three user turns of the question's session that
    share most words with it. Assistant turns are numbered within a session, so that a reply is found by an equal number."""
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("replies", F.sum((F.col("role") == "assistant").cast("long")).over(so_far))
    asked = questions.select("query_id", "session", content_words(F.col("question")).alias("q"))
    shared = F.size(F.array_intersect("q", content_words(F.coalesce("text", F.lit("")))))
    met = numbered.where("role = 'user'").join(asked, "session").withColumn("shared", shared).where("shared > 0")
    anchors = met.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "seq"))).where(F.col("_k") <= ANCHORS)
    next_ones = anchors.select("query_id", "session", F.explode(F.transform(F.sequence(F.lit(1), F.lit(REPLIES)), lambda i: F.col("replies") + i)).alias("replies")).distinct()
    return numbered.where("role = 'assistant'").join(next_ones, ["session", "replies"]).select("query_id", "seq", "text")
