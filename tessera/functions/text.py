"""Text expressions and rules, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed as fx

SECRET = "|".join(f"(?:{p})" for p in fx.SECRETS)
QUESTION_TYPES = fx.QUESTION_TYPES


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscore, Unicode."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of words (letters and digits of any language) padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_label(text: Column, rules, default: str | None) -> Column:
    """The first rule that matches gives the label."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def sentences(text: Column) -> Column:
    """Parts between sentence ends with white space, and lines, trimmed, without empty ones."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), r"\n+", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda p: p != "")


def is_secret(text: Column) -> Column:
    return text.rlike(SECRET)


def is_retraction(text: Column) -> Column:
    """A statement that an earlier one was never true."""
    return text.rlike(fx.RETRACTION)


def attribute(text: Column) -> Column:
    """What a statement is about: one of four attributes, else the phrase of "my <phrase> is <value>"."""
    phrase = F.lower(F.regexp_replace(strip(F.regexp_extract(text, fx.POSSESSIVE, 1)), r"\s+", " "))
    value = strip(F.regexp_extract(text, fx.POSSESSIVE, 2))
    opinion = F.element_at(F.split(phrase, " "), -1).isin(*fx.OPINIONS)
    own = F.when(text.rlike(fx.POSSESSIVE) & ~value.rlike(fx.CLAUSE_VALUE) & ~opinion & (F.length(phrase) >= 3), phrase)
    return F.coalesce(first_label(text, fx.ATTRIBUTES, None), own)


def durable_rule(sentence: Column) -> Column:
    """The rule by which a sentence is a durable statement of its speaker; null if it is none."""
    brief = (F.length(sentence) <= fx.MAX_CHARS) & ~sentence.endswith("?")
    rule = F.coalesce(first_label(sentence, fx.STATIVE, None), F.when(attribute(sentence).isNotNull(), "changed-attribute"))
    refused = (
        (word_count(sentence) < fx.MIN_WORDS) | is_secret(sentence) | sentence.rlike(fx.UNCERTAIN) | sentence.rlike(fx.NEGATED)
        | (sentence.rlike(fx.PROGRESSIVE) & ~sentence.rlike(fx.STATIVE_PROGRESSIVE)))
    for pattern in fx.REJECTED:
        refused = refused | sentence.rlike(pattern)
    return F.when(brief & rule.isNotNull() & ~refused, rule)  # few sentences have a rule; only these are searched for what refuses them


def independent(clause: Column) -> Column:
    words = word_count(clause)
    return (words >= 3) & ~clause.rlike(fx.SUBORDINATOR) & clause.rlike(fx.VERB) & (clause.rlike(fx.SUBJECT) | (words >= 4))


def clauses(text: Column) -> Column:
    """Statements of a text: its sentences, and the parts between commas of a sentence whose parts can all stand alone."""
    marked = F.regexp_replace(strip(text), r"([.!?;])\s+", "$1\u0001")
    found = F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")

    def parts(sentence: Column) -> Column:
        cut = F.transform(F.split(sentence, ",", -1), strip)
        ended = F.transform(cut, lambda p: F.when(p.rlike(r"[.!?]$"), p).otherwise(F.concat(p, F.lit("."))))
        return F.when((F.size(cut) > 1) & F.forall(cut, independent), ended).otherwise(F.array(sentence))

    return F.flatten(F.transform(found, parts))


def plural_word(word: Column) -> Column:
    return (F.when(word.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
            .when(word.rlike("(?i)[^aeiou]y$"), F.concat(F.left(word, F.length(word) - 1), F.lit("ies"))).otherwise(F.concat(word, F.lit("s"))))


def plural(noun: Column, count: Column) -> Column:
    """The noun for a count: its head is the word before the first preposition, else the last."""
    words = F.split(strip(noun), r"\s+")
    before = F.array_position(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.lower(w).isin(*fx.PREPOSITIONS)), True)
    head = F.when(before > 0, before).otherwise(F.size(words)) - 1
    named = F.array_join(F.transform(words, lambda w, i: F.when(i == head, plural_word(w)).otherwise(w)), " ")
    return F.when(count == 1, noun).otherwise(named)


def number(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def fact_sentence(subject: Column, predicate: Column, count: Column, total: Column, unit: Column) -> Column:
    """For example "User has 4 sessions totaling 140 hours."."""
    who = F.when(subject == "", "User").otherwise(F.concat(F.upper(F.left(subject, F.lit(1))), F.substring(subject, 2, 1 << 20)))
    tail = F.when(total.isNotNull() & (F.coalesce(unit, F.lit("")) != ""), F.concat(F.lit(" totaling "), number(total), F.lit(" "), unit)).otherwise("")
    return F.concat(who, F.lit(" has "), count.cast("string"), F.lit(" "), plural(predicate, count), tail, F.lit("."))


def names_predicate(predicate: Column, question: Column) -> Column:
    """Whether a word of three letters or more of the predicate is, in singular or plural, a word of the question."""
    words = F.filter(F.regexp_extract_all(F.lower(predicate), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    asked = F.regexp_extract_all(F.lower(question), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.exists(words, lambda w: F.exists(asked, lambda q: F.regexp_replace(w, "s$", "").isin(q, F.regexp_replace(q, "s$", ""))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def relations(text: Column) -> Column:
    """Array of (subject, predicate, object) that the relation patterns find, in the order of the patterns. Only the parts
    between marks that hold a verb of a relation are tried."""

    def of(said: Column, kind: str, pattern: str) -> Column:
        group = lambda g: F.flatten(F.transform(said, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(g))))
        both = F.arrays_zip(group(1).alias("s"), group(2).alias("o"))
        return F.transform(both, lambda x: F.struct(F.trim(x["s"]).alias("subject"), F.lit(kind).alias("predicate"), F.trim(x["o"]).alias("object")))

    parts = F.filter(F.split(text, fx.RELATION_BORDER), lambda s: s.rlike(fx.RELATION_VERB))
    return let(parts, lambda said: F.concat(*[of(said, kind, p) for kind, p in fx.RELATIONS]))


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern without the blanks and marks around them, the first of each in any case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.btrim(x, F.lit(" .,;:'\"")))
    return F.filter(found, lambda x, i: (x != "") & ~F.exists(F.slice(found, 1, i), lambda y: F.lower(y) == F.lower(x)))


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[ \t\n\r]+", " ")


def answer_text(text: Column) -> Column:
    """Lower case, number words as digits, without articles and marks (``% . - /`` stay), single blanks."""
    out = F.lower(strip(text))
    for word, value in fx.NUMBER_WORDS:
        out = F.regexp_replace(out, rf"\b{word}\s+and\s+a\s+half\b", f"{value}.5")
    for word, value in fx.NUMBER_WORDS:
        out = F.regexp_replace(out, rf"\b{word}\b", value)
    out = F.regexp_replace(F.regexp_replace(out, r"\b(?:the|a|an)\b", " "), r"[^\p{L}\p{N}_\s%.\-/]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def answer_stage(expected: Column, predicted: Column) -> Column:
    """The first way in which an answer is right: exact, normalized, numeric, unit, rule_semantic; else wrong."""
    e, p = strip(F.coalesce(expected, F.lit(""))), strip(F.coalesce(predicted, F.lit("")))
    en, pn = answer_text(e), answer_text(p)
    both = (e != "") & (p != "")
    percent = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent\b)"
    share = lambda t: F.regexp_extract(t, percent, 1).try_cast("double")
    same_share = e.rlike(percent) & p.rlike(percent) & (share(e) == share(p))
    within = (F.size(numbers(e)) > 0) & (F.size(numbers(p)) > 0) & (F.size(F.array_except(numbers(e), numbers(p))) == 0)
    same_numbers = (en == pn) | (F.size(numbers(en)) > 0) & (F.size(numbers(pn)) > 0) & (F.array_sort(numbers(en)) == F.array_sort(numbers(pn)))
    told = both & (F.contains(F.lower(p), F.lower(e)) | (F.contains(F.lower(e), F.lower(p)) & (F.length(p) >= 3)) | (e.rlike(fx.UNKNOWN) & p.rlike(fx.UNKNOWN)))
    return (F.when(both & (e == p), "exact").when((en != "") & (en == pn), "normalized").when(same_share | within, "numeric")
            .when(same_numbers, "unit").when(told, "rule_semantic").otherwise("wrong"))


def defanged(text: Column) -> Column:
    """A quoted memory that cannot open a tag: single blanks, angle brackets as parentheses."""
    return F.translate(F.trim(F.regexp_replace(text, r"\s+", " ")), "<>", "()")


def cut_at_word(text: Column, max_chars: int) -> Column:
    """The text, or its beginning up to a blank in its second half, with an ellipsis."""
    cut = F.left(text, F.lit(max_chars - 1))
    blank = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_word = F.when((F.instr(cut, " ") > 0) & (blank > max_chars // 2), F.left(cut, blank)).otherwise(cut)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(at_word, F.lit("…")))


def cut_to_tokens(text: Column, max_tokens: int) -> Column:
    """The text if it has so few words, else four characters a token and an ellipsis."""
    return F.when(word_count(text) <= max_tokens, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(4 * max_tokens))), F.lit("…")))


def parsed_date(text: Column) -> Column:
    """A date or timestamp in ISO form, or a bare year; anything else is null."""
    t = strip(text)
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"), F.try_to_timestamp(F.regexp_replace(t, "T", " ")))
    return F.coalesce(iso, F.when(t.rlike(r"^[0-9]{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")))))


def haystack_date(text: Column) -> Column:
    """"2023/05/30 (Tue) 21:40" and "2023/05/30"."""
    t = F.regexp_replace(F.regexp_replace(strip(text), r"\s*\([A-Za-z]+\)\s*", " "), "/", "-")
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2})?$"), F.try_to_timestamp(t))
