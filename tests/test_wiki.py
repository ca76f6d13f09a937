"""Facts, pages and ranked turns against rows written by hand; refreshes against pages made at once."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import wiki
from tessera.sources.store import committed

TURNS = "owner long, seq long, role string, text string, as_of date, hint string"
DAY = dt.date(2023, 5, 1)


def test_facts(spark):
    rows = [
        (1, 1, "user", 'I play the playlist on Spotify that I created, called "Summer Vibes", often', DAY, None), (1, 2, "user", "My commute, which takes 45 minutes each way, is long", None, None), (1, 3, "user", "my daily commute takes an hour.", None, None),
        (1, 4, "user", "I redeemed a $5 coupon on coffee creamer last Sunday, at last", DAY, "TARGET"), (1, 5, "user", "I redeemed a $5 coupon on coffee creamer", DAY, "Costco"), (1, 6, "user", "a degree in Business, and a play called Hamlet. So", None, None),
        (1, 7, "user", "the production of Cats, a film", DAY, None), (1, 8, "assistant", "a degree in Art.", DAY, None), (1, 9, "user", None, DAY, None), (None, 10, "user", "degree in X", None, None),
    ]
    got = {(r["seq"], r["fact_key"]): (r["owner"], r["topic"], r["text"]) for r in wiki.facts(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {
        (1, "spotify_playlist"): (1, "music", 'The user created a Spotify playlist called "Summer Vibes".'), (2, "commute_duration"): (1, "commute", "The user's daily commute takes 45 minutes each way."),
        (3, "commute_duration"): (1, "commute", "The user's daily commute takes an hour."), (4, "target_coupon_redeemed"): (1, "shopping", "The user redeemed a $5 coffee creamer coupon at Target."),
        (6, "degree"): (1, "education", "The user graduated with a degree in Business."), (6, "theater_play"): (1, "hobbies", 'The user attended the play "Hamlet" at the local community theater.'),
        (10, "degree"): (None, "education", "The user graduated with a degree in X."),
    }


def test_routed(spark):
    frame = spark.createDataFrame([("Lo-Fi beats",), ("the COMMUTE by music",), ("a school run",), ("a long run",), ("guitar",), ("rain",), (None,)], "t string")
    assert [r["x"] for r in frame.select(wiki.routed(F.col("t")).alias("x")).collect()] == ["music", "music", "education", "health_fitness", "hobbies", "misc", "misc"]


FACTS = [
    (1, "commute", "commute_duration", "It takes 1 hour.", DAY, 1), (1, "commute", "commute_duration", "It takes 2 hours.", dt.date(2023, 6, 1), 2), (1, "commute", "commute_duration", "It takes 3 hours.", dt.date(2023, 6, 1), 3),
    (1, "commute", "commute_duration", "It takes 4 hours.", None, 4), (1, "education", "degree", "Of arts.", None, 5), (2, "education", "degree", "Of law.", None, 6), (None, "education", "degree", "Of none.", DAY, 7), (2, None, "degree", "A guitar.", DAY, 8),
]


def whole(df):
    return sorted(map(str, df.select("owner", "topic", "section", "fact_key", "as_of", "seq", "line").collect()))


def test_pages(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, wiki.FACT)
    root = f"file://{tmp_path}/pages"
    assert wiki.refresh(frame([]), root) is None and wiki.pages(spark, root).count() == 0
    wiki.refresh(frame(FACTS[:2] + FACTS[4:5] + FACTS[6:7]), root)
    current = {(r["owner"], r["topic"]): r["line"] for r in wiki.pages(spark, root).where("section = 'Current Facts'").collect()}
    assert current == {(1, "commute"): "- As of 2023-06-01, it takes 2 hours.", (1, "education"): "- Of arts.", (None, "education"): "- As of 2023-05-01, of none."}
    second = wiki.refresh(frame(FACTS[2:4] + FACTS[5:6] + FACTS[7:]), root)
    assert {(r["owner"], r["topic"]) for r in wiki.runs_of(spark, f"{root}/pages", [second], wiki.LINE).collect()} == {(1, "commute"), (2, "education"), (2, "education")}  # only what was touched
    routed = [f if f[1] else (*f[:1], "education", *f[2:]) for f in FACTS]  # its key is a degree
    assert whole(wiki.pages(spark, root)) == whole(wiki.lines(frame(routed)))
    assert {r["seq"] for r in wiki.pages(spark, root).where("section = 'Current Facts' and topic = 'commute'").collect()} == {2}  # of equal dates the first
    frame(FACTS).write.parquet(f"{root}/facts/lost")
    assert whole(wiki.pages(spark, root)) == whole(wiki.lines(frame(routed))) and len(committed(spark, root)) == 2


def test_ranked(spark):
    turns = spark.createDataFrame([
        (1, 1, "user", "I returned the boots"), (1, 2, "user", "nothing here"), (1, 3, "assistant", "how long: 45 minutes to return it"), (1, 4, None, "the camping trip was a 3-day camping trip"), (1, 5, "system", None), (2, 6, "user", "return")], "session int, seq long, role string, text string")
    asked = spark.createDataFrame([(1, 1, "When did I return the boots?"), (2, 1, "is it"), (3, 1, None), (4, 1, "Which camping trips?"), (5, 9, "boots")], "query_id int, session int, question string")
    got = {}
    for r in wiki.ranked(asked, turns, 2).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["seq"], r["score"]))
    # "return" and "boots": half the words each; an assistant's turn with "return" gets a point for it
    assert got == {1: [(3, 5.75), (1, 3.25)], 2: [(1, 1.25), (2, 1.25)], 3: [(1, 1.25), (2, 1.25)], 4: [(4, 13.25), (1, 1.25)]}
