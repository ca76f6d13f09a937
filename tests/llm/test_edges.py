"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, exact, jaccard, language, lm, packing, quality, tokenfile, tokens, urls, warc
from tessera.llm.queries import tokenizer

LINE = "the cat sat on a mat and looked at the moon for a while"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(9000))
TEXTS = [(1, None), (2, ""), (3, "a"), (4, LINE), (5, LINE), (5, LINE), (6, LONG), (7, "x" * 30000), (8, "no spaces<|endoftext|>  two  "), (9, "日本語 é ß\n\nok"), (None, LINE + " null id"), (10, " " * 50)]
SCHEMA = "doc_id long, text string, lang string, n long, sha256 string, kept string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", 7, "mine", "mine", "mine") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(path, text):
    t = bpe.Codec.of(path).library
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_packing(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    assert packing.pack_documents(none, path).count() == 0
    rows = packing.pack_documents(docs, path).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in TEXTS:
        want = np.append(ids(path, t), 1).astype("<u4")
        pieces = {(r["start"], r["length"], r["ids_crc32"]) for r in by[d, len(want)]}
        assert {(s, len(want[s : s + 2048]), zlib.crc32(want[s : s + 2048].tobytes())) for s in range(0, len(want), 2048)} <= pieces
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_shortest_pack_first_places_every_length():
    rng = np.random.default_rng(3)
    histogram = collections.Counter(int(x) for x in rng.integers(1, 2049, 5000))
    patterns = packing.shortest_pack_first(histogram)
    placed = collections.Counter()
    for n, pattern in patterns:
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += n
    assert placed == histogram
    assert sum(n for n, _ in patterns) * 2048 <= 1.05 * sum(k * v for k, v in histogram.items()) + 2048


def test_warc_round_trip(spark):
    big = "é" * 200_000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nx", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "y" * 100), (7, "u", "y" * 100), (8, "u", "y" * 100)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    chunks = warc.read(warc.write(warc.chunked(warc.typed_records(frame))))
    data = chunks.where("page_id = 1").orderBy("chunk_no").collect()
    assert len(data) > 1 and b"".join(r["data"] for r in data).decode() == big
    got = sorted(tuple(r) for r in warc.records(chunks).collect())
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = min(q for q, _, g in rows if (g or "") == (h or ""))
        again = len(raw) >= 100 and p != first
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert [g[:4] for g in got] == sorted(w[:4] for w in want) and {g[0]: g[4] for g in got} == {w[0]: w[4] for w in want}
    empty = frame.limit(0)
    assert warc.records(warc.read(warc.write(warc.chunked(warc.typed_records(empty))))).count() == 0


def test_bpe_equals_the_library(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    assert tokens.encode(none, path).count() == 0
    out = tokens.decode(tokens.encode(docs, path, leaf=256), path).collect()
    want = collections.Counter((d, ids(path, t).tobytes(), t or "") for d, t in TEXTS)
    assert collections.Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in out) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_codec_on_odd_texts(name):
    import random

    rng, codec = random.Random(5), bpe.Codec(tokenizer(name))
    texts = ["".join(rng.choice("ab '\n\t.é1!sS日\u00a0") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    for t in [*texts, "'s" * 3000, "ab1!" * 3000, "ﬁ İ Σς", "\x1c a\x85b"]:
        assert codec.encode(t) == bpe.as_bytes(codec.library.encode(t, add_special_tokens=False).ids)


def test_tree_merge_equals_plain_merge():
    import random

    rng, codec = random.Random(1), bpe.Codec(tokenizer("byte_bpe_50k.json"))
    for _ in range(60):
        raw = "".join(rng.choice("abcde") for _ in range(rng.randint(30, 900))).encode()
        assert bpe.tree_merge(codec._one, raw, codec.of_id, leaf=16) == codec._one(raw)


def test_quality(docs, none):
    assert quality.line_first(none).count() == 0
    got = {r["doc_id"]: r for r in quality.line_first(docs).collect()}
    assert not got[1]["kept"] and got[1]["n_words"] == 0 and got[2]["n_dup_lines"] == 0 and got[10]["n_words"] == 0
    words = LONG.split()
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert got[6]["n_words"] == len(words) and got[6]["n_repeat_words"] == len(covered) and got[6]["lang"] == "en"


def test_quality_line_rules(spark):
    prose = "\n".join(f"line {i} says thing{i} about place{i} and time{i} in year{i} for all" for i in range(12))
    bad = "\n".join(f"{w}### {w}$$$ x{w}*** y{w}%%%" for w in map(str, range(60)))
    rows = spark.createDataFrame([(1, prose + "\nHome\nAll Rights Reserved."), (2, bad)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.line_first(rows).collect()}
    assert got[1]["kept"] and got[1]["n_removed_lines"] == 2 and got[1]["clean_text"] == prose
    assert not got[2]["kept"] and not got[2]["base_failed"]


def test_lm(docs, none, spark):
    model, counts, total, _ = lm.fit(none)
    assert lm.score(docs, model, counts, total).count() == len(TEXTS)
    model, counts, total, distinct = lm.fit(docs)
    C = collections.Counter()
    for _, t in TEXTS:
        C.update([*(t or "").encode().lower().split(), b" "])
    assert (total, distinct) == (sum(C.values()), len(C))
    for r in lm.score(docs, model, counts, total).collect():
        t = next(t for d, t in TEXTS if d == r["doc_id"])
        w = [*(t or "").encode().lower().split(), b" "]
        assert math.isclose(r["base_score"], sum(math.log10((C[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), rel_tol=1e-9)
        assert r["n_tokens"] == len(w) == r["n_known"]


def test_lm_distributions_sum_to_one():
    words = np.array([10, 20, 30], np.uint64)
    a = lm.Automaton(words, np.array([5.0, 3.0, 2.0]), np.array([0 * 4 + 1, 0 * 4 + 2, 3 * 4 + 0]), np.array([3.0, 2.0, 2.0]), 10, 3, 2)
    for h in (0, 3):
        kept = sum(10 ** a.arcs[h * 4 + w] for w in range(3) if h * 4 + w in a.arcs)
        rest = 1 - sum(10 ** a.unigram[w] for w in range(3) if h * 4 + w in a.arcs)
        assert math.isclose(kept + 10 ** a.failure[h] * rest, 1.0)


def test_lm_keeps_rare_bigrams_of_a_large_corpus(spark):
    rng = np.random.default_rng(4)
    filler = [" ".join(f"w{i}" for i in rng.integers(0, 300, 6000)) for _ in range(60)]
    texts = [*filler, "few seen here w1", "then few seen w2 few", "few seen", "few unseen"]  # 360,000 tokens: 2 are below 1e-5 of them
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = rows.where("doc_id < 62")
    model, table, total, distinct = lm.fit(learned)
    tokens = [lm.token_hashes(t) for t in texts]
    words, counts = np.unique(np.concatenate(tokens[:62]), return_counts=True)
    size, pairs = len(words) + 1, collections.Counter()
    for t in tokens[:62]:
        place = np.searchsorted(words, t)
        pairs.update((np.append(len(words), place[:-1]) * size + place).tolist())
    kept = sorted(p for p, c in pairs.items() if c >= 2)
    whole = lm.Automaton(words, counts.astype(float), np.array(kept), np.array([float(pairs[p]) for p in kept]), total, distinct, 62)
    few, seen = np.searchsorted(words, lm.token_hashes("few seen")[:2])
    assert few * size + seen in whole.arcs and 2 < lm.MIN_WORD * total
    got = {r["doc_id"]: r for r in lm.score(rows, model, table, total).collect()}
    for d, t in enumerate(tokens):
        want, base, rest = whole.traverse(t)
        rare = len(rest) * math.log10(0.1 / whole.denominator)
        assert math.isclose(got[d]["score"], want + rare, rel_tol=1e-9) and math.isclose(got[d]["base_score"], base + rare, rel_tol=1e-9)
        assert got[d]["n_known"] == len(t) - len(rest)


def test_language(docs, none, spark):
    assert language.fit(none) == {}
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}
    rng = np.random.default_rng(0)
    make = lambda stock, n: " ".join(rng.choice(stock.split(), n))
    en, de = "the of and with house river stone light bridge over under garden water", "der und mit haus fluss stein licht brücke über unter garten wasser nicht"
    rows = spark.createDataFrame([(i, make(en if i % 2 else de, 80), "en" if i % 2 else "de") for i in range(60)] + [(90, "123 !!", "en"), (91, None, "de"), (92, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(rows, language.fit(rows.where("doc_id < 30"))).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and got[i]["accepted"] for i in range(60))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (90, 91, 92))


def test_language_learns_every_labelled_language(spark):
    rng = np.random.default_rng(1)
    stock = {f"l{i:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(30)] for i in range(70)}
    rows = spark.createDataFrame([(i * 4 + k, " ".join(rng.choice(words, 60)), lang) for i, (lang, words) in enumerate(stock.items()) for k in range(4)], "doc_id long, text string, lang string")
    learned = language.fit(rows.where("doc_id % 4 <> 0"))
    assert sorted(learned) == sorted(stock)
    got = language.predict(rows.where("doc_id % 4 = 0"), learned).collect()
    assert len(got) == 70 and all(r["lang_pred"] == r["lang"] and r["accepted"] for r in got)


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q"), (2, "https://a.b.net/es/1"), (3, "https://net/fr/"), (4, "nothing"), (5, None), (6, "http://example.com"), (7, "http://badexample.com/en/"),
            (8, "http://example.com/en/"), (8, "http://example.com/en/"), (9, "x://y.org/p#f"), (10, "http:///p")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.range_join(frame, urls.rules_frame(spark, urls.RULES)).collect()}
    assert got == {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.b.net", "/es/1", "net/es/", "block"), 3: ("net", "/fr/", "net/fr/", "block"),
                   4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("example.com", "", None, "allow"), 7: ("badexample.com", "/en/", "com/", "allow"),
                   8: ("example.com", "/en/", "example.com/en/", "block"), 9: ("y.org", "/p", None, "allow"), 10: ("", "/p", None, "allow")}
    assert urls.range_join(frame, urls.rules_frame(spark, urls.RULES)).count() == len(rows)
    assert urls.range_join(frame, urls.rules_frame(spark, [])).where("rule is not null").count() == 0
    assert urls.range_join(frame.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0


def test_exact(docs, none):
    plain = docs.select("doc_id", "text")
    got = exact.decisions(plain, exact.copy_groups(plain)).collect()
    assert len(got) == len(TEXTS)
    groups = collections.defaultdict(list)
    for d, t in TEXTS:
        groups[t or ""].append(d)
    for r in got:
        t = next(t for d, t in TEXTS if d == r["doc_id"]) or ""
        keep = max((d for d in groups[t] if d is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(groups[t]), r["doc_id"] == keep, hashlib.sha256(t.encode()).hexdigest())
    assert exact.copy_groups(none.select("doc_id", "text")).count() == 0
    assert set(exact.keep_one(docs, exact.copy_groups(plain)).columns) == set(docs.columns)


def sets(texts):
    out = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(texts):
    S = sets(texts)
    up = {d: d for d in S}

    def top(x):
        return x if up[x] == x else top(up[x])

    keys = sorted(S)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(S[a] & S[b])
            if S[a] and S[b] and 100 * both >= 75 * len(S[a] | S[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(S[d]), top(d)) for d in S}


def test_jaccard_against_brute_force(spark, none):
    import random

    rng, rows = random.Random(2), []
    for g in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 99999)}"
            if rng.random() < 0.3:
                words += [f"t{g}", "shared", "closing", "line", "of", "many", "documents", "here"]
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "One two"), (1004, "one TWO"), (1005, rows[4][1].upper()), (999, rows[4][1])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert jaccard.near_groups(none).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for trial in range(1500):
        n = int(np.exp(rng.uniform(0, np.log(1500))))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        fresh = rng.integers(0, 2**64, n // 7, dtype=np.uint64)
        b = np.unique(np.concatenate([a[n // 7 :], fresh])) if trial % 2 else a[n // 4 :]
        if not jaccard.linked(a, b):
            continue
        pool = np.concatenate([a, b])
        frequent = np.unique(rng.choice(pool, int(len(pool) * rng.choice([0, 0.1, 0.5, 0.95]))))
        assert len(np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent)))


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 3000):
        for share in (0.0, 0.5, 0.9):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 2**63, n + n // 5 + 1).astype(np.uint64)]))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            bins = 4 * min(len(x), len(y))
            assert jaccard.distance(jaccard.bins_of(x, bins), jaccard.bins_of(y, bins)) <= len(np.setxor1d(a, b))


def test_token_files(docs, none):
    path = tokenizer("word_bpe_49k.json")
    rows = tokenfile.read(tokenfile.write(docs, path, files=3)).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        t = next(t for d, t in TEXTS if d == r["doc_id"])
        want = np.append(ids(path, t), 2).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d))
    assert tokenfile.read(tokenfile.write(none, path)).count() == 0


@pytest.mark.parametrize("vocab", [2, 1000, 49408, 70000])
def test_bit_packing_round_trip_and_random_access(tmp_path, vocab):
    import pyarrow as pa

    rng = np.random.default_rng(vocab)
    docs = [rng.integers(0, vocab, n).astype("<u4") for n in (0, 1, 5000, 4096, 17, 9000)]
    with pa.OSFile(str(tmp_path / "x.tok"), "wb") as f:
        w = tokenfile.Writer(f, vocab)
        for i, d in enumerate(docs):
            w.add(i, d)
        w.close()
    with pa.OSFile(str(tmp_path / "x.tok")) as f:
        r = tokenfile.Reader(f)
        assert r.bits == max(1, (vocab - 1).bit_length())
        for i in reversed(range(len(docs))):
            assert (r[i] == docs[i]).all()


def test_shared_folder_setting_is_used(spark):
    from tessera.llm.work import shared_folder

    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert F is not None


def test_url_ranges_cut_a_shared_key(spark):
    """Home pages of many hosts share the key of their domain; they spread over the ranges, and verdicts stay right."""
    frame = spark.range(8000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".com/")).alias("url"))
    keyed = frame.select(urls.reversed_key(F.lit("com"), F.lit("/")).alias("key"), F.concat(F.lit("h"), "page_id", F.lit(".com")).alias("host"), F.lit("/").alias("path"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in urls.in_ranges(keyed).groupBy("range").count().collect()]
        rules = [("com", "/", "block"), ("h7.com", "/", "allow"), ("com", "/x", "allow")]
        got = urls.range_join(frame, urls.rules_frame(spark, rules)).groupBy("rule", "verdict").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 8000 and max(sizes) <= 2 * 8000 / len(sizes) and len(sizes) > 1
    assert {tuple(r) for r in got} == {("com/", "block", 7999), ("h7.com/", "allow", 1)}
