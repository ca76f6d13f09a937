"""Registered queries over the whole smallest tables against brute force and the library, and columns that clash."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import bpe, exact, jaccard, language, lm, packing, quality, tokenfile, tokens, urls, warc
from tessera.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def library(name):
    t = bpe.Codec.of(tokenizer(name)).library
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_op1_places_every_id_once(spark, texts):
    encode, pieces, seq = library("byte_bpe_50k.json"), collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op1_packing"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {d for d, _, _ in texts}
    for d, t, _ in texts:
        ids, at = np.append(encode(t), np.uint32(1)).astype("<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    used = sum(n for parts in seq.values() for _, n in parts)
    assert used / (2048 * len(seq)) > 0.97


def test_op3_equals_the_library(spark, texts):
    encode = library("byte_bpe_50k.json")
    t = bpe.Codec.of(tokenizer("byte_bpe_50k.json")).library
    want = {}
    for d, text, _ in texts:
        ids = encode(text)
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op3_bpe"](spark, SF).collect()} == want


def test_op10_reads_back_what_the_library_encodes(spark, texts):
    encode, start, want = library("word_bpe_49k.json"), 0, {}
    for d, text, _ in sorted(texts):
        ids = np.append(encode(text), np.uint32(2)).astype("<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op10_token_output"](spark, SF).collect()} == want


def words_of(text):
    return (text or "").encode().lower().split()


def test_op5_equals_a_plain_backoff_model(spark, texts):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _, _ in texts}
    uni, pairs = collections.Counter(), collections.Counter()
    for d, t, _ in texts:
        if not held[d]:
            w = [*words_of(t), b"<end>"]
            uni.update(w)
            pairs.update(zip([b"<start>", *w], w))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    history = collections.Counter(uni)
    history[b"<start>"] = uni[b"<end>"]
    kept = collections.defaultdict(dict)
    for (h, w), c in pairs.items():
        if c >= lm.MIN_COUNT:
            kept[h][w] = (c - lm.DISCOUNT) / history[h]
    weight = {h: (1 - sum(ws.values())) / (1 - sum(map(p1, ws))) for h, ws in kept.items()}
    rows = {r["doc_id"]: r for r in QUERIES["op5_lm_score"](spark, SF).collect()}
    for d, t, _ in texts:
        w, r = [*words_of(t), b"<end>"], rows[d]
        score = sum(math.log10(kept[h][x] if x in kept.get(h, ()) else weight.get(h, 1.0) * p1(x)) for h, x in zip([b"<start>", *w], w))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(p1(x)) for x in w), rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_op6_equals_plain_compression(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    by = collections.defaultdict(list)
    for d, t, lang in texts:
        if lang is not None and t is not None and zlib.crc32(str(d).encode()) % 5 != 0:
            by[lang].append((order[d], d, t))
    makers = {}
    for lang, rows in by.items():
        chosen, size = [], 0
        for _, _, t in sorted(rows)[: language.SAMPLE_ROWS]:
            if size >= language.DICTIONARY_BYTES:
                break
            chosen.append(t)
            size += len(t.encode())
        content = b" ".join(language.letters(t) for t in reversed(chosen))[-language.DICTIONARY_BYTES :]
        makers[lang] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    right = total = 0
    rows = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    for d, t, lang in texts:
        r = rows[d]
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = language.letters(t)
        sizes = {}
        for name in sorted(makers):
            made = zstandard.ZstdCompressor(dict_data=makers[name], level=language.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(made.compress(data[k : k + language.BLOCK_BYTES])) for k in range(0, len(data), language.BLOCK_BYTES))
        best, second = sorted(sizes.values())[:2]
        assert r["lang_pred"] == min(sizes, key=lambda x: (sizes[x], x)) and math.isclose(r["score"], (second - best) / second)
        if r["held_out"] and len(t.split()) >= 20:
            total += 1
            right += r["lang_pred"] == lang
    assert right >= 0.95 * total > 0


def shingle_sets(texts):
    out = {}
    for d, t in texts:
        w = words_of(t)
        out[d] = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components(sets):
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in sets}


def test_op8_equals_brute_force(spark, texts):
    sets = shingle_sets((d, t) for d, t, _ in texts)
    top = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_jaccard_join"](spark, SF).collect()}
    assert got == {d: (len(s), top[d]) for d, s in sets.items()}


def test_op8_long_texts_and_missing_ids(spark):
    rng = random.Random(4)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(30_000)]
    near, far = list(long), list(long)
    for i in range(0, 30_000, 300):
        near[i] = "changed"
    for i in range(0, 30_000, 12):
        far[i] = "changed"
    rows = [(7, " ".join(long)), (5, " ".join(near)), (6, " ".join(far)), (None, "one two three four five six"), (9, "one two three four five six"), (None, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (0, 9), (5, 5), (6, 6), (7, 5), (9, 9)]


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as p
    from tessera.llm.work import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    kept = written(p.quality_rules(spark, docs, SF))
    good = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
    assert held(kept) == [x for x in held(docs) if x[0] in good]
    spoken = written(p.language_id(spark, kept, SF))
    model = language.Classifier(language.fit(kept.select("doc_id", "text", "lang").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 != 0)))
    assert held(spoken) == [x for x in held(kept) if model([x[1]])[0][2]]
    single = written(p.exact_dedup(spark, spoken, SF))
    last = {t: d for d, t in held(spoken)}
    assert held(single) == sorted((d, t) for t, d in last.items())
    apart = written(p.near_dedup(spark, single, SF))
    top = components(shingle_sets(held(single)))
    assert held(apart) == [x for x in held(single) if top[x[0]] == x[0]]
    packed = p.pack(spark, apart, SF)
    encode = library("byte_bpe_50k.json")
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {d: len(encode(t)) + 1 for d, t in held(apart)}


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", "日本語漢字仮名交文的一是不了人我在有他这"])
def test_unsplit_text_is_joined_by_windows(letters):
    rng, codec = random.Random(3), bpe.Codec(tokenizer("byte_bpe_50k.json"))
    text = "".join(rng.choice(letters) for _ in range(1 << 19))
    parts = [np.frombuffer(codec.encode(x), "<u4") for x in bpe.leaves(text)]
    codec.encoded = 0
    got = bpe.join_leaves(codec, parts)
    assert codec.encoded < 0.05 * len(text.encode())
    assert (got == np.array(codec.library.encode(text, add_special_tokens=False).ids)).all()


def test_joins_equal_the_library_on_odd_texts():
    rng, codec = random.Random(8), bpe.Codec(tokenizer("byte_bpe_50k.json"))
    kinds = ["ab '\n\t.é1!sS日 ", "'s", "  \n a", "日本語テ", "'sdmtl ", "!?.'", "‍👩🏽a"]
    for _ in range(800):
        text = "".join(rng.choice(rng.choice([*kinds, "<|endoftext|>"] if rng.random() < 0.01 else kinds)) for _ in range(rng.randint(1, 300))) + rng.choice(["", "<|endoftext|> x"])
        parts = [np.frombuffer(codec.encode(x), "<u4") for x in bpe.leaves(text, rng.choice([8, 33, 90]))]
        assert bpe.join_leaves(codec, parts).tolist() == codec.library.encode(text, add_special_tokens=False).ids


def test_columns_of_any_name_are_carried_or_left_out(spark):
    names = ["_len", "_prefix", "_body", "_s", "_r", "_row", "_verdict", "_key", "_bucket", "len", "body", "key", "stack", "range", "a.b", "rank", "cls", "sample", "sketch"]
    path, path2 = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    cols = [F.lit("mine").alias(n) for n in names]
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, "a b c " * 30), (3, None)], "doc_id long, text string").select("doc_id", "text", *cols)
    groups = exact.copy_groups(docs)
    assert exact.decisions(docs, groups).count() == 3 and exact.keep_one(docs, groups).columns == docs.columns and exact.keep_one(docs, groups).count() == 2
    judged = quality.line_first(docs)
    assert set(docs.columns) <= set(judged.columns) and judged.where(F.col("`a.b`") == "mine").count() == 3
    said = language.predict(docs, {"x": b"a b c", "y": b"d e f"})
    assert set(docs.columns) <= set(said.columns) and said.where("_row = 'mine'").count() == 3
    assert language.predict(docs.limit(0), {"x": b"a"}).count() == 0
    assert jaccard.near_groups(docs).count() == 3 and tokens.encode(docs, path).count() == 3 and packing.pack_documents(docs, path).count() >= 3
    assert tokenfile.read(tokenfile.write(docs, path2)).count() == 3
    model, table, total, _ = lm.fit(docs)
    assert lm.score(docs, model, table, total).count() == 3
    pages = spark.createDataFrame([(1, "http://x.com/" + "p" * 100_000, "h"), (2, None, None), (3, "http://www.example.com/en/a", "h")], "page_id long, url string, html string").select("*", *cols)
    out = urls.range_join(pages, urls.rules_frame(spark, urls.RULES)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"], r["_verdict"]) for r in out} == {1: ("com/", "allow", "mine"), 2: (None, "allow", "mine"), 3: ("www.example.com/en/", "allow", "mine")}
    assert warc.records(warc.read(warc.write(warc.chunked(warc.typed_records(pages))))).count() == 3


def test_nested_rules_of_one_host(spark):
    rng = random.Random(2)
    rules = [("h.org", "/" + "/".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), rng.choice(["allow", "block"])) for _ in range(60)] + [("org", "/", "block"), ("g.h.org", "/a", "allow")]
    pages = [(i, f"http://{rng.choice(['h.org', 'g.h.org', 'x.g.h.org', 'other.org', 'z.net'])}/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))) for i in range(400)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.range_join(spark.createDataFrame(pages, "page_id long, url string"), urls.rules_frame(spark, rules)).collect()}
    for i, url in pages:
        host, _, path = url[7:].partition("/")
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        best = max(fits, default=None)
        assert got[i] == ((best[3], best[2]) if best else (None, "allow"))
