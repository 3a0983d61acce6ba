"""Brute force, exact round trips and edge cases of the ten operators."""

import base64
import hashlib
import html
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from comparing import same
from pyspark.sql import functions as F

from trailmark.llm import bpe, chat, embeddings, exact_dedup, graph, langid, licenses, mixing, pages, sharding, simhash
from trailmark.llm.common import numbered
from trailmark.llm.queries import ORACLE_SQL, QUERIES

LONG = "lorem ipsum dolor sit amet " * 20_000
EDGE = [
    (5, "same  text here\tnow", "en", "a", 1),
    (3, "same text here now", "en", "a", 1),
    (3, "same text here now", "en", "a", 1),
    (9, "same text\nhere now", "fr", None, 1),
    (None, "same text here now", None, "b", None),
    (None, None, None, None, None),
    (11, None, "en", "a", 0),
    (12, "", "en", "b", 0),
    (13, "12345 !!!", None, "b", 9),
    (14, LONG, "en", "b", 1),
    (15, "Released under the MIT License.", "en", "b", 1),
    (2**62, "日本語 текст émigré 🎉   end", "en", "", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "shard", "slot", "count", "fp", "oid", "rid", "a", "b", "hi", "lo", "copy", "n_copies", "order_key", "input_ids", "cdf", "draws", "label", "class", "p", "t", "d", "m", "group_size", "kept", "component")


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    df = spark.createDataFrame(EDGE, COLUMNS)
    df.write.parquet(path := str(tmp_path_factory.mktemp("edge") / "t"))
    return spark.read.parquet(path).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    got, want = same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])
    assert got == want


# shared
def test_row_numbers_do_not_depend_on_live_cores(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "repeat(md5(string(id)), 9) AS text").repartition(3).write.parquet(str(tmp_path / "t"))
    read = lambda: {r[0]: r[1] for r in numbered(spark.read.parquet(str(tmp_path / "t")), "place").select("id", "place").collect()}
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        first = read()
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")  # what more cores would make of it
        assert read() == first
    finally:
        for name in ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism"):
            spark.conf.unset(name)


# 1 sharding
def test_shards_are_balanced_gapless_and_ordered(spark, sf_dir):
    rows = sorted(QUERIES["op1_histogram_shards"](spark, sf_dir).collect(), key=lambda r: (r["shard"], r["slot"]))
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    assert [r.doc_id for r in rows] == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(8):
        own = [r for r in rows if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= largest


def test_shards_split_a_hot_key(spark, tmp_path):
    spark.range(2000, numPartitions=3).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("slot")).write.parquet(str(tmp_path / "t"))
    out = sharding.shard_by_bytes(spark.read.parquet(str(tmp_path / "t")), 4, partition_bytes=1000)
    found = {r["shard"]: (r.n, r.top) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert all(abs(n - 500) <= 2 and top == n - 1 for n, top in found.values()) and len(found) == 4


def test_shards_edge_cases(edge, empty):
    rows = sharding.shard_by_bytes(edge, 3).collect()
    assert len(rows) == len(EDGE) and sorted(r["size"] for r in rows)[:3] == [1, 1, 1]
    assert sharding.shard_by_bytes(empty, 3).count() == 0


# 2 exact dedup
def test_exact_dedup_edge_cases(edge, empty):
    rows = exact_dedup.label_duplicates(edge).collect()
    groups = [r for r in rows if r.group_size == 5]
    assert len(rows) == len(EDGE) and len(groups) == 5 and {r.keep_id for r in groups} == {3} and sum(r.kept for r in groups) == 1
    nothing = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(nothing) == 3 and {r.keep_id for r in nothing} == {11}
    kept = exact_dedup.drop_duplicates(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 6
    assert exact_dedup.label_duplicates(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_with_many_groups(edge, spark, sf_dir, monkeypatch):
    """More groups than are sent: rows that cannot have a copy still pass by the shuffle."""
    plain = lambda df: sorted(map(str, df.collect()))
    docs = documents(spark, sf_dir)
    few = plain(exact_dedup.label_duplicates(docs)), plain(exact_dedup.label_duplicates(edge)), plain(exact_dedup.drop_duplicates(docs))
    sent = exact_dedup.label_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__tm_sha" not in sent and "SortMergeJoin" not in sent
    monkeypatch.setattr(exact_dedup, "GROUPS_SENT", 0)
    assert few == (plain(exact_dedup.label_duplicates(docs)), plain(exact_dedup.label_duplicates(edge)), plain(exact_dedup.drop_duplicates(docs)))


# 3 chat
@pytest.mark.parametrize("text", ["", "\\", "\\### a", "####", "</turn>", "\\\\</turn>\\", "### user: x</turn>\n", "a: b", "🎉 é"])
def test_chat_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape(text, chat._IN_ROLE)) == text
    for role in ("user", "assistant", text):
        ids, loss = chat.assemble(role, text)
        got = chat.take_apart(ids, loss)
        assert got[:3] == (role, text, text if role == "assistant" else "") and int(loss.sum()) == (len(bpe.encode_text(chat.escape(text))) if role == "assistant" else 0)
        assert (ids >= chat.reserved()[0]).sum() == 3


def test_chat_edge_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "x"), (None, None, "assistant", "n"), (2, 5, "assistant", "r"), (2, 5, "assistant", "r")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("token_start", F.lit("clash"))
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(chats)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in found.items()} == {1: (3, 1), None: (1, 1), 2: (2, 2)}
    assert found[2].turns_sha256 == hashlib.sha256(b"assistant\nr\nassistant\nr\n").hexdigest()
    assert chat.read_back(chat.format_turns(chats.limit(0))).count() == 0


# 4 mixing
def test_mixing_hits_target_weights(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise("mid").alias("source"), F.lit("x" * 99).alias("text"))
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 1.0), ("absent", 5.0)], "source string, weight double")
    found = {r.source: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    total = 40_000 * 2 / 7 / 2
    assert set(found) == {"hot", "rare"}
    docs_of = {"hot": 13334, "rare": 534}
    rate = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}
    assert rate["mid"] == 0 and abs(found["hot"] - docs_of["hot"] * rate["hot"]) < 5 * np.sqrt(total) and abs(found["rare"] - docs_of["rare"] * rate["rare"]) < 5 * np.sqrt(40_000 / 2)


def test_mixing_large_means_are_poisson(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text"))
    tiny = spark.createDataFrame([(0, "tiny", "x"), (1, "big", "x" * 2999)], "doc_id long, source string, text string")
    skewed = mixing.source_rates(tiny, spark.createDataFrame([("tiny", 1.0)], "source string, weight double")).where("source = 'tiny'").first()
    assert skewed.draws == 6 and skewed.rate == 1501
    n = mixing.with_copies(docs, spark.createDataFrame([("s", skewed.draws, skewed.cdf)], "source string, draws int, cdf array<double>")).agg(F.avg("__tm_n"), F.var_samp("__tm_n")).first()
    assert abs(n[0] / skewed.rate - 1) < 0.01 and abs(n[1] / skewed.rate - 1) < 0.15


def test_mixing_edge_cases(edge, empty):
    first = mixing.mix(edge)
    assert first.where("n_copies < copy").count() == 0 and mixing.mix(empty).count() == 0
    assert sorted(map(str, first.select("doc_id", "copy").collect())) == sorted(map(str, mixing.mix(edge.repartition(7)).select("doc_id", "copy").collect()))


# 5 BPE
def _tiktoken():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, sf_dir, edge):
    enc = _tiktoken()
    texts = [r.text for r in documents(spark, sf_dir).collect()] + [r.text for r in edge.select("text").collect()]
    texts += ["<|endoftext|> a  b\n\n c\t'll 've x's", "a   b c \x1c d", "'s 't ' s", " ", "\n", "é ‍ x"]
    rng = np.random.default_rng(5)
    pool = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x2003, 0x3000, 0x200B, 0x660, 0xB2, 0x2160, *range(33, 127), *range(0xC0, 0x250), *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F620)]]
    texts += ["".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(1500)]
    for t in texts:
        ids = bpe.encode_text(t)
        assert ids == enc.encode_ordinary(t or "") and bpe.decode_bytes(ids) == (t or "").encode()


def test_bpe_offsets_and_split_characters(spark):
    text = "naïve 🎉日"
    ids = bpe.encode_text(text)
    spans = bpe.token_offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)
    split = [k for k in range(len(ids)) if "�" in bpe.decode_bytes([ids[k]]).decode("utf-8", "replace")]
    assert split and all(spans[k] != spans[k - 1] or spans[k][1] - spans[k][0] == 1 for k in split)
    df = spark.createDataFrame([(ids,), (ids[: split[0] + 1],), (None,)], "ids array<int>")
    out = [r.t for r in df.select(bpe.decoded_text(F.col("ids")).alias("t")).collect()]
    assert out[0] == text and out[1].endswith("�") and out[2] in (None, "")


def test_bpe_edge_cases(edge, empty):
    rows = bpe.round_trip(edge).collect()
    assert len(rows) == len(EDGE) and sum(r.n_tokens == 0 for r in rows) == 3
    out = bpe.encode_documents(edge)
    assert out.columns == edge.columns and bpe.round_trip(empty).count() == bpe.encode_documents(empty).count() == 0
    assert edge.select(bpe.checked(F.col("text")).alias("x")).where("NOT x.round_trip").count() == 0


def test_split_tokens_are_told_by_offsets(spark):
    texts = ["", None, "plain text", "日本語 текст émigré 🎉🎉 end", "é" * 50, "🎉", "a🎉b"]
    rows = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        ids, data = bpe.encode_text(text), text.encode()
        ends = np.cumsum([len(bpe.decode_bytes([k])) for k in ids]).tolist()
        spans = list(zip([0, *ends], ends))
        whole = lambda k: k == len(data) or data[k] & 0xC0 != 0x80
        assert r.n_split == sum(not (whole(a) and whole(b)) for a, b in spans)
        offsets = bpe.token_offsets(text, ids)
        assert all(text.encode()[a:b] in text[x:y].encode() for (a, b), (x, y) in zip(spans, offsets, strict=True))
    assert sum(r.n_split for r in rows) > 0


# 6 licenses
def _contains(text, template):
    words = [w for w in re.findall(r"[^\W_]+", text.lower())]
    wanted = re.findall(r"[^\W_]+", template.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    reach = len(wanted) - 4
    goal = grams(wanted)
    span = reach + reach // 4
    return max((len(grams(words[k : k + span + 4]) & goal) / len(goal) for k in range(max(1, len(words) - 4))), default=0)


def test_licenses_equal_brute_force(spark, sf_dir):
    got = {(r.doc_id, r.license) for r in QUERIES["op6_license_scan"](spark, sf_dir).collect()}
    want = {(r.doc_id, name) for r in documents(spark, sf_dir).collect() for name, t in licenses.TEMPLATES.items() if _contains(r.text, t) >= 0.8}
    assert got == want and got


def test_licenses_survive_edits():
    index = licenses.Index(licenses.TEMPLATES)
    rng = np.random.default_rng(3)
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        if len(words) < 30:
            continue
        for _ in range(40):
            edited = list(words)
            edited[rng.integers(len(edited))] = "zebra"
            text = " ".join(["filler"] * int(rng.integers(0, 60)) + edited + ["tail"] * 9)
            found = {f[0] for f in index.scan(text)}
            assert (name in found) == (_contains(text, template) >= 0.8)


def test_licenses_every_passage_and_what_it_lies_within():
    index = licenses.Index(licenses.TEMPLATES)
    notice, bsd2, bsd3 = (licenses.TEMPLATES[k] for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause"))
    filler = " alpha beta gamma delta epsilon" * 50
    assert [(f[0], f[2]) for f in index.scan(f"{notice}{filler} {notice} {notice}") if f[0] == "MIT"] == [("MIT", 0), ("MIT", 255), ("MIT", 260)]
    assert [f[0] for f in index.scan(bsd2)] == ["BSD-2-Clause"]
    found = index.scan(filler + bsd3 + filler + " " + bsd2)
    assert [(f[0], f[4]) for f in found] == [("BSD-2-Clause", "BSD-3-Clause"), ("BSD-2-Clause", None), ("BSD-3-Clause", None)]
    gpl = index.scan(licenses.TEMPLATES["GPL-3.0"])
    assert [(f[0], f[4]) for f in gpl] == [("GPL-2.0", "GPL-3.0"), ("GPL-3.0", None)]


def test_licenses_each_template_is_its_own_best():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert [f[0] for f in index.scan(f"before it {text} after it") if f[4] is None] == [name]


def test_licenses_edge_cases(edge, empty):
    assert [(r.doc_id, r.license) for r in licenses.scan(edge).collect()] == [(15, "MIT")]
    assert licenses.scan(empty).count() == 0


# 7 language ID
def test_language_id_on_held_out_rows(spark, sf_dir):
    rows = QUERIES["op7_language_id"](spark, sf_dir).join(documents(spark, sf_dir), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1.0, 1.0}


def test_language_id_edge_cases(edge, empty):
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(edge).collect()}
    assert {(11, "und"), (12, "und"), (13, "und"), (None, "und")} <= rows
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns and kept.where("text IS NULL OR text = '' OR doc_id = 13").count() == 0
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = langid.identify(edge.where("lang = 'en'"))
    assert {r.lang_pred for r in one.collect()} <= {"en", "und"}


# 8 SimHash
def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _least(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls on the old quiet town".split()
    rng = np.random.default_rng(11)
    texts = {}
    for k in range(300):
        words = list(base) * 6 if k % 2 else [f"w{rng.integers(400)}" for _ in range(60)]
        for _ in range(int(rng.integers(0, 4))):
            words[rng.integers(len(words))] = f"Edit{rng.integers(9)}"
        texts[k * 7 + 1] = " ".join(words)
    texts |= {5000: None, 5001: "", 5002: "One", 5003: "ONE  two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fps = {d: _fingerprint(t) for d, t in texts.items()}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = _least(list(fps), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert len(set(want.values())) < len(want)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("fine", [False, True])
def test_simhash_pairs_are_complete(spark, fine):
    rng = np.random.default_rng(2)
    base = [*rng.integers(-(2**63), 2**63, 60), *(np.int64(x) for x in (0, -1, 0x5555555555555555, -0x5555555555555556))]
    near = [int(np.int64(x) ^ np.int64(sum(1 << int(b) if b < 63 else -(1 << 63) for b in rng.choice(64, k, replace=False)))) for x in base for k in (1, 2, 3, 3, 3, 4)]
    fps = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.near_pairs(df, "fp", fine).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_simhash_quarters_give_the_same_components_from_fewer_pairs(spark, monkeypatch):
    fps = spark.range(30_000).select(F.xxhash64("id").alias("fp"))
    met = [simhash.candidates(fps, "fp", fine).count() for fine in (False, True)]
    assert met[1] * 50 < met[0]
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words[: 30 + k % 7])) for k in range(30)] + [(99, None)], "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    monkeypatch.setattr(simhash, "FINE_FROM", 0)
    assert sorted(simhash.near_duplicates(docs).collect()) == sorted(found)


def test_simhash_edge_cases(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE) and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {11}
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 3").count() == 1
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


def test_near_dedup_keeps_one_of_each_component_whatever_its_ids(spark, tmp_path):
    texts = {k: " ".join(f"{k}word{j}" for j in range(40)) for k in "abcde"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (8, texts["e"]), (None, texts["e"])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    kept = simhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r.text[0], r.doc_id) for r in kept) == [("a", None), ("b", None), ("c", 7), ("d", 7), ("e", 8)]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(120)] + [(1000, 1000 + k) for k in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(3000, 3400, (250, 2))]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _least({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert got == {n: want[n] for n in got} and set(got) == {n for e in edges if e[0] != e[1] for n in e}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9 pages
def test_main_text_of_all_pages(spark, sf_dir):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op9_main_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


SITE = "<html><body><div>Site of things</div><div class='{0}'>Menu: a b</div><p>{1}</p><p>More about {1}.</p><div>Contact us &amp; more</div></body></html>"


def test_differencing_deletes_what_neighbours_share(spark):
    rows = [(k, f"https://h.org/news/{k}", SITE.format("x", f"story number {k} tells of   &lt;{k}&gt;")) for k in range(6)]
    rows += [(10, "http://alone.org/", "<nav>Home</nav><p>Only page</p><aside>ad</aside><section id='comments'><p>first!</p></section>"), (11, None, None), (12, "http://e.org/x", "")]
    rows += [(20, "http://c.org/a", "<p>One article</p><p>told twice</p>"), (21, "http://c.org/b", "<p>One article</p><p>told twice</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert all(found[k] == f"story number {k} tells of <{k}>\nMore about story number {k} tells of <{k}>." for k in range(6))
    assert (found[10], found[11], found[12], found[20]) == ("Only page", "", "", "One article\ntold twice")
    assert pages.main_text(df.limit(0)).count() == 0


def _texts(spark, *found):
    df = spark.createDataFrame([(k, f"http://s.org/n/{k}", page) for k, page in enumerate(found)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.main_text(df).collect()}


def test_partner_decides_plain_lines_outside_an_article(spark):
    page = "<div>Site</div><h1>Title {0}</h1><p>Lead {0}</p><article><p>Body {0}</p></article><div>Contact</div><footer>f {0}</footer>"
    text = "Title {0}\nLead {0}\nBody {0}"
    found = _texts(spark, *(page.format(k) for k in (0, 1, 2, 2, 4)))
    assert found == {k: text.format(min(k, 2) if k < 4 else k) for k in range(5)}
    alone = "Site\n" + text.format(7) + "\nContact"  # no partner, so nobody shares a line
    assert _texts(spark, page.format(7)) == {0: alone}
    assert _texts(spark, page.format(7), page.format(7)) == {0: alone, 1: alone}


def test_long_shared_boilerplate_is_deleted(spark):
    menu = "<nav>" + "".join(f"<a href='/{k}'>Menu entry number {k}</a>" for k in range(40)) + "</nav>"
    site = menu + "<div>Site of things</div><div>" + "A long notice to all readers of this site. " * 5 + "</div><p>{0}</p><div>Contact us</div><footer>" + "legal " * 50 + "</footer>"
    assert _texts(spark, *(site.format(f"Short {k}") for k in range(4))) == {k: f"Short {k}" for k in range(4)}
    assert _texts(spark, *(site.format(f"Short {k}") for k in range(2))) == {k: f"Short {k}" for k in range(2)}


def test_copies_are_told_by_hash():
    def goes(own, partner, chrome=(), marked=False):
        return [k for k, gone in zip(own, pages.shared_lines(own, [0 if k in chrome else 10 for k in own], partner, marked), strict=True) if gone]

    assert goes([1, 5, 6, 7, 2], [1, 8, 9, 2]) == [1, 2] and goes([1, 5], None) == []
    assert goes([1, 5, 6], [1, 5, 6]) == [] and goes([1, 5, 6], [1, 5, 6], marked=True) == [1, 5, 6]
    assert goes([1, 3, 4, 5, 6], [1, 3, 4, 5, 6], chrome=(1, 3, 4)) == [1, 3, 4]
    sibling = {"path": "/n/1", "hashes": [1, 8], "article": 8}
    copy = {"path": "/n/2", "hashes": [1, 5], "article": 5}
    assert pages._partner("/n/22", 5, sibling, copy) == [1, 8] and pages._partner("/n/22", 5, None, copy) is None and pages._partner("/n/22", 6, sibling, copy) == [1, 5]


def test_differencing_takes_lines_of_given_pages(spark, sf_dir, monkeypatch):
    """Lines that go as a partner shares them, on the given pages (few: most chrome there is of each page's own); without differencing other texts come out."""
    rows = QUERIES["op9_main_text"](spark, sf_dir).collect()
    assert sum(r.n_shared for r in rows) > 0 < sum(r.n_unshared for r in rows)
    site = "<div>Site</div><p>{0}</p><div>Contact</div>"
    assert _texts(spark, *(site.format(f"s{k}") for k in range(3))) == {k: f"s{k}" for k in range(3)}
    monkeypatch.setattr(pages, "_verdicts", lambda p: p.select("rid", F.array().cast("array<boolean>").alias("shared")))
    assert _texts(spark, *(site.format(f"s{k}") for k in range(3))) == {k: f"Site\ns{k}\nContact" for k in range(3)}


MB = 1_000_000


@pytest.mark.parametrize(
    "page",
    ['<a "' * (MB // 4), '<a "' * (MB // 4) + ">", "<a href='x\">" * (MB // 12), "<a b='" * (MB // 6), "<!--" * (MB // 4), "<script>" * (MB // 8), "<" * MB, "</div " * (MB // 6), "<div>" * (MB // 5), "<div>" * (MB // 10) + "</p></div>" * (MB // 10), "<b><i>" * (MB // 12) + "</u>" * (MB // 8), "<p>a<p>b" * (MB // 8), "&amp" * (MB // 4), " " * MB],
    ids=range(14),
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    pages.lines(page)
    assert time.process_time() - began < 4


def test_repetitive_pages_are_aligned_in_time():
    rng = np.random.default_rng(2)
    began = time.process_time()
    for a, b in (([1, 2] * 40_000, [2, 1, 1] * 30_000), ([5] * 80_000, [5, 6] * 40_000), (rng.integers(0, 9, 80_000).tolist(), rng.integers(0, 9, 80_000).tolist()), (list(range(80_000)), list(range(80_000, 0, -1)))):
        chain = sorted(pages._common(a, b))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[k] for k in chain))  # it is a common subsequence
    assert time.process_time() - began < 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a<p>b<script>x('</p>')</script></article><p>c", "a\nb\nc"),
        ("<article><header><h1>T</h1></header><p class='ad'>no</p><p>yes</article>", "T\nyes"),
        ("<main><form><p>f</p></form><ul><li>i<li>j</ul></main><footer>z", "i\nj"),
        ("<article>x<!-- <p>no</p> -->y<style>p{}</style></article>", "xy"),
        ("<article><table><tr><td>1<td>2</table><div class='comments'><p>c</p></div></article>", "1\n2"),
        ("plain &copy; text < 3", "plain © text < 3"),
        ("<article><p>a</p><article class='comment'><p>reply</p></article></article>", "a"),
    ],
)
def test_lines_of_markup(spark, page, text):
    df = spark.createDataFrame([(1, "http://x.org/1", page)], "page_id long, url string, html string")
    assert pages.main_text(df).first().text == text


def test_chrome_is_told_by_whole_names_and_tokens():
    kinds = lambda page: [k for _, k in pages.lines(page)]
    for attrs in ("style='overflow:hidden'", 'aria-hidden="false"', "href=/x?id=share", 'href="/x?id=share"', "data-id=share", 'class="no-sidebar"', "class=main-content", "class='content text'", "class='post-header x'", 'title="class=ad"'):
        assert kinds(f"<div {attrs}><p>a</div>") == [pages.PLAIN], attrs
        assert kinds(f"<article {attrs}><p>a</article>") == kinds(f"<body {attrs}><main><p>a</main>") == [pages.IN_ARTICLE], attrs
    for attrs in ("hidden", "HIDDEN=''", "class='x ad'", "class=comment-list", "id=sidebar-left", "style='color:red; display: none'", "aria-hidden=true", "id=comments", "ROLE=banner", 'class="cookie-notice"', "class=ad_2", "data-x='>' class=\"ad\""):
        assert kinds(f"<div {attrs}><p>a</div>") == [pages.IN_CHROME], attrs
        assert kinds(f"<body {attrs}><article {attrs}><p>a</article>") == kinds(f"<main {attrs}><p>a</main>") == [pages.IN_ARTICLE], attrs


def test_common_subsequence_is_longest():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).tolist() for _ in range(2))
        table = defaultdict(int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert len(pages._common(a, b)) == table[len(a), len(b)]


def test_common_subsequence_is_the_same_and_longest_however_often_lines_repeat(monkeypatch):
    rng = np.random.default_rng(9)
    pairs = [tuple(rng.integers(0, kinds, rng.integers(0, 60)).tolist() for _ in range(2)) for kinds in (1, 2, 3, 9, 40) for _ in range(60)]
    pairs += [([1, 2] * 300, [2, 1, 1] * 200), (rng.integers(0, 3, 700).tolist(), rng.integers(0, 3, 500).tolist())]
    for a, b in pairs:
        row = [0] * (len(b) + 1)
        for x in a:
            above, row = row, [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        found = []
        for limit in (0, 32, 10**9):
            monkeypatch.setattr(pages, "PAIRS_A_LINE", limit)
            found.append(pages._common(a, b))
        assert len(found[0]) == row[-1]
        assert found[0] == found[1] == found[2]


# 10 embeddings
def _clusters(rng, n, dim, spread):
    centres = rng.standard_normal((n, dim))
    return [c + spread * rng.standard_normal(dim) for c in centres for _ in range(6)]


def _brute(rows):
    out = {}
    unit = [None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or label is None else np.array(v, float) / np.linalg.norm(v) for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93]
    component = _least([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    for k, r in enumerate(rows):
        out[r[0]] = (sum(k in x for x in links), component[r[0]])
    return out, len(links)


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.12), (64, 0.22), (8, 0.2), (3, 0.1)])
def test_embedding_links_equal_brute_force(spark, dim, spread):
    rng = np.random.default_rng(dim)
    vectors = [np.float32(v).tolist() for v in _clusters(rng, 60, dim, spread)]
    rows = [(k, v, k % 2) for k, v in enumerate(vectors)] + [(1000 + k, vectors[0], 0) for k in range(5)]
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [float("inf")] + [1.0] * (dim - 1), 1), (2004, [None] + [1.0] * (dim - 1), 1), (2005, vectors[0], None), (2006, [], 1), (2007, vectors[0] + [0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("clash"))
    want, n = _brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    found = sum(x for x, _ in got.values()) / 2
    assert set(got) == set(want) and all(got[k][0] <= want[k][0] for k in want) and found >= 0.98 * n
    assert all(got[k] == (0, k) for k in (2000, 2001, 2002, 2003, 2004, 2005, 2006))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_chunks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(64)
    rows = [(k, np.float32(centre + 0.03 * rng.standard_normal(64)).tolist(), 1) for k in range(90)]
    monkeypatch.setattr(embeddings, "BUCKET_ROWS", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {k: (89, 0, k == 0) for k in range(90)}


@pytest.mark.parametrize("vectors", [0, 10**7, 10**8, 10**9])
def test_filters_keep_their_recall_as_labels_grow(vectors):
    rng = np.random.default_rng(vectors)
    size, threshold = embeddings.filter_sizes(64, vectors)
    assert embeddings._cap(threshold, 64) * vectors <= embeddings.BUCKET_ROWS
    met, lists = 0, []
    for _ in range(200):
        a, b = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 64)))
        b = b - (a @ b) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
        found = [embeddings.exceeded(x, vectors) for x in (a, b)]
        lists.append(found[0].size)
        met += bool(np.intersect1d(*found).size)
    assert met >= 195 and np.mean(lists) < 60 and all(f[-1] < 3 * size * size for f in found)


def test_embedding_null_and_repeated_ids(spark):
    v = [1.0, 0.5, 0.25]
    df = spark.createDataFrame([(None, v, 1), (4, v, 1), (4, v, 1), (None, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()) == sorted([(-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (-1, 0, None, True)], key=str)
