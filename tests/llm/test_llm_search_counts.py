"""Brute force and edge cases of lexical search, token counts and spelling variants."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import lexical, spelling, tokencount

COLUMNS = "doc_id long, text string"
CLASHING = ("n", "tf", "term", "w", "h", "i", "word", "q", "rank", "score", "cluster", "place", "oid", "found", "kth", "key", "probe", "n_tokens", "item", "times", "df", "top")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark, tmp_path, rows, columns=COLUMNS):
    spark.createDataFrame(rows, columns).withColumns({c: F.lit("clash") for c in CLASHING}).write.parquet(path := str(tmp_path / "t"))
    return spark.read.parquet(path)


# 11 lexical search
def ranked(items, docs, k=10):
    """item -> its (score, doc_id), from all postings."""
    terms = lambda text: re.findall(lexical.TERM, (text or "").translate(LOWER))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, df = sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked, found = set(terms(text)), []
        for i, c, n in counts:
            m = 10 + 90 * n * len(counts) // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            found += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force_on_edge_cases(spark, tmp_path):
    long = "common words of a long text " * 5000
    docs = [(3, "alpha beta beta"), (2, "ALPHA beta beta"), (2, "alpha beta beta"), (None, "alpha beta beta"), (None, None), (7, None), (8, ""), (9, "... !!!"), (10, long), (11, "Émigré émigré 日本 x1"), (12, "gamma")]
    items = [(1, "alpha, beta; gamma"), (1, "alpha"), (None, "ÉMIGRÉ émigré 日本"), (4, None), (5, ""), (6, "unknown"), (7, "common long text alpha")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHING})
    found = table(spark, tmp_path, docs)
    for k in (2, 10):
        got = lexical.rank_documents(asked, found, k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked(items, docs, k)
    assert lexical.rank_documents(asked, found.limit(0)).count() == lexical.rank_documents(asked.limit(0), found).count() == 0


def test_common_terms_bring_no_candidates_but_count(spark, tmp_path, monkeypatch):
    """More documents than are visited, so that kth scores, terms that do not lead and stopping all matter; with and without terms sent to all tasks."""
    rng = np.random.default_rng(5)
    words = [f"w{min(int(rng.zipf(1.4)), 400)}" for _ in range(30_000)]
    docs = [(k // 2, " ".join(words[at : at + 20])) for k, at in enumerate(range(0, 30_000, 20))]
    items = [(k, " ".join(words[at : at + 12])) for k, at in enumerate(range(5, 30_000, 2500))]
    asked, found = spark.createDataFrame(items, "item_id long, text string"), table(spark, tmp_path, docs)
    want = ranked(items, docs)
    assert sorted(map(tuple, lexical.rank_documents(asked, found).collect()), key=str) == want
    monkeypatch.setattr(lexical, "SENT_BYTES", 0)
    assert sorted(map(tuple, lexical.rank_documents(asked, found).collect()), key=str) == want


def test_bisection_puts_like_documents_together():
    rng = np.random.default_rng(3)
    kind = rng.permutation(np.arange(256) % 2)
    doc = np.repeat(np.arange(256), 30)
    left = lexical._halves(doc, rng.integers(0, 500, len(doc)) + 500 * kind[doc], 256)
    assert left.sum() == 128 and np.mean(left == (kind == kind[np.flatnonzero(left)[0]])) > 0.95


def test_index_stops_before_the_last_cluster(spark, sf_dir):
    """The clusters that are visited for an item hold its best documents; on topics that differ they are few."""
    topics = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("t"), (F.col("id") % 32).cast("string"), F.lit("x"), F.pmod(F.xxhash64("id", k), F.lit(60)).cast("string")))).alias("text"))
    found = lexical.rows_with_terms(topics, "doc_id", "text")
    tree = lexical.fit_order(found, "rid", "found")
    placed = found.select((F.col("oid") % 32).alias("topic"), lexical.cluster_of(F.col("found"), tree).alias("cluster")).groupBy("topic", "cluster").count().collect()
    best = defaultdict(int)
    for r in placed:
        best[r.topic] = max(best[r.topic], r["count"])
    assert len({r.cluster for r in placed}) >= 32 and np.mean([best[k] for k in range(32)]) > 60  # of 187 each, where chance gives 3


# 12 token counts
TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b ", "▁", "a▁b", "a ▁ b", "x.y", ".x", " .x.", "1,2 3", "\n\n a\tb", "日本語 テキスト", "é", "éx", "ﬁ ﬁ①", "<s> hi</s><unk>", "<0x0A>", "\x00a", "🎉a🎉 b", "nbsp\xa0here", "a" * 3000, "long words " * 9000, "Ünïcödé.É,", "▁▁ ", "don't (stop)--now"]


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_token_counts_equal_the_library(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(tokencount, "SENT_BYTES", sent)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(TEXTS + TEXTS[:12])]
    found = tokencount.count_tokens(table(spark, tmp_path, rows))
    count = lambda t: len(tokencount._model(tokencount.MODEL).encode(t or ""))
    want = [(i, len((t or "").encode()), count(t), count(t) > 4096) for i, t in rows]
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert any(r[3] for r in want) and tokencount.count_tokens(table(spark, tmp_path / "e", rows).limit(0)).count() == 0


def test_token_counts_of_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    found = tokencount.count_tokens(documents(spark, sf_dir)).collect()
    assert len(found) == len(texts)
    ids = tokencount._model(tokencount.MODEL).encode([texts[r.doc_id] or "" for r in found])
    assert [r.n_tokens for r in found] == list(map(len, ids))


def test_token_counts_refuse_a_model_with_pieces_across(monkeypatch):
    monkeypatch.setattr(tokencount, "LETTER", "a-m")  # as if it did not end its pieces where pre-tokens end
    with pytest.raises(ValueError):
        tokencount._model.__wrapped__(tokencount.MODEL)


# 13 spelling
def variants(docs):
    """word -> (form, root, n, n_near, form_n), near words by leaving out each letter."""
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return grouped({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7})


def grouped(counts):
    cut, near, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for k in range(len(w)):
            cut[k, w[:k] + w[k + 1 :]].add(w)
    for (_, rest), words in cut.items():
        for w in words:
            near[w] |= words - {w}
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def as_dict(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def test_variants_of_documents_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert as_dict(spelling.spelling_variants(documents(spark, sf_dir))) == variants(rows)


def test_variant_edge_cases(spark, tmp_path):
    rows = [(1, "Receive receive Receives ÉCOUTÉES écoutées"), (1, "receive×÷ receive"), (None, "recieve recieve receivd receivd"), (None, None), (2, ""), (3, "short a b"), (4, "receive " * 300), (5, "recive recives " * 30), (6, "x" * 5000 + " " + "x" * 5000), (7, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa")]
    found = table(spark, tmp_path, rows)
    assert as_dict(spelling.spelling_variants(found)) == variants(rows)
    assert spelling.spelling_variants(found.limit(0)).count() == 0


def test_chains_of_forms_and_long_lists(spark, tmp_path, monkeypatch):
    """Words that all share a segment are cut on; chains of forms have more than one step."""
    rng = np.random.default_rng(1)
    words = {"prefixes" + "".join(rng.choice(list("abcd"), int(rng.integers(4, 7)))): int(rng.integers(2, 6)) * 12 ** int(rng.integers(0, 4)) for _ in range(900)}
    words |= {"".join(rng.choice(list("xyz"), int(rng.integers(1, 4)))) + "suffixes": 3 for _ in range(60)} | {"a" * k: 2 * 11**k for k in range(1, 9)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    want = grouped(words)
    assert any(r[1] != r[0] and r[0] for r in want.values())
    assert as_dict(spelling.group_variants(rows)) == want
    monkeypatch.setattr(spelling, "MOST_IN_LIST", 4)
    pairs = spelling.near_pairs(rows).collect()
    assert len(pairs) == len({frozenset((r.a, r.b)) for r in pairs}) == sum(r[3] for r in want.values()) // 2
