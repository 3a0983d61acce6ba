"""Sharding and language ID against plain versions of themselves; tables that start anew when they are full."""

import math
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import bpe, langid, licenses, sharding


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1 sharding
def _cuts_are_best(rows, shards, slack):
    """Rows in order of the id: each shard ends at the row boundary nearest to its place, or within the slack of it."""
    below = [0, *accumulate(r["size"] for r in rows)]
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    cuts = [bisect_left([r["shard"] for r in rows], k) for k in range(1, shards)]
    for k, cut in enumerate(cuts, 1):
        target = below[-1] * k / shards
        nearest = min(abs(b - target) for b in below)
        assert abs(below[cut] - target) <= max(nearest, slack) + 1e-6
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(p == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize(("shards", "partition_bytes", "most"), [(1, 1 << 26, 1 << 14), (8, 1 << 26, 1 << 14), (5, 2000, 1 << 14), (8, 100, 16), (7, 1, 1)])
def test_shards_equal_a_plain_sharder(spark, sf_dir, monkeypatch, shards, partition_bytes, most):
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", most)
    docs = documents(spark, sf_dir)
    out = sharding.shard_by_bytes(docs, shards, partition_bytes=partition_bytes)
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.select("doc_id").collect())
    _cuts_are_best(rows, shards, sharding.TOLERANCE * sum(r["size"] for r in rows) / shards)


@pytest.mark.parametrize("lengths", [[0] * 500, [100_000, *[1] * 400], [*[1] * 400, 100_000], [2**k for k in range(17)], [5, 5, 5]])
def test_shards_of_odd_sizes(spark, tmp_path, lengths):
    spark.createDataFrame([(k - 3, "x" * n) for k, n in enumerate(lengths)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    rows = sharding.shard_by_bytes(spark.read.parquet(str(tmp_path / "t")), 4, partition_bytes=50).collect()
    assert len(rows) == len(lengths)
    _cuts_are_best(sorted(rows, key=lambda r: r.doc_id), 4, sharding.TOLERANCE * sum(n + 1 for n in lengths) / 4)


# 7 language ID
def _features(text):
    letters = "".join(chr(c) if c >= 0x80 or chr(c).isalpha() else " " for c in text.lower().encode()).split()
    b = " ".join(["", *letters, ""]).encode("latin-1")
    return [((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 % 2**32) >> 16 for k in range(len(b) - 2)]


class _Plain:
    def __init__(self, taught):
        counts = defaultdict(Counter)
        for text, lang in taught:
            counts[lang].update(_features(text))
        self.languages = sorted(counts)
        self.code = langid.codewords(len(self.languages)).tolist()
        self.share = [{g: (n + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * langid.GRAMS) for g, n in c.items()} for c in (counts[x] for x in self.languages)]
        self.floor = [langid.SMOOTHING / (sum(counts[x].values()) + langid.SMOOTHING * langid.GRAMS) for x in self.languages]
        grams = {g for s in self.share for g in s}
        self.odds = [{g: self._odds(g, bit) for g in grams} for bit in range(len(self.code[0]))]
        self.other = [self._odds(None, bit) for bit in range(len(self.code[0]))]
        self.trust = [max(1e-3, min(self._expected(row, bit, len(grams)) * self.code[row][bit] for row in range(len(self.languages)))) for bit in range(len(self.other))]

    def _odds(self, gram, bit):
        sides = {s: [self.share[k].get(gram, self.floor[k]) for k in range(len(self.languages)) if self.code[k][bit] == s] for s in (1, -1)}
        return math.log(sum(sides[1]) / len(sides[1])) - math.log(sum(sides[-1]) / len(sides[-1]))

    def _expected(self, row, bit, n):
        return sum(self.share[row].get(g, self.floor[row]) * w for g, w in self.odds[bit].items()) + (langid.GRAMS - n) * self.floor[row] * self.other[bit]

    def predict(self, text):
        grams = _features(text)
        margin = [langid.SHARPNESS * sum(odds.get(g, rest) for g in grams) / max(1, len(grams)) for odds, rest in zip(self.odds, self.other, strict=True)]
        loss = [sum(t / sum(self.trust) * math.log1p(math.exp(-c * m)) for t, c, m in zip(self.trust, row, margin, strict=True)) for row in self.code]
        best = min(loss)
        return self.languages[loss.index(best)], 1 / sum(math.exp(-langid.SHARPNESS * (x - best)) for x in loss), sorted(loss)[1] - best


def test_language_id_equals_a_plain_version(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.withColumn("taught", langid.in_training("doc_id")).collect()
    plain = _Plain([(r.text, r.lang) for r in rows if r.taught and r.text is not None and r.lang is not None])
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    compared = 0
    for r in rows:
        if found[r.doc_id].lang_pred == langid.UNKNOWN:
            continue
        lang, score, gap = plain.predict(r.text)
        assert found[r.doc_id].score == pytest.approx(score, abs=1e-3)
        assert found[r.doc_id].lang_pred == lang or gap < 1e-4
        assert found[r.doc_id].ambiguous == (gap < langid.AMBIGUOUS_BELOW) or abs(gap - langid.AMBIGUOUS_BELOW) < 1e-3
        compared += 1
    assert compared > 0.9 * len(rows)


def _taught(spark, texts, copies=8):
    return spark.createDataFrame([(n * copies + c, text, lang) for n, (text, lang) in enumerate(texts) for c in range(copies)], "doc_id long, text string, lang string")


def test_tied_languages_are_ambiguous_and_the_first_is_named(spark):
    rows = [("ein kleiner hund lief", "zz"), ("ein kleiner hund lief", "aa"), ("quick brown foxes jump", "mm")]
    docs = _taught(spark, rows).withColumn("doc_id", F.lit(None).cast("long"))  # all of them teach, so that both count alike
    rows = langid.identify(docs).where("text LIKE 'ein%'").collect()
    assert {(r.lang_pred, r.ambiguous) for r in rows} == {("aa", True)}
    assert langid.keep_identified(docs).select("lang").distinct().collect() == [("mm",)]


@pytest.mark.parametrize("n", [7, 40])
def test_many_languages(spark, n):
    rng = np.random.default_rng(n)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for _ in range(n)]
    texts = [(" ".join(rng.choice(words[k], 60)), f"l{k:02d}") for k in range(n) for _ in range(2)]
    rows = langid.identify(_taught(spark, texts, 4)).withColumn("k", F.col("doc_id") / 8).collect()
    assert all(r.lang_pred == f"l{int(r.k):02d}" for r in rows) and sum(r.ambiguous for r in rows) <= len(rows) // 20


# tables that start anew
def test_pieces_are_the_same_when_their_table_is_full(monkeypatch):
    tokenizer = Tokenizer.from_file(str(bpe.VOCABULARY))
    texts = [f"the table of {k} pieces is full, und fängt neu an {k * 7}" for k in range(60)] + ["", "x" * 300]
    want = [array("i", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    pieces = bpe._Pieces(tokenizer)
    assert [x for k in range(0, len(texts), 4) for x in pieces.encode(texts[k : k + 4])] == want


def test_words_are_the_same_when_their_table_is_full(monkeypatch):
    text = " ".join(licenses.TEMPLATES["Zlib"].split() * 3)
    index = licenses.Index(licenses.TEMPLATES)
    want = index.scan(text)
    monkeypatch.setattr(licenses, "KEPT_WORDS", 2)
    assert licenses.Index(licenses.TEMPLATES).scan(text) == want and want
