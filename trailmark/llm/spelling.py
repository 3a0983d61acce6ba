"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length L is cut into two segments that only L decides. One edit leaves one of them whole, so a word within one edit of it, of the same
length or one longer, has its first segment at the start or its second at the end, there shifted by the difference in length. Words are indexed by
both segments and probed with those substrings; what meets is verified.

A segment that many words share is not paired out: the part between what is known to be equal on the left and on the right is cut in two again,
by the same rule, and its words meet by the longer key. So a probe meets at most ``MOST_IN_LIST`` words a key, or the words that are equal but for one letter.
A pair that meets by the first segment of a cut does not meet by the second again, so no pair is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = r"[A-Za-z\u00C0-\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_TIMES, SLIP_EVERY, FORM_FACTOR = 7, 2, 31, 10
#: Words of the index, and probes, that may meet under one key; past that the key is made longer.
MOST_IN_LIST, MOST_PROBES = 64, 1024


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, slip_every: int = SLIP_EVERY) -> DataFrame:
    """word, n: the words of the whole texts with how often each occurs, from ``min_chars`` code points and ``min_times`` occurrences on.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z in lower case. Where ``slip_every`` divides the crc32 h of ``<id>:<word>``, the code point
    h % length is left out. A null text has no word; a null id reads as the empty text.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{min_chars},}}"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("w")).withColumn("w", F.translate("w", UPPER, LOWER))
    h = F.crc32(F.encode(F.concat("i", F.lit(":"), "w"), "UTF-8"))
    at = (F.col("h") % F.length("w")).cast("int")
    slipped = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    words = rows.select("w", h.alias("h")).select(F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_times)


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows and the key of what is equal: ``left`` code points at the start and ``right`` at the end of words of the index of length ``size``."""
    return rows.withColumn("key", F.xxhash64("size", "left", "right", F.substring("word", F.lit(1), F.col("left")), _end(F.col("word"), F.col("right"))))


def _end(word: Column, n: Column) -> Column:
    return F.substring(word, F.length(word) - n + 1, n)


def _cut(rows: DataFrame) -> DataFrame:
    """Two rows for each: the middle that is not known to be equal is cut, and its first or its second segment is equal as well. ``differ`` is where the starts must differ: a pair whose first segments are equal meets by those."""
    middle = F.col("size") - F.col("left") - F.col("right")
    half = F.floor(middle / 2).cast("int")
    first = F.struct((F.col("left") + half).alias("left"), F.col("right"), F.col("differ"))
    second = F.struct(F.col("left"), (F.col("right") + middle - half).alias("right"), (F.col("left") + half).alias("differ"))
    return _keyed(rows.select("word", "n", "probe", "size", F.explode(F.array(first, second)).alias("c")).select("word", "n", "probe", "size", "c.*"))


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word, n) with distinct words -> (a, a_n, b, b_n), each pair of words that differ by one inserted, deleted or replaced code point once."""
    size, none = F.length("word"), F.lit(0)
    roles = F.array(*(F.struct(F.lit(p).alias("probe"), s.alias("size")) for p, s in ((False, size), (True, size), (True, size - 1))))
    start = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*", none.alias("left"), none.alias("right"), F.lit(-1).alias("differ"))
    rows, found = written(_cut(start.where("size > 0 OR NOT probe")), "spelling-keys"), None
    while True:
        counts = rows.groupBy("key").agg(
            F.count_if(~F.col("probe")).alias("listed"), F.count_if("probe").alias("probes"), F.min(F.col("size") - F.col("left") - F.col("right")).alias("middle")
        )
        long = f"middle > 1 AND (listed > {MOST_IN_LIST} OR probes > {MOST_PROBES})"
        counts = written(counts.where("listed > 0 AND probes > 0").select("key", F.expr(long).alias("long")), "spelling-lists")
        met = rows.join(counts, "key")
        pairs = _verified(met.where("NOT long"))
        found = pairs if found is None else found.unionByName(pairs)
        if not counts.where("long").head(1):
            return found
        rows = written(_cut(met.where("long")), "spelling-keys")


def _verified(rows: DataFrame) -> DataFrame:
    listed = rows.where("NOT probe").select("key", "size", "left", "right", "differ", F.col("word").alias("a"), F.col("n").alias("a_n"))
    probes = rows.where("probe").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    start = lambda w, n: F.substring(w, F.lit(1), F.col(n))
    once = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    equal = (start("a", "left") == start("b", "left")) & (_end(F.col("a"), F.col("right")) == _end(F.col("b"), F.col("right")))
    first = (F.col("differ") < 0) | (start("a", "differ") != start("b", "differ"))
    pairs = listed.join(probes, "key").where(once & F.length("b").between(F.col("size"), F.col("size") + 1) & equal & first)
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """forms (word, form), without circles -> (word, root): the last form of each chain. Chains are halved each round; a word has at most some 180 near words a letter, so no form is the key of more."""
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        stepped = roots.join(ahead, "root", "left")
        roots = written(stepped.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("went")), "spelling-roots")
        if not roots.where("went").head(1):
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def group_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """words (word, n) with distinct words -> word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) where that is at least ``factor`` (2 or more) times the word's n, else null;
    ``root`` follows the forms to the last, and is the word itself where it has none. An empty table gives an empty result.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(words)
    sides = (F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba"))
    both = pairs.select(F.explode(F.array(*sides)).alias("p")).select("p.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    large = -F.col("best.n") >= factor * F.col("n")
    near = written(best.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n")), "spelling-near")
    roots = roots_of(near.where("form IS NOT NULL").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`group_variants` of the :func:`word_counts` of ``docs``. Columns of other names are not looked at; rows that repeat count each; an empty table gives an empty result."""
    return group_variants(word_counts(docs, id_col, text_col))
