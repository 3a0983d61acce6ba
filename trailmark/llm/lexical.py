"""Ranked lexical search over a clustered index, with exact stopping.

Documents are put in a new order by recursive graph bisection: a set of documents is halved, and pairs are swapped between the halves as long as that
lowers the estimated log-gap cost of their terms' posting lists; then each half is halved. The tree is fitted on a bounded sample (:data:`SAMPLE`
documents, terms hashed to :data:`VOCABULARY` numbers); every document goes down it by the same costs. Its leaves are the clusters of the index: a
table of postings in which each file is in the order of cluster and new place, and holds all postings of its documents.

The best score that a cluster could hold for a query is the sum, over the query's terms, of the weight times the greatest impact of the term in the cluster. Each query visits its
clusters from the highest bound on, and stops before the first one whose bound is below its k-th score; an equal bound is visited, as a smaller doc_id may tie.
The first score to beat is the k-th of what a query's rarest terms alone bring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, order_id, plain_id, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEST = 10
#: The bisection: documents it is fitted on (about; chosen by a hash of their place), numbers that terms are hashed to, levels, rounds of swaps, least documents to halve.
SAMPLE, VOCABULARY, LEVELS, SWEEPS, LEAST = 4096, 1 << 14, 6, 12, 16
#: A place in the new order is the cluster and, below this bit, the row number.
PLACE_BITS = 57
#: Tables of queries' terms are sent to all tasks up to so many bytes, measured; past that the join shuffles.
SENT_BYTES = 32 << 20
#: A query's rarest terms with so many postings together give the first k-th score to beat. Clusters of the first visit; each later one takes so many times more.
SEED_POSTINGS, FIRST_VISIT, GROWTH = 20_000, 2, 8
#: Terms that a task's numpy code holds at once.
TERMS_AT_ONCE = 1 << 19


def terms(text: Column) -> Column:
    """array<string>: the maximal runs of :data:`TERM`, in order, with repeats; letters as they are. Null for null."""
    return F.regexp_extract_all(text, F.lit(TERM), 0)


def lowered(term: Column) -> Column:
    """Only A-Z in lower case; ASCII terms take the fast way."""
    return F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def _numbers(found: Column) -> Column:
    """array<int>: the terms hashed."""
    return F.transform(found, lambda t: F.pmod(F.xxhash64(lowered(t)), F.lit(VOCABULARY)).cast("int"))


# the order
def _costs(here: np.ndarray, there: np.ndarray, n_here: int, n_there: int) -> np.ndarray:
    """What each term costs: its postings in both halves times the logarithm of their mean gap."""
    return here * np.log2(n_here / (here + 1.0)) + there * np.log2(n_there / (there + 1.0))


def _halves(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n documents is on the left; doc and term are its edges."""
    left = np.arange(n) < n // 2
    sizes = n // 2, n - n // 2
    for _ in range(SWEEPS):
        on_left = left[doc]
        a = np.bincount(term[on_left], minlength=VOCABULARY).astype(float)
        b = np.bincount(term[~on_left], minlength=VOCABULARY).astype(float)
        now = _costs(a, b, *sizes)
        to_right = now - _costs(np.maximum(a - 1, 0), b + 1, *sizes)
        to_left = now - _costs(a + 1, np.maximum(b - 1, 0), *sizes)
        gain = np.bincount(doc, np.where(on_left, to_right[term], to_left[term]), n)
        ours, theirs = np.flatnonzero(left), np.flatnonzero(~left)
        ours, theirs = ours[np.argsort(-gain[ours], kind="stable")], theirs[np.argsort(-gain[theirs], kind="stable")]
        pairs = min(len(ours), len(theirs))
        swaps = int((gain[ours[:pairs]] + gain[theirs[:pairs]] > 0).sum())  # gains fall along both, so these come first
        if not swaps:
            break
        left[ours[:swaps]], left[theirs[:swaps]] = False, True
    return left


def _tree(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """A row for each inner node: the weight of each term for the left, and last the score above which a document goes left."""
    nodes = np.zeros(((1 << LEVELS) - 1, VOCABULARY + 1), np.float32)
    at = np.zeros(n, np.int64)
    for node in range(len(nodes)):
        own = np.flatnonzero(at == node)
        if len(own) >= LEAST:
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = place[doc] >= 0
            d, t = place[doc[inside]], term[inside]
            left = _halves(d, t, len(own))
            counts = [np.bincount(t[left[d] == side], minlength=VOCABULARY) for side in (True, False)]
            share = [np.log2((c + 1.0) / (s + 2.0)) for c, s in zip(counts, (left.sum(), (~left).sum()), strict=True)]
            nodes[node, :-1] = share[0] - share[1]
            score = np.bincount(d, nodes[node, t], len(own))
            nodes[node, -1] = np.median(score)
            at[own] = 2 * node + 1 + (score <= nodes[node, -1])
    return nodes


def _edges(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the distinct numbers of each row; null has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(np.repeat(np.arange(len(lists)), sizes) * VOCABULARY + lists.flatten().to_numpy(zero_copy_only=False))
    return pairs // VOCABULARY, pairs % VOCABULARY


def fit_order(rows: DataFrame, number: str, found: str) -> np.ndarray:
    """The bisection tree of about ``SAMPLE`` of the rows (row number, array of terms), fitted in one task. At most SAMPLE x VOCABULARY edges, in practice some hundreds a document."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64(number), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.coalesce(F.array_distinct(_numbers(F.col(found))), F.array().cast("array<int>")).alias("t"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0) for b in batches]
        if parts:
            lists = pa.chunked_array(parts).combine_chunks()
            nodes = _tree(*_edges(lists), len(lists))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(nodes))), pa.array(list(nodes), pa.list_(pa.float32()))], ["node", "weights"])

    fitted = sorted(sample.repartition(1).mapInArrow(fit, "node long, weights array<float>").collect())
    return np.array([r.weights for r in fitted], np.float32) if fitted else np.zeros(((1 << LEVELS) - 1, VOCABULARY + 1), np.float32)


def cluster_of(found: Column, tree: np.ndarray) -> Column:
    """int: the leaf of ``tree`` (a few MB, whatever the input) that a document's terms lead to."""

    @F.arrow_udf("int")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(ends // TERMS_AT_ONCE, prepend=0))
            leaves = [np.zeros(0, np.int64)]
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                doc, term = _edges(batch[a:b])
                at = np.zeros(b - a, np.int64)
                for _ in range(LEVELS):
                    score = np.bincount(doc, tree[at[doc], term], b - a)
                    at = 2 * at + 1 + (score <= tree[at, -1])
                leaves.append(at - len(tree))
            yield pa.array(np.concatenate(leaves), pa.int32())

    return walk(_numbers(found))


# the index
@dataclass
class Index:
    """Two written tables, postings (cluster, term, place, oid, n, tf) and lists (cluster, term, df, top: its postings there and their greatest impact), and the number of documents that have a term."""

    postings: DataFrame
    lists: DataFrame
    documents: int

    def weights(self) -> DataFrame:
        """(term, w)"""
        w = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1))).cast("long")
        return self.lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", w.alias("w"))


def _sent(df: DataFrame, text: str) -> DataFrame:
    """``df``, a written table, to be broadcast if its measured size allows it."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= SENT_BYTES else df


def rows_with_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid (the row's number), oid (its id as a sort key), found (its terms)"""
    return numbered(docs.select(order_id(id_col).alias("oid"), F.col(text_col).alias("text")), "rid").select("rid", "oid", terms(F.col("text")).alias("found"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None) -> Index:
    """The index of all documents; with ``wanted`` (term), a written table, postings of other terms are left out before anything is shuffled."""
    rows = rows_with_terms(docs, id_col, text_col)
    tree = fit_order(rows, "rid", "found")
    placed = rows.select("rid", "oid", "found", F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n"), cluster_of(F.col("found"), tree).alias("cluster"))
    place = F.shiftleft(F.col("cluster").cast("long"), PLACE_BITS).bitwiseOR(F.col("rid"))
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("found", F.array().cast("array<string>"))))  # the null stands for the document
    tokens = placed.select("cluster", place.alias("place"), "oid", "n", each.alias("term")).withColumn("term", lowered(F.col("term")))
    if wanted is not None:
        tokens = tokens.join(_sent(wanted.withColumn("wanted", F.lit(True)), "term"), "term", "left").where("term IS NULL OR wanted")
    counted = tokens.repartition("place").groupBy("cluster", "place", "oid", "n", "term").agg(F.count("*").alias("tf"))  # dealt once: a document's terms are in one task
    table = written(counted.sortWithinPartitions("cluster", "place"), "lexical-index")
    documents, occurrences = table.where("term IS NULL AND n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    m = f"(10L + (90L * n * {documents}L) div {occurrences}L)"
    postings = table.where("term IS NOT NULL").withColumn("impact", F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")).drop("n", "tf")
    lists = postings.groupBy("cluster", "term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    return Index(postings, written(lists, "lexical-lists"), documents)


# the search
def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "oid", "place")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scores(index: Index, asked: DataFrame) -> DataFrame:
    """asked (q, cluster, term, w), or without cluster, a written table -> (q, oid, place, score). A file holds whole documents, so what is shuffled is one row a document and q."""
    on = [c for c in ("cluster", "term") if c in asked.columns]
    return index.postings.join(_sent(asked, "term"), on).groupBy("q", "oid", "place").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def _first_to_beat(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(q, kth): the k-th of the scores that the rarest terms alone bring documents. No k-th best score is below it."""
    df = index.lists.groupBy("term").agg(F.sum("df").alias("df"))
    rising = Window.partitionBy("q").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = written(asked.join(df, "term").withColumn("postings", F.sum("df").over(rising)).where(F.col("postings") <= SEED_POSTINGS).select("q", "term", "w"), "lexical-rare")
    return written(_best(_scores(index, rare), k).where(F.col("rank") == k).select("q", F.col("score").alias("kth")), "lexical-first")


def search(index: Index, asked: DataFrame, k: int = BEST) -> DataFrame:
    """asked (q, term), distinct -> (q, rank, doc_id, score): the k best documents of each q, ties by doc_id (null last) and then by the order of the index."""
    asked = written(asked.join(index.weights(), "term").where("w > 0").select("q", "term", "w"), "lexical-asked")
    bounds = asked.join(index.lists, "term").groupBy("q", "cluster").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "cluster"))
    plan = written(bounds.withColumn("turn", turn), "lexical-plan")
    to_beat, best, seen, until = _first_to_beat(index, asked, k), None, 0, FIRST_VISIT
    while True:
        left = plan.where(F.col("turn") > seen).join(to_beat, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(1)).cast("long")).where("bound >= kth")
        if best is not None and not left.head(1):
            return best.select("q", "rank", plain_id("oid").alias("doc_id"), "score")
        scores = _scores(index, written(left.where(F.col("turn") <= until).select("q", "cluster").join(asked, "q"), "lexical-visits"))
        scores = scores if best is None else scores.unionByName(best.select("q", "oid", "place", "score"))
        best, seen, until = written(_best(scores, k), "lexical-best"), until, until * GROWTH
        better = best.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        to_beat = to_beat.unionByName(better).groupBy("q").agg(F.max("kth").alias("kth"))


def rank_documents(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", k: int = BEST) -> DataFrame:
    """One row for each item and each of its k best documents of score above 0 (all, if fewer): item id, rank, doc_id, score.

    Scores count whole texts; a null or empty text has no term and is found by nothing; an item without a term has no row. Rows that repeat are documents, or items,
    of their own, and ties come in the order of doc_id, null last. Empty tables give an empty result. Other columns, whatever their names, are not looked at.
    """
    numbers = written(numbered(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")), "q"), "lexical-items")
    asked = written(numbers.select("q", F.explode(terms(F.col("text"))).alias("term")).select("q", lowered(F.col("term")).alias("term")).distinct(), "lexical-terms")
    index = build_index(docs, id_col, text_col, written(asked.select("term").distinct(), "lexical-wanted"))
    found = search(index, asked, k)
    return found.join(numbers.select("q", "item"), "q").select(F.col("item").alias(item_id), "rank", F.col("doc_id"), "score")
