"""An inverted index for word search (F1, P14): where each word of each column stands, by buckets of words.

A word is a maximal run of letters and digits, in lower case. The index has a row for each occurrence: word, column, EventId and position. It is a table in buckets of
words, sorted by word, so that a term's look-up reads one bucket's folder and in it the row groups of the word; a word that fills a bucket is dealt over many files.
Words of a phrase meet by (EventId, column, position), terms by EventId. What is found is read from the events by a semi join and held against the term as written, as signs
between words are not in the index: the answer is that of the scan, but only the found rows are scanned.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.search import WORD_COLUMNS, search_terms, word_search

BUCKETS = 64
#: Occurrences that a task sorts, some 150 bytes each in memory.
ROWS_A_TASK = 1 << 20
_WORD = r"[\p{L}\p{N}]+"
#: The same for one term on the driver.
_RUN = re.compile(r"[^\W_]+")


def _bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


def occurrences(events: DataFrame, columns: tuple[str, ...] = WORD_COLUMNS) -> DataFrame:
    """bucket, word, column, EventId, position"""
    found = [F.struct(F.lit(c).alias("column"), F.regexp_extract_all(F.col(c), F.lit(_WORD), 0).alias("words")) for c in columns]
    by_column = events.select("EventId", F.explode(F.array(*found)).alias("f")).select("EventId", "f.column", F.posexplode("f.words").alias("position", "word"))
    word = by_column.withColumn("word", F.lower("word"))
    return word.select((F.crc32(F.encode("word", "UTF-8")) % BUCKETS).cast("int").alias("bucket"), "word", "column", "EventId", "position")


def _tasks(events: DataFrame, columns: tuple[str, ...]) -> int:
    words = (F.coalesce(F.greatest(F.size(F.regexp_extract_all(F.col(c), F.lit(_WORD), 0)), F.lit(0)), F.lit(0)) for c in columns)
    total = events.agg(F.sum(reduce(Column.__add__, words).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / ROWS_A_TASK))


def add_to_index(events: DataFrame, path: str, columns: tuple[str, ...] = WORD_COLUMNS) -> None:
    """Indexes events, to which later ones can be added. An event is added once; those that are deleted may stay in the index. Words are counted first, so that what a task sorts is bounded, however many events there are."""
    rows = occurrences(events, columns).repartitionByRange(_tasks(events, columns), "bucket", "word", "EventId").sortWithinPartitions("bucket", "word", "EventId")
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, column string, EventId string, position int, bucket int").parquet(path)


def term_words(term: str) -> list[str]:
    return [w.lower() for w in _RUN.findall(term)]


def look_up(index: DataFrame, term: str) -> DataFrame:
    """EventId, distinct: the events that have the words of a term side by side in one column."""
    words = term_words(term)
    if not words:
        raise ValueError("a term needs a letter or digit")
    stands = [index.where((F.col("bucket") == _bucket(w)) & (F.col("word") == w)).select("EventId", "column", (F.col("position") - k).alias("at")) for k, w in enumerate(words)]
    return reduce(lambda a, b: a.join(b, ["EventId", "column", "at"], "left_semi"), stands).select("EventId").distinct()


def indexed_search(events: DataFrame, index: DataFrame, text: str, columns: tuple[str, ...] = WORD_COLUMNS) -> DataFrame:
    """The rows that :func:`word_search` finds, by way of the index. An empty text finds all."""
    terms = search_terms(text)
    if not terms:
        return events
    ids = reduce(lambda a, b: a.join(b, "EventId", "left_semi"), (look_up(index, t) for t in terms))
    return events.join(ids, "EventId", "left_semi").where(word_search(text, columns))
