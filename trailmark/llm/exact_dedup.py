"""Exact deduplication by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Each step sees only what the step before left in groups of two rows or more:

1. one narrow row a document: length and prefix hash of the normalised text, written as a table;
2. lengths that occur twice, then (length, prefix hash) pairs of such lengths that occur twice;
3. the surviving pairs; rows of others cannot have a copy: their content is not hashed and their text is never shuffled;
4. SHA-256 of the whole normalised text of the rest, grouped with partial aggregation.

What a step leaves is a bitmap of BITS_A_KEY bits a key, but never more than ``BITMAP_BYTES``, which is what makes its broadcast safe. A bit may
stand for several keys; what passes by such a chance is settled by the steps after it. So no step deals rows by their length, which many may share.

Texts never meet in one task: groups are counts and minima, so a group that holds a third of all rows is one row for each map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, numbered, order_id, plain_id, written

PREFIX_CHARS = 256
#: A bitmap has buckets of 32768 bits, 256 (1 MiB) to 65536 (256 MiB) of them. Past 2^27 keys it only gets fuller, and more rows pass.
BITS_A_KEY, BUCKET_BITS, LEAST_BUCKETS, MOST_BUCKETS = 16, 32768, 256, 65536
BITMAP_BYTES = MOST_BUCKETS * BUCKET_BITS // 8

#: Groups of equal texts, of some 110 bytes each, that are sent to every task.
GROUPS_SENT = 100_000

LEN, HEAD, SHA, RID, HASH, BUCKET, POS, BITS = (OWN + x for x in ("len", "head", "sha", "rid", "hash", "bucket", "pos", "bits"))


def normalised(text: Column) -> Column:
    """Every run of ``[\\x20\\x09-\\x0D]`` as one space; null is empty. The pattern skips single spaces, which stay as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(F.col(text_col))
    return numbered(docs, RID).withColumns({LEN: F.octet_length(norm), HEAD: F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))})


@dataclass
class Bitmap:
    """Which values of the key columns occur twice: a row of bits for each bucket that has any."""

    keys: tuple[str, ...]
    buckets: int
    bits: DataFrame

    @classmethod
    def of_repeated(cls, rows: DataFrame, *keys: str) -> Bitmap:
        twice = written(rows.groupBy(*keys).count().where("count > 1").select(F.xxhash64(*keys).alias(HASH)), "dedup-repeated")
        wanted = twice.count() * BITS_A_KEY // BUCKET_BITS
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << wanted.bit_length()))
        placed = twice.select(cls._bucket(buckets), cls._place())
        return cls(keys, buckets, written(placed.groupBy(BUCKET).agg(F.bitmap_construct_agg(POS).alias(BITS)), "dedup-bitmap"))

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.shiftrightunsigned(F.col(HASH), 20), F.lit(buckets)).cast("int").alias(BUCKET)

    @staticmethod
    def _place() -> Column:
        return F.pmod(F.col(HASH), F.lit(BUCKET_BITS)).cast("int").alias(POS)

    def beside(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        """The rows with their bucket's bits beside them, and the test of a row's bit."""
        placed = rows.withColumn(HASH, F.xxhash64(*self.keys)).select("*", self._bucket(self.buckets), self._place()).join(F.broadcast(self.bits), BUCKET, "left")
        byte = F.conv(F.hex(F.expr(f"substring({BITS}, shiftright({POS}, 3) + 1, 1)")), 16, 10).cast("long")
        return placed, F.coalesce(F.call_function("getbit", byte, F.pmod(F.col(POS), F.lit(8)).cast("int")) == 1, F.lit(False))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Bitmap:
    """Steps 1 to 3: the (length, prefix hash) pairs that two rows or more share."""
    signed = written(_signed(docs, id_col, text_col).select(LEN, HEAD), "dedup-signatures")
    rows, bit = Bitmap.of_repeated(signed, LEN).beside(signed)
    return Bitmap.of_repeated(rows.where(bit), LEN, HEAD)


def duplicate_groups(docs: DataFrame, pairs: Bitmap, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Step 4: a row for each text that occurs twice or more: its SHA-256, the smallest id, the row that stays, the number of rows."""
    rows, bit = pairs.beside(_signed(docs, id_col, text_col))
    hashed = rows.where(bit).select(LEN, HEAD, sha256_of(F.col(text_col)).alias(SHA), order_id(id_col).alias("oid"), RID)
    by_id = hashed.groupBy(LEN, HEAD, SHA, "oid").agg(F.min(RID).alias("rid"), F.count("*").alias("n"))
    return (
        by_id.groupBy(LEN, HEAD, SHA)
        .agg(F.min("oid").alias(OWN + "keep"), F.min_by("rid", "oid").alias(OWN + "keep_rid"), F.min_by("n", "oid").alias(OWN + "same_id"), F.sum("n").alias(OWN + "size"))
        .where(F.col(OWN + "size") > 1)
        .drop(LEN, HEAD)
    )


def _written_groups(groups: DataFrame) -> tuple[DataFrame, bool]:
    """The groups as a table, and whether they are few enough to go to every task: then no row is shuffled to meet its group. Beyond that, only rows that may have a copy are."""
    groups = written(groups, "dedup-groups")
    return groups, groups.count() <= GROUPS_SENT


def _stays(id_col: str) -> Column:
    """Of rows that repeat both id and text, the first one stays."""
    first = (order_id(id_col) == F.col(OWN + "keep")) & ((F.col(OWN + "same_id") == 1) | (F.col(RID) == F.col(OWN + "keep_rid")))
    return F.col(OWN + "size").isNull() | first


def label_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Equal texts: identical after :func:`normalised`; null equals the empty text. The smallest id of a group stays, a null id only
    if there is no other; rows that repeat id and text count in ``group_size`` and one of them is kept. An empty table gives an
    empty result. Other columns of ``docs``, whatever their names, are not looked at.
    """
    docs = docs.select(id_col, text_col)
    pairs = survivors(docs, id_col, text_col)
    groups, few = _written_groups(duplicate_groups(docs, pairs, id_col, text_col))
    if few:
        rows = numbered(docs, RID).select(id_col, RID, sha256_of(F.col(text_col)).alias(SHA)).join(F.broadcast(groups), SHA, "left")
    else:
        signed, bit = pairs.beside(_signed(docs, id_col, text_col))
        hashed = lambda some: some.select(id_col, RID, sha256_of(F.col(text_col)).alias(SHA))
        rows = hashed(signed.where(bit)).join(groups, SHA, "left").unionByName(hashed(signed.where(~bit)), allowMissingColumns=True)
    return rows.select(
        id_col,
        F.when(F.col(OWN + "size").isNull(), F.col(id_col)).otherwise(plain_id(OWN + "keep")).alias("keep_id"),
        F.coalesce(F.col(OWN + "size"), F.lit(1)).cast("long").alias("group_size"),
        _stays(id_col).alias("kept"),
        F.col(SHA).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Only rows that may have a copy are shuffled; the others pass by."""
    pairs = survivors(docs, id_col, text_col)
    groups, few = _written_groups(duplicate_groups(docs, pairs, id_col, text_col))
    groups = F.broadcast(groups) if few else groups
    rows, bit = pairs.beside(_signed(docs, id_col, text_col))
    alone = rows.where(~bit)
    joined = rows.where(bit).withColumn(SHA, sha256_of(F.col(text_col))).join(groups, SHA, "left").where(_stays(id_col))
    return alone.select(docs.columns).unionByName(joined.select(docs.columns))
