"""SimHash near-duplicates by segment popcounts.

The 64 bits of a fingerprint are 32 segments of two bits. Their popcounts (0, 1 or 2) are a point in a grid of 32 dimensions, and the
Manhattan distance of two points is at most the Hamming distance of the fingerprints. Fingerprints that differ in at most three bits
lie within three grid steps, so in one half of the dimensions they lie within one step: every fingerprint goes to the grid cell of each
half, and on one side of the join also to the 16 cells that are one step up. (A step down is the same pair seen from the other side.)
What meets in a cell is then compared bit by bit. Pairs that meet by chance grow with the square of the number of fingerprints, so very
many of them meet in smaller cells, of three quarters of the dimensions (``_by_quarters``). The join is on distinct fingerprints, so copies of a text meet nobody.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import OWN, numbered, order_id, plain_id, written
from .graph import connected_components

SEED, SHINGLE_WORDS, MAX_BITS = 42, 3, 3
HASHES_AT_ONCE = 1 << 18
#: From so many distinct fingerprints on, they meet in quarters: some 170 narrow rows each instead of 28, but a two-hundredth of the pairs to compare. Either way is exact.
FINE_FROM = 1 << 26
FP, RID = OWN + "fp", OWN + "rid"
_EVERY_SECOND_BIT = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """As an unsigned number. Words: what is between ``[\\x20\\x09-\\x0D]``, A-Z in lower case. A text without a word has 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE_WORDS + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        to = min(n, at + HASHES_AT_ONCE)
        shingles = zip(*(words[at + k : to + k] for k in range(SHINGLE_WORDS)), strict=True)
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, to - at)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.arrow_udf(LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in batch], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = FP) -> DataFrame:
    return docs.withColumn(name, _fingerprints(F.col(text_col)))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def popcounts(fp: Column) -> Column:
    """32 fields of two bits: the popcounts of the 32 segments."""
    low, high = fp.bitwiseAND(F.lit(_EVERY_SECOND_BIT)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVERY_SECOND_BIT))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _steps(cell: Column, dims: int, down: bool = False) -> list[Column]:
    """The cells one step up (and down) from a cell of so many two-bit fields; null where a field is at its end."""
    field = lambda k: F.shiftright(cell, 2 * k).bitwiseAND(F.lit(3))
    up = [F.when(field(k) < 2, cell + F.lit(1 << 2 * k)) for k in range(dims)]
    return up + [F.when(field(k) > 0, cell - F.lit(1 << 2 * k)) for k in range(dims)] if down else up


def _by_halves(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the fingerprints' cells of each half, those of the one side with the cells one step up."""
    halves = points.select("fp", F.posexplode(F.array(F.shiftrightunsigned("point", 32), F.col("point").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("half", "half_cell"))
    cell = F.col("half_cell")
    named = lambda cells: F.explode(F.array_compact(F.array(*(F.shiftleft(c, 1) + F.col("half") for c in cells)))).alias("cell")
    return halves.select("fp", named([cell, *_steps(cell, 16)])), halves.select("fp", named([cell]))


def _by_quarters(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of cells of three quarters (8 dimensions each). Of three steps over four quarters at least one quarter has none. If two have none, one of the others has at most one step: the
    one side takes the cells one step up. Else the other three have one step each: of two of them, the one side takes the step of the first, the other side that of the second, up or down.
    """
    rows = points.select("fp", *(F.shiftrightunsigned("point", 16 * q).bitwiseAND(F.lit(0xFFFF)).alias(f"q{q}") for q in range(4)))
    q = [F.col(f"q{k}") for k in range(4)]
    here, there = [], []

    def cell(number: int, first: Column, second: Column, third: Column) -> Column:
        return F.lit(number << 48) + F.shiftleft(first, 32) + F.shiftleft(second, 16) + third

    pairs = [(i, j, k) for i, j in combinations(range(4), 2) for k in range(4) if k not in (i, j)]
    for number, (i, j, k) in enumerate(pairs):
        here += [cell(number, q[i], q[j], x) for x in (q[k], *_steps(q[k], 8))]
        there.append(cell(number, q[i], q[j], q[k]))
    for i in range(4):
        j, k = [x for x in range(4) if x != i][:2]
        here += [cell(len(pairs) + i, q[i], x, q[k]) for x in _steps(q[j], 8)]
        there += [cell(len(pairs) + i, q[i], q[j], x) for x in _steps(q[k], 8, down=True)]
    named = lambda cells: F.explode(F.array_compact(F.array(*cells))).alias("cell")
    return rows.select("fp", named(here)), rows.select("fp", named(there))


def candidates(fps: DataFrame, name: str = FP, fine: bool = False) -> DataFrame:
    """Distinct fingerprints -> (a, b): those that meet in a cell, in halves or (fine) in quarters. Both hold all pairs within MAX_BITS."""
    points = fps.select(F.col(name).alias("fp"), popcounts(F.col(name)).alias("point"))
    here, there = (_by_quarters if fine else _by_halves)(points)
    if fine:  # Spark does not count on the rows that explode makes, and would send a side to every task that is sixty times what it takes it for
        there = there.hint("merge")
    return here.withColumnRenamed("fp", "a").join(there.withColumnRenamed("fp", "b"), "cell").where("a <> b").select("a", "b")


def near_pairs(fps: DataFrame, name: str = FP, fine: bool = False) -> DataFrame:
    """Distinct fingerprints -> (a, b): all pairs of them that differ in 1 to MAX_BITS bits, once each or more often."""
    return candidates(fps, name, fine).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def components(fps: DataFrame, id_col: str, name: str = FP) -> DataFrame:
    """(id, fingerprint) rows -> (fingerprint, component, oid): the least fingerprint and the least id, as an order id, that links lead to from each fingerprint. Only the fingerprint names a component: ids may be null or repeat."""
    groups = written(fps.groupBy(name).agg(F.min(order_id(id_col)).alias("oid")), "fingerprints")
    linked = connected_components(near_pairs(groups, name, fine=groups.count() >= FINE_FROM))
    joined = groups.join(linked.withColumnRenamed("node", name), name, "left").withColumn("component", F.coalesce("component", name))
    least = joined.groupBy("component").agg(F.min("oid").alias("least"))
    return joined.join(least, "component").select(name, "component", F.col("least").alias("oid"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id that links lead to, itself included).

    Null and empty texts have fingerprint zero and link like any other. A null id is component_id only if its whole component has
    none. Rows that repeat are rows of the same fingerprint. An empty table gives an empty result; other columns are not looked at.
    """
    fps = written(with_fingerprint(docs.select(id_col, text_col), text_col).select(id_col, FP), "simhash")
    return fps.join(components(fps, id_col), FP).select(id_col, hex_of(F.col(FP)).alias("fingerprint"), plain_id("oid").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, with all its columns: the one with the least id (null comes last), of rows with that id the first."""
    fps = written(with_fingerprint(numbered(docs.select(id_col, text_col), RID), text_col).select(id_col, RID, FP), "simhash")
    stay = fps.join(components(fps, id_col), FP).where(order_id(id_col) == F.col("oid")).groupBy("component").agg(F.min(RID).alias("first"))
    dropped = fps.join(stay, fps[RID] == stay["first"], "left_anti").select(RID)
    return numbered(docs, RID).join(written(dropped, "near-copies"), RID, "left_anti").select(docs.columns)
