"""Sharding by histogram sort.

Rows are ordered by a key of 128 bits: the id, then a hash that tells rows of one id apart. Where each shard must end is known in bytes;
which key that is, is found by counting the exact bytes and rows below candidate keys in one pass over (key, size) rows, and again
between the two candidates that enclose the end, until a candidate lies within the tolerance or no row lies between. Then the rows are
exchanged once. The counts of rows below the splitters also number the rows of a shard without another pass.

The driver holds the candidates and their counts, never rows: PROBES for each splitter, fewer when there are many splitters.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, numbered, written

SHARDS = 8
#: A splitter may miss its place by this share of a partition's bytes.
TOLERANCE = 0.001
#: Shards are sorted in partitions of about so many bytes, or larger ones where there would be more partitions than this: the driver holds a key for each.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 1 << 14
PROBES, PROBES_IN_ALL = 16, 1 << 16
KEY, SIZE, PART, PLACE = (OWN + x for x in ("key", "size", "part", "place"))
_DIGITS = 32


def sizes(text_col: str) -> Column:
    """UTF-8 bytes of the text, none if it is null, plus one."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def order_key(id_col: str, text_col: str, place: str) -> Column:
    """32 hexadecimal digits that sort as (id, hash); a null id comes first. The hash takes in the row's place in the table, so that any number of equal rows can be split between shards."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    apart = F.xxhash64(F.col(id_col), F.col(text_col), F.col(place))
    return F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (number, apart)))


def _below(keys: list[str], key: Column) -> Column:
    """How many of the sorted keys are at most ``key``: a binary search."""
    if not keys:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(keys).bit_length()))]
    table = F.lit(keys)
    hit = lambda at: (at <= len(keys)) & (F.get(table, at - 1) <= key)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(hit(at + step), at + step).otherwise(at))


@dataclass
class _Bracket:
    """Keys are integers; bytes and rows are those below the key."""

    target: float
    low: tuple[int, int, int]
    high: tuple[int, int, int]

    def best(self) -> tuple[int, int, int]:
        return min(self.low, self.high, key=lambda x: abs(x[1] - self.target))

    def open(self, tolerance: float) -> bool:
        return self.high[2] - self.low[2] > 1 and self.high[0] - self.low[0] > 1 and abs(self.best()[1] - self.target) > tolerance


def splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, int, int]]:
    """keys (KEY, SIZE) -> for each target, in bytes from the start, the key that comes within the tolerance, with the bytes and rows below it."""
    first, last, size, rows = keys.agg(F.min(KEY), F.max(KEY), F.sum(SIZE), F.count("*")).first()
    low, high = (int(first, 16), 0, 0), (int(last, 16) + 1, size, rows)
    brackets = [_Bracket(t, low, high) for t in targets]
    while todo := [b for b in brackets if b.open(tolerance)]:
        n = max(1, min(PROBES, PROBES_IN_ALL // len(todo)))
        probes = sorted({b.low[0] + (b.high[0] - b.low[0]) * k // (n + 1) for b in todo for k in range(1, n + 1)} - {low[0]})
        if not probes:
            break
        bucket = _below([f"{p:0{_DIGITS}X}" for p in probes], F.col(KEY))
        found = {r[0]: r for r in keys.groupBy(bucket.alias("bucket")).agg(F.sum(SIZE), F.count("*")).collect()}
        known, size_below, rows_below = [low], 0, 0
        for k, p in enumerate(probes):
            _, s, r = found.get(k, (k, 0, 0))
            size_below, rows_below = size_below + s, rows_below + r
            known.append((p, size_below, rows_below))
        known.append(high)
        bytes_below = [x[1] for x in known]
        for b in todo:
            at = bisect_left(bytes_below, b.target)
            b.high = min(b.high, known[min(at, len(known) - 1)])
            b.low = max(b.low, known[max(0, at - 1)])
    return sorted(b.best() for b in brackets)


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """All columns of ``docs`` (ones named size, shard or slot are replaced) and size, shard, slot: the place in the shard, gapless from 0, in order of the id.

    Shards hold nearly equal bytes: each ends within the tolerance of its place or at the row boundary next to it. Rows that repeat, in
    any number, may be split between shards. A null id comes first; null and empty texts have size 1. Fewer rows than shards leave
    shards empty; an empty table gives an empty result. ``docs`` must give its rows in the same order when read again, as tables do.
    """
    docs = docs.select([c for c in docs.columns if c not in ("size", "shard", "slot")])
    rows = numbered(docs, PLACE).withColumns({KEY: order_key(id_col, text_col, PLACE), SIZE: sizes(text_col)}).drop(PLACE)
    keys = written(rows.select(KEY, SIZE), "shard-keys")
    total = keys.agg(F.sum(SIZE)).first()[0] or 0
    if not total:
        return docs.withColumns({"size": F.lit(1).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    each = max(1, min(-(-total // (n_shards * partition_bytes)), MOST_PARTITIONS // n_shards))
    parts = n_shards * each
    ends = splitters(keys, [total * k / parts for k in range(1, parts)], tolerance * total / parts)
    starts = [(0, 0, 0), *ends]
    skip = F.lit([starts[k][2] - starts[k - k % each][2] for k in range(parts)])
    placed = rows.withColumn(PART, _below([f"{e[0]:0{_DIGITS}X}" for e in ends], F.col(KEY)))
    within = F.row_number().over(Window.partitionBy(PART).orderBy(KEY))
    slot = (F.get(skip, F.col(PART)) + within - 1).cast("long")
    shard = F.floor(F.col(PART) / each).cast("int")
    exchanged = placed.repartition(max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), PART)
    return exchanged.select(*docs.columns, F.col(SIZE).alias("size"), shard.alias("shard"), slot.alias("slot"))
