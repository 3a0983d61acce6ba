"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector is in it when their inner product reaches a threshold. The directions are random product codes: the
space is rotated and halved, each half has a random codebook, and a direction is a pair of code vectors. So 2 x BOOK inner products
decode a vector to all of the BOOK x BOOK directions that it exceeds. Two vectors at cosine 0.93 share a filter with probability
0.999 under the parameters here, closer ones more surely (measured; see the README). What shares a filter is verified in double precision.
Where a label has so many vectors that a filter of random ones would hold more than BUCKET_ROWS, caps are narrower and directions more, so that a
vector's list stays as long and a filter as full, however many vectors there are.

Equal vectors are one class and travel once. A filter that holds more than BUCKET_ROWS classes is cut into chunks, and each pair of
chunks is a task's work of its own, so no filter, however full, is gathered whole. A pair is counted in the first filter that its two
lists share. A block gives a row per class, its links and the least class they lead to, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import order_id, plain_id, written
from .graph import connected_components

MIN_COSINE = 0.93
#: Number of product codes, code vectors of a half, threshold in standard deviations of an inner product with a random direction.
CODES, BOOK, TAU = 3, 256, 3.8
#: Filters are numbered in 32 bits.
MOST_BOOK = 26_000
#: A code's list has at least its best so many filters: vectors that lie badly to a code must meet their neighbours too.
LEAST_FILTERS = 8
#: A threshold above this would leave the caps of few dimensions empty.
MAX_THRESHOLD = 0.6
BUCKET_ROWS = 1024


def _cap(threshold: float, dim: int) -> float:
    """The share of random vectors of length one whose inner product with a direction reaches the threshold."""
    angles = np.linspace(0, np.pi / 2, 20_001)
    density = np.sin(angles) ** (dim - 2)
    return float(density[angles <= np.arccos(threshold)].sum() / density.sum() / 2)


@lru_cache(maxsize=16)
def filter_sizes(dim: int, vectors: int) -> tuple[int, float]:
    """(code vectors of a half, threshold) for that many vectors of a label. Few dimensions need few code vectors."""
    size, threshold = min(BOOK, 4 * dim), min(TAU / np.sqrt(dim), MAX_THRESHOLD)
    if dim < 3 or (wide := _cap(threshold, dim)) * vectors <= BUCKET_ROWS:
        return size, threshold
    low, high = threshold, MAX_THRESHOLD
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _cap(middle, dim) * vectors > BUCKET_ROWS else (low, middle)
    return min(MOST_BOOK, int(np.ceil(size * np.sqrt(wide / _cap(high, dim))))), high


@lru_cache(maxsize=4)
def _directions(dim: int, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rotation, codebook, codebook) of each code."""
    rng = np.random.default_rng(dim)
    half = (dim + 1) // 2
    codes = []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        books = [rng.standard_normal((size, n)) for n in (half, dim - half)]
        scale = np.sqrt([half / dim, 1 - half / dim])
        codes.append((rotation, *(s * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) for s, b in zip(scale, books, strict=True))))
    return codes


def exceeded(vector: np.ndarray, vectors: int = 0) -> np.ndarray:
    """The ids, ascending, of all filters that a vector of length one exceeds, and of the best LEAST_FILTERS of each code; vectors: how many a label has at most."""
    size, threshold = filter_sizes(vector.size, vectors)
    found = []
    for k, (rotation, left, right) in enumerate(_directions(vector.size, size)):
        x = rotation @ vector
        a, b = left @ x[: left.shape[1]], right @ x[left.shape[1] :]
        rows, cols = (np.argsort(-v, kind="stable")[:LEAST_FILTERS] for v in (a, b))
        top = np.sort((a[rows, None] + b[None, cols]).ravel())[-LEAST_FILTERS:][0]
        least = min(threshold, top)
        rows, cols = np.flatnonzero(a >= least - b.max()), np.flatnonzero(b >= least - a.max())
        i, j = np.nonzero(a[rows, None] + b[None, cols] >= least)
        found.append(k * size * size + rows[i] * size + cols[j])
    return np.sort(np.concatenate(found)).astype(np.int32)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _filters(vector: Column, vectors: int) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([exceeded(_unit(np.array(x.as_py(), np.float64)[None])[0], vectors) for x in batch], pa.list_(pa.int32()))

    return listed(vector)


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    number = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  false for NaN, which Spark orders above infinity
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class _Rows:
    """The rows of a batch as arrays: lists are flat, with the places where each begins; vectors have length one."""

    classes: np.ndarray
    members: np.ndarray
    chunk: np.ndarray
    filter: np.ndarray
    filters: np.ndarray
    filters_at: np.ndarray
    units: np.ndarray
    units_at: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            lists = batch.column(name)
            at = lists.offsets.to_numpy()
            return lists.flatten().to_numpy(zero_copy_only=False), at - at[0]

        (filters, filters_at), (values, at) = flat("filters"), flat("vector")
        values = values.astype(np.float64)
        values /= np.repeat(np.maximum.reduceat(np.abs(values), at[:-1]), np.diff(at))
        values /= np.repeat(np.sqrt(np.add.reduceat(values * values, at[:-1])), np.diff(at))
        return cls(*(batch.column(c).to_numpy() for c in ("class", "members", "chunk", "filter")), filters, filters_at, values, at)

    def linked(self, start: int, end: int, two_chunks: bool) -> list[tuple[int, int, int]]:
        """The rows of a block -> (class, links that this filter owns, least class they lead to)."""
        n = end - start
        unit = self.units[self.units_at[start] : self.units_at[end]].reshape(n, -1)
        a, b = np.nonzero(np.triu(unit @ unit.T >= MIN_COSINE, 1))
        if two_chunks:
            chunk = self.chunk[start:end]
            a, b = a[keep := chunk[a] != chunk[b]], b[keep]
        if not a.size:
            return []
        own, members, names = self.filter[start], self.members[start:end].tolist(), self.classes[start:end].tolist()
        lists: dict[int, set[int]] = {}
        links, root = [0] * n, list(range(n))

        def below(k: int) -> set[int]:
            if k not in lists:
                own_list = self.filters[self.filters_at[start + k] : self.filters_at[start + k + 1]]
                lists[k] = set(own_list[own_list < own].tolist())
            return lists[k]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if below(x).isdisjoint(below(y)):
                links[x] += members[y]
                links[y] += members[x]
                low, high = sorted((find(x), find(y)))
                root[high] = low
        return [(names[k], links[k], names[find(k)]) for k in range(n) if links[k]]


BLOCK = ("filter", "label", "dim", "first", "second")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. The last block of a batch may go on in the next and waits for it."""
    names = ("class", "links", "leads_to")

    def found(batch: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        rows, two = _Rows.of(batch), (batch.column("first").to_numpy() != batch.column("second").to_numpy()).tolist()
        out = [x for s, e in pairwise(starts) if e - s > 1 for x in rows.linked(s, e, two[s])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names)

    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in BLOCK:
            values = batch.column(c)
            change |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        held = batch.slice(starts[-1])
        if len(starts) > 1:
            yield found(batch.slice(0, starts[-1]), starts)
    if held is not None:
        yield found(held, [0, held.num_rows])


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """One row for each label and distinct usable vector: class (a number), oid (least order id), members, label, vector, dim, filters."""
    rows = vectors.where(F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    largest = rows.groupBy(F.col(label_col)).count().agg(F.max("count")).first()[0] or 0
    distinct = rows.groupBy(F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).agg(F.count("*").alias("members"), F.min(order_id(id_col)).alias("oid"))
    return written(distinct.select(F.monotonically_increasing_id().alias("class"), "*", F.size("vector").alias("dim"), _filters(F.col("vector"), largest).alias("filters")), "vector-classes")


def class_links(found: DataFrame) -> DataFrame:
    """(class, links, leads_to): partial sums of links to other classes' members, and edges that connect what links connect."""
    narrow = found.select("class", "label", "dim", F.explode("filters").alias("filter"))
    shared = narrow.groupBy("label", "dim", "filter").count().where("count > 1")
    placed = (
        narrow.join(shared.select("label", "dim", "filter", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("chunks")), ["label", "dim", "filter"])
        .withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("label", "dim", "filter", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "chunk", "class")
    )
    rows = placed.join(found.select("class", "members", "filters", "vector"), "class")
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_verified, "class long, links long, leads_to long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (least id that links lead to), kept.

    A vector whose label is null, or which is null, empty, zero or holds a null or non-finite component, links with nothing: n_links 0,
    component_id its own id. Vectors of different length do not link. Equal vectors link with each other. Rows with equal ids count as
    vectors of their own. A null id is a component_id only if its component has no other. An empty table gives an empty result; other
    columns are not looked at.
    """
    vectors = vectors.select(F.col(id_col), F.col(vector_col), F.col(label_col))
    found = classes(vectors, id_col, vector_col, label_col)
    links = written(class_links(found), "vector-links")
    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    linked = connected_components(links.select(F.col("class").alias("a"), F.col("leads_to").alias("b")))
    known = (
        found.select("class", "oid", "members", "label", "vector")
        .join(degree, "class", "left")
        .join(linked.select(F.col("node").alias("class"), "component"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = known.groupBy("component").agg(F.min("oid").alias("least"))
    known = known.join(least, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), "least")
    keyed = vectors.withColumn("usable", usable(F.col(vector_col)))
    same = (F.col("usable")) & (keyed[label_col] == known["label"]) & (keyed[vector_col] == known["vector"])
    component = F.when(F.col("least").isNull(), F.col(id_col)).otherwise(plain_id("least"))
    return keyed.join(known, same, "left").select(
        F.col(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col(id_col) == component, F.col(id_col).isNull() & component.isNull()).alias("kept"),
    )
