"""Tables of Parquet files that can be changed: only the parts that hold a changed row are written anew, and one rename publishes the change.

A part is a value of a SQL expression over a row: a hash bucket of the key where rows are changed by key, a month where they go by age. A manifest names
the folder and the number of rows of each part; the one of highest number is the table. A change writes new folders, checks the number of rows in them, and
then renames its manifest into place: readers see the table before or after it, and of two writers that started from one version the second fails. Folders of
older versions stay for those who still read them, until :meth:`Stored.vacuum`.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

PART = "part"
NO_PART = "none"


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path, and what makes paths for it."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def publish(spark: SparkSession, content: str, path: str) -> None:
    """Writes a small file by one rename. Raises if there is one of that name."""
    fs, make = file_system(spark, path)
    staged = make(f"{path}.{uuid4().hex}.staged")
    out = fs.create(staged, False)
    out.write(bytearray(content.encode()))
    out.close()
    if fs.exists(make(path)) or not fs.rename(staged, make(path)):
        fs.delete(staged, False)
        raise RuntimeError(f"{path} was published by another writer")


def read_file(spark: SparkSession, path: str) -> str:
    fs, make = file_system(spark, path)
    stream = fs.open(make(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def flip_last_byte(spark: SparkSession, path: str) -> None:
    """Damages a small file, for drills of validation and restore."""
    fs, make = file_system(spark, path)
    stream = fs.open(make(path))
    data = bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    data[-1] ^= 1
    out = fs.create(make(path), True)
    out.write(data)
    out.close()


def _part(expression: str) -> Column:
    return F.coalesce(F.expr(expression).cast("string"), F.lit(NO_PART)).alias(PART)


def _write(df: DataFrame, top: str, part: str, keys: tuple[str, ...]) -> dict[str, dict]:
    """Rows dealt by part and key (so that a large part takes many tasks) into a new folder: part -> folder and rows, as read back."""
    folder = f"data-{uuid4().hex}"
    df.withColumn(PART, _part(part)).repartitionByRange(PART, *keys).write.partitionBy(PART).parquet(f"{top}/{folder}")
    back = df.sparkSession.read.schema(StructType([*df.schema.fields]).add(PART, StringType())).parquet(f"{top}/{folder}")
    found = {r[PART]: {"folder": folder, "rows": r["count"]} for r in back.groupBy(PART).count().collect()}
    if odd := [v for v in found if not re.fullmatch(r"[\w.-]+", v)]:
        raise ValueError(f"not fit to name a part: {odd[:3]}")
    return found


@dataclass(frozen=True)
class Stored:
    """One version of a table."""

    spark: SparkSession
    path: str
    number: int
    schema: StructType
    part: str
    keys: tuple[str, ...]
    parts: dict[str, dict]

    @classmethod
    def create(cls, df: DataFrame, path: str, part: str, *keys: str) -> Stored:
        """A table of the rows of ``df``; ``part`` is a SQL expression with at most some thousand values, ``keys`` name a row."""
        return cls(df.sparkSession, path, -1, df.schema, part, keys, {})._next(_write(df, path, part, keys))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Stored:
        fs, make = file_system(spark, path)
        names = [s.getPath().getName() for s in fs.globStatus(make(f"{path}/manifest-*.json"))]
        m = json.loads(read_file(spark, f"{path}/{max(names)}"))
        return cls(spark, path, m["number"], StructType.fromJson(m["schema"]), m["part"], tuple(m["keys"]), m["parts"])

    def _next(self, parts: dict[str, dict]) -> Stored:
        after = Stored(self.spark, self.path, self.number + 1, self.schema, self.part, self.keys, parts)
        content = {"number": after.number, "schema": self.schema.jsonValue(), "part": self.part, "keys": self.keys, "parts": parts}
        publish(self.spark, json.dumps(content), f"{self.path}/manifest-{after.number:09d}.json")
        return after

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some parts: nothing of the others is looked at."""
        names = [p for p in (self.parts if parts is None else parts) if p in self.parts]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{self.parts[p]['folder']}/{PART}={p}" for p in names))

    def touched(self, rows: DataFrame) -> list[str]:
        """The parts of some rows of the table's columns."""
        return [r[PART] for r in rows.select(_part(self.part)).distinct().collect()]

    def rewrite(self, parts: list[str], rows: DataFrame, added: int) -> Stored:
        """The next version, in which ``rows`` are what these parts hold. They must be ``added`` more than before (fewer, if negative) and lie in these parts; else nothing is published."""
        new = _write(rows, self.path, self.part, self.keys)
        before, now = sum(self.parts[p]["rows"] for p in parts if p in self.parts), sum(v["rows"] for v in new.values())
        if now != before + added or not new.keys() <= set(parts):
            raise RuntimeError(f"{self.path}: {now} rows were written in place of {before}, {added} more were expected")
        return self._next({p: v for p, v in self.parts.items() if p not in set(parts)} | new)

    def _same_key(self, a: str, b: str) -> Column:
        return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys))

    def upsert(self, rows: DataFrame) -> Stored:
        """Rows (distinct keys, all columns) take the place of those of equal key, or are added. ``part`` must be a function of the key. No row: the same version."""
        parts = self.touched(rows)
        if not parts:
            return self
        old = self.read(parts).alias("old")
        rest = old.join(rows.select(*self.keys).alias("new"), self._same_key("old", "new"), "left_anti")
        known = rows.alias("new").join(old.select(*self.keys), self._same_key("new", "old"), "left_anti").count()
        return self.rewrite(parts, rest.unionByName(rows.select(self.schema.names)), known)

    def delete(self, gone: Column) -> tuple[Stored, int]:
        """Without the rows for which ``gone`` is true, and how many those were."""
        counts = self.read().where(gone).groupBy(_part(self.part)).count().collect()
        parts, n = [r[PART] for r in counts], sum(r["count"] for r in counts)
        return (self.rewrite(parts, self.read(parts).where(~F.coalesce(gone, F.lit(False))), -n), n) if n else (self, 0)

    def delete_keys(self, keys: DataFrame) -> tuple[Stored, int]:
        """Without the rows whose key ``keys`` holds, and how many those were."""
        doomed = self.read().alias("old").join(keys.select(*self.keys).alias("new"), self._same_key("old", "new"), "left_semi")
        counts = doomed.groupBy(_part(self.part)).count().collect()
        parts, n = [r[PART] for r in counts], sum(r["count"] for r in counts)
        kept = self.read(parts).alias("old").join(keys.select(*self.keys).alias("new"), self._same_key("old", "new"), "left_anti")
        return (self.rewrite(parts, kept, -n), n) if n else (self, 0)

    def vacuum(self) -> int:
        """Removes the folders and manifests that this version, the newest, does not name; returns how many folders. Call it when nobody reads older ones."""
        fs, make = file_system(self.spark, self.path)
        named = {v["folder"] for v in self.parts.values()}
        gone = [s.getPath() for s in fs.globStatus(make(f"{self.path}/data-*")) if s.getPath().getName() not in named]
        old = [s.getPath() for s in fs.globStatus(make(f"{self.path}/manifest-*.json")) if s.getPath().getName() < f"manifest-{self.number:09d}.json"]
        for p in [*old, *gone]:
            fs.delete(p, True)
        return len(gone)
