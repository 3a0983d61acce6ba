"""Archives as files (S5, S6, S14): staged, checked, committed by one rename; validated by the SHA-256 of the bytes that are stored; restored whole or not at all.

An archive (a month or day of events) is a folder of compressed JSON lines. Beside it lie its manifest (count, range, digest of its events) and the list of its files with
length and SHA-256, read from the stored bytes by Spark's ``binaryFile`` source. Nothing counts before ``committed.json`` names the staged folder.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.lifecycle import TIME_FORMAT, archive_manifest
from trailmark.sources.stored import Stored, publish, read_file

COMMITTED = "committed.json"
#: Rows of one file, so that none outgrows what ``binaryFile`` reads at once.
ROWS_A_FILE = 1_000_000


class ArchiveRefused(ValueError):
    """Events that fail their verification are not archived, and an archive whose stored rows differ from the events is not committed."""


def _name(at: Column, unit: str) -> Column:
    return F.date_format(at, unit)


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """archive, file, length, sha256 of the bytes, of each data file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").load(folder)
    return files.select(F.regexp_extract("path", r"/archive=([^/]+)/", 1).alias("archive"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def _stored_events(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.withColumn("archive", F.lit("")).schema).option("timestampFormat", TIME_FORMAT).json(f"{folder}/events")


def commit_archive(events: DataFrame, path: str, failed: DataFrame | None = None, unit: str = "yyyy-MM") -> DataFrame:
    """Archives all events that have a time; returns the manifest. ``failed`` (EventId) are those that fail F7: if one of them is among the events, the archive is refused."""
    spark = events.sparkSession
    kept = events.where("InsertedDate IS NOT NULL")
    if failed is not None and (n := kept.join(failed, "EventId", "left_semi").count()):
        raise ArchiveRefused(f"{n} events fail their verification")
    staged = f"staged-{uuid4().hex}"
    top = f"{path}/{staged}"
    rows = kept.withColumn("archive", _name(F.col("InsertedDate"), unit)).repartitionByRange("archive", "EventId")
    rows.write.partitionBy("archive").option("compression", "gzip").option("maxRecordsPerFile", ROWS_A_FILE).option("timestampFormat", TIME_FORMAT).json(f"{top}/events")
    archive_manifest(kept, unit).write.parquet(f"{top}/manifest")
    stored_files(spark, f"{top}/events").write.parquet(f"{top}/files")
    manifest, found = spark.read.parquet(f"{top}/manifest"), archive_manifest(_stored_events(spark, top, events), unit)
    if manifest.exceptAll(found).count() + found.exceptAll(manifest).count():
        raise ArchiveRefused("what was stored differs from the events")
    publish(spark, json.dumps({"folder": staged}), f"{path}/{COMMITTED}")
    return manifest


def committed_folder(spark: SparkSession, path: str) -> str:
    return f"{path}/{json.loads(read_file(spark, f'{path}/{COMMITTED}'))['folder']}"


def validate(spark: SparkSession, path: str) -> DataFrame:
    """Archive, status, reason: Corrupted if a file is missing or its bytes have another SHA-256, or if there is one more. Events are not parsed."""
    top = committed_folder(spark, path)
    listed = spark.read.parquet(f"{top}/files").select("archive", "file", F.col("sha256").alias("listed"))
    both = listed.join(stored_files(spark, f"{top}/events"), ["archive", "file"], "full")
    reason = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("sha256"), "hash")
    worst = both.groupBy("archive").agg(F.min(reason).alias("reason"))
    names = spark.read.parquet(f"{top}/manifest").select("archive")
    return names.join(worst, "archive", "left").select("archive", F.when(F.col("reason").isNull(), "Completed").otherwise("Corrupted").alias("status"), "reason")


def restore(spark: SparkSession, path: str, into: Stored, unit: str = "yyyy-MM") -> tuple[Stored, DataFrame]:
    """The events of all archives into a table; events that it has stay as they are. If one archive is Corrupted, or the events read are not those of the manifest, the table stays at its version."""
    verdict = validate(spark, path)
    if verdict.where("status <> 'Completed'").head(1):
        return into, verdict
    top = committed_folder(spark, path)
    events = _stored_events(spark, top, into.read([])).drop("archive")
    wrong = spark.read.parquet(f"{top}/manifest").join(archive_manifest(events, unit), ["archive", "event_count", "digest"], "left_anti")
    if wrong.head(1):
        return into, verdict.join(wrong.select("archive", F.lit(True).alias("differs")), "archive", "left").select("archive", F.when(F.col("differs"), "Corrupted").otherwise(F.col("status")).alias("status"), F.when(F.col("differs"), "events").otherwise(F.col("reason")).alias("reason"))
    missing = events.join(into.read(into.touched(events)).select(*into.keys), list(into.keys), "left_anti")
    return into.upsert(missing), verdict
