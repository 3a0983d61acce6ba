"""Retention, purges, anonymisation, archives (C94-C96, F12, F26, S5, S6, S14). Functions give the rows that stay or go; those named apply_* delete or change them in a stored table, part by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions import canonical, text
from trailmark.functions.dates import cutoff
from trailmark.operators.search import match_policies, ordered
from trailmark.sources.stored import Stored
from trailmark.storage import written


def retention_plan(events: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """EventId and the policy that deletes it: of the active policies that match its type, the one of highest priority, if the event is older than it allows.

    Patterns are matched against the distinct types, not the events.
    """
    active = policies.where("IsActive").select(F.col("EventType").alias("policy"), "RetentionDays", "Priority")
    kinds = events.where("EventType IS NOT NULL").select("EventType").distinct()
    matched = match_policies(kinds, active)
    w = Window.partitionBy("EventType").orderBy(F.desc("Priority"), "policy")
    best = matched.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    old = F.col("InsertedDate") < F.lit(now).cast("timestamp") - F.make_interval(days=F.col("RetentionDays"))
    return events.join(best, "EventType").where(old).select("EventId", "policy")


def retention_summary(plan: DataFrame) -> DataFrame:
    """Rows deleted by policy."""
    return plan.groupBy("policy").agg(F.count("*").alias("deleted"))


def archive_scope(events: DataFrame, now: str, days: int, kinds: list[str] | None) -> DataFrame:
    """What is archived before deletion: every event before the cutoff (kinds None), or those of the matched types. The caller must choose."""
    old = events.where(F.col("InsertedDate") < cutoff(now, days))
    return old if kinds is None else old.where(F.col("EventType").isin(kinds))


def purge(events: DataFrame, now: str, days: int) -> DataFrame:
    """The rows that stay. A row without a time stays."""
    return events.where(F.col("InsertedDate").isNull() | (F.col("InsertedDate") >= cutoff(now, days)))


def purge_archives(archives: DataFrame, now: str, days: int) -> DataFrame:
    """The records that stay."""
    return archives.where((F.col("CreatedAt") >= cutoff(now, days)) | (F.col("Status") == 0))


def anonymize_user(events: DataFrame, user_id: str, most: int = schema.SUBJECT_MAX) -> DataFrame:
    """the user's newest events, anonymised. Their hashes change, so a later verification reports them: the ids tell which."""
    mine = ordered(events.where(F.col("UserId") == user_id), "-InsertedDate", "-EventId").limit(most)
    gone = F.lit(canonical.ANONYMIZED)
    return mine.withColumns({"User": gone, "UserFullName": gone, "UserAgent": gone, "IpAddress": text.anonymize_ip(F.col("IpAddress")), "JsonData": canonical.anonymize_json("JsonData", F.lit(user_id))})


#: The columns that a governed anonymisation clears.
CLEARED = ("UserId", "AspNetUserId", "UserFullName", "EntityType", "EntityId", "Action", "Duration", "JsonData", "Environment", "MachineName", "AssemblyName", "CorrelationId", "IpAddress", "UserAgent", "RequestPath")


def governed_anonymize(events: DataFrame, links: DataFrame, work_items: DataFrame, tenant: str, user_id: str) -> DataFrame:
    """refused, row by row, where a chain link or a work item exists; the rest is cleared."""
    mine = events.where((F.col("TenantId") == tenant) & (F.col("UserId") == user_id))
    free = mine.join(links.select("EventId"), "EventId", "left_anti").join(work_items.select("EventId"), "EventId", "left_anti")
    cleared = {c: F.lit(None).cast(free.schema[c].dataType) for c in CLEARED}
    return free.withColumns(cleared | {"User": F.lit(canonical.ANONYMIZED), "EventType": F.lit("Audit.Anonymized")})


def apply_retention(table: Stored, policies: DataFrame, now: str) -> tuple[Stored, dict[str, int]]:
    """Deletes what the policies doom from a stored table of events, and tells how many rows by policy. Only parts with such a row are written anew."""
    plan = written(retention_plan(table.read(), policies, now), "retention-plan")
    table, deleted = table.delete_keys(plan.select("EventId"))
    counts = {r.policy: r.deleted for r in retention_summary(plan).collect()}
    if sum(counts.values()) != deleted:
        raise RuntimeError(f"{deleted} rows were deleted, the plan has {sum(counts.values())}")
    return table, counts


def apply_purge(table: Stored, now: str, days: int) -> tuple[Stored, int]:
    """Deletes the events before the cutoff; with how many."""
    return table.delete(F.col("InsertedDate") < cutoff(now, days))


def apply_archive_purge(table: Stored, now: str, days: int) -> tuple[Stored, int]:
    """Deletes the archive records before the cutoff but those in progress; with how many."""
    return table.delete((F.col("CreatedAt") < cutoff(now, days)) & (F.col("Status") != 0))


def apply_anonymization(table: Stored, user_id: str, most: int = schema.SUBJECT_MAX) -> tuple[Stored, DataFrame]:
    """the user's newest events anonymised in the table; with the ids of those, whose hashes no longer hold."""
    rows = written(anonymize_user(table.read(), user_id, most), "anonymized")
    return table.upsert(rows), rows.select("EventId")


#: JSON times with all their digits.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def archive_manifest(events: DataFrame, unit: str = "yyyy-MM") -> DataFrame:
    """A record for each month, or other unit: count, range, and a digest that does not depend on the order of rows.

    The digest is SHA-256 over the sorted digests of buckets, each over its sorted rows' hashes: a month of any size is never one group.
    """
    line = F.concat_ws(":", "EventId", F.coalesce("EventType", F.lit("")), text.iso_time(F.col("InsertedDate")))
    rows = events.where("InsertedDate IS NOT NULL").select(F.date_format("InsertedDate", unit).alias("archive"), "InsertedDate", F.sha2(F.encode(line, "UTF-8"), 256).alias("h"))
    part = rows.groupBy("archive", F.substring("h", 1, 3).alias("bucket")).agg(F.count("*").alias("n"), F.min("InsertedDate").alias("a"), F.max("InsertedDate").alias("z"), F.sha2(F.encode(F.array_join(F.sort_array(F.collect_list("h")), "|"), "UTF-8"), 256).alias("h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "|")
    return part.groupBy("archive").agg(F.sum("n").alias("event_count"), F.min("a").alias("range_start"), F.max("z").alias("range_end"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("digest"))


def write_archive(events: DataFrame, path: str) -> DataFrame:
    """Compressed JSON lines by month below ``path``/events, the manifest beside them; returns the manifest as written."""
    kept = events.where("InsertedDate IS NOT NULL").withColumn("archive", _month(F.col("InsertedDate")))
    kept.write.mode("errorifexists").partitionBy("archive").option("compression", "gzip").option("timestampFormat", TIME_FORMAT).json(f"{path}/events")
    archive_manifest(events).write.mode("errorifexists").parquet(f"{path}/manifest")
    return events.sparkSession.read.parquet(f"{path}/manifest")


def restore_archive(spark, path: str, like: DataFrame) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(events, verdicts). Months whose digest differs from the manifest are Corrupted and not restored."""
    stored = spark.read.schema(like.withColumn("archive", F.lit("")).schema).option("timestampFormat", TIME_FORMAT).json(f"{path}/events")
    verdict = validate_archives(spark.read.parquet(f"{path}/manifest"), archive_manifest(stored))
    good = verdict.where("status = 'Completed'").select("archive")
    return stored.join(good, "archive", "left_semi").select(like.columns), verdict


def validate_archives(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Corrupted where an archive is missing or differs."""
    now = found.select("archive", F.col("digest").alias("found"))
    return expected.join(now, "archive", "left").select("archive", F.when(F.coalesce(F.col("digest") == F.col("found"), F.lit(False)), "Completed").otherwise("Corrupted").alias("status"))
