"""Counts, summaries, charts and exports (A*, S7-S10). Null and empty keys are kept or dropped as each report says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions import dates
from trailmark.operators.search import between, ordered

UNKNOWN = "Unknown"


def named(col: str) -> Column:
    """Not null and not empty."""
    return F.coalesce(F.col(col) != "", F.lit(False))


def in_window(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return events.where(between("InsertedDate", start, end)) if start or end else events


def counts(events: DataFrame, key: Column, name: str, limit: int | None = None) -> DataFrame:
    """Rows of each key, most first, the key breaking ties."""
    out = events.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out if limit is None else out.limit(limit)


def unique_users(events: DataFrame, empty_counts: bool) -> DataFrame:
    """A2 (empty counts), A3 (it does not)."""
    user = F.col("User") if empty_counts else F.when(named("User"), F.col("User"))
    return events.agg(F.countDistinct(user).alias("unique_users"))


def type_counts(events: DataFrame) -> DataFrame:
    """A4: null is Unknown."""
    return counts(events, F.coalesce("EventType", F.lit(UNKNOWN)), "EventType")


def type_distribution(events: DataFrame) -> DataFrame:
    """A5: nulls dropped."""
    return counts(events.where("EventType IS NOT NULL"), F.col("EventType"), "EventType")


def top_users(events: DataFrame, n: int, empty_counts: bool) -> DataFrame:
    """A6 (empty counts), A7, A12 (it does not)."""
    return counts(events.where(F.col("User").isNotNull() if empty_counts else named("User")), F.col("User"), "User", n)


def activity_map(events: DataFrame, user: str | None = None, start: str | None = None) -> DataFrame:
    """One row with a map from event type to count."""
    events = events.where(F.col("User") == user) if user else events
    kinds = in_window(events, start, None).where("EventType IS NOT NULL").groupBy("EventType").agg(F.count("*").alias("n"))
    return kinds.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("EventType", "n")))).alias("activity"))


def action_name(col: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in schema.AUDIT_ACTION.items() for x in kv)), col), F.lit(UNKNOWN))


def daily_types(events: DataFrame) -> DataFrame:
    """A10"""
    kind = F.coalesce("EventType", F.lit(UNKNOWN)).alias("EventType")
    return events.where("InsertedDate IS NOT NULL").groupBy(F.to_date("InsertedDate").alias("day"), kind).agg(F.count("*").alias("n")).orderBy("day", "EventType")


def user_types(events: DataFrame, n: int = 20) -> DataFrame:
    """A11"""
    grouped = events.groupBy(F.coalesce("User", F.lit(UNKNOWN)).alias("User"), F.coalesce("EventType", F.lit(UNKNOWN)).alias("EventType")).agg(F.count("*").alias("n"))
    return grouped.orderBy(F.desc("n"), "User", "EventType").limit(n)


def chart(events: DataFrame, by: str, most: int | None = schema.CHART_MAX) -> DataFrame:
    """Label, n of each hour, day, week or month with rows; an unknown ``by`` is day. Only the newest ``most`` rows are counted; None counts all. truncated tells whether rows were left out."""
    at = events.where("InsertedDate IS NOT NULL").select("InsertedDate", "EventId")
    kept = at if most is None else ordered(at, "-InsertedDate", "-EventId").limit(most)
    d = F.col("InsertedDate")
    label = {
        "hour": dates.hour_label(d),
        "week": F.date_format(dates.week_start(F.year(d), dates.week_of_year(d)), "yyyy-MM-dd"),
        "month": dates.month_label(d),
    }.get(by, dates.day_label(d))
    grouped = kept.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min(d).alias("first")).orderBy("first")
    cut = F.lit(False) if most is None else at.agg(F.count("*")).scalar() > most
    return grouped.select("label", "n", cut.alias("truncated"))


def chart_from_daily(daily: DataFrame, by: str) -> DataFrame:
    """Day, week or month and type, summed from the daily counts."""
    d = F.col("day")
    period = {"week": dates.week_start(F.year(d), dates.week_of_year(d)), "month": F.trunc(d, "month")}.get(by, d)
    return daily.groupBy(period.alias("period"), "EventType").agg(F.sum("n").alias("n")).orderBy("period", "EventType")


def date_bounds(events: DataFrame) -> DataFrame:
    """A16"""
    return events.agg(F.min("InsertedDate").alias("oldest"), F.max("InsertedDate").alias("newest"), (F.count("InsertedDate") > 0).alias("has_value"))


def archive_stats(archives: DataFrame, now: str, hours: int) -> DataFrame:
    """Averages are cut to whole numbers."""
    done = F.col("Status") == 1
    due = done & (F.col("LastVerifiedAt").isNull() | (F.col("LastVerifiedAt") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")))
    only = lambda c: F.when(done, F.col(c))
    return archives.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("Status") == k).alias(name.lower()) for k, name in schema.ARCHIVE_STATUS.items()),
        F.coalesce(F.sum(only("EventCount")), F.lit(0)).cast("long").alias("events"),
        F.coalesce(F.sum(only("SizeBytes")), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.floor(F.avg(only("EventCount"))), F.lit(0)).cast("long").alias("avg_events"),
        F.coalesce(F.floor(F.avg(only("SizeBytes"))), F.lit(0)).cast("long").alias("avg_bytes"),
        F.min(only("DateRangeStart")).alias("earliest"),
        F.max(only("DateRangeEnd")).alias("latest"),
        F.count_if(due).alias("needing_verification"),
    )


def maintenance_stats(events: DataFrame, now: str) -> DataFrame:
    """A23 without the top types, in one pass; the week begins on Sunday. size_kb is A24: the row count times 2 KiB."""
    start = dates.period_starts(F.lit(now).cast("timestamp"))
    return events.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("InsertedDate") >= at).alias(name) for name, at in start.items()),
        F.min("InsertedDate").alias("oldest"),
        F.max("InsertedDate").alias("newest"),
        F.countDistinct(F.when(named("User"), F.col("User"))).alias("unique_users"),
        (F.count("*") * 2).alias("size_kb"),
    )


def compliance_statistics(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The list narrows the total only."""
    wanted = F.col("EventType").isin(kinds) if kinds else F.lit(True)
    part = lambda word: F.count_if(F.col("EventType").contains(word))
    return events.agg(F.count_if(wanted).alias("total"), part("User").alias("user_events"), part("Update").alias("data_updates"), part("Security").alias("security_events"), part("Delete").alias("deletions"))


def summary(events: DataFrame, start: str | None = None, end: str | None = None, top: int = 10, facade: bool = False) -> DataFrame:
    """A26, and A27 as ``facade``: one table of (section, key, n): total, unique users, event types, top users. Grouped once by type and user; every section is a sum over these groups."""
    groups = in_window(events, start, end).groupBy("EventType", "User").agg(F.count("*").alias("n"))
    kind = F.coalesce("EventType", F.lit(UNKNOWN)) if facade else F.col("EventType")
    users = groups.where(named("User") if facade else F.col("User").isNotNull())
    line = lambda df, section, key: df.select(F.lit(section).alias("section"), key.alias("key"), F.col("n").cast("long").alias("n"))
    none = F.lit(None).cast("string")
    by_user = users.groupBy("User").agg(F.sum("n").alias("n"))
    return (
        line(groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "total", none)
        .unionByName(line(by_user.agg(F.count("*").alias("n")), "unique_users", none))
        .unionByName(line(groups.where(kind.isNotNull()).groupBy(kind.alias("k")).agg(F.sum("n").alias("n")), "event_type", F.col("k")))
        .unionByName(line(by_user.orderBy(F.desc("n"), "User").limit(top), "top_user", F.col("User")))
    )


def dead_letter_stats(letters: DataFrame) -> DataFrame:
    """(section, key, n) totals, by type, by reason; size as 1 KiB a row, times as seconds rounded to the nearest (a half to the even one)."""
    pending = ~F.col("IsProcessed")
    seconds = lambda at: F.rint(F.unix_micros(at) / 1_000_000).cast("long")
    totals = letters.agg(
        F.count("*").alias("total"), F.count_if(pending & (F.col("RetryCount") == 0)).alias("pending"), F.count_if(pending & (F.col("RetryCount") > 0)).alias("failed"), (F.count("*") * 1024).alias("bytes"),
        seconds(F.min("FailedAt")).alias("oldest"), seconds(F.max("FailedAt")).alias("newest"),
    )
    wide = totals.select(F.explode(F.create_map(*(x for c in totals.columns for x in (F.lit(c), F.col(c).cast("long"))))).alias("key", "n")).select(F.lit("total").alias("section"), "key", "n")
    part = lambda c, name: letters.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")
    return wide.unionByName(part("EventType", "event_type")).unionByName(part("FailureReason", "reason"))


def queue_depth(box: DataFrame, now: str) -> DataFrame:
    """A29"""
    oldest = F.min(F.when(F.col("Status") == 0, F.col("CreatedAt")))
    age = F.greatest(F.lit(0), F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(oldest))
    return box.agg(F.count_if(F.col("Status") == 0).alias("pending"), F.count_if(F.col("Status") == 1).alias("in_flight"), F.coalesce(age, F.lit(0)).cast("long").alias("oldest_pending_s"))


def integrity_health(events: DataFrame, now: str, stale_minutes: int = 5, most_stale: int = 100) -> DataFrame:
    """A33"""
    stale = (F.col("IntegrityStatus") == 1) & (F.col("InsertedDate") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(stale_minutes)} MINUTES"))
    c = events.agg(F.count_if(F.col("IntegrityStatus") == 3).alias("failed"), F.count_if(F.col("IntegrityStatus") == 1).alias("pending"), F.count_if(stale).alias("stale"))
    return c.withColumn("health", F.when(F.col("failed") > 0, "Unhealthy").when(F.col("stale") > most_stale, "Degraded").otherwise("Healthy"))


def mapped_action(kind: Column) -> Column:
    """the last part of the type, in any case."""
    last = F.lower(F.element_at(F.split(F.coalesce(kind, F.lit("")), r"\."), -1))
    # Spellings of the six actions.
    spelled = {"Created": ("created", "insert"), "Updated": ("updated", "update", "modified"), "Deleted": ("deleted", "delete", "removed"), "Viewed": ("viewed", "read", "accessed"), "Exported": ("exported",), "Imported": ("imported",)}
    out = F.lit(UNKNOWN)
    for name, words in spelled.items():
        out = F.when(last.isin(*words), name).otherwise(out)
    return out


def grouped_trail(events: DataFrame) -> DataFrame:
    """The ids of a trail by action, newest first. A trail is one page at most."""
    by = events.groupBy(mapped_action(F.col("EventType")).alias("action")).agg(F.sort_array(F.collect_list("EventId"), asc=False).alias("ids"))
    return by.select("action", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


def pass_percentage(total: Column, failed: Column) -> Column:
    """Two digits, half to even."""
    share = (total - failed).cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)")
    return F.when(total == 0, 0.0).otherwise(F.bround(share, 2).cast("double"))


def csv_field(col: Column) -> Column:
    """null is empty; a leading formula sign gets an apostrophe; quoted where needed."""
    text = F.coalesce(col, F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike("[\",\\n']"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


CSV_COLUMNS = ("EventId", "InsertedDate", "EventType", "User", "EntityType", "EntityId", "Action", "IpAddress", "Duration")


def csv_lines(events: DataFrame, most: int = schema.EXPORT_MAX) -> DataFrame:
    """Line of each row, oldest first; total and whether rows were left out."""
    cell = lambda c: csv_field(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "InsertedDate" else F.col(c).cast("string"))
    lines = ordered(events, "InsertedDate", "EventId").limit(most).select(F.concat_ws(",", *(cell(c) for c in CSV_COLUMNS)).alias("line"))
    return lines.select("line", events.agg(F.count("*")).scalar().alias("total")).withColumn("truncated", F.col("total") > most)


def write_csv(events: DataFrame, path: str, most: int = schema.EXPORT_MAX) -> None:
    """S7 as files: the header is the first line of each."""
    csv_lines(events, most).select(F.col("line").alias(",".join(CSV_COLUMNS))).write.option("header", True).option("quote", "\u0000").mode("overwrite").csv(path)


def json_report(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The summary's figures as one JSON object."""
    one = in_window(events, start, end).agg(F.count("*").alias("totalEvents"), F.countDistinct("User").alias("uniqueUsers"), F.min("InsertedDate").alias("firstEvent"), F.max("InsertedDate").alias("lastEvent"))
    return one.select(F.to_json(F.struct("totalEvents", "uniqueUsers", F.date_format("firstEvent", "yyyy-MM-dd HH:mm:ss").alias("firstEvent"), F.date_format("lastEvent", "yyyy-MM-dd HH:mm:ss").alias("lastEvent"))).alias("json"))


def user_export(events: DataFrame, user_id: str, most: int = schema.SUBJECT_MAX) -> DataFrame:
    """The newest rows of a user, oldest first, as JSON."""
    mine = ordered(events.where(F.col("UserId") == user_id), "-InsertedDate", "-EventId").limit(most)
    fields = ("EventId", "EventType", "EntityType", "EntityId", "Action", "IpAddress")
    return ordered(mine, "InsertedDate", "EventId").select(F.to_json(F.struct(*fields, F.date_format("InsertedDate", "yyyy-MM-dd HH:mm:ss").alias("InsertedDate"))).alias("json"))


def governed_export(events: DataFrame, tenant: str, user_id: str, most: int = schema.SUBJECT_MAX) -> DataFrame:
    """Five columns; more than ``most`` rows are an error when the result is read."""
    mine = events.where((F.col("TenantId") == tenant) & (F.col("UserId") == user_id)).select("EventId", "EventType", "InsertedDate", "EntityType", "EntityId")
    over = mine.limit(most + 1).agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") <= most, F.lit(f"more than {most} rows")))
    return ordered(mine.where(over.scalar().isNull()), "InsertedDate", "EventId")
