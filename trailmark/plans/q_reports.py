"""Queries of counts, summaries, charts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import dates
from trailmark.operators import reports as r
from trailmark.operators import search as s
from trailmark.sources import audit as a
from trailmark.sources.audit import BASE_SQL as B

QUERIES, ORACLE_SQL = {}, {}
TENANT, SUBJECT = a.GUID + "b00000000001", a.GUID + "a00000000007"
START, END = "2024-01-05", "2024-01-25"
W = f"InsertedDate BETWEEN '{START}' AND '{END}'"


def q(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[f"q_{name}"] = run
    if sql:
        ORACLE_SQL[f"q_{name}"] = B + sql


def e(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    q(name, lambda spark, d: run(a.audit_events(spark, d)), sql)


def text(df, *columns: str):  # noqa: ANN001, ANN201
    """Dates as text, which every reader of the results shows alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def window(x):  # noqa: ANN001, ANN201
    return r.in_window(x, START, END)


e("A1", lambda x: x.where("Duration > 50").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM E WHERE Duration > 50")
e("A2", lambda x: r.unique_users(window(x), True), f'SELECT count(DISTINCT "User") AS unique_users FROM E WHERE {W}')
e("A3", lambda x: r.unique_users(window(x), False), f"""SELECT count(DISTINCT "User") FILTER (WHERE "User" <> '') AS unique_users FROM E WHERE {W}""")
e("A4", r.type_counts, "SELECT coalesce(EventType, 'Unknown') AS EventType, count(*) AS n FROM E GROUP BY 1")
e("A5", r.type_distribution, "SELECT EventType, count(*) AS n FROM E WHERE EventType IS NOT NULL GROUP BY 1")
e("A6", lambda x: r.top_users(x, 10, True), 'SELECT "User", count(*) AS n FROM E WHERE "User" IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
e("A7", lambda x: r.top_users(x, 10, False), """SELECT "User", count(*) AS n FROM E WHERE "User" <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
e("A8", lambda x: r.activity_map(x, "user7@test.com", START).select(F.explode("activity").alias("EventType", "n")), f"""SELECT EventType, count(*) AS n FROM E WHERE "User" = 'user7@test.com' AND InsertedDate >= '{START}' AND EventType IS NOT NULL GROUP BY 1""")
NAMES = "['Created','Updated','Deleted','StatusChanged','Assigned','Unassigned','Commented','Attached','Unknown','Imported','Exported','Viewed']"
q("A9", lambda k, d: r.counts(a.audit_logs(k, d), r.action_name(F.col("Action")), "Action"), f"SELECT {NAMES}[Action] AS Action, count(*) AS n FROM L GROUP BY 1")
e("A10", lambda x: text(r.daily_types(window(x)), "day"), f"SELECT InsertedDate::DATE::VARCHAR AS day, coalesce(EventType, 'Unknown') AS EventType, count(*) AS n FROM E WHERE {W} GROUP BY 1, 2")
e("A11", r.user_types, """SELECT coalesce("User", 'Unknown') AS "User", coalesce(EventType, 'Unknown') AS EventType, count(*) AS n FROM E GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
e("A12", lambda x: r.top_users(window(x), 20, False), f"""SELECT "User", count(*) AS n FROM E WHERE "User" <> '' AND {W} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
e("A13", lambda x: r.counts(window(x).where(r.named("EventType")), F.col("EventType"), "EventType"), f"SELECT EventType, count(*) AS n FROM E WHERE EventType <> '' AND {W} GROUP BY 1")
WEEK = "CASE WHEN month({0}) = 12 AND weekofyear({0}) = 1 THEN 53 ELSE weekofyear({0}) END"
WEEK_START = "(date_trunc('week', make_date(year({0}), 1, 1))::DATE + 7 * ((" + WEEK + ") - 1)::INT)"
LABELS = {"hour": "strftime(InsertedDate, '%Y-%m-%d %H:00')", "day": "strftime(InsertedDate, '%Y-%m-%d')", "week": f"strftime({WEEK_START.format('InsertedDate')}, '%Y-%m-%d')", "month": "strftime(InsertedDate, '%b %Y')"}
for by, label in LABELS.items():
    e(f"A14_{by}", lambda x, by=by: r.chart(x, by), f"SELECT {label} AS label, count(*) AS n, (SELECT count(InsertedDate) > 100000 FROM E) AS truncated FROM (SELECT * FROM E WHERE InsertedDate IS NOT NULL ORDER BY InsertedDate DESC, EventId DESC LIMIT 100000) GROUP BY 1")
e("A14_cut", lambda x: r.chart(x, "something else", most=700), f"SELECT {LABELS['day']} AS label, count(*) AS n, true AS truncated FROM (SELECT * FROM E WHERE InsertedDate IS NOT NULL ORDER BY InsertedDate DESC, EventId DESC LIMIT 700) GROUP BY 1")
for by, period in {"day": "InsertedDate::DATE", "week": WEEK_START.format("InsertedDate"), "month": "date_trunc('month', InsertedDate)::DATE"}.items():
    e(f"A15_{by}", lambda x, by=by: text(r.chart_from_daily(r.daily_types(window(x)), by), "period"), f"SELECT ({period})::VARCHAR AS period, coalesce(EventType, 'Unknown') AS EventType, count(*) AS n FROM E WHERE {W} GROUP BY 1, 2")
e("A16", r.date_bounds, "SELECT min(InsertedDate) AS oldest, max(InsertedDate) AS newest, count(InsertedDate) > 0 AS has_value FROM E")
DUE = "Status = 1 AND (LastVerifiedAt IS NULL OR LastVerifiedAt < TIMESTAMP '1996-01-01' - INTERVAL 720 HOUR)"
q("A21", lambda k, d: r.archive_stats(a.archive_records(k, d), "1996-01-01", 720), f"""SELECT count(*) AS total, count_if(Status = 0) AS inprogress, count_if(Status = 1) AS completed, count_if(Status = 2) AS failed, count_if(Status = 3) AS corrupted,
  coalesce(sum(EventCount) FILTER (WHERE Status = 1), 0)::BIGINT AS events, coalesce(sum(SizeBytes) FILTER (WHERE Status = 1), 0)::BIGINT AS bytes, coalesce(floor(avg(EventCount) FILTER (WHERE Status = 1)), 0)::BIGINT AS avg_events,
  coalesce(floor(avg(SizeBytes) FILTER (WHERE Status = 1)), 0)::BIGINT AS avg_bytes, min(DateRangeStart) FILTER (WHERE Status = 1) AS earliest, max(DateRangeEnd) FILTER (WHERE Status = 1) AS latest, count_if({DUE}) AS needing_verification FROM AR""")
q("A22", lambda k, d: a.archive_records(k, d).where("Status = 1").agg(F.coalesce(F.sum("SizeBytes"), F.lit(0)).alias("bytes")), "SELECT coalesce(sum(SizeBytes), 0)::BIGINT AS bytes FROM AR WHERE Status = 1")
e("A23", lambda x: r.maintenance_stats(x, "2024-01-30 12:00:00"), """SELECT count(*) AS total, count_if(InsertedDate >= '2024-01-30') AS today, count_if(InsertedDate >= '2024-01-28') AS this_week, count_if(InsertedDate >= '2024-01-01') AS this_month,
  min(InsertedDate) AS oldest, max(InsertedDate) AS newest, count(DISTINCT "User") FILTER (WHERE "User" <> '') AS unique_users, count(*) * 2 AS size_kb FROM E""")
e("A23_types", lambda x: r.counts(x.where(r.named("EventType")), F.col("EventType"), "EventType", 10), "SELECT EventType, count(*) AS n FROM E WHERE EventType <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
e("A24", lambda x: x.agg((F.count("*") * 2048).alias("bytes")), "SELECT count(*) * 2048 AS bytes FROM E")
e("A25", lambda x: r.compliance_statistics(window(x), ["User.Login", "Data.Read"]), f"SELECT count_if(EventType IN ('User.Login', 'Data.Read')) AS total, count_if(contains(EventType, 'User')) AS user_events, count_if(contains(EventType, 'Update')) AS data_updates, count_if(contains(EventType, 'Security')) AS security_events, count_if(contains(EventType, 'Delete')) AS deletions FROM E WHERE {W}")


def _summary_sql(kind: str, user: str) -> str:
    return f""", X AS (SELECT * FROM E WHERE {W})
  SELECT 'total' AS section, NULL AS key, count(*) AS n FROM X UNION ALL SELECT 'unique_users', NULL, count(DISTINCT "User") FILTER (WHERE {user}) FROM X
  UNION ALL SELECT 'event_type', {kind}, count(*) FROM X WHERE {kind} IS NOT NULL GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'top_user', "User", count(*) FROM X WHERE {user} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""


e("A26", lambda x: r.summary(x, START, END), _summary_sql("EventType", '"User" IS NOT NULL'))
e("A27", lambda x: r.summary(x, START, END, facade=True), _summary_sql("coalesce(EventType, 'Unknown')", """"User" <> ''"""))
q("A28", lambda k, d: r.dead_letter_stats(a.dead_letters(k, d)), """, T AS (SELECT count(*) AS total, count_if(NOT IsProcessed AND RetryCount = 0) AS pending, count_if(NOT IsProcessed AND RetryCount > 0) AS failed, count(*) * 1024 AS bytes, epoch(min(FailedAt))::BIGINT AS oldest, epoch(max(FailedAt))::BIGINT AS newest FROM DL)
  SELECT 'total' AS section, key, n FROM (UNPIVOT T ON total, pending, failed, bytes, oldest, newest INTO NAME key VALUE n)
  UNION ALL SELECT 'event_type', EventType, count(*) FROM DL GROUP BY 2 UNION ALL SELECT 'reason', FailureReason, count(*) FROM DL GROUP BY 2""")
q("A29", lambda k, d: r.queue_depth(a.outbox(k, d), a.NOW), f"SELECT count_if(Status = 0) AS pending, count_if(Status = 1) AS in_flight, greatest(0, epoch(TIMESTAMP '{a.NOW}')::BIGINT - floor(epoch(min(CreatedAt) FILTER (WHERE Status = 0)))::BIGINT) AS oldest_pending_s FROM O")
e("A33", lambda x: r.integrity_health(x, a.NOW), f"""SELECT count_if(IntegrityStatus = 3) AS failed, count_if(IntegrityStatus = 1) AS pending, count_if(IntegrityStatus = 1 AND InsertedDate < TIMESTAMP '{a.NOW}' - INTERVAL 5 MINUTE) AS stale,
  CASE WHEN count_if(IntegrityStatus = 3) > 0 THEN 'Unhealthy' ELSE 'Healthy' END AS health FROM E""")
MAPPED = """CASE lower(list_last(string_split(coalesce(EventType, ''), '.'))) WHEN 'created' THEN 'Created' WHEN 'insert' THEN 'Created' WHEN 'updated' THEN 'Updated' WHEN 'update' THEN 'Updated' WHEN 'modified' THEN 'Updated'
  WHEN 'deleted' THEN 'Deleted' WHEN 'delete' THEN 'Deleted' WHEN 'removed' THEN 'Deleted' WHEN 'viewed' THEN 'Viewed' WHEN 'read' THEN 'Viewed' WHEN 'accessed' THEN 'Viewed' WHEN 'exported' THEN 'Exported' WHEN 'imported' THEN 'Imported' ELSE 'Unknown' END"""
e("A30", lambda x: r.grouped_trail(s.newest(x, *s.by(EntityType="Card"), limit=1000)), f"SELECT {MAPPED} AS action, count(*) AS n, string_agg(EventId, ',' ORDER BY EventId DESC) AS ids FROM (SELECT * FROM E WHERE EntityType = 'Card' ORDER BY InsertedDate DESC NULLS LAST, EventId DESC LIMIT 1000) GROUP BY 1")
e("A31", lambda x: x.groupBy("EntityType").agg(F.count("*").alias("total"), F.count_if(F.col("IntegrityStatus") == 3).alias("failed")).select("EntityType", r.pass_percentage(F.col("total"), F.col("failed")).alias("passed")), "SELECT EntityType, round_even((count(*) - count_if(IntegrityStatus = 3)) * 100.0 / count(*), 2)::DOUBLE AS passed FROM E GROUP BY 1")
e("F17", lambda x: x.select("EventId", r.mapped_action(F.col("EventType")).alias("action")), f"SELECT EventId, {MAPPED} AS action FROM E")
e("D1", lambda x: x.where("InsertedDate IS NOT NULL").select("EventId", dates.hour_label(F.col("InsertedDate")).alias("hour"), dates.day_label(F.col("InsertedDate")).alias("day")), f"SELECT EventId, {LABELS['hour']} AS hour, {LABELS['day']} AS day FROM E WHERE InsertedDate IS NOT NULL")
DAYS = "SELECT DISTINCT o_orderdate::DATE AS d FROM orders"
q("D3", lambda k, d: text(k.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", dates.week_of_year(F.col("d")).alias("week"), dates.week_start(F.year("d"), dates.week_of_year(F.col("d"))).alias("start"), dates.iso_week_start(F.col("d")).alias("iso_start"), dates.month_label(F.col("d")).alias("month")), "d", "start", "iso_start"),
  f"SELECT d::VARCHAR AS d, {WEEK.format('d')} AS week, {WEEK_START.format('d')}::VARCHAR AS start, date_trunc('week', d)::DATE::VARCHAR AS iso_start, strftime(d, '%b %Y') AS month FROM ({DAYS})")
q("D5", lambda k, d: text(k.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", *(v.cast("date").alias(n) for n, v in dates.period_starts(F.col("d").cast("timestamp")).items())), "d", "today", "this_week", "this_month"), f"SELECT d::VARCHAR AS d, d::VARCHAR AS today, (d - dayofweek(d)::INT)::DATE::VARCHAR AS this_week, date_trunc('month', d)::DATE::VARCHAR AS this_month FROM ({DAYS})")
e("D6", lambda x: x.agg(dates.age_days(F.lit(a.NOW).cast("timestamp"), F.min("InsertedDate")).alias("days")), f"SELECT floor(date_diff('second', min(InsertedDate), TIMESTAMP '{a.NOW}') / 86400)::BIGINT AS days FROM E")
e("D7", lambda x: x.where(F.col("InsertedDate") < dates.cutoff(a.NOW, 20)).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM E WHERE InsertedDate < TIMESTAMP '{a.NOW}' - INTERVAL 20 DAY")
q("F25", lambda k, d: k.read.parquet(f"{d}/events.parquet").select("event_id", dates.duration_ms(F.col("ts").cast("timestamp"), F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 MILLISECONDS") * (F.col("event_id") % 9 - 2))).alias("ms")), "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN greatest(0, 7 * (event_id % 9 - 2))::INT END AS ms FROM events")


def _cell(c: str) -> str:
    text = "coalesce(strftime(InsertedDate, '%Y-%m-%d %H:%M:%S'), '')" if c == "InsertedDate" else f"""coalesce("{c}"::VARCHAR, '')"""
    safe = f"CASE WHEN regexp_matches({text}, '^[=+\\-@\\t\\r]') THEN chr(39) || {text} ELSE {text} END"
    return f"""CASE WHEN regexp_matches({safe}, '[",\\n'']') THEN '"' || replace({safe}, '"', '""') || '"' ELSE {safe} END"""


e("S7", lambda x: r.csv_lines(x, 2000), f"SELECT concat_ws(',', {', '.join(_cell(c) for c in r.CSV_COLUMNS)}) AS line, (SELECT count(*) FROM E) AS total, (SELECT count(*) FROM E) > 2000 AS truncated FROM (SELECT * FROM E ORDER BY InsertedDate NULLS FIRST, EventId LIMIT 2000)")
q("F9", lambda k, d: k.read.parquet(f"{d}/customer.parquet").select("c_custkey", r.csv_field(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("=1,"), F.col("c_name"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('a "b" '), F.col("c_name")))).alias("field")),
  """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '"''=1,' || c_name || '"' WHEN 1 THEN '"a ""b"" ' || c_name || '"' ELSE '' END AS field FROM customer""")  # fmt: skip
e("S8", lambda x: r.json_report(x, START, END), f"""SELECT '{{"totalEvents":' || count(*) || ',"uniqueUsers":' || count(DISTINCT "User") || ',"firstEvent":"' || strftime(min(InsertedDate), '%Y-%m-%d %H:%M:%S') || '","lastEvent":"' || strftime(max(InsertedDate), '%Y-%m-%d %H:%M:%S') || '"}}' AS json FROM E WHERE {W}""")
_pair = lambda c: f"""CASE WHEN {c} IS NULL THEN NULL ELSE '"{c}":"' || {c} || '"' END"""
e("S9", lambda x: r.user_export(x, SUBJECT), "SELECT '{' || concat_ws(',', " + ", ".join(_pair(c) for c in ("EventId", "EventType", "EntityType", "EntityId", "Action", "IpAddress")) + f""", CASE WHEN InsertedDate IS NULL THEN NULL ELSE '"InsertedDate":"' || strftime(InsertedDate, '%Y-%m-%d %H:%M:%S') || '"' END) || '}}' AS json FROM E WHERE UserId = '{SUBJECT}'""")
e("S10", lambda x: r.governed_export(x, TENANT, SUBJECT), f"SELECT EventId, EventType, InsertedDate, EntityType, EntityId FROM E WHERE TenantId = '{TENANT}' AND UserId = '{SUBJECT}'")
