"""The audit tables as views of the event, order and part tables, with nulls, empty texts and ties put in on purpose.

Each view is stated once in Spark and once, for the oracle, in SQL (``BASE_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import canonical, text

#: Event types that the views deal out by event_id; they carry the words that compliance rules look for.
EVENT_TYPES = (
    "User.Login User.Logout User.LoginFailed Data.Update Data.Read Data.Export PHI.Access User.ConsentGranted Security.Alert Patient.RecordView "
    "Payment.CardCharge Admin.RoleChange Student.GradeUpdate Account.Registration Config.Setting Archive.Backup Password.Reset Session.Timeout "
    "Record.Delete Privacy.Erasure Disclosure.ThirdParty Directory.OptOut Deploy.Release Remote.VPN System.Health Audit.Review Incident.Response "
    "Banner.TermsAccepted Token.MFA Research.Study"
).split()
ACTIONS = "Created Updated Deleted Added Modified Viewed".split()
ENTITY_TYPES = "Incident Patient User Card Student".split()
NOW = "2024-01-31 00:00:00"
GUID = "00000000-0000-4000-8000-"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guid(n: Column, block: str = "") -> Column:
    return F.concat(F.lit(GUID + block), F.lpad(n.cast("string"), 12 - len(block), "0"))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.lit(values), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _json() -> Column:
    n, u = F.col("event_id"), F.col("user_id")
    return F.concat(F.lit('{"Action":"'), _pick(ACTIONS, n), F.lit('","UserName":"user'), u.cast("string"), F.lit('","k":'), F.regexp_extract("props", r"(\d+)", 1), F.lit("}"))


def _event_columns() -> list[Column]:
    n, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp")
    user = F.when(n % 17 == 0, None).when(n % 17 == 1, "").otherwise(F.concat(F.lit("user"), u.cast("string"), F.lit("@test.com")))
    kind = F.when(n % 19 == 0, None).when(n % 19 == 1, "").otherwise(_pick(EVENT_TYPES, n * 7 + u))
    ip = F.when(n % 13 == 0, None).when(n % 13 == 1, F.concat(F.lit("2001:db8:"), (n % 500).cast("string"), F.lit("::1"))).when(n % 13 == 2, "unknown").otherwise(F.concat_ws(".", F.lit("10"), (n % 200).cast("string"), (u % 250).cast("string"), F.lit("7")))
    return [
        n.alias("id"),
        guid(n).alias("EventId"),
        F.when(n % 97 == 0, None).otherwise(ts).alias("InsertedDate"),
        kind.alias("EventType"),
        user.alias("User"),
        guid(u, "a").alias("UserId"),
        F.concat(F.lit("asp-"), u.cast("string")).alias("AspNetUserId"),
        F.when(n % 11 == 0, None).otherwise(F.concat(F.lit("User "), u.cast("string"))).alias("UserFullName"),
        F.when(n % 23 == 0, "").otherwise(_pick(ENTITY_TYPES, u)).alias("EntityType"),
        F.concat(F.lit("subject-"), (n % 50).cast("string")).alias("EntityId"),
        F.when(n % 7 == 6, None).otherwise(_pick(ACTIONS, n)).alias("Action"),
        F.floor("value").cast("int").alias("Duration"),
        _json().alias("JsonData"),
        F.when(n % 29 == 0, None).otherwise(_pick(["Production", "Staging"], u)).alias("Environment"),
        F.when(n % 31 == 0, None).otherwise(F.concat(F.lit("host-"), (u % 9).cast("string"))).alias("MachineName"),
        F.when(n % 37 == 0, None).otherwise(F.lit("App.Core")).alias("AssemblyName"),
        F.when(n % 5 == 0, None).otherwise(F.concat(F.lit("corr-"), (n % 300).cast("string"))).alias("CorrelationId"),
        ip.alias("IpAddress"),
        F.concat(F.lit("agent/"), (u % 4).cast("string")).alias("UserAgent"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("RequestPath"),
        guid(u % 3, "b").alias("TenantId"),
        (n % 4 + 1).cast("int").alias("IntegrityStatus"),
    ]


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(*_event_columns())


def _linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where(F.col("event_id") % 41 != 40)


def _link_columns() -> list[Column]:
    n = F.col("event_id")
    digest = lambda x: F.base64(F.unhex(F.sha2(F.encode(F.concat(F.lit("event-"), x.cast("string")), "UTF-8"), 256)))
    rank = n - F.floor((n + 1) / 41)
    before = F.when(n % 41 == 0, n - 2).otherwise(n - 1)
    return [
        guid(n).alias("EventId"),
        digest(n).alias("EventHash"),
        F.when(n == 0, None).when(n == 777, "broken").otherwise(digest(before)).alias("PreviousEventHash"),
        F.when(n == 900, rank + 1_000_000).otherwise(rank + 1).cast("long").alias("SequenceNumber"),
        F.col("ts").cast("timestamp").alias("TrustedTimestamp"),
        (n % 3 + 1).cast("int").alias("AlgorithmVersion"),
    ]


def audit_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for each event but every 41st; one broken link, one changed hash and one missing number are put in."""
    return _linked_events(spark, sf_dir).select(*_link_columns())


#: Key of the test tables' links.
LINK_KEY = b"trailmark-test-key"


#: Neighbouring event ids of one group, within which a link finds the one before it.
NEIGHBOURS = 1 << 13


def sealed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links with hash, HMAC and checksum of their events. Links of events of duration 17 name another predecessor than they were sealed with; those of 13 carry another HMAC, those of 16 none.

    A link and its event are one row of the event table, and ids follow one another, so the only exchange is one of that table's own narrow rows, with their canonical JSON, by groups of ids; the
    last row of a group goes to the next one too. Hashes are made after it. Ids are unique.
    """
    n = F.col("event_id")
    group, after = F.floor(n / NEIGHBOURS), F.floor((n + F.when(n % 41 == 39, 2).otherwise(1)) / NEIGHBOURS)
    near = _linked_events(spark, sf_dir).withColumn("canonical", canonical.canonical_json(_json())).withColumn("group", F.explode(F.array_distinct(F.array(group, after)))).repartition("group")
    event = near.select("group", "event_id", "canonical", *(c.alias(f"_{k}") for k, c in enumerate(_link_columns()[1:])), *_event_columns())
    links = event.select(
        "group", "event_id", "EventId", "Duration", F.col("_1").alias("token"), F.col("_2").alias("SequenceNumber"), F.col("_3").alias("TrustedTimestamp"),
        text.event_hash(F.col("EventId"), F.col("EventType"), F.col("User"), F.col("InsertedDate"), F.col("canonical")).alias("EventHash"), text.checksum(F.col("EventId"), F.col("EventType"), F.col("UserId")).alias("Checksum"),
    )
    w = Window.partitionBy("group").orderBy("event_id")
    named = n - F.when(n % 41 == 0, 2).otherwise(1)
    follows = (F.lag("event_id").over(w) == named) & (F.col("token") != "broken")
    rows = links.withColumn("Previous", F.when(follows, F.lag("EventHash").over(w)).otherwise(F.col("token"))).where(F.col("group") == group)
    rows = rows.withColumn("hmac", text.chain_hmac(LINK_KEY, F.col("EventHash"), F.col("Previous"), F.col("SequenceNumber").cast("string"), text.iso_time(F.col("TrustedTimestamp"))))
    return rows.select(
        "EventId", "SequenceNumber", "TrustedTimestamp", "EventHash", "Checksum",
        F.when((F.col("Duration") == 17) & F.col("Previous").isNotNull(), "other").otherwise(F.col("Previous")).alias("PreviousEventHash"),
        F.when(F.col("Duration") == 13, F.base64(F.encode("EventId", "UTF-8"))).when(F.col("Duration") != 16, F.col("hmac")).alias("HmacSignature"),
    )


def tampered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after someone was at them, by duration: other JSON (11), broken JSON (12), another user id (14), white space that means nothing (15), gone (18)."""
    e, d = audit_events(spark, sf_dir), F.col("Duration")
    json = F.when(d == 11, F.replace("JsonData", F.lit('"k":'), F.lit('"k":9'))).when(d == 12, F.concat(F.lit("{"), "JsonData")).when(d == 15, F.replace("JsonData", F.lit(":"), F.lit(" : "))).otherwise(F.col("JsonData"))
    return e.where((d != 18) | d.isNull()).withColumns({"JsonData": json, "UserId": F.when(d == 14, guid(F.lit(0), "a")).otherwise(F.col("UserId"))})


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each event; the longer it took, the more often its link was tried."""
    return audit_events(spark, sf_dir).select("EventId", F.col("IntegrityStatus").alias("Status"), F.floor(F.col("Duration") / 15).cast("int").alias("AttemptCount"), F.col("InsertedDate").alias("CreatedAt"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _read(spark, sf_dir, "events").where("event_type = 'error'"), F.col("event_id")
    return e.select(
        guid(n, "c").alias("Id"),
        F.when(n % 3 == 0, None).otherwise(guid(n)).alias("RelatedAuditEventId"),
        _pick(["SuspiciousActivity", "FailedLogin", "TamperDetected", "RateLimitExceeded"], n).alias("EventType"),
        F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("int").alias("Severity"),
        F.concat(F.lit("alert "), n.cast("string")).alias("Message"),
        F.concat(F.lit('{"n":'), n.cast("string"), F.lit(',"pad":"'), F.repeat(F.lit("x"), (n % 5 * 1200).cast("int")), F.lit('"}')).alias("Details"),
        F.col("ts").cast("timestamp").alias("DetectedAt"),
        guid(F.col("user_id") % 3, "b").alias("TenantId"),
        guid(F.col("user_id"), "a").alias("SubjectUserId"),
    )


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    m = o.groupBy(F.date_trunc("month", "at").alias("month")).agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("z"), F.sum(F.floor("o_totalprice").cast("long")).alias("size"))
    k = (F.year("month") * 12 + F.month("month")).cast("int")
    return m.select(
        F.date_format("month", "'archive-'yyyy-MM").alias("ArchiveId"),
        F.when(k % 7 == 0, 0).when(k % 11 == 0, 2).when(k % 13 == 0, 3).otherwise(1).cast("int").alias("Status"),
        F.concat(F.lit("container-"), (k % 3).cast("string")).alias("ContainerName"),
        F.col("n").cast("int").alias("EventCount"),
        F.col("size").alias("SizeBytes"),
        F.col("a").alias("DateRangeStart"),
        F.col("z").alias("DateRangeEnd"),
        (F.col("z") + F.expr("INTERVAL 5 DAYS")).alias("CreatedAt"),
        F.when(k % 4 == 0, None).otherwise(F.col("z") + F.expr("INTERVAL 9 DAYS")).alias("LastVerifiedAt"),
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, u = _read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        guid(n, "d").alias("Id"),
        guid(F.floor(n / 3), "e").alias("EnvelopeId"),
        _pick(["Order", "Customer", "Part"], u).alias("EntityName"),
        guid(u % 40, "f").alias("EntityId"),
        (n % 12 + 1).cast("int").alias("Action"),
        F.when(n % 3 == 0, None).otherwise(F.concat(F.lit("Field"), (n % 3).cast("string"))).alias("PropertyName"),
        (n % 10).cast("string").alias("OldValue"),
        (n % 8).cast("string").alias("NewValue"),
        guid(u, "a").alias("CreatedById"),
        F.col("ts").cast("timestamp").alias("CreatedAt"),
    )


def subject_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, u = _read(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')"), F.col("event_id"), F.col("user_id")
    return e.select(guid(n, "d").alias("AuditLogId"), guid(u % 3, "b").alias("TenantId"), guid(u, "a").alias("SubjectId"), F.lit("owner").alias("Relationship"), F.col("ts").cast("timestamp").alias("OccurredAt"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th key occurs twice."""
    e, n, u = _read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    at = F.col("ts").cast("timestamp")
    return e.select(
        n.alias("Id"),
        F.concat(F.lit("key-"), F.when(n % 50 == 49, n - 1).otherwise(n).cast("string")).alias("IdempotencyKey"),
        (n % 4).cast("int").alias("Status"),
        (n % 6).cast("int").alias("AttemptCount"),
        at.alias("CreatedAt"),
        F.when(n % 3 == 0, None).otherwise(at + F.expr("INTERVAL 1 DAY") * (n % 40)).alias("NextRetryAt"),
        F.when(n % 4 == 1, at + F.expr("INTERVAL 1 DAY") * (n % 35)).alias("LeaseExpiresAt"),
        guid(u % 3, "b").alias("TenantId"),
        F.when(n % 9 == 0, None).otherwise(F.concat(F.lit("cycle-"), (n % 5).cast("string"))).alias("FailureCycleId"),
        F.when(n % 10 == 3, F.concat(F.lit("res-"), n.cast("string"))).alias("ResolutionId"),
        F.concat(F.lit("v"), (n % 20).cast("string")).alias("Content"),
    )


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _read(spark, sf_dir, "events").where("event_type = 'error'"), F.col("event_id")
    return e.select(
        guid(n, "9").alias("Id"),
        F.col("ts").cast("timestamp").alias("FailedAt"),
        _pick(["Timeout", "Conflict", "Storage"], n / 6).alias("FailureReason"),
        (n % 5).cast("int").alias("RetryCount"),
        (n % 7 == 0).alias("IsProcessed"),
        F.when(n % 7 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("ProcessedAt"),
        F.when(n % 30 == 0, "Audit.Projection").otherwise(_pick(EVENT_TYPES, n)).alias("EventType"),
    )


def retention_policies(spark: SparkSession) -> DataFrame:
    rows = [("User.*", 10, 5, True), ("*.Update", 5, 9, True), ("phi.access", 3, 7, True), ("Data.Read", 15, 1, True), ("*", 28, 0, True), ("Security.*", 2, 8, False)]
    return spark.createDataFrame(rows, "EventType string, RetentionDays int, Priority int, IsActive boolean")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _guid_sql(n: str, block: str = "") -> str:
    return f"('{GUID}{block}' || lpad(({n})::VARCHAR, {12 - len(block)}, '0'))"


def _pick_sql(values: list[str], n: str) -> str:
    return f"{_list(values)}[(({n}) % {len(values)} + {len(values)}) % {len(values)} + 1]"


BASE_SQL = f"""
WITH E AS (
  SELECT event_id AS id, {_guid_sql("event_id")} AS EventId, CASE WHEN event_id % 97 <> 0 THEN ts END AS InsertedDate,
    CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 19 = 1 THEN '' ELSE {_pick_sql(EVENT_TYPES, "event_id * 7 + user_id")} END AS EventType,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN '' ELSE 'user' || user_id || '@test.com' END AS "User",
    {_guid_sql("user_id", "a")} AS UserId, 'asp-' || user_id AS AspNetUserId, CASE WHEN event_id % 11 <> 0 THEN 'User ' || user_id END AS UserFullName,
    CASE WHEN event_id % 23 = 0 THEN '' ELSE {_pick_sql(ENTITY_TYPES, "user_id")} END AS EntityType, 'subject-' || (event_id % 50) AS EntityId,
    CASE WHEN event_id % 7 <> 6 THEN {_pick_sql(ACTIONS, "event_id")} END AS Action, floor(value)::INT AS Duration,
    '{{"Action":"' || {_pick_sql(ACTIONS, "event_id")} || '","UserName":"user' || user_id || '","k":' || regexp_extract(props, '(\\d+)', 1) || '}}' AS JsonData,
    CASE WHEN event_id % 29 <> 0 THEN {_pick_sql(["Production", "Staging"], "user_id")} END AS Environment,
    CASE WHEN event_id % 31 <> 0 THEN 'host-' || (user_id % 9) END AS MachineName, CASE WHEN event_id % 37 <> 0 THEN 'App.Core' END AS AssemblyName,
    CASE WHEN event_id % 5 <> 0 THEN 'corr-' || (event_id % 300) END AS CorrelationId,
    CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '2001:db8:' || (event_id % 500) || '::1' WHEN 2 THEN 'unknown' ELSE '10.' || (event_id % 200) || '.' || (user_id % 250) || '.7' END AS IpAddress,
    'agent/' || (user_id % 4) AS UserAgent, '/api/' || event_type AS RequestPath, {_guid_sql("user_id % 3", "b")} AS TenantId, (event_id % 4 + 1)::INT AS IntegrityStatus
  FROM events
),
I AS (
  SELECT {_guid_sql("event_id")} AS EventId, to_base64(unhex(sha256('event-' || event_id))) AS EventHash,
    CASE event_id WHEN 0 THEN NULL WHEN 777 THEN 'broken' ELSE to_base64(unhex(sha256('event-' || (CASE WHEN event_id % 41 = 0 THEN event_id - 2 ELSE event_id - 1 END)))) END AS PreviousEventHash,
    (event_id - (event_id + 1) // 41 + CASE event_id WHEN 900 THEN 1000000 ELSE 1 END)::BIGINT AS SequenceNumber, ts AS TrustedTimestamp, (event_id % 3 + 1)::INT AS AlgorithmVersion
  FROM events WHERE event_id % 41 <> 40
),
SE AS (
  SELECT {_guid_sql("event_id", "c")} AS Id, CASE WHEN event_id % 3 <> 0 THEN {_guid_sql("event_id")} END AS RelatedAuditEventId,
    {_pick_sql(["SuspiciousActivity", "FailedLogin", "TamperDetected", "RateLimitExceeded"], "event_id")} AS EventType, least(floor(value / 20), 4)::INT AS Severity,
    'alert ' || event_id AS Message, '{{"n":' || event_id || ',"pad":"' || repeat('x', (event_id % 5 * 1200)::INT) || '"}}' AS Details, ts AS DetectedAt,
    {_guid_sql("user_id % 3", "b")} AS TenantId, {_guid_sql("user_id", "a")} AS SubjectUserId
  FROM events WHERE event_type = 'error'
),
AR AS (
  SELECT strftime(month, 'archive-%Y-%m') AS ArchiveId,
    (CASE WHEN k % 7 = 0 THEN 0 WHEN k % 11 = 0 THEN 2 WHEN k % 13 = 0 THEN 3 ELSE 1 END)::INT AS Status, 'container-' || (k % 3) AS ContainerName, n::INT AS EventCount, size::BIGINT AS SizeBytes,
    a AS DateRangeStart, z AS DateRangeEnd, z + INTERVAL 5 DAY AS CreatedAt, CASE WHEN k % 4 <> 0 THEN z + INTERVAL 9 DAY END AS LastVerifiedAt
  FROM (SELECT date_trunc('month', o_orderdate) AS month, year(month) * 12 + month(month) AS k, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS z, sum(floor(o_totalprice)::BIGINT) AS size FROM orders GROUP BY 1)
),
L AS (
  SELECT {_guid_sql("event_id", "d")} AS Id, {_guid_sql("event_id // 3", "e")} AS EnvelopeId, {_pick_sql(["Order", "Customer", "Part"], "user_id")} AS EntityName, {_guid_sql("user_id % 40", "f")} AS EntityId,
    (event_id % 12 + 1)::INT AS Action, CASE WHEN event_id % 3 <> 0 THEN 'Field' || (event_id % 3) END AS PropertyName, (event_id % 10)::VARCHAR AS OldValue, (event_id % 8)::VARCHAR AS NewValue,
    {_guid_sql("user_id", "a")} AS CreatedById, ts AS CreatedAt
  FROM events
),
LK AS (
  SELECT {_guid_sql("event_id", "d")} AS AuditLogId, {_guid_sql("user_id % 3", "b")} AS TenantId, {_guid_sql("user_id", "a")} AS SubjectId, 'owner' AS Relationship, ts AS OccurredAt FROM events WHERE event_type IN ('purchase', 'signup')
),
O AS (
  SELECT event_id AS Id, 'key-' || (CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END) AS IdempotencyKey, (event_id % 4)::INT AS Status, (event_id % 6)::INT AS AttemptCount, ts AS CreatedAt,
    CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 1 DAY * (event_id % 40)::INT END AS NextRetryAt, CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL 1 DAY * (event_id % 35)::INT END AS LeaseExpiresAt,
    {_guid_sql("user_id % 3", "b")} AS TenantId, CASE WHEN event_id % 9 <> 0 THEN 'cycle-' || (event_id % 5) END AS FailureCycleId, CASE WHEN event_id % 10 = 3 THEN 'res-' || event_id END AS ResolutionId, 'v' || (event_id % 20) AS Content
  FROM events
),
DL AS (
  SELECT {_guid_sql("event_id", "9")} AS Id, ts AS FailedAt, {_pick_sql(["Timeout", "Conflict", "Storage"], "event_id // 6")} AS FailureReason, (event_id % 5)::INT AS RetryCount, event_id % 7 = 0 AS IsProcessed,
    CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 6 HOUR END AS ProcessedAt, CASE WHEN event_id % 30 = 0 THEN 'Audit.Projection' ELSE {_pick_sql(EVENT_TYPES, "event_id")} END AS EventType
  FROM events WHERE event_type = 'error'
),
RP AS (SELECT * FROM (VALUES ('User.*', 10, 5, true), ('*.Update', 5, 9, true), ('phi.access', 3, 7, true), ('Data.Read', 15, 1, true), ('*', 28, 0, true), ('Security.*', 2, 8, false)) v(EventType, RetentionDays, Priority, IsActive))
"""
