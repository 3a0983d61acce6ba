"""Queries of scans, filters, joins by id, paging and distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import search as s
from trailmark.sources import audit as a
from trailmark.sources.audit import BASE_SQL as B

QUERIES, ORACLE_SQL = {}, {}
U7 = "user7@test.com"
TENANT, SUBJECT = a.GUID + "b00000000001", a.GUID + "a00000000007"
SHOWN = ("EventId", "InsertedDate", "EventType", "User")
COLS = 'EventId, InsertedDate, EventType, "User"'
NEWEST = "ORDER BY InsertedDate DESC NULLS LAST, EventId DESC"


def q(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[f"q_{name}"] = run
    if sql:
        ORACLE_SQL[f"q_{name}"] = B + sql


def events(name: str, run, sql: str) -> None:  # noqa: ANN001
    q(name, lambda spark, d: run(a.audit_events(spark, d)).select(*SHOWN), sql)


def filtered(name: str, column: str, value: str, limit: int = 1000) -> None:
    events(name, lambda e: s.newest(e, *s.by(**{column: value}), limit=limit), f"SELECT {COLS} FROM E WHERE {column} = '{value}' {NEWEST} LIMIT {limit}")


events("S1", lambda e: e, f"SELECT {COLS} FROM E")
events("S2", lambda e: e.where(F.col("EventId") == a.GUID + "000000000123").limit(1), f"SELECT {COLS} FROM E WHERE EventId = '{a.GUID}000000000123'")
events("S3", lambda e: s.ordered(e.where("EventType = 'User.Login'"), "InsertedDate", "EventId"), f"SELECT {COLS} FROM E WHERE EventType = 'User.Login'")
q("S4", lambda k, d: s.ordered(s.by_ids(a.audit_integrity(k, d), a.audit_events(k, d).where("Duration > 40")), "SequenceNumber").select("EventId", "SequenceNumber"), "SELECT EventId, SequenceNumber FROM I WHERE EventId IN (SELECT EventId FROM E WHERE Duration > 40)")
for name, column, value in (
    ("P1", "EventType", "User.Login"), ("P2", "UserId", SUBJECT), ("P3", "AspNetUserId", "asp-7"), ("P6", "CorrelationId", "corr-17"), ("P7", "TenantId", TENANT), ("P8", "Action", "Updated"), ("P10", "Environment", "Staging"),
):
    filtered(name, column, value, 100)
events("P4", lambda e: s.newest(e, *s.by(EntityType="Patient", EntityId="subject-7")), f"SELECT {COLS} FROM E WHERE EntityType = 'Patient' AND EntityId = 'subject-7' {NEWEST} LIMIT 1000")
events("P5", lambda e: s.newest(e, s.between("InsertedDate", "2024-01-10", "2024-01-12"), limit=500), f"SELECT {COLS} FROM E WHERE InsertedDate BETWEEN '2024-01-10' AND '2024-01-12' {NEWEST} LIMIT 500")
events("P9", lambda e: s.slow_events(e, 90, 200), f"SELECT {COLS} FROM E WHERE Duration >= 90 ORDER BY Duration DESC, EventId DESC LIMIT 200")
events("P11", lambda e: s.tamper_scan(e, "2024-01-15"), f"SELECT {COLS} FROM E WHERE InsertedDate >= '2024-01-15' ORDER BY InsertedDate, EventId LIMIT 1000")
q("P12", lambda k, d: s.by_ids(a.audit_events(k, d), a.audit_integrity(k, d).where("AlgorithmVersion = 2")).select("EventId"), "SELECT EventId FROM E WHERE EventId IN (SELECT EventId FROM I WHERE AlgorithmVersion = 2)")
events("P13", lambda e: e.where(s.search_filter(user="User 7", start="2024-01-03", end="2024-01-28")), f"""SELECT {COLS} FROM E WHERE ("User" = 'User 7' OR UserFullName = 'User 7') AND InsertedDate BETWEEN '2024-01-03' AND '2024-01-28'""")


def _words(*terms: str) -> str:
    one = lambda t: " OR ".join(f"""coalesce(regexp_matches({'"User"' if c == "User" else c}, '{s.word_pattern(t)}'), false)""" for c in s.WORD_COLUMNS)
    return " AND ".join(f"({one(t)})" for t in terms)


events("P14", lambda e: e.where(s.word_search('updated "user 7"')), f"SELECT {COLS} FROM E WHERE {_words('updated', 'user 7')}")
events("F1", lambda e: e.where(s.word_search("login")), f"SELECT {COLS} FROM E WHERE {_words('login')}")
q("P15", lambda k, d: a.audit_events(k, d).select("EventId", s.terms_of(F.concat(F.lit('  "'), "UserFullName", F.lit('" OR '), F.coalesce("EventType", F.lit("a*")), F.when(F.col("EntityType") == "Card", '"').otherwise(""))).alias("t")).select("EventId", F.array_join("t", "|").alias("terms")), """SELECT EventId, CASE WHEN EntityType <> 'Card' AND EventType IS NOT NULL THEN UserFullName || '|OR' || CASE WHEN EventType <> '' THEN '|' || EventType ELSE '' END END AS terms FROM E""")
events("P16", lambda e: s.search(e, limit=0, offset=-3, event_type="Data.Export")[1], f"SELECT {COLS} FROM E WHERE EventType = 'Data.Export' {NEWEST} LIMIT 50")
q("P16_total", lambda k, d: s.page_info(s.search(a.audit_events(k, d), event_type="Data.Export")[0], 50, 100), "SELECT count(*) AS total, ceil(count(*) / 50)::BIGINT AS total_pages, 3::BIGINT AS current_page FROM E WHERE EventType = 'Data.Export'")
events("P17", lambda e: s.newest(e, *s.by(EntityType="Student"), limit=s.clamp(5000)), f"SELECT {COLS} FROM E WHERE EntityType = 'Student' {NEWEST} LIMIT 1000")
events("P18", lambda e: s.search(e, limit=40, user=U7)[1], f"""SELECT {COLS} FROM E WHERE "User" = '{U7}' OR UserFullName = '{U7}' {NEWEST} LIMIT 40""")
events("P19", lambda e: s.recent(e, a.NOW, 48), f"SELECT {COLS} FROM E WHERE InsertedDate >= TIMESTAMP '{a.NOW}' - INTERVAL 48 HOUR {NEWEST} LIMIT 1000")
events("P20", lambda e: s.newest(e, *s.by(UserId=SUBJECT), s.between("InsertedDate", "2024-01-08"), limit=s.clamp(20)), f"SELECT {COLS} FROM E WHERE UserId = '{SUBJECT}' AND InsertedDate >= '2024-01-08' {NEWEST} LIMIT 20")
events("P21", lambda e: s.newest(e, *s.by(EntityType="Card", EntityId="subject-3"), limit=s.clamp(0)), f"SELECT {COLS} FROM E WHERE EntityType = 'Card' AND EntityId = 'subject-3' {NEWEST} LIMIT 50")
q("P22", lambda k, d: s.ordered(a.audit_logs(k, d).where(s.by(EntityName="Order")[0] & (F.col("EntityId") == a.GUID + "f00000000009")), "-CreatedAt", "-Id"), f"SELECT * FROM L WHERE EntityName = 'Order' AND EntityId = '{a.GUID}f00000000009'")
q("P23", lambda k, d: s.ordered(a.audit_logs(k, d).where(F.col("CreatedById") == SUBJECT), "-CreatedAt", "-Id").limit(100), f"SELECT * FROM L WHERE CreatedById = '{SUBJECT}' ORDER BY CreatedAt DESC, Id DESC LIMIT 100")
q("P24", lambda k, d: s.ordered(a.security_events(k, d).where((F.col("Severity") >= 3) & (F.col("EventType") == "FailedLogin") & s.between("DetectedAt", "2024-01-05", "2024-01-25")), "-DetectedAt", "-Id").select("Id", "EventType", "Severity", "DetectedAt"), "SELECT Id, EventType, Severity, DetectedAt FROM SE WHERE Severity >= 3 AND EventType = 'FailedLogin' AND DetectedAt BETWEEN '2024-01-05' AND '2024-01-25'")
q("P25", lambda k, d: a.security_events(k, d).where((F.col("Severity") == 4) & s.between("DetectedAt", "2024-01-24")).select("Id", "DetectedAt"), f"SELECT Id, DetectedAt FROM SE WHERE Severity = 4 AND DetectedAt >= TIMESTAMP '{a.NOW}' - INTERVAL 168 HOUR")
q("P26", lambda k, d: s.ordered(a.audit_integrity(k, d).where((F.col("AlgorithmVersion") == 3) & F.col("SequenceNumber").between(100, 900)), "SequenceNumber"), "SELECT * FROM I WHERE AlgorithmVersion = 3 AND SequenceNumber BETWEEN 100 AND 900")
q("P27", lambda k, d: s.ordered(a.archive_records(k, d).where((F.col("Status") == 1) & (F.col("ContainerName") == "container-1")), "-CreatedAt"), "SELECT * FROM AR WHERE Status = 1 AND ContainerName = 'container-1'")
q("P28", lambda k, d: s.overlapping_archives(a.archive_records(k, d), "1995-02-10", "1996-08-20"), "SELECT * FROM AR WHERE Status = 1 AND DateRangeStart <= '1996-08-20' AND DateRangeEnd >= '1995-02-10'")
q("P29", lambda k, d: s.archives_to_verify(a.archive_records(k, d), "1996-01-01", 24 * 365), "SELECT * FROM AR WHERE Status = 1 AND (LastVerifiedAt IS NULL OR LastVerifiedAt < TIMESTAMP '1996-01-01' - INTERVAL 8760 HOUR)")
events("P30", lambda e: e.where((F.col("EventType") == "Data.Read") & (F.col("InsertedDate") < "2024-01-11")), f"SELECT {COLS} FROM E WHERE EventType = 'Data.Read' AND InsertedDate < '2024-01-11'")
q("P32", lambda k, d: a.audit_events(k, d).where("EventType IS NOT NULL").select(F.col("EventType").alias("kind")).distinct().transform(s.match_policies, a.retention_policies(k), "kind", "EventType").select("kind", F.col("EventType").alias("policy")),
  """SELECT kind, RP.EventType AS policy FROM (SELECT DISTINCT EventType AS kind FROM E WHERE EventType IS NOT NULL) JOIN RP ON lower(RP.EventType) = lower(kind) OR RP.EventType = '*'
  OR (RP.EventType LIKE '%.*' AND starts_with(lower(kind), left(lower(RP.EventType), length(RP.EventType) - 1))) OR (RP.EventType LIKE '*.%' AND suffix(lower(kind), lower(RP.EventType)[2:]))""")  # fmt: skip
q("P33", lambda k, d: s.exists(a.audit_events(k, d), F.col("Duration") > 99), "SELECT count(*) > 0 AS found FROM E WHERE Duration > 99")
q("P34", lambda k, d: s.log_view(a.audit_events(k, d)), """SELECT EventId, coalesce(EventType, 'Unknown') AS EventType, coalesce("User", 'Unknown') AS "User", coalesce(EntityType, 'Unknown') AS EntityName, UserId, InsertedDate FROM E""")
q("P35", lambda k, d: s.ordered(a.dead_letters(k, d).where(~F.col("IsProcessed") & s.between("FailedAt", "2024-01-05", "2024-01-20")), "-FailedAt", "-Id").limit(300), "SELECT * FROM DL WHERE NOT IsProcessed AND FailedAt BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY FailedAt DESC, Id DESC LIMIT 300")
q("P36", lambda k, d: s.retry_candidates(a.dead_letters(k, d), 500, 3), "SELECT * FROM (SELECT * FROM DL ORDER BY FailedAt DESC, Id DESC LIMIT 500) WHERE NOT IsProcessed AND RetryCount < 3 AND EventType <> 'Audit.Projection'")
events("L1", lambda e: s.page(e, 50, 200, "EventId"), f"SELECT {COLS} FROM E ORDER BY EventId LIMIT 50 OFFSET 200")
events("L2", lambda e: s.key_first_page(e, 50, 200), f"SELECT {COLS} FROM E {NEWEST} LIMIT 50 OFFSET 200")
q("L3", lambda k, d: s.keyset_page(a.audit_integrity(k, d), "SequenceNumber", 500, 100), "SELECT * FROM I WHERE SequenceNumber > 500 ORDER BY SequenceNumber LIMIT 100")
q("L4", lambda k, d: s.cursor_page(s.subject_records(a.audit_events(k, d), a.audit_logs(k, d), a.subject_links(k, d), a.security_events(k, d), TENANT, SUBJECT), ("2024-01-05 00:00:00", 2, ""), 10),
  f""", R AS (SELECT InsertedDate AS at, 1 AS store, EventId AS record FROM E WHERE TenantId = '{TENANT}' AND UserId = '{SUBJECT}' AND InsertedDate IS NOT NULL
  UNION ALL SELECT DISTINCT OccurredAt, 2, AuditLogId FROM LK WHERE TenantId = '{TENANT}' AND SubjectId = '{SUBJECT}'
  UNION ALL SELECT DetectedAt, 3, Id FROM SE WHERE TenantId = '{TENANT}' AND SubjectUserId = '{SUBJECT}'),
  P AS (SELECT * FROM R WHERE ("at", store, record) > (TIMESTAMP '2024-01-05', 2, '') ORDER BY "at", store, record LIMIT 11)
  SELECT *, (SELECT count(*) > 10 FROM P) AS has_more FROM P ORDER BY "at", store, record LIMIT 10""")  # fmt: skip
events("L6", lambda e: s.newest(e, limit=10), f"SELECT {COLS} FROM E {NEWEST} LIMIT 10")
q("L7", lambda k, d: a.audit_events(k, d).select("EventId", s.clamped(F.when(F.col("Environment").isNotNull(), (F.col("Duration") - 20) * 20)).cast("int").alias("size")), "SELECT EventId, (CASE WHEN Environment IS NULL OR Duration <= 20 THEN 50 ELSE least((Duration - 20) * 20, 1000) END)::INT AS size FROM E")
events("L8", lambda e: s.page(e, 25, 25, "-Duration", "EventId"), f"SELECT {COLS} FROM E ORDER BY Duration DESC, EventId LIMIT 25 OFFSET 25")
events("L9", lambda e: s.page(e, 100, 300, "-InsertedDate", "-EventId"), f"SELECT {COLS} FROM E {NEWEST} LIMIT 100 OFFSET 300")
q("L10", lambda k, d: s.page(a.archive_records(k, d).where("Status = 1"), 10, 5, "-CreatedAt", "ArchiveId"), "SELECT * FROM AR WHERE Status = 1 ORDER BY CreatedAt DESC, ArchiveId LIMIT 10 OFFSET 5")
q("S15", lambda k, d: s.ordered(a.archive_records(k, d), "-CreatedAt", "ArchiveId").select("ArchiveId", "Status", "EventCount", "SizeBytes", "CreatedAt"), "SELECT ArchiveId, Status, EventCount, SizeBytes, CreatedAt FROM AR")
q("U1", lambda k, d: s.subject_records(a.audit_events(k, d), a.audit_logs(k, d), a.subject_links(k, d), a.security_events(k, d), TENANT, SUBJECT), f"""SELECT InsertedDate AS at, 1 AS store, EventId AS record FROM E WHERE TenantId = '{TENANT}' AND UserId = '{SUBJECT}' AND InsertedDate IS NOT NULL
  UNION ALL SELECT DISTINCT OccurredAt, 2, AuditLogId FROM LK WHERE TenantId = '{TENANT}' AND SubjectId = '{SUBJECT}' UNION ALL SELECT DetectedAt, 3, Id FROM SE WHERE TenantId = '{TENANT}' AND SubjectUserId = '{SUBJECT}'""")
q("U2", lambda k, d: s.distinct_values(a.audit_events(k, d), "User"), """SELECT DISTINCT "User" FROM E WHERE "User" <> '' ORDER BY 1 LIMIT 500""")
q("U3", lambda k, d: s.distinct_values(a.audit_events(k, d), "EventType", keep_empty=True, limit=None), "SELECT DISTINCT EventType FROM E WHERE EventType IS NOT NULL")
q("U4", lambda k, d: s.distinct_values(a.audit_events(k, d), "EntityType"), "SELECT DISTINCT EntityType FROM E WHERE EntityType <> '' ORDER BY 1 LIMIT 500")
q("U5", lambda k, d: s.distinct_values(a.audit_events(k, d), "EventType", limit=None), "SELECT DISTINCT EventType FROM E WHERE EventType <> ''")
q("U6", lambda k, d: a.subject_links(k, d).select("AuditLogId", "OccurredAt").distinct(), "SELECT DISTINCT AuditLogId, OccurredAt FROM LK")
q("U8", lambda k, d: a.audit_events(k, d).join(a.audit_integrity(k, d), "EventId", "left_anti").select("EventId"), "SELECT EventId FROM E EXCEPT SELECT EventId FROM I")
