"""Queries of joins, the hash chain, and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import canonical as c
from trailmark.functions import crypto
from trailmark.functions import text as t
from trailmark.functions.event_json import read_event
from trailmark.operators import integrity as g
from trailmark.operators import search as s
from trailmark.sources import audit as a
from trailmark.sources.audit import BASE_SQL as B
from trailmark.sources.files import table_sizes

QUERIES, ORACLE_SQL = {}, {}


def q(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[f"q_{name}"] = run
    if sql:
        ORACLE_SQL[f"q_{name}"] = B + sql


def ei(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    q(name, lambda spark, d: run(a.audit_events(spark, d), a.audit_integrity(spark, d)), sql)


JOINED = "EventId, SequenceNumber, EventType, InsertedDate"
shown = lambda df: df.select(*JOINED.split(", "))
J = f"SELECT {JOINED} FROM I LEFT JOIN E USING (EventId)"
ei("J1", lambda e, i: shown(g.with_integrity(e.where("Duration > 40"), i)), f"SELECT {JOINED} FROM E LEFT JOIN I USING (EventId) WHERE Duration > 40")
ei("J2", lambda e, i: shown(g.with_events(i, e.where("InsertedDate IS NOT NULL"), "2024-01-05", "2024-01-20")), f"SELECT {JOINED} FROM I LEFT JOIN (SELECT * FROM E WHERE InsertedDate IS NOT NULL) USING (EventId) WHERE TrustedTimestamp BETWEEN '2024-01-05' AND '2024-01-20'")
ei("J3", lambda e, i: shown(g.with_events(s.page(i, 100, 300, "SequenceNumber"), e)), f"SELECT {JOINED} FROM (SELECT * FROM I ORDER BY SequenceNumber LIMIT 100 OFFSET 300) LEFT JOIN E USING (EventId)")
ei("J4", lambda e, i: shown(g.with_events(s.keyset_page(i, "SequenceNumber", 2000, 150), e)), f"SELECT {JOINED} FROM (SELECT * FROM I WHERE SequenceNumber > 2000 ORDER BY SequenceNumber LIMIT 150) LEFT JOIN E USING (EventId)")
q("J5", lambda k, d: g.with_related(a.security_events(k, d), a.audit_events(k, d)).select("Id", "RelatedAuditEventId", "RelatedType", "RelatedDate"), "SELECT SE.Id, RelatedAuditEventId, E.EventType AS RelatedType, InsertedDate AS RelatedDate FROM SE LEFT JOIN E ON RelatedAuditEventId = E.EventId")
ei("J6", lambda e, i: g.unprotected(e, i).select("EventId"), "SELECT EventId FROM E WHERE EventId NOT IN (SELECT EventId FROM I)")
ei("J7", lambda e, i: s.by_ids(e, i).select("EventId", "EventType"), "SELECT EventId, EventType FROM E SEMI JOIN I USING (EventId)")
q("J8", lambda k, d: a.outbox(k, d).join(a.outbox(k, d).where("Status = 2").select("IdempotencyKey"), "IdempotencyKey", "left_anti").select("Id", "IdempotencyKey"), "SELECT Id, IdempotencyKey FROM O WHERE IdempotencyKey NOT IN (SELECT IdempotencyKey FROM O WHERE Status = 2)")
q("J10", lambda k, d: s.policy_events(a.audit_events(k, d), a.retention_policies(k)), """SELECT RP.EventType AS policy, RP.Priority, count(E.EventId) AS n, min(InsertedDate) AS oldest FROM RP LEFT JOIN E ON RP.EventType = '*' OR lower(E.EventType) = lower(RP.EventType)
  OR (RP.EventType LIKE '%.*' AND starts_with(lower(E.EventType), lower(replace(RP.EventType, '*', '')))) OR (RP.EventType LIKE '*.%' AND ends_with(lower(E.EventType), lower(replace(RP.EventType, '*', '')))) GROUP BY ALL""")
ei("A17", g.coverage, "SELECT count(*) AS total, count(*) - count(I.EventId) AS unprotected FROM E LEFT JOIN I USING (EventId)")
SUMMARY = "count(SequenceNumber) AS n, count(DISTINCT SequenceNumber) AS n_distinct, min(SequenceNumber) AS first, max(SequenceNumber) AS last, coalesce(count(SequenceNumber) = count(DISTINCT SequenceNumber) AND max(SequenceNumber)::HUGEINT - min(SequenceNumber) + 1 = count(SequenceNumber), count(*) = 0) AS valid"
ei("A18", lambda e, i: g.sequence_summary(i), f"SELECT {SUMMARY} FROM I")
ei("A18_part", lambda e, i: g.sequence_summary(i.where("SequenceNumber BETWEEN 10 AND 800")), f"SELECT {SUMMARY} FROM I WHERE SequenceNumber BETWEEN 10 AND 800")
ei("A18_empty", lambda e, i: g.sequence_summary(i.where("SequenceNumber < 0")), f"SELECT {SUMMARY} FROM I WHERE SequenceNumber < 0")
ei("A19", lambda e, i: g.next_sequence(i), "SELECT coalesce(max(SequenceNumber), 0) + 1 AS next FROM I")
ei("A20", lambda e, i: i.where(s.between("TrustedTimestamp", "2024-01-05", "2024-01-20")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM I WHERE TrustedTimestamp BETWEEN '2024-01-05' AND '2024-01-20'")
LAG = ", X AS (SELECT *, lag(EventHash) OVER (ORDER BY SequenceNumber) AS prev_hash, lag(SequenceNumber) OVER (ORDER BY SequenceNumber) AS prev_number FROM I) "
ei("W1", lambda e, i: g.linkage(i), LAG + "SELECT EventId, SequenceNumber, prev_number IS NULL OR coalesce(PreviousEventHash = prev_hash AND SequenceNumber = prev_number + 1, false) AS linked FROM X")
ei("W1_join", lambda e, i: g.with_neighbour(i).where("NOT (PreviousEventHash <=> prev_hash)").select("EventId", "SequenceNumber"), "SELECT a.EventId, a.SequenceNumber FROM I a LEFT JOIN I b ON a.SequenceNumber = b.SequenceNumber + 1 WHERE a.PreviousEventHash IS DISTINCT FROM b.EventHash")
ei("W2", lambda e, i: g.boundary_check(i, 100, 850), """, Y AS (SELECT *, lag(EventHash) OVER (ORDER BY SequenceNumber) AS ph, lag(SequenceNumber) OVER (ORDER BY SequenceNumber) AS pn FROM I WHERE SequenceNumber BETWEEN 100 AND 850),
  Z AS (SELECT *, pn IS NULL OR coalesce(PreviousEventHash = ph AND SequenceNumber = pn + 1, false) AS linked FROM Y)
  SELECT count(*) = 0 AS is_empty, coalesce(count(*) > 0 AND min(SequenceNumber) = 100 AND max(SequenceNumber) = 850 AND count_if(NOT linked) = 0, false) AS valid, min(SequenceNumber) FILTER (WHERE NOT linked) AS first_failure FROM Z""")
FINDINGS = LAG + """SELECT EventId, SequenceNumber, 'ChainBroken' AS finding FROM X WHERE coalesce(PreviousEventHash <> prev_hash, false) OR (prev_number IS NOT NULL AND PreviousEventHash IS NULL)
  UNION ALL SELECT EventId, SequenceNumber, 'EventMissing' FROM X WHERE EventId NOT IN (SELECT EventId FROM E WHERE InsertedDate IS NOT NULL)"""
ei("W3", lambda e, i: g.chain_findings(i, e.where("InsertedDate IS NOT NULL")), FINDINGS)
ei("W3_report", lambda e, i: g.tamper_report(i, e), LAG + "SELECT 'ChainBroken' AS alert, 'Critical' AS severity, EventId FROM X WHERE coalesce(PreviousEventHash <> prev_hash, false) OR (prev_number IS NOT NULL AND PreviousEventHash IS NULL) UNION ALL SELECT 'SequenceGap', 'High', NULL")
ei("W4", lambda e, i: g.latest_link(i), "SELECT SequenceNumber, EventHash, EventId FROM I ORDER BY SequenceNumber DESC LIMIT 1")
ei("W5", lambda e, i: g.append_batch(i.select("EventId", "EventHash"), 5000, "last"), "SELECT EventId, EventHash, 5000 + row_number() OVER (ORDER BY EventId) AS SequenceNumber, coalesce(lag(EventHash) OVER (ORDER BY EventId), 'last') AS PreviousEventHash FROM I")
q("W6", lambda k, d: a.archive_records(k, d).agg(F.max_by("ArchiveId", F.struct("CreatedAt", "ArchiveId")).alias("ArchiveId")), "SELECT ArchiveId FROM AR ORDER BY CreatedAt DESC, ArchiveId DESC LIMIT 1")
q("W7", lambda k, d: g.first_per_key(a.subject_links(k, d), ["SubjectId", "Relationship"], "OccurredAt", "AuditLogId"), "SELECT * FROM LK QUALIFY row_number() OVER (PARTITION BY SubjectId, Relationship ORDER BY OccurredAt, AuditLogId) = 1")
q("T13", lambda k, d: g.reconciliation(a.work_items(k, d), a.audit_integrity(k, d), a.NOW), f"""SELECT EventId, CASE WHEN Duration >= 75 THEN 'Failed' WHEN I.EventId IS NULL THEN 'Created' ELSE 'Reconciled' END AS outcome, CASE WHEN Duration >= 75 THEN 'High' END AS alert FROM (SELECT * FROM E WHERE IntegrityStatus = 1 AND InsertedDate < TIMESTAMP '{a.NOW}' - INTERVAL 5 MINUTE ORDER BY InsertedDate, EventId LIMIT 100) LEFT JOIN I USING (EventId)""")
q("S11", lambda k, d: a.audit_integrity(k, d).where("SequenceNumber = 42").select(F.to_json(F.struct("EventId", "EventHash", "SequenceNumber")).alias("json")), """SELECT '{"EventId":"' || EventId || '","EventHash":"' || EventHash || '","SequenceNumber":' || SequenceNumber || '}' AS json FROM I WHERE SequenceNumber = 42""")

EVENT = ("EventId", "EventType", "User", "InsertedDate")
ISO = "coalesce(strftime(InsertedDate, '%Y-%m-%dT%H:%M:%S.%f') || '0Z', '')"
# the views' JSON is flat, so its canonical form can be put together in SQL
CANON = """('{"Action":"' || json_extract_string(JsonData, '$.Action') || '","UserName":"' || json_extract_string(JsonData, '$.UserName') || '","k":' || json_extract_string(JsonData, '$.k') || '}')"""
e = lambda name, run, sql=None: q(name, lambda k, d: run(a.audit_events(k, d)), sql)
e("F2", lambda x: x.select("EventId", c.canonical_json(F.concat(F.lit(' { "z" : 1.50 , "é":"a&b",'), F.substr("JsonData", F.lit(2)))).alias("canonical")), """SELECT EventId, '{"Action":"' || json_extract_string(JsonData, '$.Action') || '","UserName":"' || json_extract_string(JsonData, '$.UserName') || '","k":' || json_extract_string(JsonData, '$.k') || ',"z":1.5,"\\u00E9":"a\\u0026b"}' AS canonical FROM E""")
e("F3", lambda x: x.select("EventId", t.iso_time(F.col("InsertedDate")).alias("at")), f"SELECT EventId, {ISO} AS at FROM E")
e("F4", lambda x: x.select("EventId", t.event_hash(*EVENT, c.canonical_json("JsonData")).alias("hash")), f"""SELECT EventId, to_base64(unhex(sha256(EventId || '|' || coalesce(EventType, '') || '|' || coalesce("User", '') || '|' || {ISO} || '|' || {CANON}))) AS hash FROM E""")
e("F5", lambda x: x.select("EventId", t.checksum(F.col("EventId"), F.col("EventType"), F.col("UserId")).alias("checksum")), """SELECT EventId, to_base64(unhex(sha256(unhex(lpad(to_hex(strlen(EventId)), 8, '0')) || EventId::BLOB || unhex(lpad(to_hex(strlen(coalesce(EventType, ''))), 8, '0')) || coalesce(EventType, '')::BLOB || unhex(lpad(to_hex(strlen(UserId)), 8, '0')) || UserId::BLOB))) AS checksum FROM E""")
_part = lambda x: f"unhex(lpad(to_hex(strlen({x})), 8, '0')) || ({x})::BLOB"
_pad = lambda n: "unhex('" + bytes(x ^ n for x in b"key".ljust(64, b"\0")).hex() + "')"
CHAINED = " || ".join(map(_part, ("EventHash", "coalesce(PreviousEventHash, '')", "SequenceNumber::VARCHAR", "coalesce(strftime(TrustedTimestamp, '%Y-%m-%dT%H:%M:%S.%f') || '0Z', '')")))
q("F6", lambda k, d: a.audit_integrity(k, d).select("EventId", t.chain_hmac(b"key", F.col("EventHash"), F.col("PreviousEventHash"), F.col("SequenceNumber").cast("string"), t.iso_time(F.col("TrustedTimestamp"))).alias("hmac")),
  f"SELECT EventId, to_base64(unhex(sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || {CHAINED}))))) AS hmac FROM I")
q("F7", lambda k, d: g.verify_events(a.sealed_links(k, d), a.tampered_events(k, d), a.LINK_KEY).where("failed IS NOT NULL").select("EventId", "failed"),
  """SELECT EventId, CASE WHEN Duration IN (11, 12) THEN 'hash' WHEN Duration = 14 THEN 'checksum' ELSE 'hmac' END AS failed FROM I JOIN E USING (EventId) WHERE Duration IN (11, 12, 13) OR (Duration = 14 AND NOT ends_with(UserId, 'a00000000000')) OR (Duration = 17 AND PreviousEventHash IS NOT NULL)""")  # fmt: skip
q("W3_events", lambda k, d: g.verify_chain(a.sealed_links(k, d), a.tampered_events(k, d), a.LINK_KEY), """, S AS (SELECT I.EventId, SequenceNumber, EventHash, Duration, UserId, CASE WHEN Duration = 17 AND PreviousEventHash IS NOT NULL THEN 'other' ELSE PreviousEventHash END AS previous FROM I JOIN E USING (EventId)),
  X AS (SELECT *, lag(EventHash) OVER (ORDER BY SequenceNumber) AS hash_before, lag(SequenceNumber) OVER (ORDER BY SequenceNumber) AS number_before FROM S)
  SELECT EventId, SequenceNumber, 'ChainBroken' AS finding FROM X WHERE previous <> hash_before OR (number_before IS NOT NULL AND previous IS NULL)
  UNION ALL SELECT EventId, SequenceNumber, 'EventMissing' FROM X WHERE Duration = 18
  UNION ALL SELECT EventId, SequenceNumber, 'IntegrityFailed' FROM X WHERE Duration IN (11, 12, 13) OR (Duration = 14 AND NOT ends_with(UserId, 'a00000000000')) OR (Duration = 17 AND previous IS NOT NULL)""")
e("F8", lambda x: x.select("EventId", c.envelope_fingerprint(F.concat(F.lit('{"subjects":["b","a","b"],'), F.substr("JsonData", F.lit(2)))).alias("fingerprint")), """SELECT EventId, sha256('{"Action":"' || json_extract_string(JsonData, '$.Action') || '","UserName":"' || json_extract_string(JsonData, '$.UserName') || '","k":' || json_extract_string(JsonData, '$.k') || ',"subjects":["a","b"]}') AS fingerprint FROM E""")
e("F10", lambda x: x.select("EventId", t.anonymize_ip(F.col("IpAddress")).alias("ip")), """SELECT EventId, CASE WHEN IpAddress IS NULL OR IpAddress = '' THEN NULL WHEN len(string_split(IpAddress, '.')) = 4 THEN string_split(IpAddress, '.')[1] || '.' || string_split(IpAddress, '.')[2] || '.XXX.XXX'
  WHEN len(string_split(IpAddress, ':')) > 2 THEN string_split(IpAddress, ':')[1] || ':' || string_split(IpAddress, ':')[2] || ':XXXX:XXXX:XXXX' WHEN contains(IpAddress, ':') THEN 'XXXX:XXXX:XXXX:XXXX' ELSE 'ANONYMIZED' END AS ip FROM E""")
e("F11", lambda x: x.select("EventId", c.anonymize_json("JsonData", F.lit("user7")).alias("json")), """SELECT EventId, '{"Action":"' || json_extract_string(JsonData, '$.Action') || '","UserName":"ANONYMIZED","k":' || json_extract_string(JsonData, '$.k') || '}' AS json FROM E""")
# RE2 has no look-around: the numbers that a social security number may have are spelled out, and what stands around a phone number is kept
SAFE = "text"
for _pattern, _kept in (
    (r"""(?i)(server|data source|host|initial catalog|database|uid|pwd|password|user id|integrated security)\s*=\s*[^;"'\s]+""", "[SANITIZED]"),
    (r"(?i)(bearer|token|api[_-]?key|authorization)\s*[:=\s]\s*[^\s]+", "[SANITIZED]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[SANITIZED]"),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SANITIZED]"),
    (r"\b(00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])(0[1-9]|[1-9][0-9])(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b", "[SANITIZED]"),
    (r"\b(4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6011|65[0-9]{2})[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,4}\b", "[SANITIZED]"),
    (r"(^|[^0-9])(\+?1[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s]\s?[2-9][0-9]{2}[-.\s][0-9]{4}($|[^0-9])", r"\1[SANITIZED]\3"),
    (r"(?i)(key\s+value\s+is|values?\s*\()\s*\(?'?[^)]*'?\)", "[SANITIZED]"),
    (r"(?i)insert\s+into\s+[^\s]+\s*(\([^)]*\)\s*)?values\s*\([^)]*\)", "[SANITIZED]"),
    (r"(?i)(key|constraint|violation|duplicate|conflict)[^.]*\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[SANITIZED]"),
):
    SAFE = "regexp_replace(" + SAFE + ", '" + _pattern.replace("'", "''") + f"', '{_kept}', 'g')"
q("F13", lambda k, d: k.read.parquet(f"{d}/documents.parquet").select("doc_id", t.sanitize(F.col("text")).alias("text")), f"SELECT doc_id, CASE WHEN length(s) > 512 THEN left(s, 498) || '...[truncated]' ELSE s END AS text FROM (SELECT doc_id, {SAFE} AS s FROM documents)")
e("F14", lambda x: x.select("EventId", F.explode(t.redact_fields(F.create_map(F.lit("action"), F.col("Action"), F.lit("UserName"), F.col("User"), F.lit("Note"), F.lit("n"), F.lit("CorrelationId"), F.col("CorrelationId"), F.lit("machinename"), F.col("MachineName"), F.lit("EntityId"), F.col("EntityId")), ("note",)))), """SELECT EventId, unnest(['action', 'UserName', 'Note', 'CorrelationId', 'machinename', 'EntityId']) AS key, unnest([Action, CASE WHEN "User" IS NOT NULL THEN '[REDACTED]' END, 'n', CASE WHEN CorrelationId IS NOT NULL THEN '[REDACTED]' END, MachineName, '[REDACTED]']) AS value FROM E""")
e("F15", lambda x: x.select("EventId", t.redact_key(F.col("id")).alias("number"), t.redact_key(F.col("EventId"), guid=True).alias("guid"), t.redact_key(F.col("EventId")).alias("text"), t.redact_snapshot(F.col("Action")).alias("old"), F.array_join(t.redact_names(F.array(F.lit("Total"), F.lit("mrn"), F.lit("UserPassword"), F.lit("PatientId"), F.col("EntityType"))), ",").alias("names")),
  """SELECT EventId, id::VARCHAR AS number, EventId AS guid, '[REDACTED]' AS text, CASE WHEN Action IS NOT NULL THEN '{"_redacted":true}' END AS old, 'Total,[REDACTED_PROP],UserPassword,[REDACTED_PROP],' || EntityType AS names FROM E""")  # fmt: skip
q("F16", lambda k, d: k.read.parquet(f"{d}/documents.parquet").select("doc_id", t.truncate(F.col("text"), 100, "...").alias("text")), "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS text FROM documents")
e("F18", lambda x: x.select("EventId", t.read_event_json(F.when(F.col("id") % 100 == 9, "{bad").otherwise(F.when(F.col("id") % 2 == 0, F.replace("JsonData", F.lit("UserName"), F.lit("user_name"))).otherwise(F.col("JsonData")))).alias("j")).select("EventId", "j.action", "j.user_name", "j.k", "j.error"), """SELECT EventId, CASE WHEN id % 100 <> 9 THEN json_extract_string(JsonData, '$.Action') END AS action, CASE WHEN id % 100 <> 9 THEN json_extract_string(JsonData, '$.UserName') END AS user_name, CASE WHEN id % 100 <> 9 THEN json_extract_string(JsonData, '$.k')::BIGINT END AS k, CASE WHEN id % 100 = 9 THEN 'invalid JSON' END AS error FROM E""")


def _event_texts(x):  # noqa: ANN001, ANN202
    """JSON of events: names in the other spelling for cards, long durations as texts, broken where there is no machine."""
    name = lambda a, b: F.when(F.col("EntityType") == "Card", b).otherwise(a)
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    pair = lambda a, b, value: F.concat(F.lit('"'), name(a, b), F.lit('":'), value)
    duration = F.col("Duration").cast("string")
    environment = F.concat(F.lit("{"), pair("MachineName", "machine_name", quoted(F.col("MachineName"))), F.lit("}"))
    custom = F.concat(F.lit("{"), pair("EntityType", "entity_type", quoted(F.col("EntityType"))), F.lit(',"n":'), duration, F.lit("}"))
    parts = (pair("EventId", "event_id", quoted(F.col("EventId"))), pair("EventType", "event_type", quoted(F.col("EventType"))), pair("Duration", "duration", F.when(F.col("Duration") > 90, quoted(duration)).otherwise(duration)), pair("Environment", "environment", environment), pair("CustomFields", "custom_fields", custom))
    return F.concat(F.when(F.col("MachineName").isNull(), "{{").otherwise("{"), F.concat_ws(",", *parts), F.lit("}"))


e("F18_event", lambda x: x.select("EventId", read_event(_event_texts(x)).alias("e")).select("EventId", "e.event_id", "e.event_type", "e.duration", "e.error_message", F.col("e.environment.machine_name").alias("machine"), F.col("e.entity_changes.entity_type").alias("entity_type"), F.element_at("e.custom_fields", "n").alias("n")), """SELECT EventId, CASE WHEN MachineName IS NOT NULL THEN EventId END AS event_id, CASE WHEN MachineName IS NOT NULL THEN EventType END AS event_type,
  CASE WHEN MachineName IS NOT NULL AND Duration <= 90 THEN Duration END AS duration, CASE WHEN MachineName IS NULL THEN 'Failed to parse audit data: Malformed JSON' END AS error_message, MachineName AS machine, CASE WHEN MachineName IS NOT NULL THEN EntityType END AS entity_type, CASE WHEN MachineName IS NOT NULL THEN Duration::VARCHAR END AS n FROM E""")
q("F19", lambda k, d: a.security_events(k, d).select("Id", t.truncate(F.col("Message"), 10).alias("message"), t.guarded_details(F.col("Details")).alias("details")), """SELECT Id, left(Message, 10) AS message, CASE WHEN length(Details) > 4000 THEN '{"_truncated":true,"_originalLength":' || length(Details) || ',"_keyCount":2,"_keys":["n","pad"]}' ELSE Details END AS details FROM SE""")
e("F20", lambda x: x.select("EventId", t.masked(F.col("User"), F.col("id") % 4 == 0, F.col("id") % 4 == 1).alias("shown")), """SELECT EventId, CASE WHEN "User" IS NULL THEN NULL WHEN id % 4 = 0 THEN '[ENCRYPTED]' WHEN id % 4 = 1 THEN '***' ELSE "User" END AS shown FROM E""")
e("F21", lambda x: x.select("EventId", *(c.alias(n) for n, c in t.query_flags(F.replace("EventType", F.lit("."), F.lit("")), F.col("EventType"), F.col("RequestPath")).items())), """SELECT EventId, regexp_matches(lower(RequestPath), 'compliance|audit|regulatory|gdpr|hipaa|sox|iso') AS is_compliance,
  coalesce(lower(replace(EventType, '.', '')) IN ('useractivity', 'phiaccess', 'sensitivedata', 'securityincident'), false) AS requires_justification,
  coalesce(contains(lower(EventType), 'executive') OR contains(lower(EventType), 'security') OR contains(lower(EventType), 'breach') OR contains(lower(EventType), 'incident') OR contains(lower(EventType), 'violation'), false) AS is_sensitive FROM E""")
e("F22", lambda x: x.select("EventId", t.governance_name(F.when(F.col("id") % 3 > 0, F.concat(F.lit('{"identity":"g'), F.col("id").cast("string"), F.lit('"}')))).alias("identity")), "SELECT EventId, CASE WHEN id % 3 > 0 THEN 'g' || id END AS identity FROM E")
e("F24", lambda x: x.select("EventId", t.composite_key(F.col("id"), F.col("EntityId")).alias("key")), """SELECT EventId, '["' || id || '","' || EntityId || '"]' AS key FROM E""")
q("J9", lambda k, d: table_sizes(k, d))
KEYS = ("k1", b"0123456789abcdef0123456789abcdef", "k2", b"fedcba9876543210fedcba9876543210")


def _sealed(x):  # noqa: ANN001, ANN202
    """A field encrypted, encrypted anew with the next key, and read back; under the name of another field it does not open."""
    keys = F.create_map(*map(F.lit, KEYS))
    once = x.select("EventId", F.col("User").alias("plain"), crypto.encrypted(F.col("User"), "User", keys, "k1").alias("first"))
    twice = once.withColumn("second", crypto.rotated(F.col("first"), "User", keys, "k2"))
    return twice.select("EventId", crypto.decrypted(F.col("second"), "User", keys).alias("text"), crypto.is_encrypted(F.col("second")).alias("sealed"), (crypto.is_encrypted(F.col("first")) & (F.col("first") != F.col("second"))).alias("rotated"), crypto.decrypted(F.col("second"), "Other", keys).alias("misread"))


e("F23", _sealed, """SELECT EventId, "User" AS text, coalesce("User" <> '', false) AS sealed, CASE WHEN "User" IS NULL THEN false ELSE "User" <> '' END AS rotated, CASE WHEN "User" = '' THEN '' END AS misread FROM E""")
