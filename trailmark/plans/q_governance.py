"""Queries of compliance rules, retention, anonymisation, archives and change capture."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from trailmark.operators import capture as cap
from trailmark.operators import compliance as co
from trailmark.operators import lifecycle as lc
from trailmark.operators.rules import CHANGES, EVENT_GROUPS, RULES
from trailmark.sources import audit as a
from trailmark.sources.audit import BASE_SQL as B
from trailmark.storage import shared_dir

QUERIES, ORACLE_SQL = {}, {}
START, END = "2024-01-20", "2024-01-26"
CONFIG = {"entities": True, "properties": False}
TENANT, SUBJECT = a.GUID + "b00000000001", a.GUID + "a00000000007"


def q(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[f"q_{name}"] = run
    if sql:
        ORACLE_SQL[f"q_{name}"] = B + sql


def window(k, d):  # noqa: ANN001, ANN201
    return a.audit_events(k, d).where(F.col("InsertedDate").between(START, END))


def results(k, d):  # noqa: ANN001, ANN201
    return co.evaluate(window(k, d), a.audit_integrity(k, d), a.NOW, config=CONFIG)


# The same rules for the oracle: a term is a count over the sample X or a figure of the window C.
def _has(column: str, words: str) -> str:
    return "(" + " OR ".join(f"""coalesce(contains(lower({column}), '{w.lower()}'), false)""" for w in words.split(",")) + ")"


def _one_of(words: str) -> str:
    return "coalesce(Action IN (" + ", ".join(f"'{w}'" for w in words.split(",")) + "), false)"


def _blank(column: str) -> str:
    return f"coalesce(trim({column}), '') = ''"


def _group(name: str) -> str:
    return _has("EventType", ",".join(EVENT_GROUPS[name])) + (f" OR {_one_of(','.join(CHANGES))}" if name == "object" else "")


def _term(t: str) -> str:
    kind, _, words = t.partition(":")
    some = lambda c: f"(SELECT count_if({c}) > 0 FROM X)"
    none = lambda c: f"(SELECT count_if({c}) = 0 FROM X)"
    if kind in ("type", "entity", "user"):
        return some(_has({"type": "EventType", "entity": "EntityType", "user": '"User"'}[kind], words))
    if t.startswith("age"):
        return f"coalesce((SELECT age FROM C) {t[3:5]} {t[5:]}, false)"
    return {
        "none": none(_has("EventType", words)) if kind == "none" else "", "action": some(_one_of(words)) if kind == "action" else "",
        "account": some(f"{_one_of(','.join(CHANGES))} AND {_has('EntityType', 'User')}"), "total": "(SELECT total > 0 FROM C)", "sample": "(SELECT count(*) > 0 FROM X)",
        "protected": "(SELECT total > 0 AND unprotected = 0 FROM C)", "users": none(_blank('"User"')), "times": none("InsertedDate IS NULL"), "types": none(_blank("EventType")),
        "ips": none(_blank("IpAddress")), "actions": none(_blank("Action")), "origins": none(f"{_blank('MachineName')} AND {_blank('AssemblyName')}"), "ip": some(f"NOT ({_blank('IpAddress')})"),
        "correlation": some(f"NOT ({_blank('CorrelationId')})"), "recent": some(f"InsertedDate >= TIMESTAMP '{a.NOW}' - INTERVAL {words or 0} HOUR"), "pass": "true", "config": str(CONFIG.get(words, False)).lower(),
        "both": " AND ".join(some(_group(w)) for w in words.split(",")) if kind == "both" else "",
    }[kind]


def _rule_sql(r) -> str:  # noqa: ANN001
    test = r.test.removeprefix("pass!").strip()
    terms = [t.strip() for t in test.split("&" if "&" in test else "|")]
    held = "(" + (" AND " if "&" in test else " OR ").join(f"({_term(t)})" for t in terms) + ")"
    failed = f"'{r.severity}'"
    if "sample" in terms:
        failed = f"CASE WHEN (SELECT count(*) = 0 FROM X) THEN 'Low' ELSE {failed} END"
    if test == "protected" and r.id != "C17":
        failed = f"CASE WHEN (SELECT total = 0 FROM C) THEN 'Low' ELSE {failed} END"
    if r.id == "C54":
        failed = "CASE WHEN coalesce((SELECT age FROM C) >= 90, false) THEN 'Medium' ELSE 'High' END"
    info = "'Info'"
    if r.id == "C20":
        info = "CASE WHEN (SELECT age FROM C) >= 2190 THEN 'Info' ELSE 'Medium' END"
    if r.id == "C82":
        info = "CASE WHEN " + " + ".join(f"(SELECT (count_if({_group(g)}) > 0)::INT FROM X)" for g in EVENT_GROUPS) + " >= 4 THEN 'Info' ELSE 'Medium' END"
    name = r.name.replace("'", "''")
    return f"SELECT '{r.id}' AS rule_id, '{r.standard}' AS standard, '{name}' AS rule_name, {'true' if r.test.startswith('pass!') else held} AS passed, CASE WHEN {held} THEN {info} ELSE {failed} END AS severity"


RULE_SQL = f""", V AS (SELECT * FROM E WHERE InsertedDate BETWEEN '{START}' AND '{END}'), X AS (SELECT * FROM V ORDER BY InsertedDate DESC, EventId DESC LIMIT 5000),
C AS (SELECT count(*) AS total, count(*) - count(I.EventId) AS unprotected, floor((epoch(TIMESTAMP '{a.NOW}') - floor(epoch(min(InsertedDate)))) / 86400) AS age FROM V LEFT JOIN I USING (EventId)),
R AS ({" UNION ALL ".join(map(_rule_sql, RULES))}) """

q("C_all", results, RULE_SQL + "SELECT * FROM R")
for _standard in ("GDPR", "HIPAA", "SOC2", "ISO27001", "PCI_DSS", "FERPA", "STIG"):
    q(f"C_{_standard}", lambda k, d, x=_standard: co.evaluate(window(k, d), a.audit_integrity(k, d), a.NOW, (x,), CONFIG), RULE_SQL + f"SELECT * FROM R WHERE standard = '{_standard}'")
q("C91", lambda k, d: co.nist(results(k, d)), RULE_SQL + "SELECT * FROM R WHERE standard IN ('STIG', 'ISO27001') QUALIFY row_number() OVER (PARTITION BY lower(rule_name) ORDER BY standard DESC, rule_id) = 1")
q("C92", lambda k, d: co.recommendations(results(k, d)), RULE_SQL + "SELECT rule_id, severity, upper(severity) || ': ' || rule_name AS line FROM R WHERE NOT passed")
q("C93", lambda k, d: co.verdicts(results(k, d)), RULE_SQL + """SELECT s AS standard, count(rule_id) AS rules, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE NOT passed) = 0 AS compliant, CASE WHEN count(rule_id) = 0 THEN 0.0 ELSE round_even((count(rule_id) - count(*) FILTER (WHERE NOT passed)) * 100.0 / count(rule_id), 2)::DOUBLE END AS pass_percentage
  FROM (SELECT unnest(['GDPR', 'SOC2', 'HIPAA', 'ISO27001', 'FERPA', 'PCI_DSS', 'STIG', 'NIST']) AS s) LEFT JOIN R ON standard = s GROUP BY s""")
OLD = f"InsertedDate < TIMESTAMP '{a.NOW}' - INTERVAL 1 DAY * RetentionDays::INT"
MATCH = "(lower(RP.EventType) = lower(E.EventType) OR RP.EventType = '*' OR (RP.EventType LIKE '%.*' AND starts_with(lower(E.EventType), left(lower(RP.EventType), length(RP.EventType) - 1))) OR (RP.EventType LIKE '*.%' AND suffix(lower(E.EventType), lower(RP.EventType)[2:])))"
for _name, _wild, _on in (("P31", False, "RP.EventType = E.EventType"), ("P31_wildcards", True, MATCH)):
    q(_name, lambda k, d, w=_wild: co.policy_violations(a.audit_events(k, d), a.retention_policies(k), a.NOW, w), f"SELECT RP.EventType AS policy, count(E.EventId) AS violations, count(E.EventId) = 0 AS compliant FROM RP LEFT JOIN E ON {_on} AND {OLD} WHERE IsActive GROUP BY 1")
PLAN = f", PL AS (SELECT E.EventId, RP.EventType AS policy FROM E JOIN (SELECT * FROM RP WHERE IsActive) RP ON {MATCH} WHERE E.EventType IS NOT NULL QUALIFY row_number() OVER (PARTITION BY E.EventId ORDER BY Priority DESC, RP.EventType) = 1), DE AS (SELECT PL.* FROM PL JOIN E USING (EventId) JOIN RP ON RP.EventType = policy WHERE {OLD}) "
q("C94", lambda k, d: lc.retention_plan(a.audit_events(k, d), a.retention_policies(k), a.NOW), PLAN + "SELECT * FROM DE")
q("A32", lambda k, d: lc.retention_summary(lc.retention_plan(a.audit_events(k, d), a.retention_policies(k), a.NOW)), PLAN + "SELECT policy, count(*) AS deleted FROM DE GROUP BY 1")
q("C94_archive", lambda k, d: lc.archive_scope(a.audit_events(k, d), a.NOW, 25, None).select("EventId"), f"SELECT EventId FROM E WHERE InsertedDate < TIMESTAMP '{a.NOW}' - INTERVAL 25 DAY")
q("C95", lambda k, d: lc.purge(a.audit_events(k, d), a.NOW, 12).select("EventId"), f"SELECT EventId FROM E WHERE InsertedDate IS NULL OR InsertedDate >= TIMESTAMP '{a.NOW}' - INTERVAL 12 DAY")
q("C96", lambda k, d: lc.purge_archives(a.archive_records(k, d), "1997-01-01", 300).select("ArchiveId"), "SELECT ArchiveId FROM AR WHERE CreatedAt >= TIMESTAMP '1997-01-01' - INTERVAL 300 DAY OR Status = 0")
q("C97", lambda k, d: co.consented(
    a.audit_events(k, d).select(F.col("UserId").alias("user"), F.col("EntityId").alias("entity"), F.col("EntityType").alias("scope"), "EventId"),
    a.audit_events(k, d).where("EventType = 'User.ConsentGranted'").select(F.col("UserId").alias("user"), F.col("EntityId").alias("entity"), F.col("EntityType").alias("scope"), F.when(F.col("id") % 2 == 0, F.col("InsertedDate")).alias("expires")), "2024-01-15").select("EventId"),
  "SELECT EventId FROM E WHERE EXISTS (SELECT 1 FROM E c WHERE c.EventType = 'User.ConsentGranted' AND c.UserId = E.UserId AND c.EntityId = E.EntityId AND c.EntityType = E.EntityType AND (CASE WHEN c.id % 2 = 0 THEN c.InsertedDate END IS NULL OR c.InsertedDate > '2024-01-15'))")
q("C98", lambda k, d: co.marked_fields(a.audit_events(k, d).withMetadata("UserFullName", {"marker": "FERPA"}).withMetadata("IpAddress", {"marker": "GDPR"}).withMetadata("JsonData", {"marker": "HIPAA"}), "AuditEvent"), """SELECT 'AuditEvent' AS entity, unnest(['UserFullName', 'IpAddress', 'JsonData']) AS field, unnest(['FERPA', 'GDPR', 'HIPAA']) AS marker, unnest([count(UserFullName), count(IpAddress), count(JsonData)]) AS n FROM E""")
q("F12", lambda k, d: lc.anonymize_user(a.audit_events(k, d), SUBJECT).select("EventId", "User", "UserFullName", "UserAgent", "JsonData"), f"""SELECT EventId, 'ANONYMIZED' AS "User", 'ANONYMIZED' AS UserFullName, 'ANONYMIZED' AS UserAgent, '{{"Action":"' || json_extract_string(JsonData, '$.Action') || '","UserName":"ANONYMIZED","k":' || json_extract_string(JsonData, '$.k') || '}}' AS JsonData FROM E WHERE UserId = '{SUBJECT}'""")
q("F26", lambda k, d: lc.governed_anonymize(a.audit_events(k, d), a.audit_integrity(k, d).where("AlgorithmVersion = 1"), a.audit_events(k, d).where("IntegrityStatus = 2"), TENANT, SUBJECT).select("EventId", "User", "EventType", "JsonData"), f"""SELECT EventId, 'ANONYMIZED' AS "User", 'Audit.Anonymized' AS EventType, NULL::VARCHAR AS JsonData FROM E WHERE TenantId = '{TENANT}' AND UserId = '{SUBJECT}' AND EventId NOT IN (SELECT EventId FROM I WHERE AlgorithmVersion = 1) AND IntegrityStatus <> 2""")
ROWS = """, H AS (SELECT strftime(InsertedDate, '%Y-%m') AS archive, InsertedDate, sha256(EventId || ':' || coalesce(EventType, '') || ':' || strftime(InsertedDate, '%Y-%m-%dT%H:%M:%S.%f') || '0Z') AS h FROM E WHERE InsertedDate IS NOT NULL),
P AS (SELECT archive, left(h, 3) AS bucket, count(*) AS n, min(InsertedDate) AS a, max(InsertedDate) AS z, sha256(string_agg(h, '|' ORDER BY h)) AS h FROM H GROUP BY 1, 2) """
q("S5", lambda k, d: lc.archive_manifest(a.audit_events(k, d)), ROWS + "SELECT archive, sum(n)::BIGINT AS event_count, min(a) AS range_start, max(z) AS range_end, sha256(string_agg(h, '|' ORDER BY bucket)) AS digest FROM P GROUP BY 1")
q("S14", lambda k, d: lc.validate_archives(lc.archive_manifest(a.audit_events(k, d)), lc.archive_manifest(a.audit_events(k, d).where("EventType IS NULL OR EventType <> 'Archive.Backup'"))), "SELECT strftime(InsertedDate, '%Y-%m') AS archive, CASE WHEN bool_or(coalesce(EventType = 'Archive.Backup', false)) THEN 'Corrupted' ELSE 'Completed' END AS status FROM E WHERE InsertedDate IS NOT NULL GROUP BY 1")


def _snapshots(k, d):  # noqa: ANN001, ANN202
    p = k.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size")
    n = F.col("p_partkey")
    new = p.where("p_size <> 3").withColumns({"p_size": F.when(n % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_brand": F.when(n % 9 == 0, None).otherwise(F.col("p_brand"))})
    return p.where("p_size <> 7"), new


SNAP = ", OS AS (SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size <> 7), NS AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size <> 3) "
q("G1", lambda k, d: cap.snapshot_diff(*_snapshots(k, d), "p_partkey", {"p_brand": cap.MASK}), SNAP + """SELECT o.p_partkey, 'p_size' AS property, o.p_size::VARCHAR AS old_value, n.p_size::VARCHAR AS new_value FROM OS o JOIN NS n USING (p_partkey) WHERE o.p_size IS DISTINCT FROM n.p_size
  UNION ALL SELECT o.p_partkey, 'p_brand', '***', NULL FROM OS o JOIN NS n USING (p_partkey) WHERE o.p_brand IS DISTINCT FROM n.p_brand""")
q("G2", lambda k, d: cap.inserts_and_deletes(*_snapshots(k, d), "p_partkey", ("p_brand",)), SNAP + """SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'Created' ELSE 'Deleted' END AS action,
  '{"p_partkey":' || coalesce(o.p_partkey, n.p_partkey) || ',"p_name":"' || coalesce(o.p_name, n.p_name) || '","p_size":' || coalesce(o.p_size, n.p_size) || '}' AS snapshot FROM OS o FULL JOIN NS n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL""")
q("G3", lambda k, d: cap.changes(*_snapshots(k, d), "p_partkey"), SNAP + """SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'Created' WHEN n.p_partkey IS NULL THEN 'Deleted' ELSE 'Updated' END AS action
  FROM OS o FULL JOIN NS n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_size IS DISTINCT FROM n.p_size OR o.p_brand IS DISTINCT FROM n.p_brand""")
q("G4", lambda k, d: cap.strictest(a.audit_logs(k, d).select(F.col("EntityName").alias("entity"), F.coalesce("PropertyName", F.lit("*")).alias("field"), (F.col("Action") % 4).cast("int").alias("treatment"))), "SELECT EntityName AS entity, coalesce(PropertyName, '*') AS field, max(Action % 4) AS treatment FROM L GROUP BY 1, 2")
q("G5", lambda k, d: cap.subjects(a.audit_events(k, d), "EventId", {"UserId": "actor", "TenantId": "tenant", "EntityId": "entity"}), "SELECT EventId, UserId AS subject, 'actor' AS relationship FROM E UNION ALL SELECT EventId, TenantId, 'tenant' FROM E")
q("G6", lambda k, d: cap.diff_map(*_snapshots(k, d), "p_partkey"), SNAP + """SELECT o.p_partkey, '{' || concat_ws(',', CASE WHEN o.p_brand IS DISTINCT FROM n.p_brand THEN '"p_brand":{"Old":"' || o.p_brand || '"}' END,
  CASE WHEN o.p_size IS DISTINCT FROM n.p_size THEN '"p_size":{"Old":"' || o.p_size || '","New":"' || n.p_size || '"}' END) || '}' AS diff FROM OS o JOIN NS n USING (p_partkey) WHERE o.p_brand IS DISTINCT FROM n.p_brand OR o.p_size IS DISTINCT FROM n.p_size""")
q("G7", lambda k, d: cap.sanitized(k.read.parquet(f"{d}/customer.parquet").withColumn("c_phone", F.lit("x")).withColumn("LoginPassword", F.lit("y"))), "SELECT * FROM customer")
q("G9", lambda k, d: cap.operation_pairs(a.audit_events(k, d).where("InsertedDate IS NOT NULL").select(F.floor(F.col("id") / 2).alias("operation"), F.when(F.col("id") % 2 == 0, "Started").when(F.col("id") % 10 == 1, "Failed").otherwise("Completed").alias("kind"), F.col("InsertedDate").alias("at"), "Action").where("Action IS NOT NULL OR kind = 'Started'").drop("Action")),
  """, OP AS (SELECT id // 2 AS operation, CASE WHEN id % 2 = 0 THEN 'Started' WHEN id % 10 = 1 THEN 'Failed' ELSE 'Completed' END AS kind, InsertedDate AS at FROM E WHERE InsertedDate IS NOT NULL AND (Action IS NOT NULL OR id % 2 = 0)),
  ST AS (SELECT operation, "at" AS s FROM OP WHERE kind = 'Started'), EN AS (SELECT operation, kind, "at" AS z FROM OP WHERE kind <> 'Started')
  SELECT coalesce(ST.operation, EN.operation) AS operation, kind AS outcome, floor((epoch_us(z) - epoch_us(s)) / 1000)::BIGINT AS ms, CASE WHEN s IS NULL THEN 'end without start' END AS warning FROM ST FULL JOIN EN ON ST.operation = EN.operation""")  # fmt: skip
q("G10", lambda k, d: cap.user_fields(k.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("UserName"), F.when(F.col("c_custkey") % 3 > 0, F.lit("e@x.org")).alias("Email"), F.when(F.col("c_custkey") % 2 == 0, F.lit("Ada")).alias("FirstName"), F.when(F.col("c_custkey") % 4 == 0, F.lit("King")).alias("LastName"), F.when(F.col("c_custkey") % 5 == 0, F.lit("t")).alias("RefreshToken"))),
  """SELECT c_name AS UserName, '{' || concat_ws(',', '"UserName":"' || c_name || '"', CASE WHEN c_custkey % 3 > 0 THEN '"Email":"e@x.org"' END, CASE WHEN c_custkey % 4 = 0 THEN '"FullName":"Ada King"' WHEN c_custkey % 2 = 0 THEN '"FullName":"Ada"' END, '"HasRefreshToken":"' || (c_custkey % 5 = 0)::VARCHAR || '"') || '}' AS custom_fields FROM customer""")  # fmt: skip


def _restored(k, d):  # noqa: ANN001, ANN202
    """Writes an archive and reads it again."""
    path = f"{shared_dir(k)}/archive-{uuid4().hex}"
    events = a.audit_events(k, d)
    lc.write_archive(events, path)
    return lc.restore_archive(k, path, events)[0].select("EventId", "InsertedDate", "EventType", "Duration")


def _tracked(k, d):  # noqa: ANN001, ANN202
    path = f"{shared_dir(k)}/meta-{uuid4().hex}"
    cap.tracked(a.audit_events(k, d).where("EventType = 'PHI.Access'"), path, "PHIAccess", "type=PHI.Access", "HIPAA review", lambda rows: rows.write.parquet(f"{path}-rows"))
    return k.read.parquet(path)


q("S6", _restored, "SELECT EventId, InsertedDate, EventType, Duration FROM E WHERE InsertedDate IS NOT NULL")
q("G8", _tracked, "SELECT 'PHIAccess' AS query_type, 'type=PHI.Access' AS params, 'HIPAA review' AS purpose, count(*) AS n_rows, true AS is_compliance, true AS requires_justification, false AS is_sensitive FROM E WHERE EventType = 'PHI.Access'")
