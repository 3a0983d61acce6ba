"""Queries of the staged ingest."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from trailmark.operators import reports
from trailmark.operators import search as s
from trailmark.sources import audit as a
from trailmark.sources.audit import BASE_SQL as B
from trailmark.storage import shared_dir
from trailmark.streaming import ingest
from trailmark.streaming import outbox as o
from trailmark.streaming.ledger import receipts_held

QUERIES, ORACLE_SQL = {}, {}
NOW = "2024-01-20 00:00:00"
T = f"TIMESTAMP '{NOW}'"
TENANT = a.GUID + "b00000000001"


def q(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[f"q_{name}"] = run
    if sql:
        ORACLE_SQL[f"q_{name}"] = B + sql


def box(name: str, run, sql: str) -> None:  # noqa: ANN001
    q(name, lambda k, d: run(a.outbox(k, d)), sql)


def envelopes(k, d):  # noqa: ANN001, ANN201
    n = F.col("event_id")
    change = lambda i: F.struct(F.concat(F.lit("Field"), F.lit(i).cast("string")).alias("name"), (n % 10).cast("string").alias("old"), (n % 8).cast("string").alias("new"))
    return k.read.parquet(f"{d}/events.parquet").select(
        a.guid(n - F.when(n % 40 == 39, 1).otherwise(0)).alias("envelope_id"), (n % 2).cast("int").alias("kind"), F.lit("Order").alias("entity_name"), (n % 12 + 1).cast("int").alias("action"), F.col("ts").cast("timestamp").alias("occurred_at"),
        F.when(n % 6 == 0, F.array(change(1), change(2))).otherwise(F.array().cast("array<struct<name:string,old:string,new:string>>")).alias("changes"),
        F.array(F.struct(a.guid(F.col("user_id"), "a").alias("id"), F.lit("owner").alias("relationship"))).alias("subjects"), F.col("props").alias("payload"),
    )


def drained(table: str):  # noqa: ANN201
    """Runs the stream over all envelopes twice; the second run finds nothing new."""

    def run(k, d):  # noqa: ANN001, ANN202
        top = f"{shared_dir(k)}/ingest-{uuid4().hex}"
        rows = envelopes(k, d)
        for part in (0, 1):
            rows.write.mode("append").json(f"{top}/in")
            ingest.drain(k, f"{top}/in", f"{top}/out", f"{top}/offsets", 2).awaitTermination()
        return k.read.parquet(f"{top}/out/{table}").drop("batch")

    return run


def metered(k, d):  # noqa: ANN001, ANN201
    """What a listener counts while all envelopes are worked off, a few files a batch, and the receipts that are in state then."""
    top, metrics = f"{shared_dir(k)}/metered-{uuid4().hex}", ingest.Metrics()
    envelopes(k, d).repartition(4).write.json(f"{top}/in")
    k.streams.addListener(metrics)
    try:
        query = ingest.drain(k, f"{top}/in", f"{top}/out", f"{top}/offsets", 2)
        query.awaitTermination()
        found = metrics.of(query)
    finally:
        k.streams.removeListener(metrics)
    stored = k.read.parquet(f"{top}/out/verdicts")
    held = receipts_held(k, f"{top}/offsets").agg(F.count("*").alias("in_state"))
    return stored.agg(F.count("*").alias("stored"), F.count_if(F.col("verdict") == "New").alias("known")).crossJoin(held).select(F.lit(found["batches"]).cast("long").alias("batches"), F.lit(found["rows"]).cast("long").alias("received"), "in_state", "stored", "known")


def judged_twice(k, d):  # noqa: ANN001, ANN201
    """The stream's verdicts in two runs: the envelopes of most actions; then all, some of them changed. Those of one action are stored before, without a receipt."""
    top = f"{shared_dir(k)}/judged-{uuid4().hex}"
    rows = envelopes(k, d)
    sources = rows.where("action = 12").select(F.col("envelope_id").alias("id")).distinct()
    changed = rows.withColumn("payload", F.when(F.col("action").isin(3, 4), "changed").otherwise(F.col("payload")))
    for part in (rows.where("action < 10"), changed):
        part.write.mode("append").json(f"{top}/in")
        ingest.drain(k, f"{top}/in", f"{top}/out", f"{top}/offsets", 1000, sources=sources).awaitTermination()
    return k.read.parquet(f"{top}/out/verdicts").groupBy("envelope_id", "verdict").count()


JUDGED = f""", R AS (SELECT event_id AS n, '{a.GUID}' || lpad((event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END)::VARCHAR, 12, '0') AS id, event_id % 12 + 1 AS action, props, user_id, ts FROM events),
  S AS (SELECT 1 AS run, *, props AS payload FROM R WHERE action < 10 UNION ALL SELECT 2, *, CASE WHEN action IN (3, 4) THEN 'changed' ELSE props END FROM R),
  C AS (SELECT *, (n % 2) || '|' || action || '|' || CASE WHEN n % 6 = 0 THEN (n % 10) || ',' || (n % 8) ELSE '' END || '|' || user_id || '|' || payload AS content FROM S),
  Q AS (SELECT id, CASE WHEN id IN (SELECT id FROM R WHERE action = 12) THEN 'Unverified' WHEN row_number() OVER w = 1 THEN 'New' WHEN content = first(content) OVER w THEN 'Replay' ELSE 'Conflict' END AS verdict FROM C WINDOW w AS (PARTITION BY id ORDER BY run, ts, n)) """


def chained_stream(k, d):  # noqa: ANN001, ANN201
    """Pending events into one chain a tenant, by the stream; those that have a link are passed by. Sent twice."""
    top = f"{shared_dir(k)}/chained-{uuid4().hex}"
    events = a.audit_events(k, d).select(F.col("TenantId").alias("chain"), "EventId", F.date_format("InsertedDate", "yyyyMMddHHmmssSSSSSS").alias("at"), F.sha2(F.encode("EventId", "UTF-8"), 256).alias("EventHash"), "IntegrityStatus")
    links = events.join(a.audit_integrity(k, d).select("EventId"), "EventId", "left_semi").select("chain", "EventId", F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("hash"))
    for _ in range(2):
        events.where("IntegrityStatus = 1").drop("IntegrityStatus").write.mode("append").json(f"{top}/in")
        ingest.until_idle(ingest.chain_events(k, f"{top}/in", f"{top}/out", f"{top}/offsets", size=10, interval_ms=1, files_a_batch=1000, links=links))
    return k.read.parquet(f"{top}/out").drop("flush")


ENV = f""", V AS (SELECT '{a.GUID}' || lpad((event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END)::VARCHAR, 12, '0') AS envelope_id, event_id AS n, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END ORDER BY event_id) = 1) """
q("T1", lambda k, d: ingest.event_rows(envelopes(k, d)).select("envelope_id", "action"), f"SELECT '{a.GUID}' || lpad((event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END)::VARCHAR, 12, '0') AS envelope_id, (event_id % 12 + 1)::INT AS action FROM events WHERE event_id % 2 = 1")
box("T2", lambda x: o.stage(x.where("Status <> 2"), x.where("Status = 2")).select("Id", "IdempotencyKey"), "SELECT Id, IdempotencyKey FROM (SELECT * FROM O WHERE Status <> 2 QUALIFY row_number() OVER (PARTITION BY IdempotencyKey ORDER BY CreatedAt, Id) = 1) WHERE IdempotencyKey NOT IN (SELECT IdempotencyKey FROM O WHERE Status = 2)")
q("T3", lambda k, d: drained("verdicts")(k, d).where("verdict = 'New'").select("envelope_id"), ENV + "SELECT envelope_id FROM V")
box("T4", lambda x: o.claimable(x, NOW).select("Id"), f"SELECT Id FROM O WHERE Status = 0 AND (NextRetryAt IS NULL OR NextRetryAt <= {T}) AND (LeaseExpiresAt IS NULL OR LeaseExpiresAt <= {T}) ORDER BY CreatedAt, Id LIMIT 128")
box("T5", lambda x: o.apply_outcomes(x, x.where("FailureCycleId IS NOT NULL").select("Id", F.col("NextRetryAt").isNull().alias("ok")), NOW), f"""SELECT Id, CASE WHEN Status = 1 AND FailureCycleId IS NOT NULL AND NextRetryAt IS NULL THEN 2 WHEN Status = 1 AND FailureCycleId IS NOT NULL THEN CASE WHEN AttemptCount + 1 < 5 THEN 0 ELSE 3 END ELSE Status END::INT AS Status,
  CASE WHEN Status = 1 AND FailureCycleId IS NOT NULL THEN AttemptCount + 1 ELSE AttemptCount END::INT AS AttemptCount,
  CASE WHEN Status = 1 AND FailureCycleId IS NOT NULL AND NextRetryAt IS NOT NULL AND AttemptCount + 1 < 5 THEN {T} + INTERVAL 1 SECOND * ([1, 5, 30])[least(AttemptCount + 1, 3)] WHEN Status = 1 AND FailureCycleId IS NOT NULL THEN NULL ELSE NextRetryAt END AS NextRetryAt FROM O""")
box("T6", lambda x: x.select("Id", o.retry_delay(F.col("AttemptCount")).alias("seconds"), o.backoff_ms(F.col("AttemptCount") + 1).alias("backoff")), "SELECT Id, ([1, 5, 30])[least(greatest(AttemptCount, 1), 3)]::DOUBLE AS seconds, 100.0 * pow(2, AttemptCount) AS backoff FROM O")
box("T7", lambda x: o.recover_leases(x, NOW).select("Id", "Status", "LeaseExpiresAt"), f"SELECT Id, CASE WHEN Status = 1 AND LeaseExpiresAt < {T} THEN 0 ELSE Status END::INT AS Status, CASE WHEN NOT coalesce(Status = 1 AND LeaseExpiresAt < {T}, false) THEN LeaseExpiresAt END AS LeaseExpiresAt FROM O")
_id = lambda x: x.select(F.col("Id").alias("id"), F.col("Content").alias("fingerprint"))
box("T8", lambda x: o.classify(_id(x), x.where("Status = 2").select(F.col("Id").alias("id"), F.when(F.col("AttemptCount") < 4, F.col("Content")).otherwise("other").alias("fingerprint")), _id(x.where("NextRetryAt IS NULL"))), "SELECT Id AS id, Content AS fingerprint, CASE WHEN Status = 2 AND AttemptCount < 4 THEN 'Replay' WHEN Status = 2 THEN 'Conflict' WHEN NextRetryAt IS NULL THEN 'Unverified' ELSE 'New' END AS verdict FROM O")
q("T8_stream", judged_twice, JUDGED + "SELECT id AS envelope_id, verdict, count(*) AS count FROM Q GROUP BY ALL")
q("T12", chained_stream, """, P AS (SELECT TenantId AS chain, EventId, sha256(EventId) AS EventHash, row_number() OVER w AS rn, lag(sha256(EventId)) OVER w AS prev, count(*) OVER (PARTITION BY TenantId) AS n FROM E WHERE IntegrityStatus = 1 AND EventId NOT IN (SELECT EventId FROM I) WINDOW w AS (PARTITION BY TenantId ORDER BY InsertedDate NULLS LAST, EventId))
  SELECT chain, EventId, EventHash, rn AS SequenceNumber, prev AS PreviousEventHash, CASE WHEN rn <= n - n % 10 THEN 'count' ELSE 'time' END AS cause FROM P""")
q("T9", lambda k, d: ingest.entity_rows(envelopes(k, d)).select("envelope_id", "property", "action"), ENV + "SELECT envelope_id, p AS property, (n % 12 + 1)::INT AS action FROM (SELECT *, unnest(CASE WHEN n % 6 = 0 THEN ['Field1', 'Field2'] ELSE [NULL] END) AS p FROM V WHERE n % 2 = 0)")
box("T10", lambda x: o.fan_in(x.select(F.col("Id").alias("id"), F.col("IdempotencyKey").alias("key"), F.when(F.col("Id") % 100 < 50, "same").otherwise(F.col("Content")).alias("content"), F.col("CreatedAt").alias("created"))),
    """SELECT Id AS id, IdempotencyKey AS key, CASE WHEN row_number() OVER w = 1 THEN 'First' WHEN c IS NOT DISTINCT FROM first(c) OVER w THEN 'Duplicate' ELSE 'Conflict' END AS verdict FROM (SELECT *, CASE WHEN Id % 100 < 50 THEN 'same' ELSE Content END AS c FROM O) WINDOW w AS (PARTITION BY IdempotencyKey ORDER BY CreatedAt, Id)""")  # fmt: skip
q("T11", lambda k, d: ingest.subject_rows(envelopes(k, d).dropDuplicates(["envelope_id"])).groupBy("relationship").agg(F.countDistinct("envelope_id").alias("envelopes")), "SELECT 'owner' AS relationship, count(DISTINCT event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END) AS envelopes FROM events")
q("T14", lambda k, d: reports.dead_letter_stats(o.purge_letters(a.dead_letters(k, d), NOW).join(s.retry_candidates(a.dead_letters(k, d), 500, 3).select("Id"), "Id", "left_anti")).where("section = 'reason'"), f"SELECT 'reason' AS section, FailureReason AS key, count(*) AS n FROM DL WHERE NOT coalesce(IsProcessed AND ProcessedAt < {T} - INTERVAL 24 HOUR, false) AND Id NOT IN (SELECT Id FROM (SELECT * FROM DL ORDER BY FailedAt DESC, Id DESC LIMIT 500) WHERE NOT IsProcessed AND RetryCount < 3 AND EventType <> 'Audit.Projection') GROUP BY 2")
box("T15", lambda x: x.select("Id", o.backoff_ms(F.col("AttemptCount") + 1, 250).alias("ms")), "SELECT Id, 250.0 * pow(2, AttemptCount) AS ms FROM O")
box("T16", lambda x: o.handoffs(x, NOW), f"SELECT Id, CreatedAt, least(3600, 5 * pow(2, least(AttemptCount, 10)))::INT AS delay_s FROM O WHERE (Status = 0 OR (Status = 1 AND LeaseExpiresAt < {T})) AND (NextRetryAt IS NULL OR NextRetryAt <= {T})")
q("T18", lambda k, d: reports.queue_depth(a.outbox(k, d), NOW), f"SELECT count_if(Status = 0) AS pending, count_if(Status = 1) AS in_flight, greatest(0, epoch({T})::BIGINT - floor(epoch(min(CreatedAt) FILTER (WHERE Status = 0)))::BIGINT) AS oldest_pending_s FROM O")
q("T18_stream", metered, ENV + "SELECT 2::BIGINT AS batches, (SELECT count(*) FROM events) AS received, count(*) AS in_state, (SELECT count(*) FROM events) AS stored, count(*) AS known FROM V")
q("T19", lambda k, d: o.expired_letters(a.dead_letters(k, d), NOW, 7).select("Id"), f"SELECT Id FROM DL WHERE FailedAt >= {T} - INTERVAL 7 DAY")
for _name, _replay in (("T20", True), ("T20_skip", False)):
    box(_name, lambda x, r=_replay: o.resolve(x, TENANT, "cycle-2", r), f"SELECT Id, {0 if _replay else 3} AS Status, {'0' if _replay else 'AttemptCount'} AS AttemptCount, '{'Replay' if _replay else 'Skip'}' AS resolution FROM O WHERE Status = 3 AND TenantId = '{TENANT}' AND FailureCycleId = 'cycle-2' AND ResolutionId IS NULL")
box("T21", lambda x: o.cleanable(x, x.where("AttemptCount = 5"), x.where("FailureCycleId IS NULL"), NOW), f"SELECT Id FROM O WHERE (Status = 2 OR ResolutionId IS NOT NULL) AND CreatedAt < {T} - INTERVAL 24 HOUR AND AttemptCount <> 5 AND FailureCycleId IS NOT NULL")
q("T22", lambda k, d: o.purge_letters(a.dead_letters(k, d), NOW).select("Id", "IsProcessed"), f"SELECT Id, IsProcessed FROM DL WHERE NOT coalesce(IsProcessed AND ProcessedAt < {T} - INTERVAL 24 HOUR, false)")
q("T22_capacity", lambda k, d: o.capacity(a.dead_letters(k, d)), "SELECT count(*) AS n, CASE WHEN count(*) >= 5000 THEN 'Reject' WHEN count(*) >= 1000 THEN 'Warn' ELSE 'Accept' END AS state FROM DL")
q("S12", lambda k, d: a.dead_letters(k, d).select("Id", "FailedAt", "FailureReason", "RetryCount", "IsProcessed"), "SELECT Id, FailedAt, FailureReason, RetryCount, IsProcessed FROM DL")
box("S13", lambda x: o.stage(x, x.limit(0)).select("Id"), "SELECT min(Id) AS Id FROM O GROUP BY IdempotencyKey")
