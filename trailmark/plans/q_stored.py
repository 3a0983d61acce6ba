"""Queries over tables that are written, changed and read back: the word index, stores that are merged into, rewrites, archives of files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from trailmark.functions import text as t
from trailmark.operators import archive_files as af
from trailmark.operators import integrity as g
from trailmark.operators import lifecycle as lc
from trailmark.operators import search as s
from trailmark.operators import wordindex as w
from trailmark.plans import q_governance, q_integrity, q_search, q_streaming
from trailmark.plans.q_search import COLS, SHOWN
from trailmark.sources import audit as a
from trailmark.sources import layout
from trailmark.sources.audit import BASE_SQL as B
from trailmark.sources.stored import Stored, flip_last_byte
from trailmark.storage import shared_dir
from trailmark.streaming import letter_files as lf
from trailmark.streaming import outbox_store as os
from trailmark.streaming import writes as ws

QUERIES, ORACLE_SQL = {}, {}


def q(name: str, run, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[f"q_{name}"] = run
    if sql:
        ORACLE_SQL[f"q_{name}"] = B + sql


def folder(k, name: str) -> str:  # noqa: ANN001
    return f"{shared_dir(k)}/{name}-{uuid4().hex}"


def _searched(text: str):  # noqa: ANN202
    """Indexes all events in two batches and looks a text up."""

    def run(k, d):  # noqa: ANN001, ANN202
        events, path = a.audit_events(k, d), folder(k, "words")
        w.add_to_index(events.where("Duration <= 40"), path)
        w.add_to_index(events.where("Duration > 40 OR Duration IS NULL"), path)
        return w.indexed_search(events, w.open_index(k, path), text).select(*SHOWN)

    return run


q("P14_index", _searched('updated "user 7"'), q_search.ORACLE_SQL["q_P14"].removeprefix(B))
q("F1_index", _searched("login"), q_search.ORACLE_SQL["q_F1"].removeprefix(B))
q("P14_phrase", _searched('"data.read" "test.com"'), f"""SELECT {COLS} FROM E WHERE EventType = 'Data.Read' AND "User" LIKE '%@test.com'""")

# changes of stored tables, read back
DAY = "date_format(InsertedDate, 'yyyy-MM-dd')"


def events_table(k, d, rows=None) -> Stored:  # noqa: ANN001
    return Stored.create(a.audit_events(k, d) if rows is None else rows, folder(k, "events"), DAY, "EventId")


def _reread(table: Stored):  # noqa: ANN202
    return Stored.open(table.spark, table.path).read()


q("C94_applied", lambda k, d: _reread(lc.apply_retention(events_table(k, d), a.retention_policies(k), a.NOW)[0]).select("EventId"), q_governance.PLAN + "SELECT EventId FROM E WHERE EventId NOT IN (SELECT EventId FROM DE)")
q("C95_applied", lambda k, d: _reread(lc.apply_purge(events_table(k, d), a.NOW, 12)[0]).select("EventId", "InsertedDate"), f"SELECT EventId, InsertedDate FROM E WHERE InsertedDate IS NULL OR InsertedDate >= TIMESTAMP '{a.NOW}' - INTERVAL 12 DAY")
q("C96_applied", lambda k, d: _reread(lc.apply_archive_purge(Stored.create(a.archive_records(k, d), folder(k, "records"), "ContainerName", "ArchiveId"), "1997-01-01", 300)[0]).select("ArchiveId", "Status"), "SELECT ArchiveId, Status FROM AR WHERE CreatedAt >= TIMESTAMP '1997-01-01' - INTERVAL 300 DAY OR Status = 0")
q("F12_applied", lambda k, d: _reread(lc.apply_anonymization(events_table(k, d), q_governance.SUBJECT)[0]).select("EventId", "User", "UserAgent"), f"""SELECT EventId, CASE WHEN UserId = '{q_governance.SUBJECT}' THEN 'ANONYMIZED' ELSE "User" END AS "User", CASE WHEN UserId = '{q_governance.SUBJECT}' THEN 'ANONYMIZED' ELSE UserAgent END AS UserAgent FROM E""")

# outbox: claim and outcome, merged by bucket
AT = "2024-01-20 00:00:00"


def _boxes(k, d):  # noqa: ANN001, ANN202
    return os.create_box(a.outbox(k, d), folder(k, "outbox")), os.create_handoffs(k, folder(k, "handoffs"))


def _outcomes(k, d):  # noqa: ANN001, ANN202
    """Claims 500 rows; those without a cycle are delivered, the others fail; an outcome for a row that was not claimed is refused."""
    box, handoffs = _boxes(k, d)
    box, taken = os.claim(box, "t1", AT, 500)
    answers = taken.select("Id", F.col("FailureCycleId").isNull().alias("ok"), F.lit("Timeout").alias("reason"))
    others = box.read().where("Status = 2").select("Id", F.lit(False).alias("ok"), F.lit("late").alias("reason"))
    box, handoffs, _ = os.apply(box, handoffs, answers.unionByName(others), "t1", "op1", AT)
    failed = _reread(handoffs).select(F.col("OutboxRowId").alias("Id"), F.col("ReasonCode").alias("handoff"))
    return _reread(box).join(failed, "Id", "left").select("Id", "Status", "AttemptCount", "NextRetryAt", "LastError", "FailureCycleId", F.col("CompletedAt").isNotNull().alias("completed"), "handoff")


q("T5_store", _outcomes, f""", C AS (SELECT Id FROM O WHERE Status = 0 AND (NextRetryAt IS NULL OR NextRetryAt <= TIMESTAMP '{AT}') AND (LeaseExpiresAt IS NULL OR LeaseExpiresAt <= TIMESTAMP '{AT}') ORDER BY CreatedAt, Id LIMIT 500),
  X AS (SELECT O.*, Id IN (SELECT Id FROM C) AND FailureCycleId IS NULL AS good, Id IN (SELECT Id FROM C) AND FailureCycleId IS NOT NULL AS bad FROM O)
  SELECT Id, CASE WHEN good THEN 2 WHEN bad AND AttemptCount + 1 < 5 THEN 0 WHEN bad THEN 3 ELSE Status END::INT AS Status, (AttemptCount + bad::INT)::INT AS AttemptCount,
    CASE WHEN bad AND AttemptCount + 1 < 5 THEN TIMESTAMP '{AT}' + INTERVAL 1 SECOND * ([1, 5, 30])[least(AttemptCount + 1, 3)] WHEN NOT good AND NOT bad THEN NextRetryAt END AS NextRetryAt, CASE WHEN bad THEN 'Timeout' END AS LastError,
    CASE WHEN bad AND AttemptCount + 1 >= 5 THEN 'op1' WHEN NOT good AND NOT bad THEN FailureCycleId END AS FailureCycleId, good AS completed, CASE WHEN bad AND AttemptCount + 1 >= 5 THEN 'Timeout' END AS handoff FROM X""")
q("T7_store", lambda k, d: _reread(os.recover(_boxes(k, d)[0], AT)[0]).select("Id", "Status", "LeaseExpiresAt"), f"""SELECT O.Id, CASE WHEN R.Id IS NULL THEN Status ELSE 0 END::INT AS Status, CASE WHEN R.Id IS NULL THEN LeaseExpiresAt END AS LeaseExpiresAt FROM O LEFT JOIN
  (SELECT Id FROM O WHERE Status = 1 AND LeaseExpiresAt <= TIMESTAMP '{AT}' ORDER BY LeaseExpiresAt, Id LIMIT 1000) R ON O.Id = R.Id""")

# archives as files
BY_DAY = "yyyy-MM-dd"


def _damaged(k, d):  # noqa: ANN001, ANN202
    """Archives by day; then a bit of a file of the first day is turned over."""
    path = folder(k, "archive")
    af.commit_archive(a.audit_events(k, d), path, unit=BY_DAY)
    top = af.committed_folder(k, path)
    first = k.read.parquet(f"{top}/files").orderBy("archive", "file").first()
    flip_last_byte(k, f"{top}/events/archive={first.archive}/{first.file}")
    return af.validate(k, path)


def _restored_files(k, d):  # noqa: ANN001, ANN202
    """Archives all events, purges most of them from the table, restores them."""
    path = folder(k, "archive")
    af.commit_archive(a.audit_events(k, d), path, unit=BY_DAY)
    table, _ = lc.apply_purge(events_table(k, d), a.NOW, 12)
    table, _ = af.restore(k, path, table, BY_DAY)
    return _reread(table).select("EventId", "InsertedDate", "EventType", "JsonData")


q("S5_files", lambda k, d: af.commit_archive(a.audit_events(k, d), folder(k, "archive"), unit=BY_DAY).select("archive", "event_count"), "SELECT strftime(InsertedDate, '%Y-%m-%d') AS archive, count(*) AS event_count FROM E WHERE InsertedDate IS NOT NULL GROUP BY 1")
q("S14_files", _damaged, "SELECT archive, CASE WHEN archive = min(archive) OVER () THEN 'Corrupted' ELSE 'Completed' END AS status, CASE WHEN archive = min(archive) OVER () THEN 'hash' END AS reason FROM (SELECT DISTINCT strftime(InsertedDate, '%Y-%m-%d') AS archive FROM E WHERE InsertedDate IS NOT NULL)")
q("S6_files", _restored_files, "SELECT EventId, InsertedDate, EventType, JsonData FROM E")


# dead letters as files
def _taken_up(k, d):  # noqa: ANN001, ANN202
    """Open letters are put down, taken up in two runs and moved aside; what waits is told before and after."""
    top = folder(k, "letters")
    letters = a.dead_letters(k, d).where("NOT IsProcessed")
    for part in ("RetryCount < 2", "RetryCount >= 2"):
        lf.put(letters.where(part), top)
        waited = lf.queue_state(k, top).first().n
        lf.take_up(k, top, f"{top}/stored", f"{top}/offsets", 2).awaitTermination()
    after = lf.queue_state(k, top).first()
    stored = k.read.schema(lf.LETTER).parquet(f"{top}/stored")
    sums = stored.groupBy("FailureReason").agg(F.count("*").alias("n"), F.max("FailedAt").alias("latest"))
    return sums.withColumns({"waited": F.lit(waited).cast("long"), "waits": F.lit(after.n).cast("long"), "state": F.lit(after.state)})


q("T22_files", _taken_up, "SELECT FailureReason, count(*) AS n, max(FailedAt) AS latest, (SELECT count(*) FROM DL WHERE NOT IsProcessed AND RetryCount >= 2) AS waited, 0::BIGINT AS waits, 'Accept' AS state FROM DL WHERE NOT IsProcessed GROUP BY 1")


# events and links in buckets
def laid(name: str, run, like: str) -> None:  # noqa: ANN001
    """The query of a join, over tables that are bucketed by EventId."""

    def over(k, d):  # noqa: ANN001, ANN202
        tables = (("events", a.audit_events(k, d)), ("links", a.audit_integrity(k, d)))
        return run(*(layout.lay_out(rows, f"{kind}_{uuid4().hex}", folder(k, kind), BUCKETS) for kind, rows in tables))

    q(name, over, q_integrity.ORACLE_SQL[f"q_{like}"].removeprefix(B))


BUCKETS = 16
laid("J1_laid", lambda e, i: q_integrity.shown(g.with_integrity(e.where("Duration > 40"), i)), "J1")
laid("J4_laid", lambda e, i: q_integrity.shown(g.with_events(s.keyset_page(i, "SequenceNumber", 2000, 150), e)), "J4")
laid("J6_laid", lambda e, i: g.unprotected(e, i).select("EventId"), "J6")
laid("A17_laid", g.coverage, "A17")


# batches with an outcome for each envelope
def _content():  # noqa: ANN202
    return F.sha2(F.encode(F.to_json(F.struct("kind", "entity_name", "action", "payload")), "UTF-8"), 256)


def _envelopes(k, d):  # noqa: ANN001, ANN202
    """The earliest envelope of each id."""
    rows = q_streaming.envelopes(k, d).groupBy("envelope_id").agg(F.min(F.struct("occurred_at", "kind", "entity_name", "action", "payload")).alias("e"))
    return rows.select("envelope_id", "e.*")


def _published(k, d):  # noqa: ANN001, ANN202
    """Publishes the envelopes of most actions; then all, some of them with other content."""
    rows = _envelopes(k, d)
    empty = rows.limit(0).withColumn("fingerprint", F.lit(""))
    entities, events = (Stored.create(empty, folder(k, name), "pmod(xxhash64(envelope_id), 16)", "envelope_id") for name in ("entities", "explicit"))
    entities, events, _ = ws.publish(rows.where("action < 10"), entities, events, _content())
    changed = rows.withColumn("payload", F.when(F.col("action").isin(3, 4), "changed").otherwise(F.col("payload")))
    entities, events, said = ws.publish(changed, entities, events, _content())
    stored = _reread(entities).select("envelope_id", "payload", F.lit("entity").alias("stored_as")).unionByName(_reread(events).select("envelope_id", "payload", F.lit("event").alias("stored_as")))
    return said.join(stored, "envelope_id", "left")


def _rows_told(k, d):  # noqa: ANN001, ANN202
    """Claimed rows and what two writers answer: one of them raised. Some rows are of a kind that nobody writes."""
    rows = _envelopes(k, d).select(F.substring("envelope_id", 25, 12).cast("long").alias("row_id"), "envelope_id", F.when(F.col("action") == 12, 7).otherwise(F.col("kind")).alias("kind"), F.col("occurred_at").alias("created"), "action")
    a_, no = F.col("action"), F.lit(False)
    answered = rows.where("kind = 1").select("envelope_id", "kind", (a_ < 6).alias("succeeded"), (a_ < 3).alias("duplicate"), (a_ == 9).alias("conflict"), a_.between(6, 8).alias("retryable"), F.when(a_.between(6, 9), F.concat(F.lit("error "), a_.cast("string"))).alias("error"))
    return rows, ws.row_outcomes(rows, answered.unionByName(ws.retry_all(rows.where("kind = 0"), "writer raised")))


FIRST = f""", V AS (SELECT '{a.GUID}' || lpad((event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END)::VARCHAR, 12, '0') AS envelope_id, (event_id % 2)::INT AS kind, event_id % 12 + 1 AS action, props, ts,
  event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END AS n FROM events QUALIFY row_number() OVER (PARTITION BY event_id - CASE WHEN event_id % 40 = 39 THEN 1 ELSE 0 END ORDER BY ts, event_id % 2) = 1),
  RT AS (SELECT n AS row_id, CASE WHEN action = 12 THEN 7 ELSE kind END::INT AS kind, ts, action FROM V),
  RS AS (SELECT *, CASE WHEN kind = 7 THEN 'Failed' WHEN kind = 0 THEN 'RetryLater' WHEN action < 3 THEN 'Duplicate' WHEN action < 6 THEN 'Succeeded' WHEN action < 9 THEN 'RetryLater' ELSE 'Failed' END AS status,
    CASE WHEN kind = 7 THEN 'Unhandled AuditEnvelopeKind: 7' WHEN kind = 0 THEN 'writer raised' WHEN action < 6 THEN NULL WHEN action <= 9 THEN 'error ' || action ELSE 'Unknown error' END AS error FROM RT) """
q("T1_store", _published, FIRST + """SELECT envelope_id, kind, action NOT IN (3, 4) AS succeeded, action < 10 AND action NOT IN (3, 4) AS duplicate, action IN (3, 4) AS conflict, false AS retryable, CASE WHEN action IN (3, 4) THEN 'audit_identity_conflict' END AS error,
  props AS payload, CASE kind WHEN 0 THEN 'entity' ELSE 'event' END AS stored_as FROM V""")
q("T11_rows", lambda k, d: _rows_told(k, d)[1], FIRST + "SELECT row_id, status, error FROM RS")
q("T11_metrics", lambda k, d: ws.batch_metrics(*_rows_told(k, d), AT), FIRST + f"""SELECT kind, count(*) AS n, count_if(status = 'Succeeded') AS succeeded, count_if(status = 'Duplicate') AS duplicate, count_if(status = 'RetryLater') AS retrylater, count_if(status = 'Failed') AS failed,
  max(epoch(TIMESTAMP '{AT}' - ts)) FILTER (WHERE ts <= TIMESTAMP '{AT}') AS oldest_s FROM RS GROUP BY kind""")


# batches that are tried again
def _tried(k, d):  # noqa: ANN001, ANN202
    """A batch for each type of entity. Incidents are written at once, patients at the third attempt (the second fails half done), students never, and those without a type cannot even be put down; cards are known already, users in conflict."""
    top, events = folder(k, "tried"), a.audit_events(k, d).select("EventId", "EventType", "EntityType", "User")
    ends = []
    for kind in ("Incident", "Patient", "User", "Card", "Student", ""):
        tries = []

        def write(batch, kind=kind, tries=tries):  # noqa: ANN001, ANN202
            tries.append(kind)
            if kind == "User":
                raise ws.ConflictError("stored with other content")
            if kind == "Card":
                raise ws.DuplicateError("stored")
            if kind in ("Student", "") or (kind == "Patient" and len(tries) == 1):
                raise RuntimeError("no store")
            batch.write.mode("overwrite").parquet(f"{top}/stored/batch={kind}")
            if kind == "Patient" and len(tries) == 2:
                raise RuntimeError("no answer")

        def put_down(batch, reason, kind=kind):  # noqa: ANN001, ANN202
            if not kind:
                raise OSError("no letters")
            lf.put(ws.letters_of(batch, reason, AT), f"{top}/letters")

        batch = events.where(F.col("EntityType") == kind)
        try:
            end = ws.persistently(batch, write, put_down, lambda b: ws.emergency_file(b, f"{top}/emergency", {"User": t.redact_key(F.col("User"))}), sleep=lambda s: None).outcome
        except ws.ConflictError:
            end = "conflict"
        ends.append((kind, end, len(tries)))
    stored = k.read.schema(events.schema).parquet(f"{top}/stored").select("EventId", F.lit("stored").alias("place"), "User", F.lit(None).cast("string").alias("reason"))
    letters = lf.waiting(k, f"{top}/letters").select(F.col("Id").alias("EventId"), F.lit("letters").alias("place"), F.lit(None).cast("string").alias("User"), F.col("FailureReason").alias("reason"))
    emergency = k.read.schema(events.schema).json(f"{top}/emergency/*").select("EventId", F.lit("emergency").alias("place"), "User", F.lit(None).cast("string").alias("reason"))
    told = k.createDataFrame(ends, "EntityType string, outcome string, attempts int")
    return events.select("EventId", "EntityType").join(stored.unionByName(letters).unionByName(emergency), "EventId", "left").join(told, "EntityType", "left")


q("T15_attempts", _tried, """SELECT EntityType, EventId, CASE EntityType WHEN 'Incident' THEN 'stored' WHEN 'Patient' THEN 'stored' WHEN 'Student' THEN 'letters' WHEN '' THEN 'emergency' END AS place,
  CASE WHEN EntityType IN ('Incident', 'Patient') THEN "User" WHEN EntityType = '' AND "User" IS NOT NULL THEN '[REDACTED]' END AS "User", CASE EntityType WHEN 'Student' THEN 'Batch failed after 4 attempts' END AS reason,
  CASE EntityType WHEN 'Student' THEN 'dead letters' WHEN '' THEN 'emergency' WHEN 'User' THEN 'conflict' WHEN 'Card' THEN 'duplicate' ELSE 'success' END AS outcome, CASE EntityType WHEN 'Patient' THEN 3 WHEN 'Student' THEN 4 WHEN '' THEN 4 ELSE 1 END::INT AS attempts FROM E""")
