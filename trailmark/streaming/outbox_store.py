"""The outbox and its failure handoffs as stored tables: claims, outcomes, recovery, resolution.

Each operation reads what it needs, makes the changed rows and merges them into the table: only their hash buckets are written anew, and one rename publishes
them (:mod:`trailmark.sources.stored`). A row's owner is the token of the operation that claimed it; an outcome for a row that the token no longer owns is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.search import ordered
from trailmark.sources.stored import Stored
from trailmark.storage import written
from trailmark.streaming.outbox import COMPLETED, FAILED, IN_FLIGHT, MOST_ATTEMPTS, PENDING, claimable, retry_delay

#: Handoffs' states. Fixed values.
WAITING, DISPATCHING, DELIVERED, SUPPRESSED = range(4)
#: Rows that one operation may claim or change.
MOST_ROWS = 1000
BUCKETS = 64
HANDOFF = "Id string, OutboxRowId long, FailureCycleId string, TenantId string, Content string, ReasonCode string, CreatedAt timestamp, Status int, AttemptCount int, NextRetryAt timestamp, LeaseExpiresAt timestamp, ClaimToken string, CompletedAt timestamp"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _at(now: str, seconds: Column | int = 0) -> Column:
    return (F.lit(now).cast("timestamp").cast("double") + seconds).cast("timestamp")


def _size(size: int) -> int:
    if not 0 < size <= MOST_ROWS:
        raise ValueError(f"between 1 and {MOST_ROWS} rows at once")
    return size


def create_box(rows: DataFrame, path: str) -> Stored:
    """A stored outbox of the rows of the outbox view, in hash buckets of Id."""
    full = rows.withColumns({"LeaseOwner": _null("string"), "CompletedAt": _null("timestamp"), "LastError": _null("string")})
    return Stored.create(full, path, f"pmod(xxhash64(Id), {BUCKETS})", "Id")


def create_handoffs(spark, path: str) -> Stored:  # noqa: ANN001
    return Stored.create(spark.createDataFrame([], HANDOFF), path, f"pmod(xxhash64(Id), {BUCKETS})", "Id")


def _merged(table: Stored, rows: DataFrame, name: str) -> tuple[Stored, DataFrame]:
    """The rows are read twice (their buckets, their content), so they are written first: their choice holds."""
    rows = written(rows.select(table.schema.names), name)
    return table.upsert(rows), rows


def claim(box: Stored, token: str, now: str, size: int = 128, seconds: int = 60) -> tuple[Stored, DataFrame]:
    """T4: the oldest rows that are due are in flight under the token until the lease ends."""
    taken = claimable(box.read(), now, _size(size)).withColumns({"Status": F.lit(IN_FLIGHT), "LeaseOwner": F.lit(token), "LeaseExpiresAt": _at(now, seconds)})
    return _merged(box, taken, "claimed")


def apply(box: Stored, handoffs: Stored, outcomes: DataFrame, token: str, operation: str, now: str) -> tuple[Stored, Stored, DataFrame]:
    """Outcomes (Id, ok, reason), distinct ids: Completed; or one attempt more, and Pending with a later retry, or after the last one Failed, with a handoff. Third: (Id, applied)."""
    said = outcomes.select("Id", "ok", F.col("reason"))
    owned = box.read(box.touched(said)).where((F.col("Status") == IN_FLIGHT) & (F.col("LeaseOwner") == token)).join(said, "Id")
    attempts = F.col("AttemptCount") + F.when(F.col("ok"), 0).otherwise(1)
    again = attempts < MOST_ATTEMPTS
    status = F.when(F.col("ok"), COMPLETED).when(again, PENDING).otherwise(FAILED).cast("int")
    changed = owned.select(
        "*",
        status.alias("to"),
        attempts.cast("int").alias("attempts"),
        F.when(~F.col("ok") & again, _at(now, retry_delay(attempts))).alias("retry"),
    )
    done = changed.withColumns(
        {
            "Status": F.col("to"),
            "AttemptCount": F.col("attempts"),
            "NextRetryAt": F.col("retry"),
            "LeaseOwner": _null("string"),
            "LeaseExpiresAt": _null("timestamp"),
            "CompletedAt": F.when(F.col("ok"), _at(now)),
            "LastError": F.when(~F.col("ok"), F.col("reason")),
            "FailureCycleId": F.when(F.col("to") == FAILED, operation),
            "ResolutionId": _null("string"),
        }
    )
    after, rows = _merged(box, done, "outcomes")
    failed = rows.where(F.col("Status") == FAILED).select(
        F.sha2(F.concat(F.lit(f"{operation}:"), F.col("Id").cast("string")).cast("binary"), 256).alias("Id"), F.col("Id").alias("OutboxRowId"), "FailureCycleId", "TenantId", "Content", F.col("LastError").alias("ReasonCode"),
        _at(now).alias("CreatedAt"), F.lit(WAITING).alias("Status"), F.lit(0).alias("AttemptCount"), _null("timestamp").alias("NextRetryAt"), _null("timestamp").alias("LeaseExpiresAt"), _null("string").alias("ClaimToken"), _null("timestamp").alias("CompletedAt"),
    )
    handoffs, _ = _merged(handoffs, failed, "handoffs")
    return after, handoffs, said.select("Id").join(rows.select("Id", F.lit(True).alias("applied")), "Id", "left").select("Id", F.coalesce("applied", F.lit(False)).alias("applied"))


def recover(box: Stored, now: str, size: int = MOST_ROWS) -> tuple[Stored, DataFrame]:
    """Rows in flight whose lease has run out, those of the oldest leases first, are pending again."""
    out = box.read().where((F.col("Status") == IN_FLIGHT) & (F.col("LeaseExpiresAt") <= _at(now)))
    freed = ordered(out, "LeaseExpiresAt", "Id").limit(_size(size))
    return _merged(box, freed.withColumns({"Status": F.lit(PENDING), "LeaseOwner": _null("string"), "LeaseExpiresAt": _null("timestamp")}), "recovered")


def claim_handoffs(handoffs: Stored, token: str, now: str, size: int = 128, seconds: int = 60) -> tuple[Stored, DataFrame]:
    """First, expired dispatches wait again; then the oldest that are due go out under the token."""
    expired = handoffs.read().where((F.col("Status") == DISPATCHING) & (F.col("LeaseExpiresAt") <= _at(now)))
    freed = ordered(expired, "LeaseExpiresAt", "Id").limit(_size(size))
    handoffs, _ = _merged(handoffs, freed.withColumns({"Status": F.lit(WAITING), "ClaimToken": _null("string"), "LeaseExpiresAt": _null("timestamp")}), "handoffs-freed")
    due = handoffs.read().where((F.col("Status") == WAITING) & (F.col("NextRetryAt").isNull() | (F.col("NextRetryAt") <= _at(now))))
    taken = ordered(due, "CreatedAt", "Id").limit(size).withColumns({"Status": F.lit(DISPATCHING), "ClaimToken": F.lit(token), "LeaseExpiresAt": _at(now, seconds)})
    return _merged(handoffs, taken, "handoffs-claimed")


def acknowledge(handoffs: Stored, answers: DataFrame, token: str, now: str) -> tuple[Stored, DataFrame]:
    """Answers (Id, delivered) to dispatches that the token owns: Delivered, or waiting again, longer with each attempt."""
    owned = handoffs.read(handoffs.touched(answers)).where((F.col("Status") == DISPATCHING) & (F.col("ClaimToken") == token)).join(answers.select("Id", "delivered"), "Id")
    delay = F.least(F.lit(3600), F.lit(5) * F.pow(F.lit(2), F.least(F.col("AttemptCount"), F.lit(10))))
    marked = owned.withColumns({"Status": F.when(F.col("delivered"), DELIVERED).otherwise(WAITING).cast("int"), "CompletedAt": F.when(F.col("delivered"), _at(now)), "NextRetryAt": F.when(~F.col("delivered"), _at(now, delay)), "AttemptCount": (F.col("AttemptCount") + 1).cast("int"), "ClaimToken": _null("string"), "LeaseExpiresAt": _null("timestamp")})
    return _merged(handoffs, marked, "acknowledged")


def resolve(box: Stored, handoffs: Stored, tenant: str, cycle: str, resolution: str, replay: bool, now: str) -> tuple[Stored, Stored, DataFrame]:
    """The unresolved failed rows of a tenant and cycle get a resolution; replayed ones are pending without attempts. Their handoffs that wait or are under way are suppressed: nobody need hear of the failure any more."""
    hit = box.read().where((F.col("Status") == FAILED) & (F.col("TenantId") == tenant) & (F.col("FailureCycleId") == cycle) & F.col("ResolutionId").isNull())
    again = {"Status": F.lit(PENDING), "AttemptCount": F.lit(0)} if replay else {}
    box, rows = _merged(box, hit.withColumns({"ResolutionId": F.lit(resolution), "NextRetryAt": _null("timestamp"), **again}), "resolved")
    open_ones = handoffs.read().where(F.col("Status").isin(WAITING, DISPATCHING) & (F.col("FailureCycleId") == cycle)).join(rows.select(F.col("Id").alias("OutboxRowId")), "OutboxRowId", "left_semi")
    handoffs, _ = _merged(handoffs, open_ones.withColumns({"Status": F.lit(SUPPRESSED), "CompletedAt": _at(now), "ClaimToken": _null("string"), "LeaseExpiresAt": _null("timestamp")}), "suppressed")
    return box, handoffs, rows
