"""The state machine of staged envelopes and dead letters as functions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.search import ordered

PENDING, IN_FLIGHT, COMPLETED, FAILED = range(4)
#: Seconds before the next attempt; the last repeats. Attempts in all. Share of random delay.
RETRY_SECONDS, MOST_ATTEMPTS, JITTER = (1, 5, 30), 5, 0.2


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def stage(new: DataFrame, staged: DataFrame, key: str = "IdempotencyKey") -> DataFrame:
    """The first row of each key that is not staged yet."""
    w = Window.partitionBy(key).orderBy("CreatedAt", "Id")
    first = new.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.join(staged.select(key), key, "left_anti")


def claimable(box: DataFrame, now: str, limit: int = 128) -> DataFrame:
    """T4: pending rows whose retry is due and lease free, oldest first."""
    free = lambda c: F.col(c).isNull() | (F.col(c) <= _at(now))
    return ordered(box.where((F.col("Status") == PENDING) & free("NextRetryAt") & free("LeaseExpiresAt")), "CreatedAt", "Id").limit(limit)


def retry_delay(attempts: Column, seed: int | None = None) -> Column:
    """Seconds; with a seed, up to JITTER more or less."""
    base = F.element_at(F.lit(list(RETRY_SECONDS)), F.least(F.greatest(attempts, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int")).cast("double")
    return base if seed is None else base * (1 - JITTER + 2 * JITTER * F.rand(seed))


def apply_outcomes(box: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Outcomes (Id, ok) of rows that are still in flight: Completed, or Pending with a later retry, or Failed after the last attempt."""
    joined = box.join(outcomes.select("Id", "ok"), "Id", "left")
    done = (F.col("Status") == IN_FLIGHT) & F.col("ok").isNotNull()
    attempts = F.when(done, F.col("AttemptCount") + 1).otherwise(F.col("AttemptCount"))
    again = done & ~F.col("ok") & (F.col("AttemptCount") + 1 < MOST_ATTEMPTS)
    status = F.when(done & F.col("ok"), COMPLETED).when(again, PENDING).when(done, FAILED).otherwise(F.col("Status"))
    later = (_at(now).cast("double") + retry_delay(F.col("AttemptCount") + 1)).cast("timestamp")
    return joined.select("Id", status.cast("int").alias("Status"), attempts.cast("int").alias("AttemptCount"), F.when(again, later).otherwise(F.when(~done, F.col("NextRetryAt"))).alias("NextRetryAt"))


def recover_leases(box: DataFrame, now: str) -> DataFrame:
    """Rows in flight whose lease has run out are pending again."""
    out = (F.col("Status") == IN_FLIGHT) & (F.col("LeaseExpiresAt") < _at(now))
    return box.withColumns({"Status": F.when(out, PENDING).otherwise(F.col("Status")).cast("int"), "LeaseExpiresAt": F.when(~out | out.isNull(), F.col("LeaseExpiresAt"))})


def classify(batch: DataFrame, ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Batch (id, fingerprint) against receipts and known sources: New, Replay, Conflict or Unverified (a source without receipt)."""
    receipts = ledger.select("id", F.col("fingerprint").alias("known"))
    joined = batch.join(receipts, "id", "left").join(sources.select("id", F.lit(True).alias("stored")), "id", "left")
    verdict = F.when(F.col("known") == F.col("fingerprint"), "Replay").when(F.col("known").isNotNull(), "Conflict").when(F.col("stored"), "Unverified").otherwise("New")
    return joined.select("id", "fingerprint", verdict.alias("verdict"))


def fan_in(events: DataFrame) -> DataFrame:
    """Rows (key, content, created, id): First of its key, a Duplicate of it, or a Conflict with it."""
    w = Window.partitionBy("key").orderBy("created", "id")
    marked = events.withColumns({"rn": F.row_number().over(w), "first": F.first("content").over(w)})
    return marked.select("id", "key", F.when(F.col("rn") == 1, "First").when(F.col("content").eqNullSafe(F.col("first")), "Duplicate").otherwise("Conflict").alias("verdict"))


def backoff_ms(attempt: Column, base_ms: int = 100, seed: int | None = None) -> Column:
    """Base x 2^(attempt - 1); with a seed, up to 30 % more."""
    plain = F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt - 1)
    return plain if seed is None else plain * (1 + 0.3 * F.rand(seed))


def handoffs(rows: DataFrame, now: str) -> DataFrame:
    """Expired dispatches are pending again; due pending rows in order, with the delay after a further failure."""
    reset = rows.withColumn("Status", F.when((F.col("Status") == IN_FLIGHT) & (F.col("LeaseExpiresAt") < _at(now)), PENDING).otherwise(F.col("Status")))
    due = reset.where((F.col("Status") == PENDING) & (F.col("NextRetryAt").isNull() | (F.col("NextRetryAt") <= _at(now))))
    delay = F.least(F.lit(3600), F.lit(5) * F.pow(F.lit(2), F.least(F.col("AttemptCount"), F.lit(10)))).cast("int")
    return ordered(due, "CreatedAt", "Id").select("Id", "CreatedAt", delay.alias("delay_s"))


def resolve(box: DataFrame, tenant: str, cycle: str, replay: bool) -> DataFrame:
    """Unresolved failed rows of a tenant and cycle: replayed ones are pending without attempts, skipped ones stay failed; all get a resolution."""
    hit = box.where((F.col("Status") == FAILED) & (F.col("TenantId") == tenant) & (F.col("FailureCycleId") == cycle) & F.col("ResolutionId").isNull())
    return hit.select("Id", F.lit(PENDING if replay else FAILED).alias("Status"), F.when(F.lit(replay), 0).otherwise(F.col("AttemptCount")).alias("AttemptCount"), F.lit("Replay" if replay else "Skip").alias("resolution"))


def cleanable(box: DataFrame, projections: DataFrame, receipts: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Completed or resolved rows past the window, with no pending projection and no live receipt."""
    old = F.col("CreatedAt") < _at(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    done = box.where(((F.col("Status") == COMPLETED) | F.col("ResolutionId").isNotNull()) & old)
    return done.join(projections.select("Id"), "Id", "left_anti").join(receipts.select("Id"), "Id", "left_anti").select("Id")


def expired_letters(letters: DataFrame, now: str, days: int) -> DataFrame:
    """What stays."""
    return letters.where(F.col("FailedAt") >= _at(now) - F.expr(f"INTERVAL {int(days)} DAYS"))


def purge_letters(letters: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Processed letters go after some hours."""
    gone = F.col("IsProcessed") & (F.col("ProcessedAt") < _at(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return letters.where(~F.coalesce(gone, F.lit(False)))


def capacity(letters: DataFrame, soft: int = 1000, hard: int = 5000) -> DataFrame:
    """One row: n and what the queue does with the next letter."""
    return letters.agg(F.count("*").alias("n")).withColumn("state", F.when(F.col("n") >= hard, "Reject").when(F.col("n") >= soft, "Warn").otherwise("Accept"))
