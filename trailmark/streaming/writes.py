"""Batches written with an outcome for each envelope, tried again where that helps, and put down as dead letters where it does not.

A batch is a bounded DataFrame, such as ``foreachBatch`` hands over. What may stop it as a whole is checked first; nothing is written of a batch that breaks the contract.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.sources.stored import Stored
from trailmark.storage import written

#: Kinds of envelopes; attempts after the first and the delay before the first of them; share of random delay on top.
ENTITY_CHANGE, EXPLICIT_EVENT = 0, 1
MOST_RETRIES, BASE_MS, JITTER = 3, 500, 0.3
OUTCOME = "envelope_id string, kind int, succeeded boolean, duplicate boolean, conflict boolean, retryable boolean, error string"


class ContractError(ValueError):
    """A batch, or a writer's answer to it, that must not be: nothing is tried again."""


class ConflictError(ValueError):
    """An id that is stored with other content: nothing is tried again."""


class DuplicateError(ValueError):
    """All of it is stored already: that is a success."""


class Cancelled(Exception):
    """The caller gave up: neither another attempt nor a dead letter."""


@dataclass(frozen=True)
class Written:
    """What became of a batch: success, duplicate, dead letters or emergency; after how many attempts, with which delays (ms)."""

    outcome: str
    attempts: int
    delays_ms: tuple[float, ...]


# one outcome for each envelope
def check_batch(rows: DataFrame, *ids: str) -> None:
    """No null row or id, and each id once. One pass that returns one row."""
    found = rows.agg(F.count("*").alias("n"), *(F.countDistinct(c).alias(f"d_{c}") for c in ids)).first()
    if any(found[f"d_{c}"] != found.n for c in ids):
        raise ContractError(f"each of {', '.join(ids)} must be there, and once")


def check_outcomes(outcomes: DataFrame, expected: DataFrame) -> None:
    """Exactly one outcome, consistent in itself, for each expected envelope_id."""
    ok, other = F.coalesce("succeeded", F.lit(False)), F.coalesce("conflict", F.lit(False)) | F.coalesce("retryable", F.lit(False)) | F.col("error").isNotNull()
    odd = F.col("succeeded").isNull() | (ok & other) | (~ok & F.coalesce("duplicate", F.lit(False))) | (F.coalesce("conflict", F.lit(False)) & F.coalesce("retryable", F.lit(False)))
    told = outcomes.groupBy("envelope_id").agg(F.count("*").alias("told"), F.max(odd).alias("odd"))
    joined = expected.select("envelope_id", F.lit(True).alias("asked")).join(told, "envelope_id", "full")
    wrong = joined.where(F.col("asked").isNull() | F.col("told").isNull() | (F.col("told") != 1) | F.col("odd"))
    if not wrong.isEmpty():
        raise ContractError("a writer must return one consistent outcome for each envelope")


def row_outcomes(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows (row_id, envelope_id, kind) and outcomes -> (row_id, status, error): Succeeded, Duplicate, RetryLater or Failed. Rows of a kind that nobody writes fail without having been asked about."""
    known = F.coalesce(F.col("kind").isin(ENTITY_CHANGE, EXPLICIT_EVENT), F.lit(False))
    check_batch(rows, "row_id", "envelope_id")
    check_outcomes(outcomes, rows.where(known))
    joined = rows.select("row_id", "envelope_id", "kind").join(outcomes.drop("kind"), "envelope_id", "left")
    unhandled = F.concat(F.lit("Unhandled AuditEnvelopeKind: "), F.coalesce(F.col("kind").cast("string"), F.lit("null")))
    status = F.when(~known, "Failed").when(F.col("duplicate"), "Duplicate").when(F.col("succeeded"), "Succeeded").when(F.col("retryable"), "RetryLater").otherwise("Failed")
    error = F.when(~known, unhandled).when(~F.col("succeeded"), F.coalesce("error", F.lit("Unknown error")))
    return joined.select("row_id", status.alias("status"), error.alias("error"))


def retry_all(rows: DataFrame, error: str) -> DataFrame:
    """The outcomes of a writer that raised: all of its envelopes may be tried again."""
    return rows.select("envelope_id", "kind", F.lit(False).alias("succeeded"), F.lit(False).alias("duplicate"), F.lit(False).alias("conflict"), F.lit(True).alias("retryable"), F.lit(error).alias("error"))


def batch_metrics(rows: DataFrame, statuses: DataFrame, now: str) -> DataFrame:
    """By kind, how many rows there were, of each status, and the greatest age in seconds (rows of the future have none)."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("created").cast("double")
    joined = rows.select("row_id", "kind", F.when(age >= 0, age).alias("age")).join(statuses, "row_id")
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return joined.groupBy("kind").agg(F.count("*").alias("n"), *map(count, ("Succeeded", "Duplicate", "RetryLater", "Failed")), F.max("age").alias("oldest_s"))


# the two writers
def write_once(table: Stored, envelopes: DataFrame, fingerprint: Column) -> tuple[Stored, DataFrame]:
    """Envelopes, each id once, that the table lacks are added; the others are duplicates, or in conflict with what is stored. Only the buckets of their ids are read and written."""
    rows = written(envelopes.withColumn("fingerprint", fingerprint), "to-write")
    stored = table.read(table.touched(rows)).select("envelope_id", F.col("fingerprint").alias("known"))
    judged = written(rows.join(stored, "envelope_id", "left"), "judged")
    new, same = F.col("known").isNull(), F.col("known") == F.col("fingerprint")
    table = table.upsert(judged.where(new).select(table.schema.names))
    conflict = ~new & ~same
    said = judged.select("envelope_id", "kind", (~conflict).alias("succeeded"), (~new & same).alias("duplicate"), conflict.alias("conflict"), F.lit(False).alias("retryable"), F.when(conflict, "audit_identity_conflict").alias("error"))
    return table, said


def publish(envelopes: DataFrame, entities: Stored, events: Stored, fingerprint: Column) -> tuple[Stored, Stored, DataFrame]:
    """A batch split by kind and written by two writers that know nothing of each other: what one refuses does not undo the other. Third: the outcomes; those that did not succeed are what the caller must be told.

    An unknown kind, a null id or one that occurs twice stops the batch before anything is written.
    """
    check_batch(envelopes, "envelope_id")
    if not envelopes.where(~F.coalesce(F.col("kind").isin(ENTITY_CHANGE, EXPLICIT_EVENT), F.lit(False))).isEmpty():
        raise ContractError("an envelope is of a kind that nobody writes")
    entities, first = write_once(entities, envelopes.where(F.col("kind") == ENTITY_CHANGE), fingerprint)
    events, second = write_once(events, envelopes.where(F.col("kind") == EXPLICIT_EVENT), fingerprint)
    return entities, events, first.unionByName(second)


# attempts
def delay_ms(attempt: int, base_ms: float = BASE_MS, draw: Callable[[], float] = random.random) -> float:
    """Before the attempt of that number, from 1 for the first retry: base x 2^(n - 1) and up to 30 % more."""
    return base_ms * 2 ** (attempt - 1) * (1 + JITTER * draw())


def persistently(
    batch: DataFrame,
    write: Callable[[DataFrame], None],
    put_down: Callable[[DataFrame, str], None],
    emergency: Callable[[DataFrame], None],
    most_retries: int = MOST_RETRIES,
    base_ms: float = BASE_MS,
    sleep: Callable[[float], None] = time.sleep,
) -> Written:
    """Writes a batch, and again after a growing delay where that failed.

    Contract breaks, conflicts and cancellation go to the caller at once. Duplicates are a success. After the last attempt the events are put down as dead letters,
    with the reason; where that fails too, they go to the emergency folder. ``write`` must bear being run twice over a batch: it cannot be known what a failed attempt left behind.
    """
    if most_retries < 0:
        raise ValueError("there cannot be less than one attempt")
    delays: list[float] = []
    for attempt in range(most_retries + 1):
        if attempt:
            delays.append(delay_ms(attempt, base_ms))
            sleep(delays[-1] / 1000)
        try:
            write(batch)
        except (ContractError, ConflictError, Cancelled):
            raise
        except DuplicateError:
            return Written("duplicate", attempt + 1, tuple(delays))
        except (PySparkException, Py4JError, OSError, RuntimeError):
            continue
        return Written("success", attempt + 1, tuple(delays))
    try:
        put_down(batch, f"Batch failed after {most_retries + 1} attempts")
    except (PySparkException, Py4JError, OSError, RuntimeError):
        emergency(batch)
        return Written("emergency", most_retries + 1, tuple(delays))
    return Written("dead letters", most_retries + 1, tuple(delays))


def letters_of(batch: DataFrame, reason: str, at: str, event_id: str = "EventId", event_type: str = "EventType") -> DataFrame:
    """The dead letters of a batch, one for each event, as :mod:`trailmark.streaming.letter_files` puts them down."""
    return batch.select(F.col(event_id).alias("Id"), F.lit(at).cast("timestamp").alias("FailedAt"), F.lit(reason).alias("FailureReason"), F.lit(0).alias("RetryCount"), F.lit(False).alias("IsProcessed"), F.col(event_type).alias("EventType"))


def emergency_file(batch: DataFrame, folder: str, redacted: dict[str, Column]) -> None:
    """The events as new files of JSON lines, in a folder of the shared file system; the named columns are redacted first."""
    batch.withColumns(redacted).write.json(f"{folder}/emergency-{uuid4().hex}")


def guarded(write: Callable[[DataFrame, int], None], put_down: Callable[[DataFrame, str], None], emergency: Callable[[DataFrame], None], **how) -> Callable[[DataFrame, int], None]:  # noqa: ANN003
    """T15 as what ``foreachBatch`` calls: the stream goes on past a batch that could not be written, as its events are dead letters. Contract breaks and conflicts end the query."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            persistently(batch, lambda b: write(b, number), put_down, emergency, **how)
        finally:
            batch.unpersist()

    return run
