"""Idempotent ingest with Structured Streaming.

Envelope files are read as a stream; keyed state tells which envelope is new (:mod:`trailmark.streaming.ledger`), and ``foreachBatch`` writes the batch. The
checkpoint owns offsets and state, and a batch that is written again after a failure overwrites its own folder, so each envelope is stored once. A conflict is stored as such.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from trailmark.functions.text import iso_time
from trailmark.streaming.ledger import chained, keyed_state, verdicts

ENVELOPE = "envelope_id string, kind int, entity_name string, action int, occurred_at timestamp, changes array<struct<name:string,old:string,new:string>>, subjects array<struct<id:string,relationship:string>>, payload string"


def entity_rows(envelopes: DataFrame) -> DataFrame:
    """A log row for each changed property, or one without a property, keyed by (envelope, property)."""
    rows = envelopes.where("kind = 0").select("envelope_id", "entity_name", "action", "occurred_at", F.explode_outer("changes").alias("c"))
    return rows.select("envelope_id", "entity_name", "action", "occurred_at", F.col("c.name").alias("property"), F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value")).dropDuplicates(["envelope_id", "property"])


def subject_rows(envelopes: DataFrame) -> DataFrame:
    """Subject links, each once."""
    return envelopes.select("envelope_id", "occurred_at", F.inline("subjects")).withColumnRenamed("id", "subject_id").distinct()


def event_rows(envelopes: DataFrame) -> DataFrame:
    """Explicit events."""
    return envelopes.where("kind = 1").select("envelope_id", "entity_name", "action", "occurred_at", "payload")


TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def judged(envelopes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A stream of envelopes with the verdict on each: New, Replay, Conflict, or Unverified where ``sources`` (id) are stored without a receipt.

    What is compared is the content: all but the time. Of an envelope's versions in one batch the earliest is new, whichever order they come in.
    """
    content = F.struct("kind", "entity_name", "action", "changes", F.array_sort(F.array_distinct("subjects")).alias("subjects"), "payload")
    row = F.to_json(F.struct(*envelopes.columns), TIMES)
    keyed = envelopes.select(F.col("envelope_id").alias("id"), iso_time(F.col("occurred_at")).alias("place"), F.sha2(F.encode(F.to_json(content), "UTF-8"), 256).alias("fingerprint"), row.alias("body"))
    return verdicts(keyed, sources).select("verdict", F.from_json("body", envelopes.schema.simpleString(), TIMES).alias("e")).select("verdict", "e.*")


def write_batch(batch: DataFrame, number: int, out: str) -> None:
    """The new envelopes of a judged batch into three tables, and the verdict on each envelope into a fourth."""
    batch = batch.persist()  # read once for four tables
    new = batch.where("verdict = 'New'")
    said = batch.select("envelope_id", "occurred_at", "kind", "verdict")
    for name, rows in (("logs", entity_rows(new)), ("links", subject_rows(new)), ("events", event_rows(new)), ("verdicts", said)):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    batch.unpersist()


def drain(spark: SparkSession, source: str, out: str, checkpoint: str, files_a_batch: int = 100, schema: str | StructType = ENVELOPE, sources: DataFrame | None = None) -> StreamingQuery:
    """Works off the files that are there, some a batch, and ends."""
    stream = judged(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(source), sources)
    with keyed_state(spark):
        return stream.writeStream.foreachBatch(lambda b, n: write_batch(b, n, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_events(spark: SparkSession, source: str, out: str, checkpoint: str, size: int = 100, interval_ms: int = 1000, files_a_batch: int = 100, links: DataFrame | None = None) -> StreamingQuery:
    """A running query that links the events (chain, EventId, at, EventHash) of a folder's files. Timers need batches without input too, so it does not end by itself: see :func:`until_idle`."""
    events = spark.readStream.schema("chain string, EventId string, at string, EventHash string").option("maxFilesPerTrigger", files_a_batch).json(source)
    with keyed_state(spark):
        return chained(events, size, interval_ms, links).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="100 milliseconds").start()


def until_idle(query: StreamingQuery, batches: int = 3, seconds: float = 600) -> None:
    """Stops a query after some batches in a row without input. Raises if it failed, or is busy after so many seconds."""
    end = time.monotonic() + seconds
    while query.isActive and time.monotonic() < end:
        last = query.recentProgress[-batches:]
        if len(last) == batches and not any(p["numInputRows"] for p in last):
            query.stop()
            return
        time.sleep(0.1)
    failed = query.exception()
    query.stop()
    raise failed or TimeoutError(f"the query was busy for {seconds} s")


class Metrics(StreamingQueryListener):
    """What the session's streams have worked off: batches, rows, seconds of the longest batch and rows in state (of receipts: pages, see :func:`trailmark.streaming.ledger.receipts_held`), by query. Register it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, float]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.totals.setdefault(str(event.runId), {"batches": 0, "rows": 0, "longest_s": 0.0, "state_rows": 0})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        t = self.totals[str(p.runId)]
        t["batches"] += p.numInputRows > 0
        t["rows"] += p.numInputRows
        t["longest_s"] = max(t["longest_s"], p.durationMs.get("triggerExecution", 0) / 1000)
        t["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, seconds: float = 30) -> dict[str, float]:
        """The totals of a query that has ended; events come a little later than the end."""
        end = time.monotonic() + seconds
        while str(query.runId) not in self.ended and time.monotonic() < end:
            time.sleep(0.05)
        return self.totals[str(query.runId)]


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rate of the last batches."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]
