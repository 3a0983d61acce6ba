"""Verdicts on envelopes in the stream, and the chain of integrity links, by keyed state.

Both are stateful processors: what is kept of earlier envelopes and events lies in the state store, and a batch looks up what its own keys need only, however long the
history is. Receipts lie there in pages, as each look-up is a call from Python to the store: a page takes one call to read and one to write,
however many of its ids a batch holds. The store must be RocksDB, which holds it on disk and logs its changes to the checkpoint; :func:`keyed_state` sees to that for one query.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Envelopes are looked up by hash buckets of their ids: one call a bucket and batch instead of one an envelope. Part of a checkpoint, so not to be changed for one.
LEDGER_BUCKETS = 256
#: Receipts a page, on average, beyond which a bucket doubles its pages: some 12 kB.
PAGE_RECEIPTS = 100
#: Version of the fingerprint; a receipt of another one proves nothing.
CONTENT_VERSION = 1
SOURCE_ONLY = ""
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def bucket_of(key: Column) -> Column:
    return (F.crc32(F.encode(F.coalesce(key, F.lit("")), "UTF-8")) % LEDGER_BUCKETS).cast("int")


def _page_of(key: str, pages: int) -> int:
    """The page within its bucket, by the bits of the checksum that do not tell the bucket."""
    return zlib.crc32(key.encode()) // LEDGER_BUCKETS % pages


class Ledger(StatefulProcessor):
    """Keyed by bucket; rows (id, place, receipt, body) -> (id, verdict, body), in the order of place and receipt.

    New: the first of its id. Replay: it equals the receipt. Conflict: it differs. Unverified: a stored source has no receipt, or one of another version.

    A bucket's pages double as its receipts do, so a page stays as small however many there are, and a receipt is moved once or twice in all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "pages int, receipts long")
        self.pages = handle.getMapState("receipts", "page int", "receipts string")

    def _page(self, page: int) -> dict[str, str]:
        stored = self.pages.getValue((page,))
        return json.loads(stored[0]) if stored else {}

    def _put(self, page: int, receipts: dict[str, str]) -> None:
        self.pages.updateValue((page,), (json.dumps(receipts, separators=(",", ":")),))

    def _sized(self, coming: int) -> tuple[int, int]:
        """Pages and receipts of the bucket, after its pages are doubled as often as its receipts, or the first ones that come, need it."""
        before, held = tuple(self.size.get()) if self.size.exists() else (1, 0)
        pages = before
        while (held or coming) > pages * PAGE_RECEIPTS:
            pages *= 2
        for page in range(before if held and pages > before else 0):
            parts: defaultdict[int, dict[str, str]] = defaultdict(dict)
            for k, receipt in self._page(page).items():
                parts[_page_of(k, pages)][k] = receipt
            for at in {page, *parts}:
                self._put(at, parts[at])
        return pages, held

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        """Stored sources without a receipt."""
        pages, held = self._sized(len(initialState))
        for page, ids in initialState.assign(page=[_page_of(k, pages) for k in initialState["id"]]).groupby("page")["id"]:
            known = self._page(page)
            held -= len(known)
            known |= dict.fromkeys(ids, SOURCE_ONLY)
            held += len(known)
            self._put(page, known)
        self.size.update((pages, held))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(rows)
        pages, held = self._sized(len(batch))
        batch = batch.assign(page=[_page_of(k, pages) for k in batch["id"]]).sort_values(["page", "place", "receipt"], kind="stable")
        verdicts = []
        for page, lines in groupby(zip(batch["page"].tolist(), batch["id"], batch["receipt"], strict=True), lambda x: x[0]):
            known = self._page(page)
            before = len(known)
            for _, k, receipt in lines:
                stored = known.get(k)
                if stored is None:
                    known[k] = receipt
                    verdicts.append("New")
                else:
                    verdicts.append("Unverified" if stored.split(":")[0] != receipt.split(":")[0] else "Replay" if stored == receipt else "Conflict")
            if len(known) > before:
                self._put(page, known)
                held += len(known) - before
        self.size.update((pages, held))
        yield pd.DataFrame({"id": batch["id"], "verdict": verdicts, "body": batch["body"]})

    def close(self) -> None:
        pass


def verdicts(envelopes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A stream (id, place, fingerprint, body) -> (id, verdict, body). ``place`` orders the versions of an id in one batch; ``sources`` (id), looked at when the stream first starts, are stored without a receipt."""
    at = (bucket_of(F.col("id")).alias("bucket"), F.coalesce("id", F.lit("")).alias("id"))
    rows = envelopes.select(*at, F.coalesce("place", F.lit("")).alias("place"), F.concat(F.lit(f"{CONTENT_VERSION}:"), "fingerprint").alias("receipt"), "body")
    stored = None if sources is None else sources.select(*at).groupBy("bucket")
    return rows.groupBy("bucket").transformWithStateInPandas(Ledger(), "id string, verdict string, body string", "Append", "None", initialState=stored)


def receipts_held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(page, id) of each receipt in the state that a query of :func:`verdicts` has left at its checkpoint."""
    pages = spark.read.format("statestore").option("stateVarName", "receipts").load(checkpoint)
    return pages.select(F.col("user_map_key.page").alias("page"), F.explode(F.json_object_keys("user_map_value.receipts")).alias("id"))


class Chain(StatefulProcessor):
    """Keyed by chain; events (EventId, at, EventHash) -> their links, as many at once as a batch holds, or what is there when the interval is over.

    Events that have a link, and repeated ones, do not come here (:func:`chained`). Within a call events are taken in the order of at and EventId.
    """

    def __init__(self, size: int, interval_ms: int) -> None:
        self.size, self.interval_ms = size, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "EventId string, EventHash string")
        self.head = handle.getValueState("head", "number long, hash string, flushes long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        """The link (number, hash) of highest number; the chain goes on from it."""
        for last in initialState.itertuples():
            number, text, flushes = self._at_head()
            if last.number > number:
                self.head.update((int(last.number), last.hash, flushes))

    def _at_head(self) -> tuple[int, str | None, int]:
        return tuple(self.head.get()) if self.head.exists() else (0, None, 0)

    def _flush(self, chain: str, events: list[tuple[str, str]], cause: str) -> pd.DataFrame:
        number, before, flushes = self._at_head()
        hashes = [h for _, h in events]
        self.head.update((number + len(events), hashes[-1], flushes + 1))
        return pd.DataFrame({"chain": chain, "EventId": [k for k, _ in events], "EventHash": hashes, "SequenceNumber": range(number + 1, number + len(events) + 1), "PreviousEventHash": [before, *hashes[:-1]], "flush": flushes + 1, "cause": cause})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(rows).sort_values(["at", "EventId"], kind="stable")
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        before = len(held)
        held += zip(batch["EventId"], batch["EventHash"], strict=True)
        full = len(held) - len(held) % self.size
        for at in range(0, full, self.size):
            yield self._flush(key[0], held[at : at + self.size], "count")
        held = held[full:]
        if full or (held and not before):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
        self.waiting.put(held) if held else self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if held:
            yield self._flush(key[0], held, "time")

    def close(self) -> None:
        pass


LINKS = "chain string, EventId string, EventHash string, SequenceNumber long, PreviousEventHash string, flush long, cause string"


def chained(events: DataFrame, size: int = 100, interval_ms: int = 1000, links: DataFrame | None = None) -> DataFrame:
    """A stream (chain, EventId, at, EventHash) -> :data:`LINKS`. ``links`` (chain, EventId, number, hash) are those that there are when the stream first starts; number and hash may be null where the chain does not go on from them.

    Whether an event has a link or came before is found by event, over all tasks: by a join with ``links``, to be given again when the stream goes on, and by the ids in state. Of an event's repeats in
    one batch any may stay. Only new events come to their chain, which is a sequence, so they are numbered one after another: how much a batch holds is bounded by the source's options, and chains are
    worked off side by side.
    """
    rows = events.select("chain", "EventId", F.coalesce("at", F.lit("~")).alias("at"), "EventHash")
    before = None
    if links is not None:
        rows = rows.join(links.select("chain", "EventId"), ["chain", "EventId"], "left_anti")
        last = links.where("number IS NOT NULL").groupBy("chain").agg(F.max_by(F.struct(F.col("number").cast("long").alias("number"), "hash"), "number").alias("last"))
        before = last.select("chain", "last.number", "last.hash").groupBy("chain")
    fresh = rows.dropDuplicates(["chain", "EventId"])
    return fresh.groupBy("chain").transformWithStateInPandas(Chain(size, interval_ms), LINKS, "Append", "ProcessingTime", initialState=before)
