"""The staged ingest stores each envelope once, over repeated files, repeated runs and a repeated batch."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from trailmark.plans import q_streaming
from trailmark.streaming import ingest, ledger, letter_files


def envelope(k, kind=0, changes=()):
    return {"envelope_id": f"e{k}", "kind": kind, "entity_name": "Order", "action": 2, "occurred_at": "2024-01-01T00:00:00Z", "changes": [{"name": n, "old": "1", "new": "2"} for n in changes], "subjects": [{"id": "s1", "relationship": "owner"}] * 2, "payload": "{}"}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_each_envelope_is_stored_once(spark, tmp_path):
    source, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    put(source, "1.json", [envelope(1, changes=("a", "b")), envelope(2), envelope(3, kind=1), envelope(1, changes=("a",))])
    ingest.drain(spark, str(source), out, offsets).awaitTermination()
    put(source, "2.json", [envelope(2), envelope(4, changes=("c",))])
    query = ingest.drain(spark, str(source), out, offsets)
    query.awaitTermination()
    stored = {t: spark.read.parquet(f"{out}/{t}") for t in ("verdicts", "logs", "links", "events")}
    assert sorted((r.envelope_id, r.verdict) for r in stored["verdicts"].collect()) == [("e1", "Conflict"), ("e1", "New"), ("e2", "New"), ("e2", "Replay"), ("e3", "New"), ("e4", "New")]
    first = min([("e1", "a")], [("e1", "a"), ("e1", "b")], key=lambda kept: len(kept) != stored["logs"].where("envelope_id = 'e1'").count())  # of equal times either may be the first
    assert {(r.envelope_id, r.property) for r in stored["logs"].collect()} == {*first, ("e2", None), ("e4", "c")}
    assert stored["links"].count() == 4 and [r.envelope_id for r in stored["events"].collect()] == ["e3"]
    assert ingest.progress(query)[-1]["rows"] >= 2


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.read.schema(ingest.ENVELOPE).json(spark.sparkContext.parallelize([json.dumps(envelope(k, changes=("a",))) for k in range(5)])).withColumn("verdict", F.lit("New"))
    for number in (0, 0):
        ingest.write_batch(rows, number, out)
    assert spark.read.parquet(f"{out}/verdicts").count() == spark.read.parquet(f"{out}/logs").count() == 5


def test_verdicts_of_conflicts_replays_and_sources(spark, tmp_path):
    source, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    sources = spark.createDataFrame([("e7",)], "id string")
    put(source, "1.json", [envelope(1), envelope(7), envelope(2) | {"subjects": [{"id": "a", "relationship": "x"}, {"id": "b", "relationship": "x"}]}])
    ingest.drain(spark, str(source), out, offsets, sources=sources).awaitTermination()
    put(source, "2.json", [envelope(1) | {"occurred_at": "2025-01-01T00:00:00Z"}, envelope(1, changes=("z",)), envelope(7), envelope(2) | {"subjects": [{"id": "b", "relationship": "x"}, {"id": "a", "relationship": "x"}] * 2}])
    ingest.drain(spark, str(source), out, offsets, sources=sources).awaitTermination()
    said = sorted((r.batch > 0, r.envelope_id, r.verdict) for r in spark.read.parquet(f"{out}/verdicts").collect())
    assert said == [(False, "e1", "New"), (False, "e2", "New"), (False, "e7", "Unverified"), (True, "e1", "Conflict"), (True, "e1", "Replay"), (True, "e2", "Replay"), (True, "e7", "Unverified")]


class CountedState:
    """State of one bucket in memory, as a processor's handle gives it; counts the calls to it."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getMapState(self, name, *schemas):  # noqa: N802
        return self

    def getValueState(self, name, *schemas):  # noqa: N802
        return ValueOf(self)

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.values[key] = value


class ValueOf:
    def __init__(self, state):
        self.state, self.value = state, None

    def exists(self):
        self.state.calls += 1
        return self.value is not None

    def get(self):
        self.state.calls += 1
        return self.value

    def update(self, value):
        self.state.calls += 1
        self.value = value


def test_a_batch_takes_few_calls_to_the_state_however_many_receipts_there_are():
    rng, state, model, rows = random.Random(4), CountedState(), {}, 0
    judge = ledger.Ledger()
    judge.init(state)
    for part in (range(1), range(300), range(200, 600)):
        judge.handleInitialState((0,), pd.DataFrame({"id": [f"s{k}" for k in part]}), None)
    model |= {f"s{k}": "" for k in range(600)}
    for size in (40, 3000, 20_000, 20_000, 100):
        batch = pd.DataFrame({"id": [rng.choice((f"s{rng.randrange(900)}", f'\u00fc"{rng.randrange(30_000)}')) for _ in range(size)]})
        batch = batch.assign(place=[f"{rng.randrange(5)}" for _ in range(size)], receipt=[f"1:{rng.randrange(3)}" for _ in range(size)], body=[f"b{k}" for k in range(size)])
        wanted = {}
        for r in batch.sort_values(["place", "receipt"], kind="stable").itertuples():
            before = model.setdefault(r.id, None)
            wanted[r.body] = (r.id, "New" if before is None else "Unverified" if before == "" else "Replay" if before == r.receipt else "Conflict")
            model[r.id] = r.receipt if before is None else before
        said = pd.concat(judge.handleInputRows((0,), iter([batch[: size // 2], batch[size // 2 :]]), None))
        assert {r.body: (r.id, r.verdict) for r in said.itertuples()} == wanted
        rows += size
    assert state.calls < rows / 20
    pages = [json.loads(v[0]) for v in state.values.values()]
    assert {k: v for page in pages for k, v in page.items()} == model and sum(map(len, pages)) == len(model)
    assert max(map(len, pages)) < 3 * ledger.PAGE_RECEIPTS


def test_receipts_in_state_are_those_of_the_ids(spark, tmp_path):
    source, offsets = tmp_path / "in", str(tmp_path / "offsets")
    ids = [f"e{k}" for k in range(700)] + ['"', "\\", "\u00fc\u2028", ""]
    for name, some in (("1.json", ids[:60]), ("2.json", ids)):
        put(source, name, [envelope(0) | {"envelope_id": k} for k in some])
        ingest.drain(spark, str(source), str(tmp_path / "out"), offsets, sources=spark.createDataFrame([("e7",), ("s",)], "id string")).awaitTermination()
    assert sorted(r.id for r in ledger.receipts_held(spark, offsets).collect()) == sorted([*ids, "s"])


def test_chains_are_flushed_by_count_and_by_time(spark, tmp_path):
    """Two chains over two runs: one goes on from a link that there is; events come twice; what is short of a batch waits for its time."""
    source, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    event = lambda chain, k: {"chain": chain, "EventId": f"{chain}{k:03}", "at": f"t{k:03}", "EventHash": f"h{chain}{k}"}
    links = spark.createDataFrame([("a", "a000", 41, "before"), ("b", "b003", None, None)], "chain string, EventId string, number long, hash string")
    put(source, "1.json", [event("a", k) for k in reversed(range(8))] + [event("b", k) for k in range(5)])
    run = lambda: ingest.until_idle(ingest.chain_events(spark, str(source), out, offsets, size=3, interval_ms=1, links=links))
    run()
    put(source, "2.json", [event("a", k) for k in range(4, 11)])
    run()
    got = {r.EventId: r for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() == 10 + 4 and "a000" not in got and "b003" not in got
    for chain, first, number, before in (("a", 1, 42, "before"), ("b", 0, 1, None)):
        rows = sorted((r for r in got.values() if r.chain == chain), key=lambda r: r.SequenceNumber)
        assert [r.SequenceNumber for r in rows] == list(range(number, number + len(rows)))
        assert [r.PreviousEventHash for r in rows] == [before, *(r.EventHash for r in rows[:-1])]
        assert [r.EventId for r in rows] == sorted(r.EventId for r in rows) and rows[0].EventId == f"{chain}00{first}"
        sizes = {r.flush: (r.cause, sum(x.flush == r.flush for x in rows)) for r in rows}
        assert all(n == 3 if cause == "count" else n < 3 for cause, n in sizes.values()) and {"count", "time"} == {cause for cause, _ in sizes.values()}


def test_the_whole_table_is_ingested(spark, tmp_path):
    n = F.col("id")
    events = spark.range(2500).select(n.alias("event_id"), F.timestamp_seconds(n).alias("ts"), (n % 7).alias("user_id"), F.lit("{}").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    new = q_streaming.drained("verdicts")(spark, str(tmp_path)).where("verdict = 'New'").collect()
    assert sorted(int(r.envelope_id[-12:]) for r in new) == [k for k in range(2500) if k % 40 != 39]


def test_dead_letters_are_taken_up_once_and_purged(spark, tmp_path):
    folder, out, offsets = str(tmp_path / "letters"), str(tmp_path / "out"), str(tmp_path / "offsets")
    letters = spark.range(10).select(F.col("id").cast("string").alias("Id"), F.timestamp_seconds("id").alias("FailedAt"), F.lit("Timeout").alias("FailureReason"), F.lit(0).alias("RetryCount"), F.lit(False).alias("IsProcessed"), F.lit("A").alias("EventType"), F.lit("left out").alias("Other"))
    assert letter_files.waiting(spark, folder).count() == 0 and letter_files.purge_processed(spark, folder, datetime(2030, 1, 1)) == 0
    letter_files.put(letters.where("id < 7"), folder)
    assert letter_files.queue_state(spark, folder, 5, 8).first().asDict() == {"n": 7, "state": "Warn"}
    letter_files.take_up(spark, folder, out, offsets, 1).awaitTermination()
    letter_files.put(letters.where("id >= 7"), folder)
    letter_files.take_up(spark, folder, out, offsets, 1).awaitTermination()
    assert letter_files.waiting(spark, folder).count() == 0
    assert sorted(int(r.Id) for r in spark.read.parquet(out).collect()) == list(range(10))
    assert letter_files.purge_processed(spark, folder, datetime.now() - timedelta(days=2)) == 0
    assert letter_files.purge_processed(spark, folder, datetime.now() + timedelta(days=2)) > 0
    batch = letters.limit(2).drop("Other").withColumn("file", F.lit(f"{folder}/waiting/gone.json"))
    letter_files.store_batch(batch, 99, folder, out)  # a batch that is done again, after its files went aside
    assert spark.read.parquet(out).where("batch = 99").count() == 2
