"""Batches with an outcome for each envelope, and attempts."""

import pytest
from pyspark.sql import functions as F

from trailmark.sources.stored import Stored
from trailmark.streaming import letter_files as lf
from trailmark.streaming import writes as w

ROWS = "row_id long, envelope_id string, kind int"


def outcomes(spark, *rows):
    return spark.createDataFrame(rows, w.OUTCOME)


def test_rows_get_the_status_of_their_envelopes(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 1), (4, "d", 1), (5, "e", 9), (6, "f", None)], ROWS)
    said = outcomes(spark, ("a", 0, True, False, False, False, None), ("b", 0, True, True, False, False, None), ("c", 1, False, False, False, True, "busy"), ("d", 1, False, False, True, False, None))
    got = {r.row_id: (r.status, r.error) for r in w.row_outcomes(rows, said).collect()}
    assert got == {1: ("Succeeded", None), 2: ("Duplicate", None), 3: ("RetryLater", "busy"), 4: ("Failed", "Unknown error"), 5: ("Failed", "Unhandled AuditEnvelopeKind: 9"), 6: ("Failed", "Unhandled AuditEnvelopeKind: null")}
    aged = rows.withColumn("created", F.expr("CASE WHEN row_id = 1 THEN TIMESTAMP '2024-01-01 00:00:10' ELSE TIMESTAMP '2024-01-02' END"))
    told = {r.kind: r for r in w.batch_metrics(aged, w.row_outcomes(rows, said), "2024-01-01 00:01:00").collect()}
    assert (told[0].n, told[0].succeeded, told[0].duplicate, told[0].oldest_s) == (2, 1, 1, 50.0)
    assert (told[1].retrylater, told[1].failed, told[1].oldest_s) == (1, 1, None)
    none = rows.limit(0)
    assert w.row_outcomes(none, outcomes(spark)).count() == 0


@pytest.mark.parametrize("rows", [[(1, "a", 0), (1, "b", 0)], [(1, "a", 0), (2, "a", 0)], [(1, None, 0)], [(None, "a", 0)]])
def test_claimed_rows_are_unique(spark, rows):
    with pytest.raises(w.ContractError):
        w.check_batch(spark.createDataFrame(rows, ROWS), "row_id", "envelope_id")


ONE = ("a", 0, True, False, False, False, None)
ODD = {
    "none": [],
    "twice": [ONE, ONE],
    "another": [("b", *ONE[1:])],
    "one more": [ONE, ("b", *ONE[1:])],
    "null": [("a", 0, None, False, False, False, None)],
    "success with an error": [("a", 0, True, False, False, False, "x")],
    "success to be tried again": [("a", 0, True, False, False, True, None)],
    "failed duplicate": [("a", 0, False, True, False, False, "x")],
    "conflict to be tried again": [("a", 0, False, False, True, True, "x")],
}


@pytest.mark.parametrize("name", ODD)
def test_writers_that_break_the_contract(spark, name):
    rows = spark.createDataFrame([(1, "a", 0)], ROWS)
    w.check_outcomes(outcomes(spark, ONE), rows)
    with pytest.raises(w.ContractError):
        w.row_outcomes(rows, outcomes(spark, *ODD[name]))


def test_what_one_writer_refuses_does_not_undo_the_other(spark, tmp_path):
    shape = "envelope_id string, kind int, payload string"
    batch = lambda *rows: spark.createDataFrame(rows, shape)
    tables = [Stored.create(batch().withColumn("fingerprint", F.lit("")), str(tmp_path / n), "pmod(xxhash64(envelope_id), 4)", "envelope_id") for n in "ab"]
    same = F.sha2(F.encode(F.coalesce("payload", F.lit("")), "UTF-8"), 256)
    *tables, first = w.publish(batch(("x", 0, "1"), ("y", 1, None)), *tables, same)
    *tables, second = w.publish(batch(("x", 0, "2"), ("y", 1, None), ("z", 1, "3")), *tables, same)
    told = lambda df: {r.envelope_id: (r.succeeded, r.duplicate, r.conflict) for r in df.collect()}
    assert told(first) == {"x": (True, False, False), "y": (True, False, False)}
    assert told(second) == {"x": (False, False, True), "y": (True, True, False), "z": (True, False, False)}
    w.check_outcomes(second, batch(("x", 0, None), ("y", 1, None), ("z", 1, None)))
    assert [sorted(r.payload or "" for r in t.read().collect()) for t in tables] == [["1"], ["", "3"]]
    for bad in (batch(("q", 0, "1"), ("r", 2, "1")), batch(("q", 0, "1"), ("q", 1, "1")), batch((None, 0, "1"))):
        with pytest.raises(w.ContractError):
            w.publish(bad, *tables, same)
    assert [Stored.open(spark, t.path).number for t in tables] == [t.number for t in tables]


def failing(times, error=RuntimeError):
    tries = []

    def write(_):
        tries.append(1)
        if len(tries) <= times:
            raise error("x")

    return write, tries


def test_attempts_and_delays():
    down, lost, slept = [], [], []
    put = lambda b, reason: down.append(reason)
    run = lambda write, **k: w.persistently("batch", write, put, lost.append, sleep=slept.append, **k)
    write, tries = failing(2)
    got = run(write)
    assert (got.outcome, got.attempts, len(tries)) == ("success", 3, 3) and slept == [d / 1000 for d in got.delays_ms]
    assert all(500 * 2**n <= d <= 650 * 2**n for n, d in enumerate(got.delays_ms))
    assert run(failing(9)[0]).outcome == "dead letters" and down == ["Batch failed after 4 attempts"]
    assert run(failing(1)[0], most_retries=0) == w.Written("dead letters", 1, ())
    assert run(failing(1, w.DuplicateError)[0]).outcome == "duplicate"
    for error in (w.ConflictError, w.ContractError, w.Cancelled):
        write, tries = failing(1, error)
        with pytest.raises(error):
            run(write)
        assert len(tries) == 1
    with pytest.raises(ValueError):
        run(failing(0)[0], most_retries=-1)

    def no_letters(b, reason):
        raise OSError("full")

    assert w.persistently("batch", failing(9)[0], no_letters, lost.append, sleep=slept.append).outcome == "emergency" and lost == ["batch"]
    with pytest.raises(KeyError):  # a mistake in the code is not a failure of the store
        run(failing(1, KeyError)[0])


def test_a_stream_goes_on_past_a_batch_that_fails(spark, tmp_path):
    top = str(tmp_path)
    for n in range(3):
        spark.createDataFrame([(f"e{n}", "T")], "EventId string, EventType string").coalesce(1).write.mode("append").json(f"{top}/in")

    def write(batch, number):
        if number == 1:
            raise RuntimeError("no store")
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    down = lambda b, reason: lf.put(w.letters_of(b, reason, "2024-01-01"), f"{top}/letters")
    stream = spark.readStream.schema("EventId string, EventType string").option("maxFilesPerTrigger", 1).json(f"{top}/in")
    run = w.guarded(write, down, lambda b: w.emergency_file(b, top, {}), most_retries=1, base_ms=1)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{top}/offsets").trigger(availableNow=True).start().awaitTermination()
    stored, letters = spark.read.parquet(f"{top}/out").select("EventId").collect(), lf.waiting(spark, f"{top}/letters").collect()
    assert len(stored) == 2 and [r.FailureReason for r in letters] == ["Batch failed after 2 attempts"]
    assert sorted([r.EventId for r in stored] + [r.Id for r in letters]) == ["e0", "e1", "e2"]
