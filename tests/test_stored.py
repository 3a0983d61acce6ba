"""Stored tables, the outbox on them, archives as files, the word index."""

import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.operators import archive_files, lifecycle, search, wordindex
from trailmark.sources import audit
from trailmark.sources.stored import Stored, flip_last_byte
from trailmark.storage import shared_dir
from trailmark.streaming import outbox_store as store


def folders(table):
    return {p: v["folder"] for p, v in table.parts.items()}


def test_only_touched_parts_are_written_anew(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("g"), F.lit("a").alias("v"))
    table = Stored.create(rows, str(tmp_path / "t"), "g", "k")
    assert sorted(table.parts) == ["0", "1", "2", "3", "4", "none"] and Stored.open(spark, table.path) == table
    changed = spark.createDataFrame([(1, 1, "b"), (500, 2, "c")], "k long, g long, v string")
    after = table.upsert(changed)
    assert {p for p in folders(after) if folders(after)[p] != folders(table)[p]} == {"1", "2"}
    assert after.read().count() == 101 and {tuple(r) for r in after.read().where("v <> 'a'").collect()} == {(1, 1, "b"), (500, 2, "c")}
    assert table.read().count() == 100  # older readers keep their version
    less, n = after.delete(F.col("g").isNull())
    assert n == 15 and "none" not in less.parts and less.read().count() == 86 and Stored.open(spark, table.path) == less
    same, none = less.delete(F.col("v") == "nothing")
    assert (same, none) == (less, 0) and less.upsert(changed.limit(0)) == less
    gone, n = less.delete_keys(spark.createDataFrame([(1,), (2,), (9999,)], "k long"))
    assert n == 2 and gone.read().count() == 84
    assert gone.vacuum() > 0 and gone.read().count() == 84 == Stored.open(spark, table.path).read().count()


def test_of_two_writers_the_second_fails(spark, tmp_path):
    table = Stored.create(spark.range(10).select(F.col("id").alias("k")), str(tmp_path / "t"), "k % 2", "k")
    table.delete(F.col("k") == 1)
    with pytest.raises(RuntimeError):
        table.delete(F.col("k") == 2)
    with pytest.raises(RuntimeError):  # rows that were lost on the way
        table.rewrite(["0"], table.read(["0"]).limit(1), 0)
    assert {r.k for r in Stored.open(spark, table.path).read().collect()} == set(range(10)) - {1}
    with pytest.raises(ValueError):
        Stored.create(spark.createDataFrame([("a/b",)], "k string"), str(tmp_path / "u"), "k", "k")
    empty = Stored.create(spark.createDataFrame([], "k long"), str(tmp_path / "e"), "k", "k")
    assert empty.read().count() == 0 and empty.upsert(spark.createDataFrame([(3,)], "k long")).read().count() == 1


BOX = "Id long, IdempotencyKey string, Status int, AttemptCount int, CreatedAt timestamp, NextRetryAt timestamp, LeaseExpiresAt timestamp, TenantId string, FailureCycleId string, ResolutionId string, Content string"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def text(seconds):
    return at(seconds).isoformat(" ")


def test_two_rounds_of_claims_and_outcomes_equal_a_replay(spark, tmp_path):
    rows = {k: dict(Status=0, AttemptCount=k % 6 % 5, CreatedAt=at(-k % 17), NextRetryAt=at(20) if k % 7 == 3 else None, owner=None, cycle=None) for k in range(40)}
    box = store.create_box(spark.createDataFrame([(k, f"key{k}", r["Status"], r["AttemptCount"], r["CreatedAt"], r["NextRetryAt"], None, "tenant", None, None, "c") for k, r in rows.items()], BOX), str(tmp_path / "box"))
    handoffs, heard = store.create_handoffs(spark, str(tmp_path / "handoffs")), set()
    for number, (now, size) in enumerate(((0, 12), (25, 30))):
        token, operation = f"t{number}", f"op{number}"
        due = [k for k in rows if rows[k]["Status"] == 0 and (rows[k]["NextRetryAt"] is None or rows[k]["NextRetryAt"] <= at(now))]
        mine = sorted(due, key=lambda k: (rows[k]["CreatedAt"], k))[:size]
        box, taken = store.claim(box, token, text(now), size)
        assert sorted(r.Id for r in taken.collect()) == sorted(mine)
        said = {k: k % 3 == 0 for k in rows}  # outcomes of rows that are not owned are refused
        box, handoffs, applied = store.apply(box, handoffs, spark.createDataFrame([(k, ok, "why") for k, ok in said.items()], "Id long, ok boolean, reason string"), token, operation, text(now))
        assert {r.Id for r in applied.where("applied").collect()} == set(mine)
        for k in mine:
            r = rows[k]
            if said[k]:
                r |= {"Status": 2, "NextRetryAt": None}
            else:
                r["AttemptCount"] += 1
                last = r["AttemptCount"] >= 5
                r |= {"Status": 3 if last else 0, "cycle": operation if last else None, "NextRetryAt": None if last else at(now + (1, 5, 30)[min(r["AttemptCount"], 3) - 1])}
                heard |= {(k, operation)} if last else set()
    got = {r.Id: (r.Status, r.AttemptCount, r.NextRetryAt, r.FailureCycleId) for r in Stored.open(spark, box.path).read().collect()}
    assert got == {k: (r["Status"], r["AttemptCount"], r["NextRetryAt"], r["cycle"]) for k, r in rows.items()}
    assert heard and {(r.OutboxRowId, r.FailureCycleId) for r in handoffs.read().collect()} == heard
    # handoffs: an answer without the token is refused; a failed one waits longer; resolution suppresses what is open
    handoffs, out = store.claim_handoffs(handoffs, "h1", text(30), 100)
    answers = out.select("Id", (F.col("OutboxRowId") % 2 == 0).alias("delivered"))
    assert store.acknowledge(handoffs, answers, "other", text(31))[1].count() == 0
    handoffs, _ = store.acknowledge(handoffs, answers, "h1", text(31))
    found = {r.OutboxRowId: (r.Status, r.NextRetryAt, r.AttemptCount) for r in handoffs.read().collect()}
    assert found == {k: (store.DELIVERED, None, 1) if k % 2 == 0 else (store.WAITING, at(36), 1) for k, _ in heard}
    cycle = max(c for _, c in heard)
    box, handoffs, solved = store.resolve(box, handoffs, "tenant", cycle, "res", True, text(40))
    assert {r.Id for r in solved.collect()} == {k for k, c in heard if c == cycle}
    assert all(r.Status == 0 and r.AttemptCount == 0 and r.ResolutionId == "res" for r in box.read().where(F.col("FailureCycleId") == cycle).collect())
    assert {r.Status for r in handoffs.read().where(F.col("FailureCycleId") == cycle).collect()} <= {store.DELIVERED, store.SUPPRESSED}


def test_expired_leases_are_recovered(spark, tmp_path):
    rows = [(k, f"k{k}", 1, 0, at(k), None, at(k), "t", None, None, "c") for k in range(10)]
    box, freed = store.recover(store.create_box(spark.createDataFrame(rows, BOX), str(tmp_path / "box")), text(5), 4)
    assert sorted(r.Id for r in freed.collect()) == [0, 1, 2, 3] and box.read().where("Status = 0").count() == 4
    with pytest.raises(ValueError):
        store.claim(box, "t", text(0), 10_000)


def events_of(spark, sf_dir):
    return audit.audit_events(spark, sf_dir).where("Duration < 60")


def test_archive_commit_damage_and_restore(spark, sf_dir, tmp_path):
    events, path = events_of(spark, sf_dir), str(tmp_path / "archive")
    with pytest.raises(archive_files.ArchiveRefused):
        archive_files.commit_archive(events, path, events.where("InsertedDate IS NOT NULL").limit(1).select("EventId"))
    archive_files.commit_archive(events, path, unit="yyyy-MM-dd")
    with pytest.raises(RuntimeError):  # committed once
        archive_files.commit_archive(events, path, unit="yyyy-MM-dd")
    table = Stored.create(events, str(tmp_path / "events"), "date_format(InsertedDate, 'yyyy-MM-dd')", "EventId")
    purged, n = lifecycle.apply_purge(table, audit.NOW, 12)
    assert n > 0
    again, verdict = archive_files.restore(spark, path, purged, "yyyy-MM-dd")
    assert {r.status for r in verdict.collect()} == {"Completed"} and again.read().exceptAll(events).count() == 0 == events.exceptAll(again.read()).count()
    part = spark.read.parquet(f"{archive_files.committed_folder(spark, path)}/files").first()
    flip_last_byte(spark, f"{archive_files.committed_folder(spark, path)}/events/archive={part.archive}/{part.file}")
    found = {r.archive: (r.status, r.reason) for r in archive_files.validate(spark, path).collect()}
    assert found.pop(part.archive) == ("Corrupted", "hash") and set(found.values()) == {("Completed", None)}
    rolled_back, verdict = archive_files.restore(spark, path, purged, "yyyy-MM-dd")
    assert rolled_back == purged and Stored.open(spark, table.path) == again


def test_retention_tells_and_deletes_the_same(spark, sf_dir, tmp_path):
    events = audit.audit_events(spark, sf_dir)
    table = Stored.create(events, str(tmp_path / "events"), "date_format(InsertedDate, 'yyyy-MM-dd')", "EventId")
    after, counts = lifecycle.apply_retention(table, audit.retention_policies(spark), audit.NOW)
    assert sum(counts.values()) == events.count() - after.read().count() > 0
    assert len([p for p in after.parts if folders(after)[p] == folders(table)[p]]) > 0


@pytest.mark.parametrize("query", ["login", "User", '"user 7"', 'user7 "test.com"', '"data.read"', "é2", '"a b" A', "x_y", "C++", "nothing here"])
def test_index_finds_what_the_scan_finds(spark, tmp_path, query):
    texts = ["User.Login", "logins", "user 7", "user  7", "user-7@test.com user7", "Data.Read", "data read", None, "", "é2 É2", "a b", "b a", "a, b", "x_y", "x y", "C++ c", "nothing", "here nothing", "user7@test.com"]
    rows = [(f"e{k}", a, b) for k, (a, b) in enumerate((x, y) for x in texts for y in (texts[(len(x or "") * 7) % len(texts)], None))]
    events = spark.createDataFrame(rows, "EventId string, EventType string, User string")
    columns, path = ("EventType", "User"), str(tmp_path / "index")
    wordindex.add_to_index(events.where("EventId < 'e2'"), path, columns)
    wordindex.add_to_index(events.where("EventId >= 'e2'"), path, columns)
    index = wordindex.open_index(spark, path)
    got = wordindex.indexed_search(events, index, query, columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, events.where(search.word_search(query, columns)).collect()))


def test_look_up_reads_one_bucket_a_term(spark, sf_dir, tmp_path):
    path = str(tmp_path / "index")
    wordindex.add_to_index(audit.audit_events(spark, sf_dir), path)
    found = wordindex.look_up(wordindex.open_index(spark, path), "login")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(word,login)" in plan


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_dir(Session)
