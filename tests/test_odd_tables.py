"""Queries held against their SQL, to the last digit, on tables with rows that the given ones lack."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmark.operators import integrity, wordindex
from trailmark.plans.catalog import ORACLE_SQL, QUERIES
from trailmark.sources import audit
from trailmark.streaming import ledger


def _equal(spark, folder, name, **tables):
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    for table, df in {"events": _events(spark, ["2024-01-02 00:00:00"]), "orders": _orders(spark), **tables}.items():
        path = f"{folder}/{table}.parquet"
        df.coalesce(1).write.parquet(path)
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    answer, df = duck.execute(ORACLE_SQL[name]), QUERIES[name](spark, str(folder))
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    got, want = (sorted([repr(x) for x in row] for row in found) for found in (df.select(names).collect(), answer.fetchall()))
    assert got == want
    return got


def _events(spark, times, ids=None, value=None):
    rows = [(k, datetime.datetime.fromisoformat(t), k % 7, "error", 1.5 * k if value is None else value, '{"k": 1}') for k, t in zip(ids or range(1, len(times) + 1), times, strict=True)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def _orders(spark):
    return spark.createDataFrame([(1, datetime.date(2024, 1, 1), 1.0)], "o_orderkey long, o_orderdate date, o_totalprice double")


@pytest.mark.parametrize("first, last", [("00:00:01.5", "00:00:02.5"), ("00:00:01.499999", "00:00:02.999999"), ("00:00:01.500001", "00:00:03")])
def test_dead_letters_times_are_rounded_seconds(spark, tmp_path, first, last):
    _equal(spark, tmp_path, "q_A28", events=_events(spark, [f"2024-01-01 {first}", f"2024-01-01 {last}"]))


@pytest.mark.parametrize("oldest, days", [("2024-01-01 00:00:00.000001", "30"), ("2024-01-01 00:00:00.999999", "30"), ("2024-01-01 00:00:01", "29"), ("2023-12-31 23:59:59.5", "30")])
def test_age_in_days_leaves_out_fractions_of_a_second(spark, tmp_path, oldest, days):
    assert _equal(spark, tmp_path, "q_D6", events=_events(spark, [oldest, "2024-01-15 00:00:00"])) == [[days]]


ODD_TEXTS = (
    "bearer\x0babc", "host=\x0b", "database\u00a0= x", "pa\u017f\u017fword=x", "to\u212aen: abc", "to\u0131ken: abc", "\u0130nsert into t values(1)", "\u00e9123456789", "123456789\u0300", "\u0663123-45-6789",
    "212-555-1234 212-555-9876", "212-555-1234\n(212) 555-9876, 3(212) 555-1234", "++1 212-555-1234\n", "31 212-555-1234x", "key \u00e90f0f0f0f-1111-2222-3333-444444444444", "4111 1111 1111 1111\u00fc",
    "e\u0301" * 300, "\U0001d518" * 513, "\U0001f468\u200d\U0001f469" * 171, "x" * 512, "", None,
)


@pytest.mark.parametrize("at", range(len(ODD_TEXTS)))
def test_free_text_is_sanitised_as_in_sql(spark, tmp_path, at):
    documents = spark.createDataFrame([(1, ODD_TEXTS[at])], "doc_id long, text string")
    _equal(spark, tmp_path, "q_F13", documents=documents)


@pytest.mark.parametrize("name", ["q_F7", "q_W3_events"])
def test_links_find_the_one_before_across_groups_and_gaps(spark, tmp_path, name):
    """Group ends (one of them a number without a link), numbers that are missing, the broken link."""
    ends = [k * audit.NEIGHBOURS + n for k in (1, 2, 6, 33) for n in range(-3, 4)]
    ids = sorted({*range(45), *ends, 775, 776, 777, 778, 900, 901})
    found = _equal(spark, tmp_path, name, events=_events(spark, ["2024-01-02 00:00:00.25"] * len(ids), ids, 50.0))
    assert bool(found) == (name == "q_W3_events")


def test_links_are_sealed_by_one_exchange_of_event_rows(spark, sf_dir):
    plan = audit.sealed_links(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_verified_links_shuffle_neither_hmac_nor_what_it_is_made_of(spark):
    links = spark.range(9).selectExpr(*(f"string(id) AS {c}" for c in ("EventId", "EventHash", "PreviousEventHash", "HmacSignature", "Checksum")), "id AS SequenceNumber", "timestamp_seconds(id) AS TrustedTimestamp")
    events = spark.range(9).selectExpr(*(f"string(id) AS {c}" for c in ("EventId", "EventType", "User", "UserId", "JsonData")), "timestamp_seconds(id) AS InsertedDate")
    plan = integrity.verify_events(links, events, b"k")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert "SortMergeJoin" in above and "Broadcast" not in plan and not any(c in above for c in ("HmacSignature", "PreviousEventHash", "TrustedTimestamp"))


def test_a_task_of_the_word_index_sorts_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wordindex, "ROWS_A_TASK", 500)
    events = spark.range(2000).selectExpr("string(id) AS EventId", "'one two two' AS a", "if(id % 3 = 0, NULL, 'three') AS b")
    wordindex.add_to_index(events, str(tmp_path / "words"), ("a", "b"))
    rows = wordindex.open_index(spark, str(tmp_path / "words"))
    sizes = [r[1] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 * 3 + 1333 and max(sizes) <= 1500
    assert wordindex.look_up(rows, "two three").count() == 0 and wordindex.look_up(rows, "one two two").count() == 2000


def test_chains_keep_no_state_for_events_that_have_a_link(spark):
    """What is kept of earlier events lies with the events, over all tasks, and not with their chain."""
    events = spark.readStream.format("rate").load().selectExpr("'a' AS chain", "string(value) AS EventId", "string(timestamp) AS at", "string(value) AS EventHash")
    links = spark.createDataFrame([("a", "1", 1, "h"), ("a", "2", None, None)], "chain string, EventId string, number long, hash string")
    plan = ledger.chained(events, links=links)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [chain" in plan and "LeftAnti" in plan
