"""Joins of bucketed tables: the same rows as over plain tables, and no exchange."""

from uuid import uuid4

import pytest
from comparing import rows
from pyspark.sql import functions as F

from trailmark.operators import integrity as g
from trailmark.operators import search as s
from trailmark.sources import audit as a
from trailmark.sources import layout

JOINS = {
    "J1": lambda e, i: g.with_integrity(e, i).select("EventId", "SequenceNumber", "EventType"),
    "J2": lambda e, i: g.with_events(i, e, "2024-01-05", "2024-01-20").select("EventId", "SequenceNumber", "EventType"),
    "J6": lambda e, i: g.unprotected(e, i).select("EventId"),
    "J7": lambda e, i: s.by_ids(e, i).select("EventId", "EventType"),
}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.fixture(scope="module")
def sides(spark, sf_dir, tmp_path_factory):
    top, name = tmp_path_factory.mktemp("layout"), uuid4().hex
    plain = a.audit_events(spark, sf_dir), a.audit_integrity(spark, sf_dir)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    laid = layout.lay_out(plain[0], f"e_{name}", f"{top}/e", 16), layout.lay_out(plain[1], f"i_{name}", f"{top}/i", 16)
    yield plain, laid
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(JOINS))
def test_no_exchange_and_the_same_rows(sides, name):
    plain, laid = (JOINS[name](*x) for x in sides)
    assert "Exchange" not in plan(laid) and "Exchange" in plan(plain)
    assert rows(laid.columns, laid.collect()) == rows(plain.columns, plain.collect())


def test_fewer_buckets_on_one_side(spark, sides, tmp_path):
    (events, links), (laid, _) = sides
    fewer = layout.lay_out(links, f"f_{uuid4().hex}", str(tmp_path / "f"), 8)
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    try:
        found = JOINS["J1"](laid, fewer)
        assert "Exchange" not in plan(found)
        assert found.count() == events.count()
    finally:
        spark.conf.unset("spark.sql.bucketing.coalesceBucketsInJoin.enabled")


def test_coverage_exchanges_one_row_a_task(sides):
    plain, laid = sides
    text = plan(g.coverage(*laid))
    assert text.count("Exchange") == text.count("Exchange SinglePartition") == 1
    assert g.coverage(*laid).collect() == g.coverage(*plain).collect()


def test_later_rows_go_to_their_buckets_and_tables_are_attached_again(spark, sides, tmp_path):
    name = uuid4().hex
    events = sides[0][0].select("EventId", "EventType", "Duration")
    layout.lay_out(events.where("Duration <= 40"), f"a_{name}", str(tmp_path / "a"), 8)
    all_rows = layout.add(events.where("Duration > 40 OR Duration IS NULL").select("Duration", "EventType", "EventId"), f"a_{name}", 8)
    assert rows(events.columns, all_rows.collect()) == rows(events.columns, events.collect())
    again = layout.attach(spark, f"b_{name}", str(tmp_path / "a"), 8)
    joined = all_rows.join(again.select("EventId", F.col("Duration").alias("d")), "EventId")
    assert "Exchange" not in plan(joined)
    assert joined.where("Duration <=> d").count() == events.count()


def test_null_keys_empty_tables_and_refusals(spark, tmp_path):
    name = uuid4().hex
    odd = spark.createDataFrame([(None, 1), ("x", 2), ("x", 3), ("", 4)], "EventId string, n int")
    laid = layout.lay_out(odd, f"n_{name}", str(tmp_path / "n"), 8)
    assert sorted(r.n for r in laid.collect()) == [1, 2, 3, 4]
    none = layout.lay_out(odd.limit(0), f"z_{name}", str(tmp_path / "z"), 8)
    assert none.count() == 0 and laid.join(none, "EventId", "left_anti").count() == 4
    assert [layout.bucket_count(x) for x in (0, 1 << 30, 3 << 30, 10 << 40, 1 << 60)] == [8, 8, 16, 65536, 65536]
    for bad in (lambda: layout.lay_out(odd, "q", "p", 12), lambda: layout.lay_out(odd, "q", "p", 8, "absent")):
        with pytest.raises(ValueError):
            bad()
