"""Vectors for what DuckDB cannot say, and for rare branches."""

import base64
import hashlib
import hmac
import json
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.functions import canonical, dates, text
from trailmark.operators import capture, integrity, lifecycle, search
from trailmark.sources import audit


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_week_buckets_at_the_turn_of_years(spark):
    days = [date(2020, 12, 31), date(2021, 1, 1), date(2024, 12, 31), date(2023, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    found = {r.d: (r.w, r.s, r.i) for r in df.select("d", dates.week_of_year(F.col("d")).alias("w"), dates.week_start(F.year("d"), dates.week_of_year(F.col("d"))).alias("s"), dates.iso_week_start(F.col("d")).alias("i")).collect()}
    assert found[days[0]] == (53, date(2020, 12, 28), date(2020, 12, 28))
    assert found[days[1]] == (53, date(2021, 12, 27), date(2020, 12, 28))
    assert found[days[2]] == (53, date(2024, 12, 30), date(2024, 12, 30))
    assert found[days[3]][0] == 52


@pytest.mark.parametrize(
    ("given_text", "wanted"),
    [
        ('{"b":1,"a":[true,null]}', '{"a":[true,null],"b":1}'),
        ('{"a":"é"}', '{"a":"\\u00E9"}'),
        ('{"a":"é"}', '{"a":"\\u00E9"}'),
        ('{"t":"2024-01-01T02:00:00+02:00"}', '{"t":"2024-01-01T00:00:00.0000000Z"}'),
        ('{"n":1.500,"m":1e2}', '{"m":100,"n":1.5}'),
        ('{"x":"<a&\'+`>"}', '{"x":"\\u003Ca\\u0026\\u0027\\u002B\\u0060\\u003E"}'),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_json(given_text, wanted):
    assert canonical.canonical(given_text) == wanted


def test_canonical_json_rejects(spark):
    for bad in ("{", "nope", '{"a":NaN}'):
        with pytest.raises(ValueError):
            canonical.canonical(bad)
    with pytest.raises(ValueError):
        canonical.fingerprint('{"a":1,"a":2}')
    assert one(spark, x=canonical.canonical_json(F.lit("{bad"))).x is None


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=5), json_values, max_size=4))
def test_canonical_json_is_stable(value):
    first = canonical.canonical(json.dumps(value))
    assert canonical.canonical(first) == first
    assert canonical.canonical(json.dumps(dict(reversed(value.items())), indent=2)) == first


def test_hashes_equal_hashlib(spark):
    r = one(spark, c=text.checksum(F.lit("id"), F.lit(None).cast("string"), F.lit("ü")), h=text.chain_hmac(b"k", F.lit("a"), F.lit(None).cast("string"), F.lit("7"), F.lit("t")), long=text.chain_hmac(b"k" * 99, F.lit("a")))
    framed = lambda *p: b"".join(len(x.encode()).to_bytes(4, "big") + x.encode() for x in p)
    assert r.c == base64.b64encode(hashlib.sha256(framed("id", "", "ü")).digest()).decode()
    assert r.h == base64.b64encode(hmac.digest(b"k", framed("a", "", "7", "t"), "sha256")).decode()
    assert r.long == base64.b64encode(hmac.digest(b"k" * 99, framed("a"), "sha256")).decode()


@pytest.mark.parametrize(
    ("dirty", "gone"),
    [
        ("Server=db1;Password=hunter2;", "hunter2"),
        ("sent with Bearer abc.def-123", "abc.def"),
        ("mail to jane@example.org now", "jane@"),
        ("ssn 123-45-6789", "123-45"),
        ("card 4111 1111 1111 1111", "4111"),
        ("call (555) 234-5678", "555"),
        ("api_key=sk123456", "sk123456"),
        ("INSERT INTO t VALUES (1, 'x')", "'x'"),
        ("ssn 123456789 there", "123456789"),
        ("The duplicate key value is ('jane')", "jane"),
        ("host=db2 database=audit", "db2"),
        ("conflict on 00000000-0000-4000-8000-000000000001", "00000000"),
    ],
)
def test_sanitize(spark, dirty, gone):
    clean = one(spark, x=text.sanitize(F.lit(dirty))).x
    assert gone not in clean and text.SANITIZED in clean


def test_sanitize_limits_length_and_keeps_null(spark):
    r = one(spark, long=text.sanitize(F.lit("word " * 300)), none=text.sanitize(F.lit(None).cast("string")))
    assert len(r.long) == 512 and r.none is None


def test_search_terms():
    assert search.search_terms('one "two words" AND') == ["one", "two words", "AND"]
    for bad in ("a*", '"open', "--", "x" * 600):
        with pytest.raises(ValueError):
            search.search_terms(bad)
    with pytest.raises(ValueError):
        search.page(None, 0, 0, "id")


@pytest.mark.parametrize("asked", ['one "two words" AND', "a*", '"open', "--", "x" * 600, "", '  b-c   "x  y" ', '"" a'])
def test_terms_in_a_table_are_those_of_the_driver(spark, asked):
    try:
        want = search.search_terms(asked)
    except ValueError:
        want = None
    assert one(spark, t=search.terms_of(F.lit(asked))).t == want


def test_work_items_fail_after_the_last_attempt(spark):
    items = spark.createDataFrame([("a", 1, 5), ("b", 1, 4), ("c", 1, 0), ("d", 2, 9), ("e", 1, 0)], "EventId string, Status int, AttemptCount int").withColumn("CreatedAt", F.when(F.col("EventId") != "e", F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp"))
    found = integrity.reconciliation(items, spark.createDataFrame([("a",), ("b",)], "EventId string"), "2024-02-01 00:04:00").collect()
    assert sorted(map(tuple, found), key=str) == [("a", "Failed", "High"), ("b", "Reconciled", None), ("c", "Created", None)]


def test_word_match_needs_whole_words(spark):
    df = spark.createDataFrame([("User.Login",), ("Logins",), ("pre-login-post",), (None,)], "t string")
    found = [r.t for r in df.where(search.word_search("login", ("t",))).collect()]
    assert found == ["User.Login", "pre-login-post"]


def test_policy_patterns(spark):
    cases = [("User.*", "user.Login", True), ("User.*", "Users.Login", False), ("*.Update", "Data.Update", True), ("*.Update", "Update", False), ("*", "x", True), ("A.B", "a.b", True)]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, k string")
    assert [r.m for r in df.select(F.coalesce(F.array_contains(search.policy_keys(F.col("k")), F.lower("p")), F.lit(False)).alias("m")).collect()] == [c[2] for c in cases]


def test_sequence_summary_of_extremes(spark):
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "SequenceNumber long")
    assert integrity.sequence_summary(wide).first().valid is False
    assert integrity.sequence_summary(wide.limit(0)).first().valid is True
    double = spark.createDataFrame([(1,), (2,), (2,)], "SequenceNumber long")
    assert integrity.sequence_summary(double).first().valid is False


def test_long_chain_over_partitions(spark):
    n = 10_000
    links = spark.range(1, n + 1, numPartitions=7).select(F.col("id").alias("SequenceNumber"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("EventHash"), F.when(F.col("id") > 1, F.when(F.col("id") == 4321, "x").otherwise(F.concat(F.lit("h"), (F.col("id") - 1).cast("string")))).alias("PreviousEventHash"), F.col("id").cast("string").alias("EventId"))
    events = links.select("EventId")
    assert [r.SequenceNumber for r in integrity.chain_findings(links, events).collect()] == [4321]
    assert integrity.boundary_check(links, 1, n).first().first_failure == 4321
    assert integrity.boundary_check(links.where("SequenceNumber < 4000"), 1, 3999).first().valid
    assert integrity.boundary_check(links, n + 5, n + 9).first().is_empty


def test_anonymize_json():
    assert canonical.anonymized('{"UserName":"x","k":1,"note":"for u7"}', "u7") == '{"UserName":"ANONYMIZED","k":1,"note":"ANONYMIZED"}'
    assert canonical.anonymized("not json", "u") == '{"_anonymization_error":"Failed to parse JSON for anonymization"}'
    assert canonical.anonymized(None, "u") is None


def test_archive_round_trip_and_corruption(spark, sf_dir, tmp_path):
    events = audit.audit_events(spark, sf_dir).where("id < 400")
    lifecycle.write_archive(events, str(tmp_path / "a"))
    restored, verdict = lifecycle.restore_archive(spark, str(tmp_path / "a"), events)
    assert {r.status for r in verdict.collect()} == {"Completed"}
    kept = events.where("InsertedDate IS NOT NULL")
    assert restored.exceptAll(kept).count() == 0 and kept.exceptAll(restored).count() == 0
    part = next((tmp_path / "a/events").rglob("part-*.json.gz"))
    part.write_bytes(b"")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    restored, verdict = lifecycle.restore_archive(spark, str(tmp_path / "a"), events)
    assert "Corrupted" in {r.status for r in verdict.collect()}


def test_tracked_queries_write_an_event_and_run_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        runs.add(1)
        return x

    rows = spark.range(7).select(counted("id").alias("id"))
    out, n = capture.tracked(rows, str(tmp_path / "log"), "PHIAccess", "Security=7", "HIPAA review", lambda df: df.collect())
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert (len(out), n, row.n_rows, runs.value) == (7, 7, 7, 7)
    assert (row.is_compliance, row.requires_justification, row.is_sensitive) == (True, True, True)


def test_redaction_of_names_keys_and_fields(spark):
    r = one(
        spark,
        names=text.redact_names(F.array(F.lit("mrn"), F.lit("UserPassword"), F.lit("PASSWORD"), F.lit("Total"))),
        number=text.redact_key(F.lit(7)),
        digits=text.redact_key(F.lit("123456789")),
        guid_text=text.redact_key(F.lit("00000000-0000-4000-8000-000000000001")),
        guid=text.redact_key(F.lit("00000000-0000-4000-8000-000000000001"), guid=True),
        fields=text.redact_fields(F.create_map(*map(F.lit, ("CorrelationId", "c", "status", "s", "TenantId", "t", "_Action", "a", "ErrorMessage", "pwd=x")))),
        snapshot=text.redact_snapshot(F.lit("{}")),
    )
    assert r.names == ["[REDACTED_PROP]", "UserPassword", "[REDACTED_PROP]", "Total"]
    assert (r.number, r.digits, r.guid_text, r.guid) == ("7", "[REDACTED]", "[REDACTED]", "00000000-0000-4000-8000-000000000001")
    assert r.fields == {"CorrelationId": "[REDACTED]", "status": "s", "TenantId": "[REDACTED]", "_Action": "a", "ErrorMessage": "[SANITIZED]"} and r.snapshot == '{"_redacted":true}'


@pytest.mark.parametrize(("ip", "shown"), [("10.20.30.40", "10.20.XXX.XXX"), ("a.b.c.d", "a.b.XXX.XXX"), ("2001:db8:5::1", "2001:db8:XXXX:XXXX:XXXX"), ("::1", "::XXXX:XXXX:XXXX"), ("a:b", "XXXX:XXXX:XXXX:XXXX"), ("unknown", "ANONYMIZED"), ("", None), (None, None)])
def test_anonymized_addresses(spark, ip, shown):
    assert one(spark, x=text.anonymize_ip(F.lit(ip).cast("string"))).x == shown
