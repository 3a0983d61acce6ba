"""The hash chain over more than one range partition."""

from pyspark.sql import functions as F

from trailmark.operators import integrity

LINKS = 20_000
BROKEN = (1, 777, 4_999, 9_999, 10_000, 15_001, 19_999)


def test_predecessors_do_not_depend_on_partitions(spark, tmp_path):
    n = F.col("id")
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    before = F.when(n.isin(*BROKEN), "other").when(n > 0, name(n - 1))
    rows = spark.range(LINKS).select(n.alias("SequenceNumber"), name(n).alias("EventHash"), before.alias("PreviousEventHash"), F.lpad(n.cast("string"), 6, "0").alias("EventId"))
    rows.write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.SequenceNumber: r.prev_number for r in integrity.with_predecessor(links).collect()}
        unlinked = sorted(r.SequenceNumber for r in integrity.linkage(links).where("NOT linked").collect())
        found = sorted(r.SequenceNumber for r in integrity.chain_findings(links, links).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: k - 1 if k else None for k in range(LINKS)}
    assert unlinked == found == list(BROKEN)


def test_batch_is_numbered_over_partitions(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(LINKS).select(F.lpad(n.cast("string"), 6, "0").alias("EventId"), F.concat(F.lit("h"), n.cast("string")).alias("EventHash"))
    rows.write.parquet(str(tmp_path / "batch"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = integrity.append_batch(spark.read.parquet(str(tmp_path / "batch")), 100, "last").collect()
        none = integrity.append_batch(spark.read.parquet(str(tmp_path / "batch")).limit(0), 100, "last").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((int(r.EventId), r.SequenceNumber, r.PreviousEventHash) for r in got) == [(k, 101 + k, f"h{k - 1}" if k else "last") for k in range(LINKS)]
    assert none == []


def test_sequence_summary_by_bitmaps_and_by_numbers(spark):
    for numbers in ([], [5], [-(2**63), -(2**63) + 1, -(2**63) + 2], [2**63 - 2, 2**63 - 1], list(range(-40_000, 40_000)), [*range(70_000), 32_768], [*range(32_768), *range(32_769, 65_536)], [-(2**63), 2**63 - 1], [1, 10**15], [None, 1, 2]):
        found = integrity.sequence_summary(spark.createDataFrame([(n,) for n in numbers], "SequenceNumber long").repartition(3)).first()
        given = [n for n in numbers if n is not None]
        want = (len(given), len(set(given)), min(given, default=None), max(given, default=None), not given or len(given) == len(set(given)) == max(given) - min(given) + 1)
        assert (found.n or 0, found.n_distinct or 0, found.first, found.last, found.valid) == want
    plan = integrity.sequence_summary(spark.range(1000).withColumnRenamed("id", "SequenceNumber"))._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "count(distinct" not in plan.lower()
