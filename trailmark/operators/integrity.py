"""Hash chain and sequence checks (J*, W*, A17-A20, F7, T12, T13).

A chain is checked by joining each link with the one whose number is one less: a shuffle on the number, which spreads over any cluster. Where
numbers are missing the predecessor is another; ``with_predecessor`` then finds it by range partitions whose ends are stitched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import canonical, text
from trailmark.operators.search import between, ordered
from trailmark.storage import written

EVENT_COLUMNS = ("InsertedDate", "EventType", "User")


def with_integrity(events: DataFrame, links: DataFrame) -> DataFrame:
    """J1"""
    return events.join(links, "EventId", "left")


def with_events(links: DataFrame, events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Links whose event is missing stay."""
    return links.where(between("TrustedTimestamp", start, end)).join(events.select("EventId", *EVENT_COLUMNS), "EventId", "left")


def with_related(security: DataFrame, events: DataFrame) -> DataFrame:
    """J5"""
    related = events.select(F.col("EventId").alias("RelatedAuditEventId"), F.col("EventType").alias("RelatedType"), F.col("InsertedDate").alias("RelatedDate"))
    return security.join(related, "RelatedAuditEventId", "left")


def unprotected(events: DataFrame, links: DataFrame) -> DataFrame:
    """J6"""
    return events.join(links, "EventId", "left_anti")


def coverage(events: DataFrame, links: DataFrame) -> DataFrame:
    """One pass over one join."""
    marked = events.select("EventId").join(links.select("EventId", F.lit(True).alias("linked")), "EventId", "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("linked").isNull()).alias("unprotected"))


#: Numbers of one bitmap; how many numbers a chain may span for each link it has, to be counted by bitmaps.
BITMAP_SHIFT, DENSE = 15, 64


def sequence_summary(links: DataFrame) -> DataFrame:
    """Valid if no number is missing or repeated; an empty chain is valid.

    The distinct numbers are counted by bitmaps of 32,768 neighbouring numbers (4 kB), one a bucket and task, in place of a shuffle of each number. A chain so thin that
    bitmaps would be larger than its numbers is counted by those.
    """
    n, first, last = links.agg(F.count("SequenceNumber"), F.min("SequenceNumber"), F.max("SequenceNumber")).first()
    number = F.col("SequenceNumber")
    if n and last - first < DENSE * n:
        bits = links.where(number.isNotNull()).groupBy(F.shiftright(number, BITMAP_SHIFT).alias("bucket")).agg(F.bitmap_construct_agg(number.bitwiseAND(F.lit((1 << BITMAP_SHIFT) - 1))).alias("bits"), F.count("*").alias("n"), F.min(number).alias("first"), F.max(number).alias("last"))
        s = bits.agg(F.sum("n").alias("n"), F.sum(F.bitmap_count("bits")).alias("n_distinct"), F.min("first").alias("first"), F.max("last").alias("last"))
    else:
        s = links.agg(F.count(number).alias("n"), F.countDistinct(number).alias("n_distinct"), F.min(number).alias("first"), F.max(number).alias("last"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return s.withColumn("valid", F.coalesce((F.col("n") == F.col("n_distinct")) & (wide("last") - wide("first") + 1 == wide("n")), F.col("n") == 0))


def next_sequence(links: DataFrame) -> DataFrame:
    """A19"""
    return links.agg((F.coalesce(F.max("SequenceNumber"), F.lit(0)) + 1).cast("long").alias("next"))


def with_neighbour(links: DataFrame) -> DataFrame:
    """Each link and prev_hash, the hash of the link numbered one less (null if there is none)."""
    before = links.select((F.col("SequenceNumber") + 1).alias("SequenceNumber"), F.col("EventHash").alias("prev_hash"), F.col("SequenceNumber").alias("prev_number"))
    return links.join(before, "SequenceNumber", "left")


def with_predecessor(links: DataFrame) -> DataFrame:
    """Each link and prev_hash, prev_number of the link before it, whatever its number.

    Links are sorted by range; within a partition the predecessor is the row before. Only the first link of a partition looks for its predecessor
    among the partitions' last links, of which there is one a partition. The links are written with their partition before both are read: a second
    exchange would draw its own ranges.
    """
    placed = links.select("SequenceNumber", "EventHash", "PreviousEventHash", "EventId").repartitionByRange("SequenceNumber", "EventId").withColumn("part", F.spark_partition_id())
    keys = written(placed, "links-in-order")
    w = Window.partitionBy("part").orderBy("SequenceNumber", "EventId")
    rows = keys.withColumns({"prev_hash": F.lag("EventHash").over(w), "prev_number": F.lag("SequenceNumber").over(w), "rank": F.row_number().over(w)})
    inner = rows.where("rank > 1").drop("rank")
    lasts = keys.groupBy("part").agg(F.max_by("EventHash", F.struct("SequenceNumber", "EventId")).alias("last_hash"), F.max("SequenceNumber").alias("last_number"))
    ends = lasts.select("part", F.lag("last_hash").over(Window.orderBy("part")).alias("end_hash"), F.lag("last_number").over(Window.orderBy("part")).alias("end_number"))
    firsts = rows.where("rank = 1").join(ends, "part", "left").withColumns({"prev_hash": F.col("end_hash"), "prev_number": F.col("end_number")}).drop("rank", "end_hash", "end_number")
    return inner.unionByName(firsts).drop("part")


def linkage(links: DataFrame) -> DataFrame:
    """Whether each link but the first continues its predecessor in hash and number."""
    rows = with_predecessor(links)
    ok = F.coalesce((F.col("PreviousEventHash") == F.col("prev_hash")) & (F.col("SequenceNumber") == F.col("prev_number") + 1), F.lit(False))
    return rows.select("EventId", "SequenceNumber", (F.col("prev_number").isNull() | ok).alias("linked"))


def boundary_check(links: DataFrame, start: int, end: int) -> DataFrame:
    """One row: is_empty, valid, first_failure (the least number in disorder). An empty range is not valid."""
    inside = links.where(F.col("SequenceNumber").between(start, end))
    r = linkage(inside).agg(F.count("*").alias("n"), F.min("SequenceNumber").alias("first"), F.max("SequenceNumber").alias("last"), F.min(F.when(~F.col("linked"), F.col("SequenceNumber"))).alias("first_failure"))
    valid = (F.col("n") > 0) & (F.col("first") == start) & (F.col("last") == end) & F.col("first_failure").isNull()
    return r.select((F.col("n") == 0).alias("is_empty"), F.coalesce(valid, F.lit(False)).alias("valid"), "first_failure")


def chain_findings(links: DataFrame, events: DataFrame, strict: bool = False) -> DataFrame:
    """(EventId, SequenceNumber, finding). A link can have two. The first link of the window has no predecessor to be held against; ``strict`` holds it against none at all."""
    rows = with_predecessor(links)
    first = F.col("prev_number").isNull()
    broken = F.coalesce(F.col("PreviousEventHash") != F.col("prev_hash"), F.lit(False)) | (~first & F.col("PreviousEventHash").isNull())
    if strict:
        broken = broken | (first & F.col("PreviousEventHash").isNotNull())
    chain = rows.where(broken).select("EventId", "SequenceNumber", F.lit("ChainBroken").alias("finding"))
    missing = rows.join(events.select("EventId"), "EventId", "left_anti").select("EventId", "SequenceNumber", F.lit("EventMissing").alias("finding"))
    return chain.unionByName(missing)


def latest_link(links: DataFrame) -> DataFrame:
    """W4, W6"""
    return links.agg(F.max("SequenceNumber").alias("SequenceNumber"), F.max_by("EventHash", "SequenceNumber").alias("EventHash"), F.max_by("EventId", "SequenceNumber").alias("EventId"))


def append_batch(batch: DataFrame, last_number: int, last_hash: str | None) -> DataFrame:
    """Numbers and previous hashes for a batch (EventId, EventHash) in order of EventId, of any size. Hashes do not depend on their predecessors.

    Rows are numbered within range partitions; what comes before a partition, its count and its last hash, is one row a partition.
    """
    rows = written(batch.select("EventId", "EventHash").repartitionByRange("EventId", "EventHash").withColumn("part", F.spark_partition_id()), "batch-in-order")
    w = Window.partitionBy("part").orderBy("EventId", "EventHash")
    ends = rows.groupBy("part").agg(F.count("*").alias("n"), F.max_by("EventHash", F.struct("EventId", "EventHash")).alias("last"))
    over = Window.orderBy("part")
    before = ends.select("part", (F.sum("n").over(over) - F.col("n") + last_number).alias("below"), F.coalesce(F.lag("last").over(over), F.lit(last_hash)).alias("end_hash"))
    placed = rows.withColumns({"rank": F.row_number().over(w), "prev": F.lag("EventHash").over(w)}).join(before, "part")
    return placed.select("EventId", "EventHash", (F.col("rank") + F.col("below")).cast("long").alias("SequenceNumber"), F.when(F.col("rank") == 1, F.col("end_hash")).otherwise(F.col("prev")).alias("PreviousEventHash"))


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """W7, T10"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def verify_events(links: DataFrame, events: DataFrame, key: bytes) -> DataFrame:
    """EventId, SequenceNumber and the first check that fails of hash, HMAC and checksum (null: none), all made anew from the event; links without their event do not appear.

    JSON that cannot be read is a failure of the hash. A link without an HMAC is not asked for one. The HMAC is held against the link alone, before the join, so that
    neither it nor what it is made of is shuffled. The join is by sorting: rows with hashes are far larger than the files that would have one side sent to every task.
    """
    read = events.select("EventId", "EventType", "User", "InsertedDate", "UserId", canonical.canonical_json("JsonData").alias("canonical"))
    event = read.select("EventId", "EventType", "UserId", text.event_hash(F.col("EventId"), F.col("EventType"), F.col("User"), F.col("InsertedDate"), F.col("canonical")).alias("hash"), F.col("canonical").isNull().alias("unreadable"))
    hmac = text.chain_hmac(key, F.col("EventHash"), F.col("PreviousEventHash"), F.col("SequenceNumber").cast("string"), text.iso_time(F.col("TrustedTimestamp")))
    equal = lambda a, b: F.coalesce(a == b, F.lit(False))
    bad_hmac = (F.coalesce("HmacSignature", F.lit("")) != "") & ~equal(hmac, F.col("HmacSignature"))
    rows = links.select("EventId", "SequenceNumber", "EventHash", "Checksum", bad_hmac.alias("bad_hmac")).join(event.hint("merge"), "EventId")
    bad_hash = F.col("unreadable") | ~equal(F.col("hash"), F.col("EventHash"))
    bad_checksum = ~equal(text.checksum(F.col("EventId"), F.col("EventType"), F.col("UserId")), F.col("Checksum"))
    return rows.select("EventId", "SequenceNumber", F.when(bad_hash, "hash").when(F.col("bad_hmac"), "hmac").when(bad_checksum, "checksum").alias("failed"))


def verify_chain(links: DataFrame, events: DataFrame, key: bytes) -> DataFrame:
    """(EventId, SequenceNumber, finding): what :func:`chain_findings` tells, and IntegrityFailed for each link whose event fails F7. A link can have both."""
    failed = verify_events(links, events, key).where("failed IS NOT NULL").select("EventId", "SequenceNumber", F.lit("IntegrityFailed").alias("finding"))
    return chain_findings(links, events).unionByName(failed)


def tamper_report(links: DataFrame, events: DataFrame) -> DataFrame:
    """The alerts of a verification: a gap in the numbers (High), broken links and missing events (Critical)."""
    gap = sequence_summary(links).where("NOT valid").select(F.lit("SequenceGap").alias("alert"), F.lit("High").alias("severity"), F.lit(None).cast("string").alias("EventId"))
    found = chain_findings(links, events).select(F.col("finding").alias("alert"), F.lit("Critical").alias("severity"), "EventId")
    return gap.unionByName(found)


def reconciliation(items: DataFrame, links: DataFrame, now: str, limit: int = 100, minutes: int = 5, most_attempts: int = 5) -> DataFrame:
    """Pending work items (EventId, Status, AttemptCount, CreatedAt) older than some minutes, oldest first, and what becomes of each: Failed for good, with an alert, after the last attempt; Reconciled if its link exists; else the link is Created anew."""
    due = items.where((F.col("Status") == 1) & (F.col("CreatedAt") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES")))
    head = ordered(due, "CreatedAt", "EventId").limit(limit)
    tried = F.col("AttemptCount") >= most_attempts
    outcome = F.when(tried, "Failed").when(F.col("linked"), "Reconciled").otherwise("Created")
    return head.join(links.select("EventId", F.lit(True).alias("linked")), "EventId", "left").select("EventId", outcome.alias("outcome"), F.when(tried, "High").alias("alert"))
