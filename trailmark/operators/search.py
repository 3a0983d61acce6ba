"""Search, trails, paging and distinct values (S1-S4, P*, J7, L*, U*). ``now`` is always an argument; equality is case-sensitive."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema

WORD_COLUMNS = ("EventType", "User", "UserFullName", "EntityType", "EntityId", "Action", "JsonData")


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """By keys; one that begins with "-" falls. Null is lowest."""
    return df.orderBy(*(F.col(k[1:]).desc() if k[0] == "-" else F.col(k).asc() for k in keys))


def clamp(limit: int) -> int:
    """None or less is the default page, more than the most is the most."""
    return schema.PAGE_DEFAULT if limit <= 0 else min(limit, schema.PAGE_MAX)


def clamped(limit: Column) -> Column:
    """L7 for limits in a table; null is the default page."""
    return F.when(F.coalesce(limit, F.lit(0)) <= 0, schema.PAGE_DEFAULT).otherwise(F.least(limit, F.lit(schema.PAGE_MAX)))


def newest(df: DataFrame, *conditions: Column, limit: int = 1000) -> DataFrame:
    """The newest rows that meet all conditions; ids break ties."""
    return ordered(df.where(reduce(and_, conditions, F.lit(True))), "-InsertedDate", "-EventId").limit(limit)


def by(**values: object) -> list[Column]:
    return [F.col(k) == v for k, v in values.items()]


def between(col: str, start: str | None = None, end: str | None = None) -> Column:
    """Both ends belong to the range; a null time is in none but the boundless one."""
    parts = [F.col(col) >= F.lit(start).cast("timestamp")] * (start is not None) + [F.col(col) <= F.lit(end).cast("timestamp")] * (end is not None)
    return reduce(and_, parts, F.lit(True))


def slow_events(events: DataFrame, least: int, limit: int = 100) -> DataFrame:
    """P9"""
    return ordered(events.where(F.col("Duration") >= least), "-Duration", "-EventId").limit(limit)


def tamper_scan(events: DataFrame, start: str, limit: int = 1000) -> DataFrame:
    """P11"""
    return ordered(events.where(between("InsertedDate", start)), "InsertedDate", "EventId").limit(limit)


def recent(events: DataFrame, now: str, hours: int, limit: int = 1000) -> DataFrame:
    """P19"""
    return newest(events, F.col("InsertedDate") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"), limit=limit)


def search_terms(text: str, longest: int = 512) -> list[str]:
    """Words and quoted phrases. Raises on over-long text, a star, an unbalanced quote, a term without letter or digit."""
    text = text.strip()
    if not text:
        return []
    if len(text) > longest:
        raise ValueError(f"search text is longer than {longest} characters")
    if "*" in text:
        raise ValueError("wildcards are not supported")
    if text.count('"') % 2:
        raise ValueError("unbalanced quote")
    terms = [" ".join((phrase or word).split()) for phrase, word in re.findall(r'"([^"]*)"|([^\s"]+)', text)]
    for term in terms:
        if not any(c.isalnum() for c in term):
            raise ValueError("a term needs a letter or digit")
    return terms


def terms_of(text: Column, longest: int = 512) -> Column:
    """P15 for texts in a table, as searches that were logged: array of terms; null where :func:`search_terms` raises."""
    found = F.regexp_extract_all(text, F.lit(r'"[^"]*"|[^\s"]+'), 0)
    terms = F.transform(found, lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit('"'), F.lit("")), r"\s+", " ")))
    good = (F.length(F.trim(text)) <= longest) & ~F.contains(text, F.lit("*")) & (F.regexp_count(text, F.lit('"')) % 2 == 0) & F.forall(terms, lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.when(good, terms)


def word_pattern(term: str) -> str:
    """a pattern that Java's and RE2's syntax read alike."""
    return r"(?i)(^|[^\p{L}\p{N}])" + re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", term) + r"([^\p{L}\p{N}]|$)"


def word_search(text: str, columns: tuple[str, ...] = WORD_COLUMNS) -> Column:
    """Every term must occur, as whole words, in one of the columns at least."""
    hit = lambda term: reduce(or_, (F.coalesce(F.col(c).rlike(word_pattern(term)), F.lit(False)) for c in columns))
    return reduce(and_, (hit(t) for t in search_terms(text)), F.lit(True))


def search_filter(event_id=None, event_type=None, user=None, entity_type=None, entity_id=None, start=None, end=None, text=None) -> Column:  # noqa: ANN001
    """What is given must match; user matches User or UserFullName."""
    parts = by(**{k: v for k, v in {"EventId": event_id, "EventType": event_type, "EntityType": entity_type, "EntityId": entity_id}.items() if v is not None})
    parts += [(F.col("User") == user) | (F.col("UserFullName") == user)] * (user is not None)
    parts += [between("InsertedDate", start, end)] * (start is not None or end is not None)
    if text:
        parts.append(word_search(text))
    return reduce(and_, parts, F.lit(True))


def page(df: DataFrame, limit: int, offset: int, *keys: str) -> DataFrame:
    """An order is required; a page below one or without size is an error."""
    if limit < 1 or offset < 0 or not keys:
        raise ValueError("a page needs a size, an offset and an order")
    return ordered(df, *keys).offset(offset).limit(limit)


def key_first_page(events: DataFrame, limit: int, offset: int) -> DataFrame:
    """L2: the page is found on the two key columns alone; only its rows are then read whole. The keys are at most one page."""
    keys = page(events.select("InsertedDate", "EventId"), limit, offset, "-InsertedDate", "-EventId").select("EventId")
    return ordered(events.join(F.broadcast(keys), "EventId", "left_semi"), "-InsertedDate", "-EventId")


def search(events: DataFrame, limit: int = 50, offset: int = 0, **given: object) -> tuple[DataFrame, DataFrame]:
    """(total, page); the limit is clamped, a negative offset is 0."""
    found = events.where(search_filter(**given))
    return found.agg(F.count("*").alias("total")), key_first_page(found, clamp(limit), max(0, offset))


def page_info(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """L5"""
    return total.select("total", F.ceil(F.col("total") / limit).cast("long").alias("total_pages"), F.lit(offset // limit + 1).cast("long").alias("current_page"))


def keyset_page(df: DataFrame, key: str, after: object, take: int) -> DataFrame:
    """L3, J4"""
    return ordered(df.where(F.col(key) > after), key).limit(take)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "EventId") -> DataFrame:
    """The rows of an id table. Spark broadcasts the ids if they are few."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row, found or not."""
    return df.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def distinct_values(df: DataFrame, column: str, keep_empty: bool = False, limit: int | None = schema.DISTINCT_MAX) -> DataFrame:
    """Sorted; null never, empty only on demand."""
    kept = F.col(column).isNotNull() if keep_empty else F.coalesce(F.col(column) != "", F.lit(False))
    out = df.where(kept).select(column).distinct().orderBy(column)
    return out if limit is None else out.limit(limit)


def overlapping_archives(archives: DataFrame, start: str, end: str) -> DataFrame:
    """Completed archives whose range meets the window."""
    a, z = (F.lit(x).cast("timestamp") for x in (start, end))
    return archives.where((F.col("Status") == 1) & (F.col("DateRangeStart") <= z) & (F.col("DateRangeEnd") >= a))


def archives_to_verify(archives: DataFrame, now: str, hours: int) -> DataFrame:
    """Never verified ones first."""
    due = F.col("LastVerifiedAt").isNull() | (F.col("LastVerifiedAt") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return ordered(archives.where((F.col("Status") == 1) & due), "LastVerifiedAt", "ArchiveId")


def policy_keys(kind: Column) -> Column:
    """All patterns that match a type, in lower case: itself, ``*``, ``Prefix.*`` for what is before each dot, ``*.Suffix`` for what is behind it. A null type has ``*`` alone."""
    k = F.lower(kind)
    parts = F.split(k, r"\.", -1)
    n = F.size(parts)
    before = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit(".*")))
    behind = F.transform(F.sequence(F.lit(2), n), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(parts, i, n), ".")))
    plain = F.array(k, F.lit("*"))
    return F.array_distinct(F.when(n > 1, F.concat(plain, before, behind)).otherwise(plain))


def match_policies(kinds: DataFrame, policies: DataFrame, kind: str = "EventType", policy: str = "policy") -> DataFrame:
    """Each type beside each policy whose pattern matches it: an equal join on the patterns that a type has."""
    return kinds.withColumn("pattern", F.explode(policy_keys(F.col(kind)))).join(policies.withColumn("pattern", F.lower(policy)), "pattern").drop("pattern")


def policy_events(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Each policy with the events whose type its pattern matches, active or not: how many, and the oldest. Events are counted by type first, so patterns meet distinct types only."""
    kinds = events.groupBy("EventType").agg(F.count("*").alias("n"), F.min("InsertedDate").alias("oldest"))
    found = match_policies(kinds.withColumnRenamed("EventType", "kind"), policies.select(F.col("EventType").alias("policy")).distinct(), "kind")
    sums = found.groupBy("policy").agg(F.sum("n").alias("n"), F.min("oldest").alias("oldest"))
    return policies.select(F.col("EventType").alias("policy"), "Priority").join(sums, "policy", "left").select("policy", "Priority", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "oldest")


def log_view(events: DataFrame) -> DataFrame:
    """The listing form of an event, with defaults for what is missing."""
    return events.select(
        "EventId",
        F.coalesce("EventType", F.lit("Unknown")).alias("EventType"),
        F.coalesce("User", F.lit("Unknown")).alias("User"),
        F.coalesce("EntityType", F.lit("Unknown")).alias("EntityName"),
        F.coalesce("UserId", F.lit("00000000-0000-0000-0000-000000000000")).alias("UserId"),
        "InsertedDate",
    )


def retry_candidates(letters: DataFrame, limit: int, most_retries: int) -> DataFrame:
    """The newest ``limit`` first, then the filter."""
    head = ordered(letters, "-FailedAt", "-Id").limit(limit)
    return head.where(~F.col("IsProcessed") & (F.col("RetryCount") < most_retries) & (F.col("EventType") != "Audit.Projection"))


def subject_records(events: DataFrame, logs: DataFrame, links: DataFrame, security: DataFrame, tenant: str, subject: str) -> DataFrame:
    """(at, store, record) of a subject from three stores."""
    e = events.where((F.col("TenantId") == tenant) & (F.col("UserId") == subject) & F.col("InsertedDate").isNotNull()).select(F.col("InsertedDate").alias("at"), F.lit(1).alias("store"), F.col("EventId").alias("record"))
    mine = links.where((F.col("TenantId") == tenant) & (F.col("SubjectId") == subject)).select("AuditLogId", "OccurredAt").distinct()
    k = mine.select(F.col("OccurredAt").alias("at"), F.lit(2).alias("store"), F.col("AuditLogId").alias("record"))
    s = security.where((F.col("TenantId") == tenant) & (F.col("SubjectUserId") == subject)).select(F.col("DetectedAt").alias("at"), F.lit(3).alias("store"), F.col("Id").alias("record"))
    return e.unionByName(k).unionByName(s)


def cursor_page(records: DataFrame, after: tuple[str, int, str] | None, take: int) -> DataFrame:
    """L4: rows after the cursor in (at, store, record) order; has_more tells whether another page follows."""
    if after:
        at, store, record = F.lit(after[0]).cast("timestamp"), F.lit(after[1]), F.lit(after[2])
        records = records.where((F.col("at") > at) | (F.col("at") == at) & ((F.col("store") > store) | (F.col("store") == store) & (F.col("record") > record)))
    more = ordered(records, "at", "store", "record").limit(take + 1)
    has_more = more.agg(F.count("*")).scalar() > take
    return ordered(more, "at", "store", "record").limit(take).select("at", "store", "record", has_more.alias("has_more"))
