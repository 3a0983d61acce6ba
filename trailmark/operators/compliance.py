"""The rule engine over an event window (C1-C98). One wide aggregate feeds all rules; no rule scans by itself."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators import reports
from trailmark.operators.rules import CHANGES, EVENT_GROUPS, RULES, SEVERITIES, Rule
from trailmark.operators.search import match_policies, ordered


def _filled(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col)) != "", F.lit(False))


def _contains(col: str, words: list[str]) -> Column:
    """Whether the text has one of the words in it, in any case: one pattern a term keeps the plan of some hundred terms small."""
    return F.coalesce(F.col(col).rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(False))


COLUMNS = {"type": "EventType", "entity": "EntityType", "user": "User"}


def _some(term: str) -> Column | None:
    """The condition on a row that makes a term true if some row meets it."""
    kind, _, words = term.partition(":")
    if kind in COLUMNS or kind == "none":
        return _contains(COLUMNS.get(kind, "EventType"), words.split(","))
    if kind == "action":
        return F.coalesce(F.col("Action").isin(words.split(",")), F.lit(False))
    if kind == "account":
        return F.coalesce(F.col("Action").isin(*CHANGES), F.lit(False)) & _contains("EntityType", ["User"])
    return {"ip": _filled("IpAddress"), "correlation": _filled("CorrelationId")}.get(term)


EVERY = {
    "users": _filled, "times": lambda c: F.col(c).isNotNull(), "types": _filled, "ips": _filled, "actions": _filled,
}
EVERY_COLUMN = {"users": "User", "times": "InsertedDate", "types": "EventType", "ips": "IpAddress", "actions": "Action"}


def _terms(test: str) -> tuple[list[str], bool]:
    test = test.removeprefix("pass!").strip()
    both = "&" in test
    return [t.strip() for t in test.split("&" if both else "|")], both


def facts(sample: DataFrame, now: str) -> DataFrame:
    """One row: a count for each condition that the rules name, over the sampled events."""
    at = F.lit(now).cast("timestamp")
    found = {t: c for r in RULES for t in _terms(r.test)[0] if (c := _some(t)) is not None}
    found |= {f"group:{k}": _contains("EventType", list(w)) | (F.coalesce(F.col("Action").isin(*CHANGES), F.lit(False)) if k == "object" else F.lit(False)) for k, w in EVENT_GROUPS.items()}
    found |= {k: ~EVERY[k](c) for k, c in EVERY_COLUMN.items()} | {"origins": ~(_filled("MachineName") | _filled("AssemblyName"))}
    found |= {f"recent:{h}": F.coalesce(F.col("InsertedDate") >= at - F.expr(f"INTERVAL {h} HOURS"), F.lit(False)) for h in (1, 720)}
    return sample.agg(F.count("*").alias("sample"), *(F.count_if(c).alias(k) for k, c in found.items()))


def _true(term: str, config: dict[str, bool]) -> Column:
    kind, _, words = term.partition(":")
    if kind == "config":
        return F.lit(config.get(words, False))
    if term == "pass":
        return F.lit(True)
    if term == "protected":
        return (F.col("total") > 0) & (F.col("unprotected") == 0)
    if term in ("total", "sample"):
        return F.col(term) > 0
    if term.startswith("age"):
        days = F.col("age_days")
        return F.coalesce(days >= int(term[5:]) if term[3] == ">" else days <= int(term[5:]), F.lit(False))
    if kind == "both":
        return reduce(and_, (F.col(f"`group:{w}`") > 0 for w in words.split(",")))
    if term in EVERY_COLUMN or term == "origins" or kind == "none":
        return F.col(f"`{term}`") == 0
    return F.col(f"`{term}`") > 0


def _result(rule: Rule, config: dict[str, bool]) -> Column:
    terms, both = _terms(rule.test)
    held = reduce(and_ if both else or_, (_true(t, config) for t in terms))
    failed = F.lit(rule.severity)
    if "sample" in terms:
        failed = F.when(F.col("sample") == 0, "Low").otherwise(failed)
    if rule.test == "protected" and rule.id != "C17":
        failed = F.when(F.col("total") == 0, "Low").otherwise(failed)
    if rule.id == "C54":
        failed = F.when(F.coalesce(F.col("age_days") >= 90, F.lit(False)), "Medium").otherwise(failed)
    if rule.id == "C69" and not config.get("tamper_detection", True):
        held, failed = held | (F.col("total") == 0), F.lit("Info")
    held_severity = F.lit("Info")
    if rule.id == "C20":
        held_severity = F.when(F.col("age_days") >= 2190, "Info").otherwise("Medium")
    if rule.id == "C82":
        groups = reduce(lambda a, b: a + b, (F.when(F.col(f"`group:{k}`") > 0, 1).otherwise(0) for k in EVENT_GROUPS))
        held_severity = F.when(groups >= 4, "Info").otherwise("Medium")
    return F.struct(
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.standard).alias("standard"),
        F.lit(rule.name).alias("rule_name"),
        (F.lit(True) if rule.test.startswith("pass!") else held).alias("passed"),
        F.when(held, held_severity).otherwise(failed).alias("severity"),
    )


def sampled(events: DataFrame, most: int | None = schema.SAMPLE_MAX) -> DataFrame:
    """The newest events of a window; None takes all."""
    return events if most is None else ordered(events, "-InsertedDate", "-EventId").limit(most)


def context(window: DataFrame, links: DataFrame, now: str) -> DataFrame:
    """One row over the whole window: total, unprotected, age of the oldest event in days."""
    marked = window.select("EventId", "InsertedDate").join(links.select("EventId", F.lit(True).alias("linked")), "EventId", "left")
    oldest = F.min("InsertedDate")
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(oldest)) / 86400)
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("linked").isNull()).alias("unprotected"), age.cast("long").alias("age_days"))


def evaluate(window: DataFrame, links: DataFrame, now: str, standards: tuple[str, ...] = schema.COMPLIANCE_STANDARD, config: dict[str, bool] | None = None, most: int | None = schema.SAMPLE_MAX) -> DataFrame:
    """One row per rule of the enabled standards, from the one row of facts and the one of the context."""
    whole = context(window, links, now).select(F.struct("*")).scalar()
    known = facts(sampled(window, most), now).withColumn("whole", whole).select("*", "whole.*")
    chosen = [_result(r, config or {}) for r in RULES if r.standard in standards]
    return known.select(F.inline(F.array(*chosen)))


def nist(results: DataFrame) -> DataFrame:
    """STIG and ISO results under one name each, in any case; STIG's stays."""
    both = results.where(F.col("standard").isin("STIG", "ISO27001"))
    w = Window.partitionBy(F.lower("rule_name")).orderBy(F.desc("standard"), "rule_id")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def recommendations(results: DataFrame) -> DataFrame:
    """Failed rules, severest first."""
    rank = reduce(lambda acc, k: F.when(F.col("severity") == SEVERITIES[k], k).otherwise(acc), range(5), F.lit(0))
    failed = results.where("NOT passed").withColumn("rank", rank)
    return failed.orderBy(F.desc("rank"), "rule_id").select("rule_id", "severity", F.concat_ws(": ", F.upper("severity"), "rule_name").alias("line"))


def verdicts(results: DataFrame, standards: tuple[str, ...] = schema.COMPLIANCE_STANDARD) -> DataFrame:
    """One row per standard. A standard without rules is compliant."""
    names = results.sparkSession.createDataFrame([(s,) for s in standards], "standard string")
    by = results.groupBy("standard").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    out = names.join(by, "standard", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "failed": F.coalesce("failed", F.lit(0))})
    return out.select("standard", F.col("n").alias("rules"), "failed", (F.col("failed") == 0).alias("compliant"), reports.pass_percentage(F.col("n"), F.col("failed")).alias("pass_percentage"))


def policy_violations(events: DataFrame, policies: DataFrame, now: str, wildcards: bool = False) -> DataFrame:
    """Events of each active policy's type that are too old. Types are compared exactly, or as patterns with ``wildcards``; patterns are matched against the distinct types."""
    active = policies.where("IsActive").select(F.col("EventType").alias("policy"), "RetentionDays")
    kinds = events.select(F.col("EventType").alias("kind")).distinct()
    meant = match_policies(kinds, active, "kind") if wildcards else active.withColumn("kind", F.col("policy"))
    old = F.col("InsertedDate") < F.lit(now).cast("timestamp") - F.make_interval(days=F.col("RetentionDays"))
    found = events.select("EventType", "InsertedDate").join(meant, F.col("EventType").eqNullSafe(F.col("kind"))).where(old).groupBy("policy").agg(F.count("*").alias("n"))
    return active.join(found, "policy", "left").select("policy", F.coalesce("n", F.lit(0)).alias("violations"), F.col("n").isNull().alias("compliant"))


def consented(requests: DataFrame, consents: DataFrame, now: str) -> DataFrame:
    """Requests (user, entity, scope) with a consent that has not expired."""
    live = consents.where(F.col("expires").isNull() | (F.col("expires") > F.lit(now).cast("timestamp")))
    return requests.join(live, ["user", "entity", "scope"], "left_semi")


def marked_fields(df: DataFrame, entity: str) -> DataFrame:
    """A row for each column whose metadata name a marker: entity, field, marker, and how many rows hold a value."""
    marks = [(f.name, f.metadata["marker"]) for f in df.schema.fields if "marker" in f.metadata]
    counts = df.agg(*(F.count(F.col(name)).alias(name) for name, _ in marks))
    rows = F.array(*(F.struct(F.lit(entity).alias("entity"), F.lit(name).alias("field"), F.lit(marker).alias("marker"), F.col(name).alias("n")) for name, marker in marks))
    return counts.select(F.explode(rows).alias("r")).select("r.*")
