"""Change capture from snapshots (G*)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trailmark.functions import text

AUDIT, MASK, ENCRYPT, OMIT = range(4)


def _differs(columns: list[str]) -> Column:
    return reduce(or_, (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns))


def _joined(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, treatments: dict[str, int] | None = None, longest: int = 4000) -> DataFrame:
    """G1: (key, property, old_value, new_value): changed properties of rows that both snapshots have, as their treatment shows them."""
    treatments = treatments or {}
    columns = [c for c in old.columns if c != key and c in new.columns and treatments.get(c, AUDIT) != OMIT]

    def shown(side: str, c: str) -> Column:
        value = F.col(f"{side}.{c}").cast("string")
        how = treatments.get(c, AUDIT)
        return F.when(value.isNotNull(), {MASK: F.lit("***"), ENCRYPT: F.lit("[ENCRYPTED]")}.get(how, text.truncate(value, longest)))

    both = _joined(old, new, key).where(F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull() & _differs(columns))
    change = lambda c: F.struct(F.lit(c).alias("property"), shown("o", c).alias("old_value"), shown("n", c).alias("new_value"), (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias("changed"))
    return both.select(F.col(f"n.{key}").alias(key), F.inline(F.array(*map(change, columns)))).where("changed").drop("changed")


def inserts_and_deletes(old: DataFrame, new: DataFrame, key: str, omitted: tuple[str, ...] = ()) -> DataFrame:
    """One JSON snapshot of each row that only one side has, with its action."""
    shown = [c for c in new.columns if c not in omitted]
    snap = lambda side: F.to_json(F.struct(*(F.col(f"{side}.{c}") for c in shown)))
    gone, came = F.col(f"n.{key}").isNull(), F.col(f"o.{key}").isNull()
    return _joined(old, new, key).where(gone | came).select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), F.when(came, "Created").otherwise("Deleted").alias("action"), F.when(came, snap("n")).otherwise(snap("o")).alias("snapshot"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The action of each row that differs."""
    columns = [c for c in old.columns if c != key]
    action = F.when(F.col(f"o.{key}").isNull(), "Created").when(F.col(f"n.{key}").isNull(), "Deleted").when(_differs(columns), "Updated")
    return _joined(old, new, key).select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), action.alias("action")).where("action IS NOT NULL")


def strictest(policies: DataFrame) -> DataFrame:
    """(entity, field) -> the strictest treatment of all that are stated."""
    return policies.groupBy("entity", "field").agg(F.max("treatment").alias("treatment"))


GUID = r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"


def subjects(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, subject, relationship) of the guid columns; no nulls, no repeats."""
    pairs = F.array(*(F.struct(F.col(c).alias("subject"), F.lit(r).alias("relationship")) for c, r in columns.items()))
    return df.select(key, F.inline(pairs)).where(F.col("subject").rlike(GUID)).distinct()


def diff_map(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A JSON map {property: {Old, New}} of each changed row."""
    columns = [c for c in old.columns if c != key]
    entry = lambda c: F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.struct(F.lit(c).alias("k"), F.struct(F.col(f"o.{c}").cast("string").alias("Old"), F.col(f"n.{c}").cast("string").alias("New")).alias("v")))
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).where(_differs(columns))
    return both.select(F.col(f"n.{key}").alias(key), F.to_json(F.map_from_entries(F.array_compact(F.array(*map(entry, columns))))).alias("diff"))


#: Parts of names of columns that leave a captured row.
SENSITIVE_PARTS = tuple("password secret token apikey ssn creditcard cvv pin email phone address dateofbirth salary".split())


def sanitized(df: DataFrame, sensitive: tuple[str, ...] = SENSITIVE_PARTS) -> DataFrame:
    """Without columns whose names are sensitive."""
    return df.drop(*(c for c in df.columns if any(s in c.lower() for s in sensitive)))


def operation_pairs(events: DataFrame) -> DataFrame:
    """Started operations with their end, if any: rows (operation, kind Started/Completed/Failed, at)."""
    start = events.where("kind = 'Started'").select("operation", F.col("at").alias("started"))
    end = events.where("kind IN ('Completed', 'Failed')").select("operation", F.col("kind").alias("outcome"), F.col("at").alias("ended"))
    joined = start.join(end, "operation", "full_outer")
    ms = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1000).cast("long")
    return joined.select("operation", "outcome", ms.alias("ms"), F.when(F.col("started").isNull(), "end without start").alias("warning"))


def user_fields(users: DataFrame) -> DataFrame:
    """The chosen user fields as a JSON map; the token itself is not among them."""
    full = F.trim(F.concat_ws(" ", F.col("FirstName"), F.col("LastName")))
    fields = {"UserName": F.col("UserName"), "Email": F.col("Email"), "FullName": F.when(full != "", full), "HasRefreshToken": (F.coalesce(F.col("RefreshToken"), F.lit("")) != "").cast("string")}
    entries = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in fields.items())))
    return users.select("UserName", F.to_json(F.map_from_entries(entries)).alias("custom_fields"))


def tracked(result: DataFrame, log_path: str, kind: str, params: str, purpose: str, use: Callable[[DataFrame], object]) -> tuple[object, int]:
    """Hands a query's rows to ``use``, which runs one action on them, and appends the event that says it was asked. The rows are counted as they pass by: the query runs once. Returns what ``use`` returns and the count."""
    seen = Observation()
    out = use(result.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    row = result.sparkSession.createDataFrame([(kind, params, purpose, n)], "query_type string, params string, purpose string, n_rows long")
    row.withColumns(text.query_flags(F.col("query_type"), F.col("params"), F.col("purpose"))).write.mode("append").parquet(log_path)
    return out, n
