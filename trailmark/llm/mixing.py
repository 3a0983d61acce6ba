"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's rate is the number of times its documents should occur on average: its share of the mixture over its share of the corpus,
both in bytes. Each document draws its count from the Poisson distribution of that mean, by inverting the distribution at a number
that a hash of seed and id gives: the draw needs no state, is the same after a retry, and does not depend on the partitioning. The
document is repeated that often, and a hash of seed, id, copy and place in the table deals the copies out in random order, equal rows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, numbered, written

SEED = 17
#: Share of the corpus to the power of this is the default weight: small sources are raised, large ones lowered.
TEMPERATURE = 0.5
#: A draw of a larger mean is the sum of draws of equal means below this, where exp(-mean) does not vanish.
MEAN_AT_MOST = 256.0
#: 13 hexadecimal digits of a hash: as many as a double holds exactly.
_STEPS = float(1 << 52)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the hash of the parts as text; null reads as the empty text."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double") + 0.5) / _STEPS


def _size(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: source, rate, draws (how many draws are added) and cdf (the distribution of one draw).

    weights (source, weight): a source that it lacks has weight 0. None: the source's bytes to the power TEMPERATURE.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(_size(text_col)).alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE)))
    else:
        own = weights.groupBy(F.col("source").alias("w")).agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.join(own, F.col("source").eqNullSafe(F.col("w")), "left").select("source", "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = written(sizes, "source-sizes")
    all_bytes, all_weight = sizes.agg(F.sum("bytes"), F.sum("weight")).first()
    rate = F.col("weight") / all_weight * all_bytes / F.col("bytes") if all_weight else F.lit(0.0)
    rates = sizes.select("source", rate.alias("rate"))
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_AT_MOST)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("mean") / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf"),
    )
    return rates.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).drop("mean")


def with_copies(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` and n_copies, the count that each document draws. A document without an id draws by its text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))))
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(seed), key, j))
    count = F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, u: acc + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    rates = rates.select(F.col("source").alias(OWN + "source"), "draws", "cdf")
    return docs.join(rates, F.col(source_col).eqNullSafe(F.col(OWN + "source"))).withColumn(OWN + "n", count).drop(OWN + "source", "draws", "cdf")


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and copy (from 1), n_copies, order_key: the mixture in random order, by partition and within each.

    A null source is a source of its own; null and empty texts weigh one byte. Rows with equal ids draw equal counts; a null id draws by the text instead.
    An empty table gives an empty result. Columns of ``docs`` named copy, n_copies or order_key are replaced. Documents that draw 0 are not in the mixture: that is
    what a target below the source's share asks for.
    """
    rates = written(source_rates(docs, weights, source_col, text_col), "rates")  # read again, its true size decides about a broadcast
    columns = [c for c in docs.columns if c not in ("copy", "n_copies", "order_key")]
    inner = numbered(docs.select([F.col(c).alias(f"{OWN}{k}") for k, c in enumerate(columns)]), OWN + "rid")
    name = {c: f"{OWN}{k}" for k, c in enumerate(columns)}
    counted = with_copies(inner, rates, name[id_col], name[source_col], name[text_col], seed)
    copies = counted.where(F.col(OWN + "n") > 0).select(
        *(F.col(own).alias(c) for c, own in name.items()),
        F.explode(F.sequence(F.lit(1), F.col(OWN + "n").cast("int"))).alias("copy"),
        F.col(OWN + "n").alias("n_copies"),
        OWN + "rid",
    )
    keyed = copies.withColumn("order_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy"), F.col(OWN + "rid"))).drop(OWN + "rid")
    return keyed.repartition("order_key").sortWithinPartitions("order_key")
