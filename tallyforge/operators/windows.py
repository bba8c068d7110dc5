"""Ranked and cumulative operators that hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def mode(df: DataFrame, by: list[str], value: str, first: Column, name: str) -> DataFrame:
    """The most frequent value per group; of equally frequent ones the one that comes first. Two
    aggregations with map-side combining, no window over a group."""
    per = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"))
    return per.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(name))


def running_share(df: DataFrame, value: str, key: str, total: Column | None = None, buckets: int = 64) -> DataFrame:
    """Adds rank, running (sum of value down to the row) by value descending, then key.

    Rows are cut into ranges of value at approximate quantiles; windows run inside ranges, and the
    ranges' own sums, at most ``buckets`` rows, are added. No window sees all rows.
    """
    cuts = sorted(set(df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    # the number of cuts that are larger: ranges are numbered from the largest values on
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c > F.col(value))) if cuts else F.lit(0)
    df = df.withColumn("_part", F.coalesce(part, F.lit(len(cuts) + 1)))
    order = W.partitionBy("_part").orderBy(F.col(value).desc_nulls_last(), F.col(key))
    inside = df.withColumn("_rn", F.row_number().over(order)).withColumn("_run", F.sum(value).over(order.rowsBetween(W.unboundedPreceding, 0)))
    sums = df.groupBy("_part").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"))
    out = inside.join(F.broadcast(sums), "_part")
    return out.withColumn("rank", F.col("_rn") + F.col("_c")).withColumn("running", F.col("_run") + F.col("_s")).drop("_part", "_rn", "_run", "_s", "_c")


def keep_if_any(df: DataFrame, by: list[str], passes: Column, rank: Column, fallback: int | None) -> DataFrame:
    """Rows that pass; where none of a group does, its first ``fallback`` rows by rank (all if None)."""
    hit = F.max(F.col("_passes").cast("int")).over(W.partitionBy(*by)) == 1
    rest = F.lit(True) if fallback is None else rank <= fallback
    df = df.withColumn("_passes", passes).withColumn("_hit", hit)
    return df.filter((F.col("_hit") & F.col("_passes")) | (~F.col("_hit") & rest)).drop("_hit", "_passes")


def latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the newest. An upsert is a union and this."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).filter("_rn = 1").drop("_rn")


def merge_tiers(tiers: list[DataFrame], by: list[str], order: list[Column]) -> DataFrame:
    """Union of result lists; of rows with the same key that of the first list stays."""
    out = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy("tier", *order))).filter("_rn = 1").drop("_rn")


def previous_where(df: DataFrame, by: str, order: list[Column], value: Column, cond: Column, name: str) -> DataFrame:
    """As-of within a group: the last earlier value that meets a condition."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(cond, value), ignorenulls=True).over(w))
