"""Range joins: rows whose value lies in intervals of another table, both sides of any size.

Intervals are dealt to levels by their length; a level's bins are four times as wide as those of the
level below, so an interval lies in two bins of its level at most, however long it is. A value is
looked up in one bin of every level that occurs. Bins and keys meet in an equi-join, then the bounds
are tested. Bins with very many values are split by salt, their intervals copied to each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.sources.stored import stored

#: Values of a bin and key beyond which it is split, and into how many parts.
HOT, SALTS = 1_000_000, 16
#: Split bins that are named to every task; beyond that all bins are split.
NAMED = 100_000
_OPEN = -1


def interval_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, by: tuple[str, ...] = (), hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """Pairs of points and ranges that agree in ``by`` and have low <= value < high: the columns of both, those
    of ``by`` once. Values and bounds are numbers.

    A null bound is open on that side; intervals without a value in them (low >= high) and null values
    match nothing, null keys neither. Open intervals have a level of their own and are found by key alone.
    Rows that repeat on either side repeat in the result. Other columns must have different names.
    """
    ranges = ranges.filter(F.coalesce(F.col(low) < F.col(high), F.lit(True)))
    length = (F.col(high) - F.col(low)).cast("double")
    width = ranges.agg(F.percentile_approx(length, 0.25).alias("w")).first().w or 1.0
    level = F.when(length.isNull(), _OPEN).otherwise(F.greatest(F.ceil(F.log(4.0, length / width) - F.lit(1e-9)), F.lit(0))).cast("int")
    size = F.lit(width) * F.pow(F.lit(4.0), F.col("_level"))
    binned = lambda x: F.when(F.col("_level") == _OPEN, 0).otherwise(F.floor(x.cast("double") / size)).cast("bigint")

    keyed = ranges.withColumn("_level", level)
    levels = [r._level for r in keyed.select("_level").distinct().collect()]  # by powers of four of the length: some dozens
    right = keyed.withColumn("_bin", F.explode(F.when(F.col("_level") == _OPEN, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(binned(F.col(low)), binned(F.col(high))))))
    left = points.filter(F.col(value).isNotNull())
    if not levels:
        return left.limit(0).join(ranges.limit(0), list(by)) if by else left.limit(0).crossJoin(ranges.limit(0))
    left = left.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", binned(F.col(value)))

    # bins with many values are split; each part meets a copy of the bin's intervals
    keys = [*by, "_level", "_bin"]
    crowded = stored(left.groupBy(*keys).count().filter(F.col("count") > hot).select(*keys, F.lit(True).alias("_hot")), "crowded")
    n = crowded.count()
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    if n == 0:
        left, right = left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    elif n <= NAMED:
        left = left.withColumn("_salt", salt).join(F.broadcast(crowded), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(0)).drop("_hot")
        right = right.join(F.broadcast(crowded), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    else:
        left, right = left.withColumn("_salt", salt), right.withColumn("_salt", each)
    inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return left.join(right, [*keys, "_salt"]).filter(inside).drop("_level", "_bin", "_salt")


def stacked(steps: DataFrame, below: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A price list of upper bounds as intervals [_low, below): each begins where the one before it ends,
    the first is open. Lists are split by key; one list is a bounded window."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return steps.withColumn("_low", F.lag(below).over(w.orderBy(below)))
