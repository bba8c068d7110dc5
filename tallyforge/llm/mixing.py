"""Mixing sources to target weights.

Each source's words are summed, targets are weights times a level under a ceiling of twice the
source's words, and the repetition rate of a source is its target over its words. A document is
emitted floor(rate) times, and once more if its coin, seeded by a hash of its id, falls below the
fraction. Rates never exceed 2, so neither do copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.llm.base import Shared, n_words

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CEILING = 2
BROADCAST_SOURCES = 100_000
SALTS = 64


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5: the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """One row per source of (source, size): source_size, target.

    Weights go round the sources by code point, null last. Targets are least(ceiling * size,
    level * weight); the level that makes them sum to ``budget`` times all sizes is found in one
    pass over the sources in the order in which they reach their ceilings, which equals resharing
    the excess by weight until none is above. The windows run in one task over one row of six numbers
    per source, never over documents; tens of millions of sources still sort there, by spilling.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_q_rank") - 1) % len(weights) + 1).cast("int"))
    cap = (F.lit(ceiling) * F.col("source_size")).cast("double")
    by_cap = W.orderBy((F.col("_q_cap") / F.col("_q_weight")).asc(), F.col("_q_rank").asc())
    rest = F.lit(budget) * F.sum(F.col("source_size").cast("double")).over(W.partitionBy()) - F.coalesce(F.sum("_q_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = rest / F.sum("_q_weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("_q_rank", rank).withColumn("_q_weight", weight).withColumn("_q_cap", cap).withColumn("_q_level", level)
    free = F.when(F.col("_q_cap") > F.col("_q_level") * F.col("_q_weight"), F.struct((F.col("_q_cap") / F.col("_q_weight")).alias("a"), F.col("_q_rank").alias("b"), F.col("_q_level").alias("level")))
    per = per.withColumn("_q_final", F.min(free).over(W.partitionBy())["level"])
    target = F.least(F.col("_q_cap"), F.coalesce(F.col("_q_final") * F.col("_q_weight"), F.col("_q_cap")))
    return per.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, seed: int = 11, weights=WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """docs (doc_id, source, text, ...) with _q_size, source_size, target and _q_copies.

    A source without words has target 0 and no copies. Rows that repeat an id share its coin; rows
    without an id toss by their text. The table of sources is broadcast up to BROADCAST_SOURCES
    rows; beyond that it is joined on source and salt, so a source with a third of the rows is
    spread over SALTS parts.
    """
    spark = docs.sparkSession
    slim = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = Shared(spark, "mix").save(source_targets(slim, weights, budget, ceiling), "targets")
    targets = targets.withColumnsRenamed({"source": "_q_source"})
    rows = docs.drop("source_size", "target").withColumn("_q_size", n_words(F.col("text")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = rows.withColumn("_q_coin", coin(key, seed))
    same = F.col("source").eqNullSafe(F.col("_q_source"))
    if targets.count() <= BROADCAST_SOURCES:
        out = rows.join(F.broadcast(targets), same)
    else:
        rows = rows.withColumn("_q_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        salted = targets.withColumn("_q_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(salted, same & (F.col("_q_salt") == F.col("_q_salt2"))).drop("_q_salt", "_q_salt2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(F.col("_q_coin") < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("_q_copies", copies.cast("int")).drop("_q_source", "_q_coin")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it; the columns of docs in their order. Null and empty
    texts have no words: they count nothing towards a target and are taken like any row of their
    source; a source that has only such rows is left out."""
    out = with_copies(docs, **options).filter("_q_copies > 0")
    out = out.withColumn("_q_copy", F.explode(F.sequence(F.lit(1), F.col("_q_copies"))))
    return out.select(*docs.columns)


ORACLE = """
with s as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from s group by source),
ranked as (select *, row_number() over (order by source asc nulls last) as rk from per),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((rk - 1) % 3 + 1)::int] as weight, (2 * source_size)::double as cap from ranked),
lv as (select *, (1.5::double * sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, rk rows between current row and unbounded following) as lvl from w),
fin as (select (select lvl from lv where cap > lvl * weight order by cap / weight, rk limit 1) as final),
tg as (select source, source_size, least(cap, coalesce(final * weight, cap)) as target from lv, fin),
j as (select s.*, tg.source_size, tg.target, case when tg.source_size > 0 then tg.target / tg.source_size else 0 end as rate,
    ('0x' || substr(md5('11:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 13))::bigint::double / 4503599627370496.0::double as u
    from s join tg on s.source is not distinct from tg.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from j
"""
