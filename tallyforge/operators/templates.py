"""Estimate templates: price statistics, canonical deals, positions, keywords, reverse index, and
estimates from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions.dates import freshness
from tallyforge.functions.numeric import round_half_up
from tallyforge.functions.text import tokens
from tallyforge.operators.intervals import interval_join, stacked
from tallyforge.operators.windows import top_n
from tallyforge.sources.stored import stored


def price_stats(samples: DataFrame, by: list[str], as_of: str) -> DataFrame:
    """Per group of (by, price, quantity, closed): mean, median, mean weighted by quantity and
    freshness, mean without the lowest and highest tenth, their average, spread and confidence.
    Prices of zero and less are left out; a missing quantity counts as 1."""
    s = samples.filter("price > 0")
    quantity = F.when(F.coalesce("quantity", F.lit(0.0)) != 0, F.col("quantity")).otherwise(1.0)
    s = s.withColumn("_w", quantity * freshness(F.col("closed"), as_of))
    w = W.partitionBy(*by)
    s = s.withColumn("_rn", F.row_number().over(w.orderBy("price"))).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_cut", F.floor(F.col("_n") * 0.1))
    inner = F.when((F.col("_rn") > F.col("_cut")) & (F.col("_rn") <= F.col("_n") - F.col("_cut")), F.col("price"))
    out = s.groupBy(*by).agg(
        F.avg("price").alias("mean"),
        F.median("price").alias("median"),
        (F.sum(F.col("price") * F.col("_w")) / F.sum("_w")).alias("weighted_mean"),
        F.avg(inner).alias("trimmed_mean"),
        F.stddev_pop("price").alias("std"),
        F.count(F.lit(1)).alias("sample_size"),
    )
    out = out.withColumn("final", (F.col("mean") + F.col("median") + F.col("weighted_mean") + F.col("trimmed_mean")) / 4)
    out = out.withColumn("cv", F.when(F.col("final") > 0, F.col("std") / F.col("final")).otherwise(0.0))
    conf = F.when(F.col("cv") < 0.15, "high").when(F.col("cv") < 0.3, "medium").otherwise("low")
    money = [round_half_up(F.col(c), 2).alias(c) for c in ("mean", "median", "weighted_mean", "trimmed_mean", "final", "std")]
    return out.select(*by, *money, round_half_up(F.col("cv"), 4).alias("cv"), conf.alias("confidence"), "sample_size")


def _element(deals: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """Element floor(n q) of the sorted values, all above 0, per group. Ranges of values, a 256th of an octave
    wide, are counted first; only the values of the range that holds the element come together."""
    rows = deals.select(by, value, F.rint(F.log2(value) * 256).alias("_range"))
    per = rows.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    to = lambda order: F.sum("_c").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    per = per.withColumn("_to", to("_range")).withColumn("_n", F.sum("_c").over(W.partitionBy(by)))
    at = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1) - (F.col("_to") - F.col("_c"))
    # written, so that its size is known when rows meet it
    hit = stored(per.withColumn("_at", at).filter("_at >= 0 and _at < _c").select(by, "_range", "_at"), "ranges")
    per = rows.join(hit, [by, "_range"]).groupBy(by, "_at", value).agg(F.count(F.lit(1)).alias("_c"))
    return per.withColumn("_to", to(value)).filter("_to > _at").groupBy(by).agg(F.min(value).alias(name))


def canonical_deals(deals: DataFrame, category: str) -> DataFrame:
    """The deal that stands for a category: of those with at least two positions, and as many as six
    in ten have, an order before an offer, the nearest to the median opportunity.

    Deals stay where they are: what a category asks of them, and the least gap that they reach, are a row per
    category, written so that its size is known when deals meet it.
    """
    pool = deals.filter("unique_products >= 2")
    p60 = _element(pool, category, "unique_products", 0.6, "p60")
    median = _element(pool.filter("opportunity > 0"), category, "opportunity", 0.5, "median_opportunity")
    some = pool.join(stored(p60.join(median, category, "left"), "limits"), category).filter("unique_products >= p60")
    gap = F.abs(F.coalesce("opportunity", F.lit(0.0)) - F.coalesce("median_opportunity", F.lit(0.0)))
    some = some.select(category, (F.col("dataset") != "orders").cast("int").alias("_a"), gap.alias("_gap"), "deal_id", "dataset")
    least = some.groupBy(category, "_a").agg(F.min("_gap").alias("_gap"), F.count(F.lit(1)).alias("_c"))
    least = least.groupBy(category).agg(F.min(F.struct("_a", "_gap")).alias("_b"), F.sum("_c").alias("eligible"))
    best = some.join(stored(least.select(category, "_b.*", "eligible"), "least"), [category, "_a", "_gap"])
    return best.groupBy(category, "eligible").agg(F.min(F.struct("deal_id", "dataset")).alias("_b")).select(category, "_b.deal_id", "_b.dataset", "eligible")


def good_frequency(lines: DataFrame, category: str) -> DataFrame:
    """Share of a category's deals in which each product occurs.

    A deal names each of its products and categories once, where its lines lie; what is counted by product
    needs no distinct deals any more. Both counts come from one pass, written once, a row per product.
    """
    pair = F.struct(F.col(category).alias("c"), F.col("product_key").alias("p"), F.lit(False).alias("whole"))
    deals = lines.groupBy("dataset", "deal_id").agg(F.collect_set(pair).alias("pairs"))
    whole = F.array_distinct(F.transform("pairs", lambda x: F.struct(x["c"].alias("c"), F.lit(None).cast("string").alias("p"), F.lit(True).alias("whole"))))
    named = F.col("dataset").isNotNull() & F.col("deal_id").isNotNull()
    counts = deals.select(named.alias("named"), F.explode(F.concat("pairs", whole)).alias("x")).groupBy("x.c", "x.p", "x.whole").agg(F.count_if("named").alias("deals"))
    counts = stored(counts, "frequency")
    n = counts.filter("whole").select(F.col("c").alias(category), F.col("deals").alias("_n"))
    per = counts.filter("not whole").select(F.col("c").alias(category), F.col("p").alias("product_key"), "deals")
    return per.join(n, category).select(category, "product_key", "deals", round_half_up(F.col("deals") / F.col("_n"), 2).alias("frequency"))


def canonical_positions(lines: DataFrame, canonical: DataFrame, category: str, as_of: str) -> DataFrame:
    """Positions of canonical deals with statistics over the whole category."""
    samples = lines.select(category, "product_key", "price", "quantity", F.col("ship").cast("date").alias("closed"))
    rows = lines.join(canonical.select(category, "dataset", "deal_id"), [category, "dataset", "deal_id"]).select(category, "deal_id", "line", "product_key", "product_name", "quantity")
    # statistics only for products that a canonical deal has
    samples = samples.join(rows.select(category, "product_key").distinct(), [category, "product_key"], "left_semi")
    stats = price_stats(samples, [category, "product_key"], as_of)
    return rows.join(stats.select(category, "product_key", "final", "std", "confidence", "sample_size"), [category, "product_key"]).join(good_frequency(lines, category).drop("deals"), [category, "product_key"])


def keywords(texts: DataFrame, by: str, text: str, n: int = 8, least: int = 3, stop: tuple = ()) -> DataFrame:
    """The n most frequent tokens per group."""
    words = texts.select(by, F.explode(tokens(F.col(text), least)).alias("word")).filter(~F.col("word").isin(*stop) if stop else F.lit(True))
    return top_n(words.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n")), [by], [F.desc("n"), F.col("word")], n)


def reverse_index(positions: DataFrame, category: str) -> DataFrame:
    return positions.groupBy("product_key").agg(F.array_join(F.array_sort(F.collect_set(category)), "|").alias("categories"))


def estimates(positions: DataFrame, requests: DataFrame, category: str) -> DataFrame:
    """(request_id, category, total, low, high, positions): each position's final price times its
    typical quantity times the request's scale. The band is the larger of the joint standard
    deviation and a tenth of the total."""
    q = F.col("quantity") * F.col("scale")
    rows = requests.join(positions, category).select("request_id", category, (F.col("final") * q).alias("t"), F.pow(F.col("std") * q, 2).alias("v"))
    out = rows.groupBy("request_id", category).agg(F.sum("t").alias("total"), F.sqrt(F.sum("v")).alias("sd"), F.count(F.lit(1)).alias("positions"))
    band = F.greatest(F.col("sd"), F.col("total") * 0.1)
    r = lambda c: F.round(c, 2)
    return out.select("request_id", category, r(F.col("total")).alias("total"), r(F.greatest(F.col("total") - band, F.lit(0.0))).alias("low"), r(F.col("total") + band).alias("high"), "positions")


BRACKETS = 1000


def bracket_price(rows: DataFrame, value: Column, brackets: DataFrame) -> DataFrame:
    """Range join: the first bracket (below, rate) whose upper bound exceeds the value, null where none does.
    Up to BRACKETS steps are one expression over them; a longer list is joined by intervals."""
    steps = [(r["below"], r["rate"]) for r in brackets.orderBy("below").limit(BRACKETS + 1).collect()]
    if len(steps) > BRACKETS:
        last = brackets.agg(F.max("below")).first()[0]
        valued, names = rows.withColumn("_value", value), rows.columns
        listed = stacked(brackets.groupBy("below").agg(F.min("rate").cast("double").alias("rate")), "below")
        found = interval_join(valued, listed, "_value", "_low", "below").select(*names, "rate")
        none = valued.filter(F.col("_value").isNull() | (F.col("_value") >= last)).select(*names, F.lit(None).cast("double").alias("rate"))
        return found.unionByName(none)
    out = F.when(F.lit(False), F.lit(0.0))
    for below, rate in steps:
        out = out.when(value < below, F.lit(float(rate)))
    return rows.withColumn("rate", out)
