"""Prices for requests from ranked candidates, and the parts of a response that show them.

Candidates are rows (query_id, rank, ...) of retrieved documents or catalogue facts.
"""

from __future__ import annotations

import math
import os.path
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions.numeric import round_money
from tallyforge.operators.similarity import REMAINS, edit_pairs, spread, within_edits
from tallyforge.operators.windows import top_n
from tallyforge.sources.stored import stored

#: Order in which a candidate may anchor a price.
ANCHORS = ("auto", "guided", "bundle")


def anchors(candidates: DataFrame, pool: int = 10) -> DataFrame:
    """The candidate that anchors each query's price: an auto price before a guided one before a
    bundle before any with a median, the better ranked one of equals, among the first ``pool``."""
    kind = F.when(F.col("doc_type") == "bundle", "bundle").otherwise(F.col("price_mode"))
    level = reduce(lambda c, i: c.when(kind == ANCHORS[i], i), range(1, len(ANCHORS)), F.when(kind == ANCHORS[0], 0)).when(F.col("p50").isNotNull(), len(ANCHORS))
    some = candidates.filter(F.col("rank") <= pool).withColumn("level", level).filter("level is not null")
    best = F.min_by(F.struct(*[c for c in some.columns if c != "query_id"]), F.struct("level", "rank"))
    return some.groupBy("query_id").agg(best.alias("r")).select("query_id", "r.*")


def resolved(rows: DataFrame, markup: Column, band: float = 0.2) -> DataFrame:
    """value, low, high and confidence of a product: by mode, else cost times mark-up, else the base
    price with a wide band; nothing at all is a manual price of null."""
    p50, base, cost = F.col("p50"), F.col("base_price"), F.col("cost_price")
    known = F.col("price_mode").isin("auto", "guided") & p50.isNotNull()
    value = F.when(known, p50).when(cost > 0, cost * markup).otherwise(base)
    low = F.when(known & (F.col("price_mode") == "auto"), F.coalesce("p25", p50)).when(known, p50 * (1 - band)).when(cost > 0, cost * markup * 0.8).otherwise(base * 0.7)
    high = F.when(known & (F.col("price_mode") == "auto"), F.coalesce("p75", p50)).when(known, p50 * (1 + band)).when(cost > 0, cost * markup * 1.2).otherwise(base * 1.3)
    conf = F.when(known, F.col("price_mode")).otherwise("manual")
    return rows.withColumns({"value": round_money(value), "low": round_money(low), "high": round_money(high), "confidence": conf})


def bundle_price(median: Column, names: Column, services: dict[str, tuple[tuple, float]], wanted: Column, has: Column, band: float = 0.2) -> dict[str, Column]:
    """Median of a bundle, raised for each service that its products lack, scaled by the wanted over
    the bundle's size (between a half and three times)."""
    low = F.lower(F.coalesce(names, F.lit("")))
    lacks = {k: ~reduce(lambda a, b: a | b, [low.contains(t) for t in terms]) for k, (terms, _) in services.items()}
    surcharge = reduce(lambda a, k: a + F.when(lacks[k], services[k][1]).otherwise(0.0), services, F.lit(1.0))
    size = F.when((wanted > 0) & (has > 0), F.greatest(F.least(wanted / has, F.lit(3.0)), F.lit(0.5))).otherwise(1.0)
    value = F.when(median > 0, median * surcharge * size)
    missing = F.array_join(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in lacks.items()]), lambda x: x.isNotNull()), ", ")
    return {"value": F.round(value, 0), "low": F.round(value * (1 - band), 0), "high": F.round(value * (1 + band), 0), "missing": missing}


def analog_prices(targets: DataFrame, analogs: DataFrame, prices: DataFrame) -> DataFrame:
    """For targets (key, name, direction) the first analog (by rank) that has a price (name, price)."""
    rows = targets.join(analogs, ["name", "direction"]).join(prices.select(F.col("name").alias("analog"), F.col("direction").alias("analog_direction"), "price"), ["analog", "analog_direction"])
    return rows.groupBy("key").agg(F.min_by(F.struct("analog", "price"), "rank").alias("r")).select("key", "r.*")


def parametric(components: DataFrame, pools: DataFrame) -> DataFrame:
    """Sum over a request's components (query_id, component, quantity) of the best price of its pool
    (component, low, high, price, confidence): the range that holds the quantity, else the nearest.
    Confidence is weighted by value; the band is 10, 25 or 35 % by confidence.

    Ranges are looked up once for each distinct component and quantity, so requests that ask for equal
    amounts are not multiplied by their pool; requests meet only the range found."""
    components = stored(components.select("query_id", "component", "quantity").distinct(), "components")
    asked = components.select("component", "quantity").distinct()
    gap = F.greatest(F.col("low") - F.col("quantity"), F.col("quantity") - F.col("high"), F.lit(0.0))
    rows = asked.join(pools, "component").withColumn("gap", gap)
    best = rows.groupBy("component", "quantity").agg(F.min_by(F.struct("price", "confidence"), F.struct("gap", "price", "confidence")).alias("r"))
    best = stored(best, "ranges").alias("b")
    best = components.alias("a").join(best, (F.col("a.component") == F.col("b.component")) & F.col("a.quantity").eqNullSafe(F.col("b.quantity"))).select("query_id", "a.quantity", "r")
    value = F.col("r.price") * F.col("quantity")
    out = best.groupBy("query_id").agg(F.sum(value).alias("t"), F.sum(value * F.col("r.confidence")).alias("w"), F.count(F.lit(1)).alias("components"))
    conf = F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0)
    band = F.when(conf >= 0.8, 0.1).when(conf >= 0.5, 0.25).otherwise(0.35)
    return out.select("query_id", round_money(F.col("t")).alias("total"), F.round(conf, 4).alias("confidence"), round_money(F.col("t") * (1 - band)).alias("low"), round_money(F.col("t") * (1 + band)).alias("high"), "components")


def heuristic_boost(factors: list[tuple[Column, Column | float]]) -> Column:
    """Product of the factors whose conditions hold."""
    return reduce(lambda a, f: a * F.when(f[0], f[1]).otherwise(1.0), factors, F.lit(1.0))


def segments(candidates: DataFrame, quotas: dict[str, int], name: str) -> DataFrame:
    """References by segment: each name is shown once, in the first segment (in the order of quotas)
    that has it, best rank first, up to the segment's quota."""
    order = F.array_position(F.array(*[F.lit(s) for s in quotas]), F.col("segment"))
    rows = candidates.withColumn("_o", order).filter("_o > 0")
    rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy("query_id", name).orderBy("_o", "rank"))).filter("_rn = 1")
    limit = reduce(lambda a, s: a.when(F.col("segment") == s, quotas[s]), quotas, F.when(F.lit(False), 0))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id", "segment").orderBy("rank")))
    return rows.filter(F.col("place") <= limit).drop("_o", "_rn")


def distinct_best(candidates: DataFrame, name: str, n: int) -> DataFrame:
    """The n best candidates of each query with distinct names."""
    one = candidates.groupBy("query_id", name).agg(F.min("rank").alias("rank"))
    return top_n(one, ["query_id"], [F.col("rank"), F.col(name)], n, "place")


def sources(candidates: DataFrame, pool: int = 10) -> DataFrame:
    """orders, offers, both or catalog_only by what the first candidates rest on."""
    some = candidates.filter(F.col("rank") <= pool).groupBy("query_id").agg(F.bool_or(F.col("dataset") == "orders").alias("o"), F.bool_or(F.col("dataset") == "offers").alias("f"))
    return some.select("query_id", F.when(F.col("o") & F.col("f"), "both").when(F.col("o"), "orders").when(F.col("f"), "offers").otherwise("catalog_only").alias("source"))


def dominant(candidates: DataFrame, value: str, pool: int, share: float) -> DataFrame:
    """The value of at least ``share`` of a query's first ``pool`` candidates, else null."""
    some = candidates.filter(F.col("rank") <= pool)
    per = some.groupBy("query_id", value).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
    best = per.groupBy("query_id").agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("r"))).alias("b"), F.sum("n").alias("all"))
    return best.select("query_id", F.when(F.col("b.n") >= share * F.col("all"), F.col(f"b.{value}")).alias(value))


def linked(rows: DataFrame, targets: list[DataFrame], n: int) -> DataFrame:
    """Follow links (query_id, id): the target of an id from the first table that has it (each table:
    id, title), n links a query by id."""
    out = None
    for i, t in enumerate(targets):
        part = rows.join(t.select("id", "title"), "id").withColumn("tier", F.lit(i))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("query_id", "id").agg(F.min_by(F.struct("title", "tier"), "tier").alias("r")).select("query_id", "id", "r.*")
    return top_n(one, ["query_id"], [F.col("id")], n, "place")


def skip_reasons(deals: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """How many deals each first matching rule leaves out; 'kept' for the rest."""
    reason = F.coalesce(*[F.when(c, F.lit(k)) for c, k in rules], F.lit("kept"))
    return deals.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("deals"))


def coverage(values: DataFrame, group: str, covered: Column, n: int) -> DataFrame:
    """Uncovered groups by value with their share of everything, the n largest."""
    per = values.groupBy(group).agg(F.sum("value").alias("v"), F.bool_or(covered).alias("c"))
    total = per.agg(F.sum("v").alias("t"))
    return per.filter(~F.col("c")).join(F.broadcast(total)).select(group, F.round("v", 2).alias("value"), F.round(F.col("v") / F.col("t"), 4).alias("share")).orderBy(F.desc("value"), group).limit(n)


def slug_matches(left: DataFrame, right: DataFrame, least: float = 0.55, inside: float = 0.4, shortest: int = 4) -> DataFrame:
    """(id, other, kind, score): exact slug (0), else one of at least ``shortest`` characters contained
    in the other and ``inside`` of its length (1), else edit similarity from ``least`` on (2).

    Slugs are compared once each. A contained slug equals a part of the other: parts of its length are
    joined. Edit similarity is asked only for slugs that found nothing so far, with one edit more each
    time: a slug is done when no pair with more edits can reach its best score, so slugs that nearly all
    resemble each other meet few. What is left beyond short strings is compared by segments.
    """
    a, b = left.select("slug").distinct(), right.groupBy("slug2").agg(F.min("other").alias("other"))
    n, m = F.length("slug"), F.length("slug2")
    score = 1 - F.levenshtein("slug", "slug2") / F.greatest(n, m)
    exact = a.join(b, F.col("slug") == F.col("slug2")).select("slug", "other", F.lit(0).alias("kind"), F.lit(1.0).alias("score"))
    held = _containing(a, b, "slug", "slug2", inside, shortest).unionByName(_containing(b, a, "slug2", "slug", inside, shortest))
    held = held.select("slug", "other", F.lit(1).alias("kind"), F.round(F.least(score + 0.2, F.lit(1.0)), 4).alias("score"))
    first = lambda df: df.groupBy("slug").agg(F.min_by(F.struct("other", "kind", "score"), F.struct("kind", -F.col("score"), "other")).alias("r"))
    found = stored(first(exact.unionByName(held)), "slugs")
    rest = stored(a.join(found.select("slug"), "slug", "left_anti"), "slugs")
    ends = a.unionByName(b.select(F.col("slug2").alias("slug"))).agg(F.min("slug"), F.max("slug"), F.max(F.length("slug"))).first()
    common, longest = len(os.path.commonprefix([ends[0] or "", ends[1] or ""])), ends[2] or 0
    edits = 0
    while math.comb(longest - common, edits + 1) <= REMAINS and edits + 1 <= longest * (1 - least) + 1e-6 and not rest.isEmpty():
        edits += 1
        near = within_edits(rest, b, "slug", "slug2", edits, common).filter(score >= least)
        near = first(near.select("slug", "other", F.lit(2).alias("kind"), F.round(score, 4).alias("score")))
        near = stored(near.filter(F.col("r.score") > F.round(1 - (edits + 1) / F.greatest(n, F.lit(longest)), 4)), "slugs")
        found, rest = found.unionByName(near), stored(rest.join(near.select("slug"), "slug", "left_anti"), "slugs")
    if edits + 1 <= longest * (1 - least) + 1e-6 and not rest.isEmpty():
        near = edit_pairs(rest, b, "slug", "slug2", least).filter(score >= least)
    else:  # with all edits that the ratio allows, what was seen is all there is
        near = within_edits(rest, b, "slug", "slug2", edits, common).filter(score >= least)
    found = found.unionByName(first(near.select("slug", "other", F.lit(2).alias("kind"), F.round(score, 4).alias("score"))))
    return left.select("id", "slug").join(found, "slug").select("id", "r.*")


def _containing(short: DataFrame, long: DataFrame, x: str, y: str, inside: float, shortest: int) -> DataFrame:
    """Pairs in which x of short, of at least ``shortest`` characters and ``inside`` of the other's length, is
    a part of y of long and not all of it: met at that part, so slugs that only begin alike never meet.
    A slug has as many parts as the square of its length: this is for names."""
    n = F.length(y)
    least = F.greatest(F.lit(max(shortest, 1)), F.ceil(n * F.lit(inside) - F.lit(1e-9)).cast("int"))
    parts = spread(long, y).filter(n > least).withColumn("_n", F.explode(F.sequence(least, n - 1)))
    parts = parts.withColumn("_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("_n") + 1), lambda i: F.xxhash64(F.substr(F.col(y), i, F.col("_n")))))))
    cond = F.col(y).contains(F.col(x)) & (F.length(x) >= shortest) & (F.length(x) >= inside * n) & (F.col(x) != F.col(y))
    return short.withColumn("_k", F.xxhash64(x)).join(parts.hint("merge"), "_k").filter(cond).drop("_k", "_n")
