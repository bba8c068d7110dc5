"""Facts on sales lines: deals, products, bundles, clients, templates, timelines, prices, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions.dates import duration_days, month
from tallyforge.functions.numeric import quantiles, ratio, round_money
from tallyforge.functions.rules import MATERIALS
from tallyforge.functions.text import tokens
from tallyforge.operators.taxonomy import component_name, materials
from tallyforge.operators.similarity import top_sharing
from tallyforge.operators.windows import mode, running_share, top_n

MISSING_CLIENT = "__MISSING_CLIENT__"
MISSING_DIRECTION = "__MISSING_DIRECTION__"
BARTER = "barter"
#: Stems of lines that change a price and are no products (fixed values), and their English likes.
MODIFIERS = ("безнал", "скидк", "налог", "комис", "процент", "%", "discount", "surcharge", "prepayment")


def _known(product_id: Column) -> Column:
    return product_id.isNotNull() & ~product_id.cast("string").isin("", "0")


def product_key(product_id: Column, name: Column) -> Column:
    """The catalogue id, or for a manual line (no id, or 0) its lower-case name."""
    return F.when(_known(product_id), product_id.cast("string")).otherwise(F.concat(F.lit("manual:"), F.lower(F.trim(F.coalesce(name, F.lit(""))))))


def client_key(company: Column, contact: Column | None = None) -> Column:
    """Company before contact before the sentinel; 0 and empty ids count as missing."""
    real = lambda c: F.when(c.isNotNull() & ~c.cast("string").isin("", "0"), c.cast("string"))
    return F.coalesce(real(company), *([real(contact)] if contact is not None else []), F.lit(MISSING_CLIENT))


def last_wins(goods: DataFrame, key: str, order: Column) -> DataFrame:
    """Of repeated catalogue rows the last one."""
    return goods.groupBy(key).agg(F.max_by(F.struct(*[c for c in goods.columns if c != key]), order).alias("g")).select(key, "g.*")


def normalise(lines: DataFrame, goods: DataFrame) -> DataFrame:
    """Line totals, price ratios, keys, and the catalogue's columns (a left join: lines of unknown
    products stay and say so in catalog_match). Close is the deal's last shipment.

    Spark picks the join by the catalogue's size; nothing is forced to be broadcast.
    """
    return normalised(with_goods(lines, goods))


def with_goods(lines: DataFrame, goods: DataFrame) -> DataFrame:
    """Lines with the catalogue's columns; ``_in`` is null for unknown products. ``_manual`` is the name where the
    id does not tell the product, so that names travel only with what reads them."""
    g = goods.select("product_id", F.col("name").alias("product_name"), "base_price", "direction", "section", F.lit(True).alias("_in"))
    return lines.join(g, "product_id", "left").withColumn("_manual", F.when(~_known(F.col("product_id")), F.col("product_name")))


def normalised(lines: DataFrame) -> DataFrame:
    """The second half of ``normalise``, for lines that have the catalogue's columns."""
    manual = F.col("product_id").isNull() | (F.col("product_id") == 0)
    return lines.select(
        "dataset",
        "deal_id",
        "title",
        client_key(F.col("client_id")).alias("client_key"),
        "begin",
        "ship",
        "payment",
        "opportunity",
        "line",
        "product_id",
        product_key(F.col("product_id"), F.col("_manual")).alias("product_key"),
        F.coalesce("product_name", F.lit("")).alias("product_name"),
        "price",
        "quantity",
        "base_price",
        (F.col("price") * F.col("quantity")).alias("line_total"),
        ratio(F.col("price"), F.col("base_price")).alias("price_ratio"),
        F.coalesce("direction", F.lit(MISSING_DIRECTION)).alias("direction"),
        F.coalesce("section", F.lit("")).alias("section"),
        F.when(manual, "manual_row").when(F.col("_in"), "catalog").otherwise("missing_catalog").alias("catalog_match"),
    )


def repaired(lines: DataFrame, goods: DataFrame, needs: Column) -> DataFrame:
    """Lines whose direction is missing (needs) take it from the catalogue; ``fixed`` tells which."""
    g = goods.select("product_id", F.col("direction").alias("_d"))
    out = lines.join(g, "product_id", "left").withColumn("fixed", needs & F.col("_d").isNotNull())
    return out.withColumn("direction", F.when(needs, F.coalesce("_d", F.lit(MISSING_DIRECTION))).otherwise(F.col("direction"))).drop("_d")


def deal_facts(lines: DataFrame, of: tuple[str, ...] | None = None) -> DataFrame:
    """One row per deal, with the columns of ``of`` where it is given: what only the others need does not
    travel. Attributes are those of its first line; the primary direction is the most frequent one, the
    sentinel excluded, first line first."""
    needs = {*(of or ()), *(["begin"] if "duration_days" in (of or ()) else []), *(["opportunity"] if "gap_pct" in (of or ()) else [])}
    about = [c for c in ("title", "client_key", "begin", "payment", "opportunity") if of is None or c in needs]
    # one pass over the lines: per deal and direction first, whose counts give the mode
    per = lines.groupBy("dataset", "deal_id", "direction").agg(
        *([F.min_by(F.struct(*about), "line").alias("f")] if about else []),
        F.min("line").alias("l"),
        F.max("ship").alias("close"),
        F.count(F.lit(1)).alias("n"),
        F.sum("quantity").alias("q"),
        F.sum("line_total").alias("t"),
        F.collect_set("product_key").alias("products"),
        F.collect_set(F.when(F.col("section") != "", F.col("section"))).alias("s"),
    )
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    facts = per.groupBy("dataset", "deal_id").agg(
        *([F.min_by("f", "l").alias("f")] if about else []),
        F.max("close").alias("close"),
        F.sum("n").alias("line_count"),
        F.round(F.sum("q"), 2).alias("total_quantity"),
        F.round(F.sum("t"), 2).alias("line_total"),
        every("products").alias("product_keys"),
        F.array_join(every("s"), "|").alias("sections"),
        F.min(F.when(F.col("direction") != MISSING_DIRECTION, F.struct((-F.col("n")).alias("n"), "l", "direction")))["direction"].alias("primary_direction"),
    )
    facts = facts.select("dataset", "deal_id", *(["f.*"] if about else []), *[c for c in facts.columns if c not in ("dataset", "deal_id", "f")])
    gap = F.when((F.col("opportunity") != 0) & (F.col("line_total") != 0), F.abs(F.col("line_total") - F.col("opportunity")) / F.col("opportunity"))
    out = {
        "dataset": F.col("dataset"),
        "deal_id": F.col("deal_id"),
        "title": F.col("title"),
        "client_key": F.col("client_key"),
        "begin": F.col("begin"),
        "close": F.col("close"),
        "close_month": month(F.col("close")),
        "payment": F.col("payment"),
        "duration_days": duration_days(F.col("begin"), F.col("close")),
        "line_count": F.col("line_count"),
        "unique_products": F.size("product_keys").cast("long"),
        "total_quantity": F.col("total_quantity"),
        "line_total": F.col("line_total"),
        "opportunity": F.col("opportunity"),
        "gap_pct": F.round(gap, 4),
        "primary_direction": F.coalesce("primary_direction", F.lit(MISSING_DIRECTION)),
        "bundle_key": F.array_join("product_keys", "|"),
        "product_keys": F.col("product_keys"),
        "sections": F.col("sections"),
    }
    return facts.select(*[out[c].alias(c) for c in of or out])


def product_facts(lines: DataFrame, goods: DataFrame) -> DataFrame:
    """One row per product of the catalogue, offers or orders (a full outer join of what each side
    has been reduced to). Barter is left out of prices, not of row counts."""
    orders, offers = lines.filter("dataset = 'orders'"), lines.filter("dataset = 'offers'")
    priced = lambda c: F.when(F.col("payment") != BARTER, F.col(c))
    o = orders.groupBy("product_key").agg(
        F.count(F.lit(1)).alias("order_rows"),
        F.count_distinct("deal_id").alias("order_deals"),
        F.round(F.coalesce(F.sum(priced("quantity")), F.lit(0.0)), 2).alias("total_order_qty"),
        quantiles(priced("price"), 0.25, 0.5, 0.75).alias("_p"),
        quantiles(priced("quantity"), 0.25, 0.5, 0.75).alias("_q"),
        quantiles(priced("price_ratio"), 0.25, 0.5, 0.75).alias("_r"),
        (F.max(priced("price_ratio")) - F.min(priced("price_ratio"))).alias("_range"),
    )
    f = offers.groupBy("product_key").agg(F.count(F.lit(1)).alias("offer_rows"), F.count_distinct("deal_id").alias("offer_deals"), F.slice(F.array_sort(F.collect_set("quantity")), 1, 8).alias("_ladder"))
    g = goods.select(F.col("product_id").cast("string").alias("product_key"), "name", "base_price", "direction", "section", F.lit("Y").alias("goods_present"))
    out = g.join(o, "product_key", "full_outer").join(f, "product_key", "full_outer")
    at = lambda a, i, n: round_money(F.get(F.col(a), i), 4).alias(n)
    out = out.select(
        "product_key",
        F.coalesce("name", F.lit("")).alias("product_name"),
        F.coalesce("direction", F.lit(MISSING_DIRECTION)).alias("direction"),
        F.when(F.col("goods_present") == "Y", "catalog").when(F.col("product_key").startswith("manual:"), "manual_row").otherwise("missing_catalog").alias("catalog_match"),
        F.coalesce("goods_present", F.lit("N")).alias("goods_present"),
        "base_price",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("offer_rows", "offer_deals", "order_rows", "order_deals")],
        F.coalesce("total_order_qty", F.lit(0.0)).alias("total_order_qty"),
        F.coalesce(F.array_join(F.transform("_ladder", lambda x: x.cast("long").cast("string")), "|"), F.lit("")).alias("offer_qty_ladder"),
        *[at(a, i, f"{n}_p{q}") for a, n in (("_p", "price"), ("_q", "qty"), ("_r", "ratio")) for i, q in enumerate((25, 50, 75))],
        F.round("_range", 4).alias("ratio_range"),
    )
    rule = classify(out)
    return out.select("*", rule["price_mode"].alias("price_mode"), rule["confidence"].alias("confidence"), rule["reason"].alias("reason"))


def is_modifier(name: Column) -> Column:
    """Discounts, surcharges, taxes and the like are no products."""
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(MODIFIERS))


def classify(fact: DataFrame) -> Column:
    """Ordered rules: how far a price can be quoted without a person, and why not."""
    out = lambda mode_, conf, why: F.struct(F.lit(mode_).alias("price_mode"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))
    rows, spread = F.col("order_rows"), F.col("ratio_range")
    return (
        F.when(F.col("catalog_match") != "catalog", out("manual", "low", "manual_or_missing_catalog"))
        .when(is_modifier(F.col("product_name")), out("manual", "low", "financial_modifier"))
        .when(rows < 10, out("manual", "low", "insufficient_history"))
        .when(spread.isNull(), out("manual", "low", "no_price_anchor"))
        .when((rows >= 30) & (spread <= 0.15), out("auto", "high", ""))
        .when(spread <= 0.5, out("guided", "medium", "requires_context_lookup"))
        .otherwise(out("manual", "low", "high_price_variance"))
    )


def nearest_analogs(targets: DataFrame, goods: DataFrame, n: int = 3) -> DataFrame:
    """(name, direction, product_id, analog, score, rank): catalogue products that share a token.

    The score is the token overlap, 0.15 more in the same direction. Equal names are scored once, and
    a token that very many names share makes no pairs of its own.
    """
    a = targets.select(F.col("name").alias("id"), F.col("direction").alias("d")).distinct().withColumn("t", tokens(F.col("id")))
    b = goods.select(F.col("name").alias("other"), F.col("direction").alias("e")).distinct().withColumn("u", tokens(F.col("other")))
    score = lambda c, n, m: F.round(F.size(c) / F.greatest(n, m) + F.when(F.col("d") == F.col("e"), 0.15).otherwise(0.0), 4)
    pairs = top_sharing(a, b, score, n, ("d",), ("e",)).withColumnsRenamed({"id": "name", "d": "direction", "other": "analog", "e": "analog_direction"})
    ids = goods.groupBy(F.col("name").alias("analog"), F.col("direction").alias("analog_direction")).agg(F.min("product_id").alias("product_id"))
    return pairs.join(ids, ["analog", "analog_direction"])


def pricing(facts: DataFrame) -> DataFrame:
    """Recommended, least and most price by mode; a guided band spans the base price +-10 % at least."""
    rec = F.when(F.col("price_mode").isin("auto", "guided"), F.coalesce("price_p50", "base_price"))
    low, high = F.coalesce(F.col("price_p25"), rec), F.coalesce(F.col("price_p75"), rec)
    glow, ghigh = F.coalesce(F.col("price_p25"), rec * 0.9), F.coalesce(F.col("price_p75"), rec * 1.1)
    out = facts.withColumn("recommended", round_money(rec))
    guided = F.col("price_mode") == "guided"
    out = out.withColumn("suggested_min", round_money(F.when(guided, F.least(glow, F.col("base_price") * 0.9)).when(F.col("price_mode") == "auto", low)))
    out = out.withColumn("suggested_max", round_money(F.when(guided, F.greatest(ghigh, F.col("base_price") * 1.1)).when(F.col("price_mode") == "auto", high)))
    return out.withColumn("markup", F.round(F.when((F.col("base_price") > 0) & (F.col("price_p50") > 0), F.col("price_p50") / F.col("base_price")), 2))


def bundle_facts(deals: DataFrame, most: int = 500) -> DataFrame:
    """One row per dataset and set of products; values without barter, samples by value. Deals with the
    columns letter_height_cm and description give the bundle both: the most frequent height above 0, of
    equally frequent ones that of the first deal, and the longest description, of equally long ones that of
    the first deal, cut to ``most`` characters (empty where none has one).

    Deals travel once: places by value, the counts of a bundle's directions and its facts are worked out
    where its deals lie; windows of a large bundle spill.
    """
    by = ["dataset", "bundle_key"]
    some = deals.filter(F.col("bundle_key") != "")
    same = W.partitionBy(*by, "primary_direction")
    rows = some.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_first", F.min("deal_id").over(same))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("line_total"), F.col("deal_id"))))
    value = F.when(F.col("payment") != BARTER, F.col("line_total"))
    best = F.array_sort(F.collect_list(F.when(F.col("_at") <= 5, F.struct("_at", "deal_id"))))
    details = []
    if {"letter_height_cm", "description"} <= set(deals.columns):
        height, text = F.col("letter_height_cm"), F.coalesce("description", F.lit(""))
        like = W.partitionBy(*by, "letter_height_cm")
        rows = rows.withColumn("_height", F.when(height > 0, F.struct((-F.count(F.lit(1)).over(like)).alias("n"), F.min("deal_id").over(like).alias("f"), height.alias("h"))))
        rows = rows.withColumn("_longest", F.struct((-F.length(text)).alias("n"), F.col("deal_id"), F.substring(text, 1, most).alias("t")))
        details = [F.min("_height")["h"].alias("letter_height_cm"), F.min("_longest")["t"].alias("description")]
    return rows.groupBy(*by).agg(
        F.max("unique_products").alias("product_count"),
        F.count(F.lit(1)).alias("deal_count"),
        round_money(F.median(value)).alias("median_value"),
        round_money(F.avg(value)).alias("avg_value"),
        F.round(F.median("duration_days"), 0).alias("duration_p50"),
        F.array_join(F.array_sort(F.array_distinct(F.split(F.array_join(F.collect_set("sections"), "|"), r"\|"))), "|").alias("canonical_key"),
        F.min_by("title", "deal_id").alias("sample_title"),
        F.min_by("primary_direction", F.struct(-F.col("_n"), F.col("_first"))).alias("direction"),
        F.array_join(F.transform(best, lambda x: x["deal_id"].cast("string")), "|").alias("sample_deals"),
        *details,
    )


def client_facts(deals: DataFrame) -> DataFrame:
    dominant = mode(deals, ["client_key"], "primary_direction", F.struct("dataset", "deal_id"), "dominant_direction")
    out = deals.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("deal_count"),
        F.count_if(F.col("dataset") == "orders").alias("order_deals"),
        F.count_if(F.col("dataset") == "offers").alias("offer_deals"),
        F.round(F.sum("line_total"), 2).alias("total_value"),
        round_money(F.avg("line_total")).alias("avg_value"),
        round_money(F.median("line_total")).alias("median_value"),
        F.min("close_month").alias("first_month"),
        F.max("close_month").alias("last_month"),
        F.array_join(F.array_sort(F.collect_set("dataset")), "|").alias("datasets"),
    )
    return out.join(dominant, "client_key")


def client_concentration(deals: DataFrame) -> DataFrame:
    """Clients by order value with their share and the share of all down to them."""
    orders = deals.filter((F.col("dataset") == "orders") & (F.col("client_key") != MISSING_CLIENT))
    per = orders.groupBy("client_key").agg(F.count(F.lit(1)).alias("deal_count"), F.round(F.sum("line_total"), 2).alias("total_value"))
    primary = mode(orders, ["client_key"], "primary_direction", F.col("deal_id"), "dominant_direction")
    total = orders.agg(F.sum("line_total").alias("_total"))
    out = running_share(per, "total_value", "client_key").join(primary, "client_key").join(F.broadcast(total))
    return out.select("client_key", "deal_count", "total_value", "dominant_direction", F.round(F.col("total_value") / F.col("_total"), 4).alias("value_share"), F.round(F.col("running") / F.col("_total"), 4).alias("cumulative_share"), F.col("rank").cast("long").alias("rank"))


def template_matches(deals: DataFrame) -> DataFrame:
    """For each set of products that offers have: order deals with exactly that set, and with all of
    it (relational division by counting: a shared product is one row, no sets are intersected).

    The join starts from each template's rarest product, which every deal that contains it must
    have, so frequent products are not multiplied out; containment is then tested on the row.
    """
    offers, orders = deals.filter("dataset = 'offers'"), deals.filter("dataset = 'orders'")
    templates = offers.groupBy("bundle_key").agg(F.count(F.lit(1)).alias("template_deals"), F.min_by("title", "deal_id").alias("sample_title"), F.max(F.size("product_keys")).alias("products"))
    sets = offers.groupBy("bundle_key").agg(F.first("product_keys").alias("keys"))
    exact = orders.groupBy("bundle_key").agg(F.count(F.lit(1)).alias("exact"))
    items = orders.select("deal_id", "line_total", "product_keys", F.explode("product_keys").alias("product"))
    rarity = items.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    needs = sets.select("bundle_key", F.explode("keys").alias("product")).join(rarity, "product", "left")
    # only the key travels with each product; the set comes back where its key lies
    rarest = needs.groupBy("bundle_key").agg(F.min_by("product", F.struct(F.coalesce("n", F.lit(0)), "product")).alias("product")).join(sets, "bundle_key")
    hits = rarest.join(items, "product").filter(F.size(F.array_except("keys", "product_keys")) == 0)
    contained = hits.groupBy("bundle_key").agg(F.count(F.lit(1)).alias("contained"), round_money(F.median("line_total")).alias("matched_median"))
    out = templates.join(exact, "bundle_key", "left").join(contained, "bundle_key", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("bundle_key", F.col("products").cast("long").alias("products"), "template_deals", "sample_title", n("exact").alias("exact_matches"), n("contained").alias("contained_matches"), "matched_median", F.round(n("contained") / F.col("template_deals"), 4).alias("match_rate"))


def timelines(deals: DataFrame, bundles: int = 200) -> DataFrame:
    """Durations per direction (all datasets) and per bundle (orders, the most frequent bundles)."""
    stats = [
        F.count("duration_days").alias("deal_count"),
        F.min("duration_days").alias("duration_min"),
        quantiles(F.col("duration_days").cast("double"), 0.25, 0.5, 0.75).alias("q"),
        F.max("duration_days").alias("duration_max"),
    ]
    by_direction = deals.filter(F.col("primary_direction") != MISSING_DIRECTION).groupBy(F.lit("direction").alias("group_type"), F.col("primary_direction").alias("group_key")).agg(*stats)
    orders = deals.filter((F.col("dataset") == "orders") & (F.col("bundle_key") != ""))
    top = orders.groupBy("bundle_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bundle_key").limit(bundles).select("bundle_key")
    by_bundle = orders.join(F.broadcast(top), "bundle_key", "left_semi").groupBy(F.lit("bundle").alias("group_type"), F.col("bundle_key").alias("group_key")).agg(*stats)
    out = by_direction.unionByName(by_bundle).filter("deal_count > 0")
    return out.select("group_type", "group_key", "deal_count", "duration_min", *[F.floor(F.get("q", i) + 0.5).cast("long").alias(f"duration_p{p}") for i, p in enumerate((25, 50, 75))], "duration_max")


def qualifying(deals: DataFrame, dataset: str, barter: bool) -> DataFrame:
    """Deals of at least two products and over 500; with or without barter."""
    out = deals.filter((F.col("dataset") == dataset) & (F.col("unique_products") >= 2) & (F.col("line_total") > 500))
    return out if barter else out.filter(F.col("payment") != BARTER)


def deal_profiles(lines: DataFrame, deals: DataFrame, dataset: str = "orders") -> DataFrame:
    """Top ten components, the share of each direction and the materials of every qualifying deal.

    Totals are added from the highest line down, so a share that lies on a half is rounded the same way
    however the lines are dealt to tasks. All windows and groups are of one deal: lines travel once.
    """
    about = ["deal_total", "primary_direction", "unique_products"]
    chosen = qualifying(deals, dataset, barter=False).select("deal_id", F.col("line_total").alias("deal_total"), *about[1:])
    d = F.when(F.col("direction").startswith("__"), "other").otherwise(F.col("direction"))
    item = F.concat("product_name", F.lit(" x"), F.rint("quantity").cast("long"), F.lit(" = "), F.floor(F.col("line_total") + 0.5).cast("long"))
    rows = lines.filter(F.col("dataset") == dataset).select("deal_id", "line", "line_total", d.alias("d"), "product_name", item.alias("s"))
    rows = rows.join(chosen, "deal_id")
    order, down = [F.desc("line_total"), F.col("line")], (W.unboundedPreceding, W.currentRow)
    deal, part = W.partitionBy("deal_id").orderBy(*order), W.partitionBy("deal_id", "d").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(deal)).withColumn("g", F.sum("line_total").over(deal.rowsBetween(*down)))
    rows = rows.withColumn("t", F.sum("line_total").over(part.rowsBetween(*down)))
    per = rows.groupBy("deal_id", "d").agg(
        *[F.first(c).alias(c) for c in about],
        F.max("rank").alias("last"),
        F.max_by("g", "rank").alias("g"),
        F.max_by("t", "rank").alias("t"),
        F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "s"))).alias("parts"),
        F.collect_set(materials(F.col("product_name"))).alias("m"),
    )
    out = per.groupBy("deal_id").agg(
        *[F.first(c).alias(c) for c in about],
        F.max_by("g", "last").alias("g"),
        F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"),
        F.count(F.lit(1)).alias("direction_count"),
        F.array_sort(F.collect_list(F.struct((-F.round("t", 2)).alias("k"), "d", "t"))).alias("shares"),
        _materials(F.flatten(F.collect_list("m"))).alias("materials"),
    )
    share = lambda x: F.concat(x["d"], F.lit(": "), F.floor(x["t"] / F.col("g") * 100 + 0.5).cast("long"), F.lit("%"))
    return out.select(
        "deal_id",
        *about,
        F.array_join(F.transform("parts", lambda x: x["s"]), "; ").alias("components"),
        "direction_count",
        F.array_join(F.transform("shares", share), "; ").alias("direction_breakdown"),
        "materials",
    )


def _materials(lists: Column) -> Column:
    """Labels of several lists in the order of their table."""
    found = F.flatten(lists)
    return F.array_join(F.filter(F.array(*[F.lit(m) for m in MATERIALS]), lambda m: F.array_contains(found, m)), ", ")


def service_composition(lines: DataFrame, deals: DataFrame) -> DataFrame:
    """What orders of a direction consist of: core (5 % and more) and optional (2 % and more) products
    among its fifteen most frequent, directions that come along, and the materials of its deals."""
    chosen = qualifying(deals, "orders", barter=True).select("deal_id", F.col("line_total").alias("deal_total"), "primary_direction").filter(~F.col("primary_direction").startswith("__"))
    stats = chosen.groupBy("primary_direction").agg(F.count(F.lit(1)).alias("deal_count"), F.median("deal_total").alias("med"), F.avg("deal_total").alias("avg"), F.sum("deal_total").alias("total")).filter("deal_count >= 3")
    rows = lines.filter("dataset = 'orders'").join(chosen, "deal_id")
    name = component_name(F.col("product_name"))
    freq = rows.filter((F.col("product_name") != "") & ~is_modifier(F.col("product_name"))).groupBy("primary_direction", name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("line_total").alias("v"))
    freq = top_n(freq, ["primary_direction"], [F.desc("n"), F.col("name")], 15).join(stats, "primary_direction")
    share = F.round(F.col("n") / F.col("deal_count"), 2)
    text = F.concat("name", F.lit(" ["), F.floor(share * 100 + 0.5).cast("long"), F.lit("%, "), F.floor(F.round(F.col("v") / F.col("total"), 4) * 100 + 0.5).cast("long"), F.lit("%]"))
    ranked = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", text.alias("s"))))), lambda x: x["s"]), "; ")
    products = freq.groupBy("primary_direction").agg(ranked(share >= 0.05).alias("core_products"), ranked((share >= 0.02) & (share < 0.05)).alias("optional_products"))
    cross = rows.filter((F.col("direction") != F.col("primary_direction")) & ~F.col("direction").startswith("__")).select("primary_direction", "direction", "deal_id").distinct()
    cross = cross.groupBy("primary_direction", "direction").agg(F.count(F.lit(1)).alias("n"))
    cross = top_n(cross, ["primary_direction"], [F.desc("n"), F.col("direction")], 5).join(stats.select("primary_direction", "deal_count"), "primary_direction")
    with_share = F.concat("direction", F.lit(" ("), F.floor(F.col("n") / F.col("deal_count") * 100 + 0.5).cast("long"), F.lit("%)"))
    cross = cross.groupBy("primary_direction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", with_share.alias("s")))), lambda x: x["s"]), ", ").alias("cross_directions"))
    used = rows.select("primary_direction", "deal_id", F.explode(materials(F.col("product_name"))).alias("m")).distinct().groupBy("primary_direction", "m").agg(F.count(F.lit(1)).alias("n")).join(stats.select("primary_direction", "deal_count"), "primary_direction")
    listed = F.struct((-F.col("n")).alias("k"), F.col("m"), F.concat("m", F.lit(" ("), F.floor(F.col("n") / F.col("deal_count") * 100 + 0.5).cast("long"), F.lit("%)")).alias("s"))
    used = used.groupBy("primary_direction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["s"]), ", ").alias("top_materials"))
    out = stats.join(products, "primary_direction", "left").join(cross, "primary_direction", "left").join(used, "primary_direction", "left")
    return out.select("primary_direction", "deal_count", F.floor(F.col("med") + 0.5).cast("long").alias("median_value"), F.floor(F.col("avg") + 0.5).cast("long").alias("avg_value"), "core_products", "optional_products", F.coalesce("cross_directions", F.lit("")).alias("cross_directions"), F.coalesce("top_materials", F.lit("")).alias("top_materials"))


def monthly_kpis(deals: DataFrame) -> DataFrame:
    return deals.groupBy("dataset", "close_month", "primary_direction").agg(F.count(F.lit(1)).alias("deal_count"), F.round(F.sum("line_total"), 2).alias("total_value"), round_money(F.median("line_total")).alias("median_value"), round_money(F.avg("line_total")).alias("avg_value"))


def catalogue_use(facts: DataFrame) -> DataFrame:
    status = F.when((F.col("offer_rows") > 0) & (F.col("order_rows") > 0), "used_in_both").when(F.col("offer_rows") > 0, "offers_only").when(F.col("order_rows") > 0, "orders_only").otherwise("unused")
    return facts.filter("goods_present = 'Y'").select("product_key", "product_name", "direction", "base_price", "offer_rows", "order_rows", status.alias("status"))


def price_stability(facts: DataFrame) -> DataFrame:
    cols = ["product_key", "product_name", "direction", "order_rows", "price_mode", "confidence", "ratio_range", "base_price", "price_p50", "reason"]
    return facts.select(*cols).orderBy(F.asc_nulls_last("ratio_range"), F.desc("order_rows"), "product_key")


def kpi_summary(facts: DataFrame, deals: DataFrame, templates: DataFrame) -> DataFrame:
    """One row. Repeat clients are those of two order deals and more."""
    d = deals.agg(F.count_if(F.col("dataset") == "orders").alias("order_deals"), F.count_if(F.col("dataset") == "offers").alias("offer_deals"))
    c = deals.filter((F.col("dataset") == "orders") & (F.col("client_key") != MISSING_CLIENT)).groupBy("client_key").count()
    c = c.agg(F.count(F.lit(1)).alias("known_clients"), F.count_if(F.col("count") >= 2).alias("repeat_clients"))
    p = facts.agg(*[F.count_if(F.col("price_mode") == m).alias(f"{m}_products") for m in ("auto", "guided", "manual")])
    t = templates.agg(F.count_if(F.col("exact_matches") > 0).alias("exact_templates"), F.count_if(F.col("contained_matches") > 0).alias("contained_templates"))
    out = d.join(c).join(p).join(t)  # one row each
    return out.withColumn("repeat_share", F.round(F.col("repeat_clients") / F.nullif(F.col("known_clients"), F.lit(0)), 4))


def dataset_quality(lines: DataFrame) -> DataFrame:
    """Per dataset: rows, ids, coverage of the catalogue, missing values."""
    return lines.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("deal_id").alias("deals"),
        F.count_distinct("product_key").alias("products"),
        F.count_if(F.col("catalog_match") == "catalog").alias("catalog_rows"),
        F.round(F.count_if(F.col("catalog_match") == "catalog") / F.count(F.lit(1)), 4).alias("coverage"),
        F.count_if(F.col("direction") == MISSING_DIRECTION).alias("missing_direction"),
        F.count_if(F.col("client_key") == MISSING_CLIENT).alias("missing_client"),
        F.count_if(F.col("price").isNull() | (F.col("price") <= 0)).alias("bad_price"),
    )


def line_gaps(lines: DataFrame) -> DataFrame:
    """Per dataset: how far the lines of deals miss their opportunity."""
    per = lines.groupBy("dataset", "deal_id").agg(F.sum("line_total").alias("t"), F.min_by("opportunity", "line").alias("o"))
    per = per.filter("o is not null and o <> 0 and t <> 0").withColumn("gap", F.abs(F.col("t") - F.col("o")) / F.col("o"))
    return per.groupBy("dataset").agg(F.count(F.lit(1)).alias("comparable"), F.round(F.median("gap"), 4).alias("median_gap"), F.round(F.percentile("gap", F.lit(0.95)), 4).alias("p95_gap"), F.count_if(F.col("gap") <= 0.05).alias("within_5pct"))


def quality_issues(lines: DataFrame, goods: DataFrame) -> DataFrame:
    """Issues as rows (code, severity, n), those that occur; overlaps of datasets as information."""
    deals = lines.select("dataset", "deal_id").distinct()
    both = deals.filter("dataset = 'offers'").select("deal_id").intersect(deals.filter("dataset = 'orders'").select("deal_id")).agg(F.count(F.lit(1)).alias("n"))
    unused = goods.join(lines.filter("product_id is not null").select("product_id").distinct(), "product_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    early = lines.agg(F.count_if(F.col("ship") < F.col("begin")).alias("n"))
    issue = lambda df, code, sev: df.select(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col("n"))
    out = issue(both, "deal_in_offers_and_orders", "warning").unionByName(issue(unused, "catalogue_product_never_sold", "info")).unionByName(issue(early, "shipped_before_begin", "warning"))
    out = out.unionByName(issue(lines.agg(F.count_if(F.col("catalog_match") != "catalog").alias("n")), "line_outside_catalogue", "blocking"))
    return out.filter("n > 0")
