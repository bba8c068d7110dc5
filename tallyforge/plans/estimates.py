"""Queries of the estimate operators. Orders are the queries, their lines the ranked candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.operators import estimates as E
from tallyforge.operators import sales as S
from tallyforge.plans.sales import DEALS, FACTS, LINES
from tallyforge.sources.roles import catalogue, lines, table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


CAND = """, cand as (select l.deal_id as query_id, row_number() over (partition by l.deal_id order by l.line) as rank, l.product_key, l.product_name, l.direction, l.dataset, l.quantity, l.section,
    case when l.section = 'Brand#7' then 'bundle' else 'product' end as doc_type, pfacts.price_mode, pfacts.price_p25 as p25, pfacts.price_p50 as p50, pfacts.price_p75 as p75, pfacts.base_price, case when l.product_id % 4 = 0 then l.base_price * 0.5 end as cost_price
    from lines l join pfacts using (product_key) where l.dataset <> 'open')
"""


def _candidates(spark, d):
    rows = lines(spark, d)
    facts = S.product_facts(rows, catalogue(spark, d)).select("product_key", "price_mode", F.col("price_p25").alias("p25"), F.col("price_p50").alias("p50"), F.col("price_p75").alias("p75"), "base_price")
    some = rows.filter("dataset <> 'open'").select(F.col("deal_id").alias("query_id"), "line", "product_key", "product_name", "direction", "dataset", "quantity", "section", F.when(F.col("product_id") % 4 == 0, F.col("base_price") * 0.5).alias("cost_price"))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("line"))).drop("line")
    return some.join(facts, "product_key").withColumn("doc_type", F.when(F.col("section") == "Brand#7", "bundle").otherwise("product"))


ANCH = CAND + """, lv as (select *, case case when doc_type = 'bundle' then 'bundle' else price_mode end when 'auto' then 0 when 'guided' then 1 when 'bundle' then 2 else case when p50 is not null then 3 end end as level from cand where rank <= 10),
an as (select * from (select *, row_number() over (partition by query_id order by level, rank) as rn from lv where level is not null) where rn = 1)
"""


@query(LINES + FACTS + ANCH + "select query_id, rank, product_key, level, doc_type, price_mode, p50 from an")
def price_anchors(spark, d):
    return E.anchors(_candidates(spark, d)).select("query_id", "rank", "product_key", "level", "doc_type", "price_mode", "p50")


@query(
    LINES
    + FACTS
    + ANCH
    + """, m as (select *, case when section < 'Brand#2' then 1.65 else 2.0 end as mk, price_mode in ('auto', 'guided') and p50 is not null as known from an)
select query_id, product_key, round(case when known then p50 when cost_price > 0 then cost_price * mk else base_price end + 1e-9, 2) as value,
round(case when known and price_mode = 'auto' then coalesce(p25, p50) when known then p50 * (1 - 0.2) when cost_price > 0 then cost_price * mk * 0.8 else base_price * 0.7 end + 1e-9, 2) as low,
round(case when known and price_mode = 'auto' then coalesce(p75, p50) when known then p50 * (1 + 0.2) when cost_price > 0 then cost_price * mk * 1.2 else base_price * 1.3 end + 1e-9, 2) as high, case when known then price_mode else 'manual' end as confidence from m"""
)
def resolved_prices(spark, d):
    a = E.anchors(_candidates(spark, d))
    return E.resolved(a, F.when(F.col("section") < "Brand#2", 1.65).otherwise(2.0)).select("query_id", "product_key", "value", "low", "high", "confidence")


@query(
    DEALS
    + """, b as (select bundle_key, median(line_total) as med, string_agg(sections, '|') as names, max(line_count) as n from deals where dataset = 'offers' group by 1),
v as (select *, 1.0 + case when contains(lower(names), 'brand#1') then 0.0 else 0.25 end + case when contains(lower(names), 'brand#2') or contains(lower(names), 'brand#3') then 0.0 else 0.15 end as sur, greatest(least(3 / n::double, 3.0), 0.5) as sz from b)
select bundle_key, round(med * sur * sz, 0) as value, round(med * sur * sz * (1 - 0.2), 0) as low, round(med * sur * sz * (1 + 0.2), 0) as high,
array_to_string(list_filter([case when contains(lower(names), 'brand#1') then null else 'mounting' end, case when contains(lower(names), 'brand#2') or contains(lower(names), 'brand#3') then null else 'frame' end], lambda x: x is not null), ', ') as missing from v"""
)
def bundle_prices(spark, d):
    deals = S.deal_facts(lines(spark, d)).filter("dataset = 'offers'")
    b = deals.groupBy("bundle_key").agg(F.median("line_total").alias("med"), F.array_join(F.collect_set("sections"), "|").alias("names"), F.max("line_count").alias("n"))
    cols = E.bundle_price(F.col("med"), F.col("names"), {"mounting": (("brand#1",), 0.25), "frame": (("brand#2", "brand#3"), 0.15)}, F.lit(3), F.col("n"))
    return b.select("bundle_key", *[c.alias(k) for k, c in cols.items()])


@query(
    LINES
    + """, n as (select distinct name, direction, list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) as t from goods),
p as (select a.name, a.direction, b.name as analog, b.direction as analog_direction, round(len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) + case when a.direction = b.direction then 0.15 else 0 end, 4) as score from n a join n b on len(list_intersect(a.t, b.t)) > 0),
k as (select *, row_number() over (partition by name, direction order by score desc, analog, analog_direction) as rank from p),
pr as (select name as analog, direction as analog_direction, round(median(base_price), 2) as price from goods group by 1, 2),
j as (select product_id as key, k.analog, price, row_number() over (partition by product_id order by rank) as rn from goods join k using (name, direction) join pr using (analog, analog_direction) where rank <= 3)
select key, analog, price from j where rn = 1"""
)
def analog_prices(spark, d):
    g = catalogue(spark, d)
    prices = g.groupBy("name", "direction").agg(F.round(F.median("base_price"), 2).alias("price"))
    targets = g.select(F.col("product_id").alias("key"), "name", "direction")
    return E.analog_prices(targets, S.nearest_analogs(g, g).drop("product_id", "score"), prices)


@query(
    LINES
    + """, c as (select deal_id as query_id, direction as component, sum(quantity) as quantity from lines where dataset = 'offers' group by 1, 2),
p as (select p_type as component, p_size::double as low, p_size + 20.0::double as high, median(p_retailprice) as price, (p_size % 10) / 10.0::double as confidence from part group by p_type, p_size),
j as (select *, row_number() over (partition by query_id, component order by greatest(low - quantity, quantity - high, 0), price, confidence) as rn from c join p using (component)),
t as (select query_id, sum(price * quantity) as t, sum(price * quantity * confidence) as w, count(*) as components from j where rn = 1 group by 1), f as (select *, case when t > 0 then w / t else 0 end as conf from t),
b as (select *, case when conf >= 0.8 then 0.1 when conf >= 0.5 then 0.25 else 0.35 end as band from f)
select query_id, round(t + 1e-9, 2) as total, round(conf, 4) as confidence, round(t * (1 - band) + 1e-9, 2) as low, round(t * (1 + band) + 1e-9, 2) as high, components from b"""
)
def parametric_estimates(spark, d):
    comp = lines(spark, d).filter("dataset = 'offers'").groupBy(F.col("deal_id").alias("query_id"), F.col("direction").alias("component")).agg(F.sum("quantity").alias("quantity"))
    # one priced range per component and size: a price list whose length sizes bound
    p = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.median("p_retailprice").alias("price"))
    pools = p.select(F.col("p_type").alias("component"), F.col("p_size").cast("double").alias("low"), (F.col("p_size") + 20.0).alias("high"), "price", ((F.col("p_size") % 10) / 10.0).alias("confidence"))
    return E.parametric(comp, pools)


@query(
    LINES
    + FACTS
    + CAND
    + """, b as (select query_id, rank, round((1.0 / (60 + rank)) * case when price_mode = 'guided' then 1.1 else 1.0 end * case when doc_type = 'bundle' then 1.2 else 1.0 end * case when direction = 'PROMO' then 1.25 else 1.0 end * case when quantity >= 10 then least(1.0 + log10(quantity) * 0.07, 1.35) else 1.0 end, 8) as score from cand)
select *, row_number() over (partition by query_id order by score desc, rank) as new_rank from b"""
)
def heuristic_rerank(spark, d):
    c = _candidates(spark, d)
    boost = E.heuristic_boost([(F.col("price_mode") == "guided", 1.1), (F.col("doc_type") == "bundle", 1.2), (F.col("direction") == "PROMO", 1.25), (F.col("quantity") >= 10, F.least(1.0 + F.log10("quantity") * 0.07, F.lit(1.35)))])
    out = c.select("query_id", "rank", F.round((1.0 / (60 + F.col("rank"))) * boost, 8).alias("score"))
    return out.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


@query(
    LINES
    + FACTS
    + CAND
    + """, s as (select *, case when direction = 'PROMO' then 'promo' when direction = 'SMALL' then 'small' else 'rest' end as segment from cand),
o2 as (select *, case segment when 'promo' then 1 when 'small' then 2 else 3 end as o from s), u as (select *, row_number() over (partition by query_id, product_name order by o, rank) as rn from o2),
p as (select *, row_number() over (partition by query_id, segment order by rank) as place from u where rn = 1) select query_id, segment, product_name, rank, place from p where place <= case segment when 'promo' then 2 when 'small' then 1 else 3 end"""
)
def segmented_references(spark, d):
    c = _candidates(spark, d).withColumn("segment", F.when(F.col("direction") == "PROMO", "promo").when(F.col("direction") == "SMALL", "small").otherwise("rest"))
    return E.segments(c, {"promo": 2, "small": 1, "rest": 3}, "product_name").select("query_id", "segment", "product_name", "rank", "place")


@query(LINES + FACTS + CAND + ", o2 as (select query_id, product_name, min(rank) as rank from cand group by 1, 2), p as (select *, row_number() over (partition by query_id order by rank, product_name) as place from o2) select * from p where place <= 3")
def filled_items(spark, d):
    return E.distinct_best(_candidates(spark, d), "product_name", 3)


@query(LINES + FACTS + CAND + ", s as (select query_id % 1000 as query_id, rank, dataset from cand), o2 as (select query_id, bool_or(dataset = 'orders') as o, bool_or(dataset = 'offers') as f from s where rank <= 10 group by 1) select query_id, case when o and f then 'both' when o then 'orders' when f then 'offers' else 'catalog_only' end as source from o2")
def source_distinction(spark, d):
    return E.sources(_candidates(spark, d).withColumn("query_id", F.col("query_id") % 1000))


@query(
    LINES
    + FACTS
    + CAND
    + """, p as (select query_id, direction, count(*) as n, min(rank) as r from cand where rank <= 10 group by 1, 2), b as (select *, row_number() over (partition by query_id order by n desc, r) as rn, sum(n) over (partition by query_id) as total from p)
select query_id, case when n >= 0.6 * total then direction end as direction from b where rn = 1"""
)
def dominant_direction(spark, d):
    return E.dominant(_candidates(spark, d), "direction", 10, 0.6)


@query(
    """with l as (select distinct o_custkey as query_id, l_partkey as id from lineitem join orders on o_orderkey = l_orderkey),
t as (select p_partkey as id, p_name as title, 0 as tier from part where p_partkey % 2 = 0 union all select p_partkey, p_brand, 1 from part), j as (select query_id, id, title, tier, row_number() over (partition by query_id, id order by tier) as rn from l join t using (id)),
k as (select query_id, id, title, tier, row_number() over (partition by query_id order by id) as place from j where rn = 1) select * from k where place <= 3"""
)
def followed_links(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("l_orderkey"))
    links = table(spark, d, "lineitem").join(o, "l_orderkey").select("query_id", F.col("l_partkey").alias("id")).distinct()
    p = table(spark, d, "part")
    first = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return E.linked(links, [first, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"))], 3)


@query(DEALS + "select case when opportunity <= 0 then 'no_value' when close_month < '1995-01' then 'too_old' when sections = '' then 'no_section' when unique_products < 2 then 'one_product' else 'kept' end as reason, count(*) as deals from deals group by 1")
def skipped_deals(spark, d):
    rules = [(F.col("opportunity") <= 0, "no_value"), (F.col("close_month") < "1995-01", "too_old"), (F.col("sections") == "", "no_section"), (F.col("unique_products") < 2, "one_product")]
    return E.skip_reasons(S.deal_facts(lines(spark, d)), rules)


@query(LINES + ", p as (select section, sum(line_total) as v, bool_or(direction = 'PROMO' and quantity > 49) as c from lines where dataset = 'orders' group by 1) select section, round(v, 2) as value, round(v / (select sum(v) from p), 4) as share from p where not c order by value desc, section limit 25")
def uncovered_revenue(spark, d):
    rows = lines(spark, d).filter("dataset = 'orders'").withColumn("value", F.col("line_total"))
    return E.coverage(rows, "section", (F.col("direction") == "PROMO") & (F.col("quantity") > 49), 25)


@query(
    """with l as (select c_custkey as id, 'customer_' || c_custkey || '_' || c_nationkey as slug from customer), r as (select s_suppkey as other, 'customer_' || (s_suppkey * 7) || '_' || s_nationkey as slug2 from supplier),
p as (select *, 1 - levenshtein(slug, slug2) / greatest(length(slug), length(slug2)) as sc, (contains(slug, slug2) or contains(slug2, slug)) and least(length(slug), length(slug2)) / greatest(length(slug), length(slug2)) >= 0.4 as ins from l, r),
k2 as (select *, case when slug = slug2 then 0 when ins then 1 when sc >= 0.55 then 2 end as kind, round(case when slug = slug2 then 1.0 when ins then least(sc + 0.2, 1.0) else sc end, 4) as score from p),
b as (select *, row_number() over (partition by id order by kind, score desc, other) as rn from k2 where kind is not null) select id, other, kind, score from b where rn = 1"""
)
def slug_matches(spark, d):
    slug = lambda i, n: F.concat_ws("_", F.lit("customer"), i.cast("string"), F.col(n).cast("string"))
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), slug(F.col("c_custkey"), "c_nationkey").alias("slug"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("other"), slug(F.col("s_suppkey") * 7, "s_nationkey").alias("slug2"))
    return E.slug_matches(left, right)


@query(LINES + FACTS + CAND + "select query_id, count(*)::int as \"references\", count(distinct doc_type)::int as types, bool_or(p50 is not null) as priced from cand where rank <= 50 group by 1")
def projected_answers(spark, d):
    from tallyforge.operators.documents import projected_answers as project

    return project(_candidates(spark, d))
