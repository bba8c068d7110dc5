"""Queries of the sales operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import sales as S
from tallyforge.sources.roles import catalogue, lines, raw_lines
from tallyforge.sources.stored import stored

LINES = """
with goods as (select p_partkey as product_id, p_name as name, p_retailprice as base_price, p_type as direction, p_brand as section from part),
lines as (select case o_orderstatus when 'F' then 'orders' when 'O' then 'offers' else 'open' end as dataset, o_orderkey as deal_id, o_orderpriority as title,
    case when o_custkey = 0 then '__MISSING_CLIENT__' else o_custkey::varchar end as client_key, o_orderdate as begin_at, l_shipdate as ship, case when o_orderpriority = '5-LOW' then 'barter' else 'money' end as payment,
    o_totalprice as opportunity, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line, l_partkey as product_id, case when l_partkey = 0 then 'manual:' || lower(trim(p_name)) else l_partkey::varchar end as product_key,
    p_name as product_name, l_extendedprice / l_quantity as price, l_quantity as quantity, p_retailprice as base_price,
    l_extendedprice / l_quantity * l_quantity as line_total, l_extendedprice / l_quantity / p_retailprice as price_ratio, p_type as direction, p_brand as section
    from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey)
"""
DEALS = (
    LINES
    + """, pr as (select dataset, deal_id, arg_min(direction, k) as primary_direction from (select dataset, deal_id, direction, row(-count(*), min(line)) as k from lines group by 1, 2, 3) group by 1, 2),
d0 as (select dataset, deal_id, arg_min(title, line) as title, arg_min(client_key, line) as client_key, arg_min(begin_at, line) as begin_at, max(ship) as close_at, arg_min(payment, line) as payment,
    arg_min(opportunity, line) as opportunity, count(*) as line_count, round(sum(quantity), 2) as total_quantity, round(sum(line_total), 2) as line_total,
    list_sort(list(distinct product_key)) as product_keys, array_to_string(list_sort(list(distinct section)), '|') as sections from lines group by 1, 2),
deals as (select d0.*, primary_direction, strftime(close_at, '%Y-%m') as close_month, case when close_at >= begin_at then floor((epoch_ms(close_at) - epoch_ms(begin_at)) / 86400000.0 + 0.5)::bigint end as duration_days,
    len(product_keys) as unique_products, round(case when opportunity <> 0 and line_total <> 0 then abs(line_total - opportunity) / opportunity end, 4) as gap_pct, array_to_string(product_keys, '|') as bundle_key
    from d0 join pr using (dataset, deal_id))
"""
)
FACTS = """
, o as (select product_key, count(*) as order_rows, count(distinct deal_id) as order_deals, round(coalesce(sum(quantity) filter (payment <> 'barter'), 0), 2) as total_order_qty,
    quantile_cont(price, [0.25, 0.5, 0.75]) filter (payment <> 'barter') as p, quantile_cont(quantity::double, [0.25, 0.5, 0.75]) filter (payment <> 'barter') as q, quantile_cont(price_ratio, [0.25, 0.5, 0.75]) filter (payment <> 'barter') as r,
    max(price_ratio) filter (payment <> 'barter') - min(price_ratio) filter (payment <> 'barter') as rng from lines where dataset = 'orders' group by 1),
f as (select product_key, count(*) as offer_rows, count(distinct deal_id) as offer_deals, list_sort(list(distinct quantity))[1:8] as ladder from lines where dataset = 'offers' group by 1),
g as (select product_id::varchar as product_key, * exclude (product_id), 'Y' as goods_present from goods),
pf as (select coalesce(g.product_key, o.product_key, f.product_key) as product_key, coalesce(name, '') as product_name, coalesce(direction, '__MISSING_DIRECTION__') as direction,
    case when goods_present = 'Y' then 'catalog' when coalesce(o.product_key, f.product_key) like 'manual:%' then 'manual_row' else 'missing_catalog' end as catalog_match, coalesce(goods_present, 'N') as goods_present, base_price,
    coalesce(offer_rows, 0) as offer_rows, coalesce(offer_deals, 0) as offer_deals, coalesce(order_rows, 0) as order_rows, coalesce(order_deals, 0) as order_deals, coalesce(total_order_qty, 0.0) as total_order_qty,
    coalesce(array_to_string(list_transform(ladder, lambda x: x::bigint::varchar), '|'), '') as offer_qty_ladder,
    round(p[1] + 1e-9, 4) as price_p25, round(p[2] + 1e-9, 4) as price_p50, round(p[3] + 1e-9, 4) as price_p75, round(q[1] + 1e-9, 4) as qty_p25, round(q[2] + 1e-9, 4) as qty_p50, round(q[3] + 1e-9, 4) as qty_p75,
    round(r[1] + 1e-9, 4) as ratio_p25, round(r[2] + 1e-9, 4) as ratio_p50, round(r[3] + 1e-9, 4) as ratio_p75, round(rng, 4) as ratio_range
    from g full join o on g.product_key = o.product_key full join f on f.product_key = coalesce(g.product_key, o.product_key)),
facts as (select *, case when catalog_match <> 'catalog' then 'manual_or_missing_catalog' when regexp_matches(lower(product_name), 'discount|surcharge|prepayment') then 'financial_modifier' when order_rows < 10 then 'insufficient_history'
    when ratio_range is null then 'no_price_anchor' when order_rows >= 30 and ratio_range <= 0.15 then '' when ratio_range <= 0.5 then 'requires_context_lookup' else 'high_price_variance' end as reason from pf),
pfacts as (select *, case reason when '' then 'auto' when 'requires_context_lookup' then 'guided' else 'manual' end as price_mode, case reason when '' then 'high' when 'requires_context_lookup' then 'medium' else 'low' end as confidence from facts)
"""
MATCHES = """
, off as (select * from deals where dataset = 'offers'), ord as (select * from deals where dataset = 'orders'),
tp as (select bundle_key, count(*) as template_deals, arg_min(title, deal_id) as sample_title, any_value(product_keys) as keys from off group by 1),
ex as (select bundle_key, count(*) as n from ord group by 1),
un as (select bundle_key, len(keys) as k, unnest(keys) as product from tp),
oi as (select deal_id, line_total, unnest(product_keys) as product from ord),
hit as (select bundle_key, deal_id, any_value(line_total) as line_total from un join oi using (product) group by bundle_key, deal_id, k having count(*) = k),
cn as (select bundle_key, count(*) as n, round(median(line_total) + 1e-9, 2) as med from hit group by 1),
tm as (select tp.bundle_key, len(keys) as products, template_deals, sample_title, coalesce(ex.n, 0) as exact_matches, coalesce(cn.n, 0) as contained_matches, med as matched_median, round(coalesce(cn.n, 0) / template_deals, 4) as match_rate
    from tp left join ex using (bundle_key) left join cn using (bundle_key))
"""

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def shared_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines for several branches and queries: written once in an application."""
    return stored(lines(spark, d), "lines")


def shared_deals(spark: SparkSession, d: str) -> DataFrame:
    """Deal facts for several branches and queries: from lines that lie by deal, not from the written ones,
    which would be shuffled again."""
    return stored(S.deal_facts(lines(spark, d)), "deals")


def narrow_deals(spark: SparkSession, d: str, *of: str) -> DataFrame:
    """Deal facts of few columns for one query, from lines that carry nothing else. Position and product order
    a deal's lines for its primary direction: lines equal in both name the same directions."""
    rows = lines(spark, d, by_deal=True).withColumn("line", F.struct("line.l_linenumber", "line.l_partkey"))
    return S.deal_facts(rows, of)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return S.product_facts(shared_lines(spark, d), catalogue(spark, d))


@query(LINES + "select dataset, deal_id, client_key, payment, product_key, product_name, round(price + 1e-9, 4) as price, quantity, round(line_total, 2) as line_total, round(price_ratio, 4) as price_ratio, direction, section from lines")
def normalised_lines(spark, d):
    cols = ["dataset", "deal_id", "client_key", "payment", "product_key", "product_name", F.round(F.col("price") + 1e-9, 4).alias("price"), "quantity", F.round("line_total", 2).alias("line_total"), F.round("price_ratio", 4).alias("price_ratio"), "direction", "section"]
    return lines(spark, d).select(*cols)


_DEAL = "dataset, deal_id, title, client_key, close_month, payment, duration_days, line_count, unique_products, total_quantity, line_total, opportunity, gap_pct, primary_direction, bundle_key, sections"


@query(DEALS + f"select {_DEAL} from deals")
def deal_facts(spark, d):
    return shared_deals(spark, d).select(*_DEAL.split(", "))


@query(
    DEALS
    + """, c as (select client_key, count(*) as deal_count, round(sum(line_total), 2) as total_value from deals where dataset = 'orders' and client_key <> '__MISSING_CLIENT__' group by 1),
dd as (select client_key, arg_min(primary_direction, k) as dominant_direction from (select client_key, primary_direction, row(-count(*), min(deal_id)) as k from deals where dataset = 'orders' group by 1, 2) group by 1),
t as (select sum(line_total) as t from deals where dataset = 'orders' and client_key <> '__MISSING_CLIENT__')
select client_key, deal_count, total_value, dominant_direction, round(total_value / t, 4) as value_share,
    round(sum(total_value) over (order by total_value desc, client_key rows unbounded preceding) / t, 4) as cumulative_share, row_number() over (order by total_value desc, client_key) as rank from c join dd using (client_key), t"""
)
def client_concentration(spark, d):
    return S.client_concentration(shared_deals(spark, d))


@query(LINES + FACTS + "select * exclude (reason), reason from pfacts")
def product_facts(spark, d):
    return _facts(spark, d)


@query(
    LINES
    + FACTS
    + """, r as (select *, case when price_mode in ('auto', 'guided') then coalesce(price_p50, base_price) end as rec from pfacts)
select product_key, price_mode, base_price, round(rec + 1e-9, 2) as recommended,
    round(case price_mode when 'guided' then least(coalesce(price_p25, rec * 0.9), base_price * 0.9) when 'auto' then coalesce(price_p25, rec) end + 1e-9, 2) as suggested_min,
    round(case price_mode when 'guided' then greatest(coalesce(price_p75, rec * 1.1), base_price * 1.1) when 'auto' then coalesce(price_p75, rec) end + 1e-9, 2) as suggested_max,
    round(case when base_price > 0 and price_p50 > 0 then price_p50 / base_price end, 2) as markup from r"""
)
def pricing_facts(spark, d):
    return S.pricing(_facts(spark, d)).select("product_key", "price_mode", "base_price", "recommended", "suggested_min", "suggested_max", "markup")


@query(
    LINES
    + """, n as (select distinct name, direction, list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) as t from goods),
p as (select a.name, a.direction, b.name as analog, b.direction as analog_direction, round(len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) + case when a.direction = b.direction then 0.15 else 0 end, 4) as score from n a join n b on len(list_intersect(a.t, b.t)) > 0),
k as (select *, row_number() over (partition by name, direction order by score desc, analog, analog_direction) as rank from p),
i as (select name as analog, direction as analog_direction, min(product_id) as product_id from goods group by 1, 2)
select name, direction, analog, analog_direction, score, rank, product_id from k join i using (analog, analog_direction) where rank <= 3"""
)
def token_analogs(spark, d):
    g = catalogue(spark, d)
    return S.nearest_analogs(g, g)


@query(
    DEALS
    + """, dd as (select dataset, bundle_key, arg_min(primary_direction, k) as direction from (select dataset, bundle_key, primary_direction, row(-count(*), min(deal_id)) as k from deals group by 1, 2, 3) group by 1, 2),
tp as (select dataset, bundle_key, array_to_string(list(deal_id::varchar order by rn), '|') as sample_deals from (select *, row_number() over (partition by dataset, bundle_key order by line_total desc, deal_id) as rn from deals) where rn <= 5 group by 1, 2),
b as (select dataset, bundle_key, max(unique_products) as product_count, count(*) as deal_count, round(median(line_total) filter (payment <> 'barter') + 1e-9, 2) as median_value, round(avg(line_total) filter (payment <> 'barter') + 1e-9, 2) as avg_value,
    floor(median(duration_days) + 0.5) as duration_p50, array_to_string(list_sort(list_distinct(string_split(string_agg(sections, '|'), '|'))), '|') as canonical_key, arg_min(title, deal_id) as sample_title from deals group by 1, 2)
select * from b join dd using (dataset, bundle_key) join tp using (dataset, bundle_key)"""
)
def bundle_facts(spark, d):
    return S.bundle_facts(shared_deals(spark, d))


@query(
    DEALS
    + """, dd as (select client_key, arg_min(primary_direction, k) as dominant_direction from (select client_key, primary_direction, row(-count(*), min(row(dataset, deal_id))) as k from deals group by 1, 2) group by 1)
select client_key, count(*) as deal_count, count(*) filter (dataset = 'orders') as order_deals, count(*) filter (dataset = 'offers') as offer_deals, round(sum(line_total), 2) as total_value, round(avg(line_total) + 1e-9, 2) as avg_value, round(median(line_total) + 1e-9, 2) as median_value,
    min(close_month) as first_month, max(close_month) as last_month, array_to_string(list_sort(list(distinct dataset)), '|') as datasets, any_value(dominant_direction) as dominant_direction from deals join dd using (client_key) group by 1"""
)
def client_facts(spark, d):
    return S.client_facts(shared_deals(spark, d))


@query(DEALS + MATCHES + "select * from tm")
def template_matches(spark, d):
    return S.template_matches(shared_deals(spark, d))


@query(
    DEALS
    + """, top as (select bundle_key from deals where dataset = 'orders' group by 1 order by count(*) desc, bundle_key limit 200),
u as (select 'direction' as group_type, primary_direction as group_key, duration_days from deals union all select 'bundle', bundle_key, duration_days from deals semi join top using (bundle_key) where dataset = 'orders'),
q as (select group_type, group_key, count(duration_days) as deal_count, min(duration_days) as duration_min, quantile_cont(duration_days::double, [0.25, 0.5, 0.75]) as q, max(duration_days) as duration_max from u group by 1, 2)
select group_type, group_key, deal_count, duration_min, floor(q[1] + 0.5)::bigint as duration_p25, floor(q[2] + 0.5)::bigint as duration_p50, floor(q[3] + 0.5)::bigint as duration_p75, duration_max from q where deal_count > 0"""
)
def timeline_facts(spark, d):
    return S.timelines(shared_deals(spark, d))


@query(
    DEALS
    + """, ch as (select deal_id, line_total as deal_total, primary_direction, unique_products from deals where dataset = 'orders' and unique_products >= 2 and line_total > 500 and payment <> 'barter'),
r as (select l.*, row_number() over (partition by l.deal_id order by l.line_total desc, line) as rn from lines l join ch using (deal_id) where dataset = 'orders'),
c as (select deal_id, string_agg(product_name || ' x' || quantity::bigint || ' = ' || floor(line_total + 0.5)::bigint, '; ' order by rn) as components from r where rn <= 10 group by 1),
g as (select deal_id, sum(line_total) as g from r group by 1),
p as (select deal_id, direction, sum(line_total) as t from r group by 1, 2),
s as (select deal_id, count(*) as direction_count, string_agg(direction || ': ' || floor(t / g * 100 + 0.5)::bigint || '%', '; ' order by round(t, 2) desc, direction) as direction_breakdown from p join g using (deal_id) group by 1)
select *, '' as materials from ch join c using (deal_id) join s using (deal_id)"""
)
def deal_profiles(spark, d):
    return S.deal_profiles(lines(spark, d), shared_deals(spark, d))


@query(
    DEALS
    + """, ch as (select deal_id, line_total as deal_total, primary_direction from deals where dataset = 'orders' and unique_products >= 2 and line_total > 500),
st as (select primary_direction, count(*) as deal_count, median(deal_total) as med, avg(deal_total) as av, sum(deal_total) as total from ch group by 1 having count(*) >= 3),
r as (select l.*, ch.primary_direction from lines l join ch using (deal_id) where dataset = 'orders'),
f as (select *, row_number() over (partition by primary_direction order by n desc, name) as rank from (select primary_direction, substr(trim(regexp_replace(product_name, '\\s+', ' ', 'g')), 1, 60) as name, count(*) as n, sum(line_total) as v from r group by 1, 2)),
t as (select primary_direction, rank, round(n / deal_count, 2) as share, name || ' [' || floor(round(n / deal_count, 2) * 100 + 0.5)::bigint || '%, ' || floor(round(v / total, 4) * 100 + 0.5)::bigint || '%]' as s from f join st using (primary_direction) where rank <= 15),
pr2 as (select primary_direction, coalesce(string_agg(s, '; ' order by rank) filter (share >= 0.05), '') as core_products, coalesce(string_agg(s, '; ' order by rank) filter (share >= 0.02 and share < 0.05), '') as optional_products from t group by 1),
x as (select *, row_number() over (partition by primary_direction order by n desc, direction) as rank from (select primary_direction, direction, count(distinct deal_id) as n from r where direction <> primary_direction group by 1, 2)),
y as (select primary_direction, string_agg(direction || ' (' || floor(n / deal_count * 100 + 0.5)::bigint || '%)', ', ' order by rank) as cross_directions from x join st using (primary_direction) where rank <= 5 group by 1)
select primary_direction, deal_count, floor(med + 0.5)::bigint as median_value, floor(av + 0.5)::bigint as avg_value, core_products, optional_products, coalesce(cross_directions, '') as cross_directions, '' as top_materials from st left join pr2 using (primary_direction) left join y using (primary_direction)"""
)
def service_composition(spark, d):
    # three branches read the lines of orders: written with their columns, as they lie by deal
    rows = stored(lines(spark, d).filter("dataset = 'orders'").select("dataset", "deal_id", "product_name", "direction", "line_total"), "order_lines")
    return S.service_composition(rows, shared_deals(spark, d))


@query(DEALS + "select dataset, close_month, primary_direction, count(*) as deal_count, round(sum(line_total), 2) as total_value, round(median(line_total) + 1e-9, 2) as median_value, round(avg(line_total) + 1e-9, 2) as avg_value from deals group by 1, 2, 3")
def monthly_kpis(spark, d):
    return S.monthly_kpis(shared_deals(spark, d))


@query(LINES + FACTS + "select product_key, product_name, direction, base_price, offer_rows, order_rows, case when offer_rows > 0 and order_rows > 0 then 'used_in_both' when offer_rows > 0 then 'offers_only' when order_rows > 0 then 'orders_only' else 'unused' end as status from pfacts where goods_present = 'Y'")
def catalogue_use(spark, d):
    return S.catalogue_use(_facts(spark, d))


@query(LINES + FACTS + "select product_key, product_name, direction, order_rows, price_mode, confidence, ratio_range, base_price, price_p50, reason from pfacts")
def price_stability(spark, d):
    return S.price_stability(_facts(spark, d))


@query(DEALS + MATCHES + "select bundle_key, products, template_deals, exact_matches, contained_matches, match_rate, sample_title from tm")
def template_conversion(spark, d):
    return S.template_matches(shared_deals(spark, d)).select("bundle_key", "products", "template_deals", "exact_matches", "contained_matches", "match_rate", "sample_title")


@query(
    DEALS
    + MATCHES
    + FACTS.replace(", o as", ", o as", 1)
    + """, c as (select client_key, count(*) as n from ord where client_key <> '__MISSING_CLIENT__' group by 1)
select (select count(*) from ord) as order_deals, (select count(*) from off) as offer_deals, (select count(*) from c) as known_clients, (select count(*) from c where n >= 2) as repeat_clients,
    (select count(*) from pfacts where price_mode = 'auto') as auto_products, (select count(*) from pfacts where price_mode = 'guided') as guided_products, (select count(*) from pfacts where price_mode = 'manual') as manual_products,
    (select count(*) from tm where exact_matches > 0) as exact_templates, (select count(*) from tm where contained_matches > 0) as contained_templates, round((select count(*) from c where n >= 2) / (select count(*) from c), 4) as repeat_share"""
)
def kpi_summary(spark, d):
    rows, deals = shared_lines(spark, d), shared_deals(spark, d)
    return S.kpi_summary(S.product_facts(rows, catalogue(spark, d)), deals, S.template_matches(deals))


@query(LINES + FACTS + "select price_mode, confidence, reason, count(*) as products, count(price_p50) as with_price from pfacts group by 1, 2, 3")
def pricing_summary(spark, d):
    return _facts(spark, d).groupBy("price_mode", "confidence", "reason").agg(F.count(F.lit(1)).alias("products"), F.count("price_p50").alias("with_price"))


@query(LINES + "select dataset, count(*) as rows, count(distinct deal_id) as deals, count(distinct product_key) as products, count(*) filter (product_id <> 0) as catalog_rows, round(count(*) filter (product_id <> 0) / count(*), 4) as coverage, 0::bigint as missing_direction, count(*) filter (client_key = '__MISSING_CLIENT__') as missing_client, count(*) filter (price is null or price <= 0) as bad_price from lines group by 1")
def dataset_quality(spark, d):
    return S.dataset_quality(lines(spark, d))


@query(LINES + ", g as (select dataset, deal_id, abs(sum(line_total) - any_value(opportunity)) / any_value(opportunity) as gap from lines group by 1, 2 having any_value(opportunity) <> 0 and sum(line_total) <> 0) select dataset, count(*) as comparable, round(median(gap), 4) as median_gap, round(quantile_cont(gap, 0.95), 4) as p95_gap, count(*) filter (gap <= 0.05) as within_5pct from g group by 1")
def line_gaps(spark, d):
    return S.line_gaps(lines(spark, d))


@query(
    LINES
    + """, i as (select 'deal_in_offers_and_orders' as code, 'warning' as severity, (select count(*) from (select deal_id from lines where dataset = 'offers' intersect select deal_id from lines where dataset = 'orders')) as n
union all select 'catalogue_product_never_sold', 'info', (select count(*) from goods where product_id not in (select product_id from lines)) union all select 'shipped_before_begin', 'warning', (select count(*) from lines where ship < begin_at) union all select 'line_outside_catalogue', 'blocking', (select count(*) from lines where product_id = 0))
select * from i where n > 0"""
)
def quality_issues(spark, d):
    return S.quality_issues(shared_lines(spark, d), catalogue(spark, d))


@query(
    LINES
    + """, b as (select deal_id, dataset, line, product_id, case when product_id % 7 = 0 then '__MISSING_DIRECTION__' else direction end as direction from lines),
r as (select dataset, b.direction = '__MISSING_DIRECTION__' as fixed, g.direction as direction from b join goods g using (product_id))
select dataset, direction, count(*) as rows, count(*) filter (fixed) as fixed from r group by 1, 2"""
)
def direction_repair(spark, d):
    broken = lines(spark, d).withColumn("direction", F.when(F.col("product_id") % 7 == 0, S.MISSING_DIRECTION).otherwise(F.col("direction")))
    out = S.repaired(broken, catalogue(spark, d), F.col("direction") == S.MISSING_DIRECTION)
    return out.groupBy("dataset", "direction").agg(F.count(F.lit(1)).alias("rows"), F.count_if("fixed").alias("fixed"))


@query(
    LINES
    + """, g as (select dataset, opportunity, deal_id from lines group by 1, 2, 3)
select dataset, case when opportunity < 50000 then 'low' when opportunity < 150000 then 'middle' else 'high' end as bucket, count(*) as deals, round(sum(opportunity), 2) as total from g group by 1, 2"""
)
def value_buckets(spark, d):
    from tallyforge.functions.numeric import money_bucket

    rows = raw_lines(spark, d).select("dataset", "opportunity", "deal_id").distinct()
    return rows.groupBy("dataset", money_bucket(F.col("opportunity"), [50_000.0, 150_000.0], ["low", "middle", "high"]).alias("bucket")).agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("opportunity"), 2).alias("total"))


@query(
    DEALS
    + """, h as (select dataset, bundle_key, deal_id, deal_id % 4 * 15 as height, repeat(title || ' ', (deal_id % 3)::int) as text from deals where bundle_key <> ''),
m as (select dataset, bundle_key, arg_min(height, k) as letter_height_cm from (select dataset, bundle_key, height, row(-count(*), min(deal_id)) as k from h where height > 0 group by 1, 2, 3) group by 1, 2),
t as (select dataset, bundle_key, arg_min(text, row(-length(text), deal_id)) as description, count(*) as deal_count from h group by 1, 2)
select dataset, bundle_key, deal_count, letter_height_cm, left(description, 500) as description from t left join m using (dataset, bundle_key)"""
)
def described_bundles(spark, d):
    """Bundles with the height most of their deals have and the longest description of one."""
    deals = shared_deals(spark, d).withColumn("letter_height_cm", F.col("deal_id") % 4 * 15).withColumn("description", F.expr("repeat(title || ' ', cast(deal_id % 3 as int))"))
    return S.bundle_facts(deals).select("dataset", "bundle_key", "deal_count", "letter_height_cm", "description")
