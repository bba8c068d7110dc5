"""Queries of the template operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import sales as S
from tallyforge.operators import templates as T
from tallyforge.operators.intervals import interval_join
from tallyforge.plans.sales import DEALS, LINES, narrow_deals, shared_deals
from tallyforge.sources.roles import catalogue, lines
from tallyforge.sources.stored import stored

AS_OF = "2000-01-01"
Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_R = "floor({} * 100 + 0.5) / 100"
STATS = """, sm as (select {by}, product_key, price, quantity, ship from {src} where price > 0),
sr as (select *, row_number() over (partition by {by}, product_key order by price) as rn, count(*) over (partition by {by}, product_key) as n,
    case when coalesce(quantity, 0) <> 0 then quantity else 1 end * coalesce(pow(0.5, greatest(date_diff('day', ship::date, date '2000-01-01'), 0) / 365.0), 0.5) as w from sm),
sa as (select {by}, product_key, avg(price) as mean, median(price) as median, sum(price * w) / sum(w) as weighted_mean, avg(price) filter (rn > floor(n * 0.1) and rn <= n - floor(n * 0.1)) as trimmed_mean, stddev_pop(price) as std, count(*) as sample_size from sr group by 1, 2),
sf as (select *, (mean + median + weighted_mean + trimmed_mean) / 4 as final from sa),
st as (select *, case when final > 0 then std / final else 0 end as cv from sf)
"""


def _lines(spark, d):
    return lines(spark, d).withColumn("category", F.col("direction"))


@query(
    LINES
    + STATS.format(by="direction", src="lines")
    + f"""select direction as category, product_key, {_R.format('mean')} as mean, {_R.format('median')} as median, {_R.format('weighted_mean')} as weighted_mean, {_R.format('trimmed_mean')} as trimmed_mean, {_R.format('final')} as final,
    {_R.format('std')} as std, floor(cv * 10000 + 0.5) / 10000 as cv, case when cv < 0.15 then 'high' when cv < 0.3 then 'medium' else 'low' end as confidence, sample_size from st"""
)
def template_price_stats(spark, d):
    rows = _lines(spark, d).select("category", "product_key", "price", "quantity", F.col("ship").cast("date").alias("closed"))
    return T.price_stats(rows, ["category", "product_key"], AS_OF)


CANON = """, pl as (select primary_direction as category, * from deals where unique_products >= 2),
k1 as (select category, unique_products as p, row_number() over (partition by category order by unique_products) as rn, count(*) over (partition by category) as n from pl),
p60 as (select category, p as p60 from k1 where rn = least(floor(n * 0.6), n - 1) + 1),
k2 as (select category, opportunity as o, row_number() over (partition by category order by opportunity) as rn, count(*) over (partition by category) as n from pl where opportunity > 0),
mo as (select category, o as mo from k2 where rn = least(floor(n * 0.5), n - 1) + 1),
el as (select pl.*, row_number() over (partition by category order by case when dataset = 'orders' then 0 else 1 end, abs(opportunity - coalesce(mo, 0)), deal_id) as rn, count(*) over (partition by category) as eligible
    from pl join p60 using (category) left join mo using (category) where unique_products >= p60),
cd as (select category, deal_id, dataset, eligible from el where rn = 1)
"""


@query(DEALS + CANON + "select * from cd")
def canonical_deals(spark, d):
    pool = narrow_deals(spark, d, "dataset", "deal_id", "primary_direction", "unique_products", "opportunity").filter("unique_products >= 2")
    return T.canonical_deals(stored(pool.withColumnRenamed("primary_direction", "category"), "pool"), "category")


@query(LINES + ", n as (select direction, count(distinct (dataset, deal_id)) as n from lines group by 1), p as (select direction, product_key, count(distinct (dataset, deal_id)) as deals from lines group by 1, 2) select direction as category, product_key, deals, floor(deals / n * 100 + 0.5) / 100 as frequency from p join n using (direction)")
def good_frequency(spark, d):
    return T.good_frequency(_lines(spark, d), "category")


POS = (
    CANON
    + ", cl as (select l.*, primary_direction as category from lines l join pr using (dataset, deal_id)), cr as (select cl.* from cl join cd using (category, dataset, deal_id)), cs as (select cl.* from cl semi join cr using (category, product_key))"
    + STATS.format(by="category", src="cs")
    + f""", fn as (select category, count(distinct (dataset, deal_id)) as n from cl group by 1), fp as (select category, product_key, count(distinct (dataset, deal_id)) as k from cl group by 1, 2),
ps as (select cr.category, cr.deal_id, cr.product_key, cr.product_name, cr.quantity, {_R.format('final')} as final, {_R.format('std')} as std, case when cv < 0.15 then 'high' when cv < 0.3 then 'medium' else 'low' end as confidence, sample_size, floor(k / n * 100 + 0.5) / 100 as frequency
    from cr join st using (category, product_key) join fn using (category) join fp using (category, product_key))
"""
)


def _positions(spark, d):
    deals = shared_deals(spark, d).withColumn("category", F.col("primary_direction"))
    canonical = stored(T.canonical_deals(deals, "category"), "canonical")
    # lines lie by deal_id: joined by it alone they stay where they are
    rows = lines(spark, d).select("dataset", "deal_id", "line", "product_key", "product_name", "price", "quantity", "ship")
    rows = rows.join(deals.select("deal_id", F.col("dataset").alias("_in"), "category"), "deal_id").filter(F.col("dataset") == F.col("_in")).drop("_in")
    rows = stored(rows, "category_lines")
    return T.canonical_positions(rows, canonical, "category", AS_OF)


@query(DEALS + POS + "select * from ps")
def canonical_positions(spark, d):
    return _positions(spark, d).drop("line")


@query(DEALS + POS + "select product_key, array_to_string(list_sort(list(distinct category)), '|') as categories from ps group by 1")
def product_to_categories(spark, d):
    return T.reverse_index(_positions(spark, d), "category")


@query(
    DEALS
    + POS
    + """, rq as (select r_regionkey as request_id, c.category, r_regionkey + 1.0 as scale from region, (select distinct category from cd) c),
t as (select request_id, category, sum(final * quantity * scale) as total, sqrt(sum(pow(std * quantity * scale, 2))) as sd, count(*) as positions from rq join ps using (category) group by 1, 2)
select request_id, category, round(total, 2) as total, round(greatest(total - greatest(sd, total * 0.1), 0), 2) as low, round(total + greatest(sd, total * 0.1), 2) as high, positions from t"""
)
def template_estimates(spark, d):
    from tallyforge.sources.roles import table

    positions = _positions(spark, d)
    requests = table(spark, d, "region").select(F.col("r_regionkey").alias("request_id"), (F.col("r_regionkey") + 1.0).alias("scale"), F.explode(F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])).alias("category"))
    return T.estimates(positions, requests, "category")


@query(
    """with w as (select p_type as direction, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 3))) as word from part),
c as (select direction, word, count(*) as n from w where word not in ('red') group by 1, 2), k as (select *, row_number() over (partition by direction order by n desc, word) as rank from c) select * from k where rank <= 8"""
)
def category_keywords(spark, d):
    return T.keywords(catalogue(spark, d), "direction", "name", stop=("red",))


@query("select p_partkey as product_id, p_size, case when p_size < 10 then 120.0 when p_size < 20 then 180.0 when p_size < 35 then 260.0 when p_size < 1000 then 400.0 end as rate from part")
def bracket_rates(spark, d):
    from tallyforge.sources.roles import table

    brackets = spark.createDataFrame([(10, 120.0), (20, 180.0), (35, 260.0), (1000, 400.0)], "below int, rate double")
    return T.bracket_price(table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_size"), F.col("p_size"), brackets)


@query(
    """with r as (select l_partkey, l_suppkey, min(l_quantity) as low, case when count(*) > 1 then max(l_quantity) + 1 end as high from lineitem group by 1, 2)
select l_orderkey, l_linenumber, count(*) as ranges, min(r.l_suppkey) as first_supplier, round(sum(r.low), 2) as lows from lineitem l join r on l.l_partkey = r.l_partkey and l_quantity >= low and (high is null or l_quantity < high) group by 1, 2"""
)
def quantity_ranges(spark, d):
    """Lines and the quantity ranges of their product that they fall in: a range of each supplier, open above
    where it has delivered the product once."""
    from tallyforge.sources.roles import table

    lines = table(spark, d, "lineitem")
    ranges = lines.groupBy("l_partkey", F.col("l_suppkey").alias("supplier")).agg(F.min("l_quantity").alias("low"), F.when(F.count("*") > 1, F.max("l_quantity") + 1).alias("high"))
    found = interval_join(lines.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ranges, "l_quantity", "low", "high", ("l_partkey",))
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("ranges"), F.min("supplier").alias("first_supplier"), F.round(F.sum("low"), 2).alias("lows"))
