"""Queries of the taxonomy operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyforge.functions import rules
from tallyforge.operators import sales as S
from tallyforge.operators import taxonomy as X
from tallyforge.plans.sales import DEALS, LINES, shared_deals
from tallyforge.sources.roles import catalogue, lines, table

Q: dict = {}
O: dict = {}
URL = "https://crm.example/deal/%s/"


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_STOFF = ["ПВХ 3 мм", "акриловая панель", "неон и стекло", "баннер на магнитах", "plain"]
_NAMES = "list_value('ПВХ 3 мм', 'акриловая панель', 'неон и стекло', 'баннер на магнитах', 'plain')"


def _texts(spark, d):
    """Catalogue names with a material and a size, as the trade writes them."""
    p = table(spark, d, "part")
    stuff = F.element_at(F.array(*[F.lit(x) for x in _STOFF]), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    size = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit(" см"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size") * 10, F.lit(" мм"))).otherwise(F.concat((F.col("p_size") % 10).cast("string"), F.lit(",5 м")))
    return p.select(F.col("p_partkey").alias("product_id"), "p_type", "p_size", F.concat_ws(" ", "p_name", stuff, size).alias("text"))


_TEXTS = f"""with tx as (select p_partkey as product_id, p_type, p_size, p_name || ' ' || {_NAMES}[p_partkey % 5 + 1] || ' ' || case p_size % 3 when 0 then p_size || ' см' when 1 then (p_size * 10) || ' мм' else (p_size % 10) || ',5 м' end as text from part),
hx as (select *, case p_size % 3 when 0 then p_size when 1 then p_size else (p_size % 10) * 100 + 50 end as h0 from tx), hs as (select *, case when h0 between 10 and 200 and (p_size % 3 <> 0 or p_size >= 10) then h0 end as height from hx)
"""


@query(
    _TEXTS
    + """select product_id, array_to_string(list_filter([case when regexp_matches(lower(text), 'пвх') then 'ПВХ' end, case when regexp_matches(lower(text), 'акрил') then 'Акрил' end, case when regexp_matches(lower(text), 'неон') then 'Неон' end, case when regexp_matches(lower(text), 'баннер') then 'Баннер' end,
    case when regexp_matches(lower(text), 'стекл') then 'Стекло' end, case when regexp_matches(lower(text), 'магнит') then 'Магнит' end], lambda x: x is not null), '|') as materials from tx"""
)
def named_materials(spark, d):
    return _texts(spark, d).select("product_id", F.array_join(X.materials(F.col("text")), "|").alias("materials"))


@query(_TEXTS + ", k as (select p_type, height, count(*) as n, min(product_id) as f from hs where height is not null group by 1, 2) select p_type, arg_min(height, row(-n, f)) as height from k group by 1")
def height_modes(spark, d):
    return X.height_modes(_texts(spark, d), ["p_type"], "text", "product_id")


@query("select p_partkey as product_id, substr(trim(regexp_replace(regexp_replace(p_name || ' - ' || p_size || '-' || (p_size + 5) || ' мп,  more', '[0-9]+-[0-9]+ *мп', '', 'g'), '\\s+', ' ', 'g')), 1, 60) as name from part")
def component_names(spark, d):
    text = F.concat("p_name", F.lit(" - "), "p_size", F.lit("-"), F.col("p_size") + 5, F.lit(" мп,  more"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), X.component_name(text).alias("name"))


_TITLE = "case o_orderkey % 4 when 0 then 'Объёмные буквы «Дом» ' || o_orderpriority when 1 then 'Срочная ВИЗИТКИ 90х50 мм, ' || o_orderpriority when 2 then 'Сувенирная (кружка) ПВХ3 белая' else lower(o_orderpriority) || ' order' end"
_KEY = "case o_orderkey % 4 when 0 then 'объёмные буквы' when 1 then 'срочная визитки' when 2 then 'сувенирная кружка' else lower(o_orderpriority) || case when length(o_orderpriority) >= 3 then ' order' else '' end end"


def _titled(spark, d):
    k = F.col("o_orderkey") % 4
    title = F.when(k == 0, F.concat(F.lit("Объёмные буквы «Дом» "), "o_orderpriority")).when(k == 1, F.concat(F.lit("Срочная ВИЗИТКИ 90х50 мм, "), "o_orderpriority")).when(k == 2, F.lit("Сувенирная (кружка) ПВХ3 белая")).otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" order")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("deal_id"), title.alias("title"))


@query(f"with t as (select o_orderkey as deal_id, case when o_orderpriority = '4-NOT SPECIFIED' and o_orderkey % 4 = 3 then '4-not specified' else {_KEY} end as category from orders), n as (select category from t group by 1 having count(*) >= 3) select category, count(*) as deals, min(deal_id) as first_deal from t semi join n using (category) group by 1")
def title_clusters(spark, d):
    rows = X.clustered(_titled(spark, d))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("deals"), F.min("deal_id").alias("first_deal"))


_SEEDS = [("BIG", "orders", 3, True), ("BIG", "orders", 5, False), ("BIG", "offers", 1, False), ("SMALL", "offers", 2, True), ("SMALL", "offers", 4, False), ("NONE", "orders", 3, True), ("SMALL", "offers", -1, False)]


@query(
    DEALS
    + """, sd as (select * from (values ('BIG', 'orders', 3, true), ('BIG', 'orders', 5, false), ('BIG', 'offers', 1, false), ('SMALL', 'offers', 2, true), ('SMALL', 'offers', 4, false), ('NONE', 'orders', 3, true), ('SMALL', 'offers', -1, false)) t(category, dataset, deal_id, canonical)),
me as (select case when unique_products >= 4 then 'BIG' else 'SMALL' end as category, dataset, deal_id from deals), kn as (select sd.*, line_count from sd join deals using (dataset, deal_id)), ch as (select * from kn where canonical and category in (select category from me)),
ev as (select * from me union select category, dataset, deal_id from kn where category in (select category from ch)), c0 as (select category, min(deal_id) as deal_id from me where dataset = 'orders' group by 1)
select category, coalesce(ch.dataset, 'orders') as dataset, coalesce(ch.deal_id, c0.deal_id) as deal_id, ch.deal_id is not null as seeded, (select count(*) from ev where ev.category = c0.category) as members from c0 left join ch using (category)"""
)
def seeded_canonicals(spark, d):
    deals = shared_deals(spark, d)
    members = deals.select(F.when(F.col("unique_products") >= 4, "BIG").otherwise("SMALL").alias("category"), "dataset", "deal_id")
    first = members.filter("dataset = 'orders'").groupBy("category").agg(F.min("deal_id").alias("deal_id")).withColumn("dataset", F.lit("orders"))
    seeds = spark.createDataFrame(_SEEDS, "category string, dataset string, deal_id long, canonical boolean")
    every, canonical = X.seeded(members, first, deals, seeds)
    return canonical.join(every.groupBy("category").agg(F.count(F.lit(1)).alias("members")), "category")


@query(f"with t as (select o_orderkey as deal_id, {_TITLE} as title from orders) select deal_id, case deal_id % 4 when 0 then 'signboard_volume' when 1 then 'visitka' when 2 then 'merch_mug' end as subcategory, case deal_id % 4 when 0 then 'signboard_volume' when 1 then 'visitka' when 2 then 'merch_mug' end as asked, case deal_id % 5 when 0 then 'poster' when 1 then 'menu' else case deal_id % 4 when 0 then 'signboard_volume' when 1 then 'visitka' when 2 then 'merch_mug' end end as by_id from t")
def subcategories(spark, d):
    t = _titled(spark, d)
    ids = F.when(F.col("deal_id") % 5 == 0, F.array(F.lit("x"), F.lit("p"))).when(F.col("deal_id") % 5 == 1, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>"))
    name = lambda i: X.subcategory(i, F.col("title"), F.lit(""), {"p": "poster", "m": "menu"})
    return t.select("deal_id", name(F.array().cast("array<string>")).alias("subcategory"), X.query_subcategory(F.col("title")).alias("asked"), name(ids).alias("by_id"))


@query(
    """with w as (select p_partkey as product_id, string_split(p_name, ' ') as w, p_size as z from part), s as (select *, array_to_string(w, '_') as n from w)
select product_id, array_to_string(list_distinct_keep, '|') as slugs from (select product_id, list_filter([n || '_' || z || '_sht', n, w[1] || '_' || w[2], w[1], n || '_' || z || '_sht_fast'], lambda x, i: list_position([n || '_' || z || '_sht', n, w[1] || '_' || w[2], w[1], n || '_' || z || '_sht_fast'], x) = i) as list_distinct_keep from s)"""
)
def title_slugs(spark, d):
    title = F.concat("p_name", F.lit(" "), "p_size", F.lit(" шт. fast"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.array_join(X.candidate_slugs(title), "|").alias("slugs"))


@query(
    """select o_orderkey as deal_id, case o_orderkey % 3 when 0 then 'see [сделка #' || (o_orderkey + 1000) || '](https://crm.example/deal/' || (o_orderkey + 1000) || '/) and [#' || (o_orderkey + 2000) || '](https://crm.example/deal/' || (o_orderkey + 2000) || '/).'
    when 1 then '[КП #' || (o_orderkey + 1000) || '](https://crm.example/deal/' || (o_orderkey + 1000) || '/), [x #9999](https://a.b/#8888) https://a.b/#7777' else 'no. 5 a#12345 #123 #0000' end as linked from orders"""
)
def linked_texts(spark, d):
    k, n = F.col("o_orderkey") % 3, lambda x: (F.col("o_orderkey") + x).cast("string")
    text = F.when(k == 0, F.concat(F.lit("see сделка № "), n(1000), F.lit(" and #"), n(2000), F.lit("."))).when(k == 1, F.concat(F.lit("КП#"), n(1000), F.lit(", [x #9999](https://a.b/#8888) https://a.b/#7777"))).otherwise(F.lit("no. 5 a#12345 #123 #0000"))
    once = X.linkified(text, URL)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("deal_id"), X.linkified(once, URL).alias("linked"))


_JSON = {
    0: '{"estimated_price": %s, "price_band": [%s, %s], "estimated_lead_time": 5}',
    1: '{"estimated_price": "1 %s,5", "price_band": %s, "estimated_lead_time": {"days": %s}}',
    2: '{"estimated_price": {"value": %s, "basis": "history"}, "price_band": {"min": %s, "max": %s}, "estimated_lead_time": "soon"}',
    3: '{"estimated_price": [%s], "price_band": [%s], "estimated_lead_time": {"min": 3, "max": %s}}',
    4: "not json %s %s %s",
}


@query(
    """select o_orderkey as deal_id, case o_orderkey % 5 when 0 then o_orderkey::double when 1 then ('1' || o_orderkey || '.5')::double when 2 then o_orderkey::double end as price, case o_orderkey % 5 when 2 then 'history' when 0 then '' when 1 then '' end as basis,
    case when o_orderkey % 5 < 3 then o_orderkey::double end as band_min, case when o_orderkey % 5 < 3 then o_orderkey::double end as band_max,
    case o_orderkey % 5 when 0 then '5 раб. дн.' when 1 then o_orderkey || ' раб. дн.' when 2 then 'soon' when 3 then '3-' || o_orderkey || ' раб. дн.' when 4 then '1-3 рабочих дня' end as lead_time from orders"""
)
def coerced_answers(spark, d):
    k = F.col("o_orderkey").cast("string")
    text = F.lit(None).cast("string")
    for i, t in _JSON.items():
        text = F.when(F.col("o_orderkey") % 5 == i, F.format_string(t, k, k, k)).otherwise(text)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("deal_id"), text.alias("answer"))
    c = X.coerced(F.col("answer"))
    rows = rows.select("deal_id", *[v.alias(n) for n, v in c.items()])
    lead = X.lead_time(F.col("estimated_lead_time"), F.lit("Визитки на заказ"), F.lit(True))
    return rows.select("deal_id", F.col("estimated_price.value").alias("price"), F.col("estimated_price.basis").alias("basis"), F.col("price_band.min").alias("band_min"), F.col("price_band.max").alias("band_max"), lead.alias("lead_time"))


@query("with p as (select item_id, list_filter([row(nullif(instr(lower(text), 'the'), 0), 1, 'the'), row(nullif(instr(lower(text), 'on'), 0), 2, 'on'), row(nullif(instr(lower(text), 'e'), 0), 3, 'e')], lambda x: x[1] is not null) as c from benchmark) select item_id, list_sort(c)[1][3] as first_word from p")
def earliest_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.earliest(F.col("text"), {"the": "the", "on": "on", "e": "e"}).alias("first_word"))


_TOK = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2))"
_BRIDGE = f"""with g as (select p_name as product, min(p_partkey) as product_id, {_TOK.format('p_name')} as u from part group by 1),
wn as (select s_nationkey as nk, s_suppkey as package, unnest([p_name || ' large', 'nothing alike']) as name from supplier join part on p_partkey = s_suppkey),
nm as (select distinct name, {_TOK.format('name')} as t from wn), pr as (select name, product_id, product, round(0.7 * len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) + 0.3 * len(list_intersect(t, u)) / least(len(t), len(u)), 4) as score from nm, g where len(list_intersect(t, u)) > 0),
bs as (select name, arg_min(product_id, row(-score, product)) as product_id from pr where score >= 0.45 group by 1), fd as (select * from wn left join bs using (name))
"""


def _services(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey")
    pack = F.struct(F.col("s_suppkey").cast("string").alias("name"), F.array(F.col("s_suppkey")).alias("offer_ids"), F.array(F.concat("p_name", F.lit(" large")), F.lit("nothing alike")).alias("products"))
    packs = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(pack)).alias("packages"))
    n = table(spark, d, "nation").join(packs, F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select(F.col("n_name").alias("service"), F.col("n_regionkey").cast("string").alias("direction"), "packages")


@query(_BRIDGE + "select 'bridge_' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) as doc_id, array_to_string(list_sort(list(distinct package)), '|') as offers, coalesce(array_to_string(list_sort(list(distinct product_id)), '|'), '') as products, count(*) as wanted, count(product_id) as resolved from fd join nation on n_nationkey = nk group by n_name")
def bridge_documents(spark, d):
    docs, _ = X.bridges(_services(spark, d), catalogue(spark, d))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return docs.select("doc_id", show("offer_ids").alias("offers"), show("product_ids").alias("products"), "wanted", "resolved")


@query(_BRIDGE + "select n_name as service, package::varchar as package, name as product_name from fd join nation on n_nationkey = nk where product_id is null")
def unresolved_products(spark, d):
    return X.bridges(_services(spark, d), catalogue(spark, d))[1]


@query(LINES + ", r as (select *, row_number() over (partition by dataset, deal_id order by line_total desc, line) as rn from lines) select dataset, deal_id, string_agg(product_name || ' x' || quantity::bigint || ' [' || section || ']', '; ' order by rn) as composition, count(*) as known from r where rn <= 3 group by 1, 2")
def deal_compositions(spark, d):
    return X.compositions(lines(spark, d), catalogue(spark, d), 3)


@query("with m as (select conv_id, max(turn) as t, count(*) as n from conversations group by 1) select conv_id as chat_id, case when conv_id % 2 = 0 then t + 10 else t end as updated_at, case when conv_id % 2 = 0 then n + 1 else n end as messages from m")
def appended_messages(spark, d):
    c = table(spark, d, "conversations")
    messages = c.select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") % 7).alias("user_id"), "role", F.col("text").alias("content"), F.col("turn").cast("long").alias("created_at"))
    chats = messages.groupBy("chat_id", "user_id").agg(F.max("created_at").alias("updated_at"))
    user = F.when(F.col("chat_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)  # others may not write
    new = chats.select("chat_id", user.alias("user_id"), F.lit("user").alias("role"), F.lit("more").alias("content"), (F.col("updated_at") + 10).alias("created_at"))
    every, touched = X.append_messages(messages, chats, new)
    return touched.select("chat_id", "updated_at").join(every.groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages")), "chat_id")


@query("with u as (select c_custkey as user_id, c_name as username, 'active' as status from customer where c_custkey % 2 = 0 union all select min(c_custkey) + 1000000, 'new ' || c_nationkey, 'pending' from customer group by c_nationkey) select user_id, username, case when user_id % 10 = 0 then 'rejected' when user_id % 10 = 4 then 'approved' else status end as status from u")
def user_lifecycle(spark, d):
    c = table(spark, d, "customer")
    users = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.lit("active").alias("status"))
    fresh = c.select((F.col("c_custkey") + 1_000_000).alias("user_id"), F.concat(F.lit("new "), "c_nationkey").alias("username"))
    taken = users.select((F.col("user_id") + 5_000_000).alias("user_id"), "username")
    every = X.registered(users, fresh.unionByName(taken))
    old = every.filter("user_id % 10 in (0, 4)").select("user_id", F.lit("seen").alias("status"), F.lit(1).alias("at"))
    new = every.filter("user_id % 10 in (0, 4)").select("user_id", F.when(F.col("user_id") % 10 == 0, "rejected").otherwise("approved").alias("status"), F.lit(2).alias("at"))
    return X.with_status(every, old.unionByName(new)).select("user_id", "username", "status")


@query("select user_id, count(*) filter (value <> 0) as ratings, count(*) filter (value > 20) as positive, round(count(*) filter (value > 20) / count(*) filter (value <> 0), 4) as csat from events group by 1 having count(*) filter (value <> 0) > 0")
def user_satisfaction(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("value") > 20, 1).when(F.col("value") != 0, -1).alias("rating"))
    return X.satisfaction(e, "user_id")


#: Words of which the query below makes titles.
_WORDS = "вывеска световая буквы объемные табличка прозрачная стенд напольный пакет майка логотип бриф ручка флаги меню панель макет дизайн карта пластик кружка стикер наклейка баннер".split()


def _category_sql() -> str:
    """The rule table as one CASE; boundaries by the characters beside a word."""
    word = "[^\\p{L}\\p{N}_]"

    def plain(p: str) -> str:
        p = re.sub(r"\\b(?=[\w(])", lambda _: f"(?:^|{word})", p)
        return p.replace("\\b", f"(?:$|{word})").replace("'", "''")

    hit = lambda p: f"regexp_matches(t, '{plain(p)}')"
    cases = []
    for parent, name, all_of, any_of, not_any in rules.CATEGORIES:
        terms = [*map(hit, all_of), *([f"({' or '.join(map(hit, any_of))})"] if any_of else []), *(f"not {hit(p)}" for p in not_any)]
        cases.append(f"when {' and '.join(terms)} then '{parent}|{name}'")
    words = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
    n = len(_WORDS)
    return f"with t as (select p_partkey as id, {words}[p_partkey % {n} + 1] || ' ' || {words}[p_size * 7 % {n} + 1] || ' ' || lower(p_name) as t from part) select id, t as title, case {' '.join(cases)} end as category from t"


@query(_category_sql())
def title_categories(spark, d):
    """Categories of titles by the whole rule table."""
    words, n = F.array(*map(F.lit, _WORDS)), len(_WORDS)
    title = F.concat_ws(" ", F.get(words, (F.col("p_partkey") % n).cast("int")), F.get(words, (F.col("p_size") * 7 % n).cast("int")), F.lower("p_name"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), title.alias("title"))
    found = X.title_category(F.col("title"))
    return rows.withColumn("c", found).select("id", "title", F.when(F.col("c").isNotNull(), F.concat_ws("|", "c.parent", "c.name")).alias("category"))
