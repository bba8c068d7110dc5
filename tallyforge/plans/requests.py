"""Queries of requests, quotes and the wider facts. The test tables hold no text of the trade, so requests
and quotes are phrases of it that Spark derives from the tables' keys and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import quotes
from tallyforge.operators import fact_details as D
from tallyforge.operators import requests as A
from tallyforge.operators.retrieval import dense_top_k
from tallyforge.operators.texts import roadmap_chunks as chunks_of
from tallyforge.plans import retrieval, sales
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


def _pick(words: list[str], by: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(by, F.lit(len(words))).cast("int"))


def _sql(words: list) -> str:
    return "[" + ", ".join("'" + str(w) + "'" for w in words) + "]"


SIZED = "product_name || ' ' || (product_id % 40 + 10) || ' cm'"
HEIGHTS = (
    f""", nm as (select dataset, deal_id, {SIZED} as name, min(line) as l, count(*) as n, any_value(product_id % 40 + 10) as h from lines group by 1, 2, 3),
hs as (select dataset, deal_id, arg_min(h, k) as letter_height_cm from (select dataset, deal_id, h, row(-sum(n), min(l)) as k from nm where h between 10 and 200 group by 1, 2, 3) group by 1, 2),
sm as (select dataset, deal_id, string_agg(name, ' | ' order by rn) as sample_products from (select *, row_number() over (partition by dataset, deal_id order by l, name) as rn from nm) where rn <= 5 group by 1, 2)
"""
)


@query(
    sales.DEALS
    + HEIGHTS
    + "select dataset, deal_id, title, client_key, begin_at as begin, close_at as close, line_count, line_total, primary_direction, case when client_key = '__MISSING_CLIENT__' then 'missing' else 'known' end as client_status, year(close_at) as close_year, letter_height_cm, sample_products from deals join sm using (dataset, deal_id) left join hs using (dataset, deal_id)"
)
def deal_details(spark, d):
    """Names carry a size by their catalogue id, so that deals have heights. Lines are read as they lie by
    deal, not as they were written, so that the names of a deal are combined without a shuffle."""
    sized = F.concat("product_name", F.lit(" "), F.pmod("product_id", F.lit(40)) + 10, F.lit(" cm"))
    out = D.deal_details(lines(spark, d).withColumn("product_name", sized), sales.shared_deals(spark, d))
    return out.select("dataset", "deal_id", "title", "client_key", "begin", "close", "line_count", "line_total", "primary_direction", "client_status", "close_year", "letter_height_cm", "sample_products")


@query(
    sales.LINES
    + sales.FACTS
    + """, rr as (select product_key, round(min(price_ratio) filter (dataset = 'orders' and payment <> 'barter'), 4) as ratio_min, round(max(price_ratio) filter (dataset = 'orders' and payment <> 'barter'), 4) as ratio_max,
    arg_min(row(product_id, product_name, direction, base_price), row(case dataset when 'orders' then 0 else 1 end, deal_id, line)) as s from lines where dataset in ('orders', 'offers') group by 1)
select product_key, coalesce(s[1]::varchar, product_key) as product_id, case when pf.product_name = '' then s[2] else pf.product_name end as product_name, case when pf.product_name = '' then s[2] else pf.product_name end as catalog_name,
    case when goods_present = 'Y' then pf.direction else s[3] end as direction, coalesce(pf.base_price, s[4]) as base_price, order_rows, offer_rows, ratio_range, price_mode, section, ratio_min, ratio_max
from pfacts pf left join goods on product_key = goods.product_id::varchar left join rr using (product_key)"""
)
def product_details(spark, d):
    goods = catalogue(spark, d)
    out = D.product_details(sales._facts(spark, d), sales.shared_lines(spark, d), goods)
    return out.select("product_key", "product_id", "product_name", "catalog_name", "direction", "base_price", "order_rows", "offer_rows", "ratio_range", "price_mode", "section", "ratio_min", "ratio_max")


#: Requests, and what each is after in a first and in a later turn.
ASKED = [
    ("Вы делаете вывески", "consultation", "consultation"),
    ("Какой у вас график работы", "out_of_scope", "out_of_scope"),
    ("Оплата по безналу", "financial_modifier", "financial_modifier"),
    ("Сделайте визуализацию", "visualization", "visualization"),
    ("Дай смету", "empty_context_smeta", "empty_context_smeta"),
    ("Составь смету на эту вывеску", "referential", "general"),
    ("Для этого клиента под ключ", "referential", "bundle_query"),
    ("Почему у вас дороже", "objection_arguments", "objection_arguments"),
    ("Почему цена на баннер выше", "product_query", "product_query"),
    ("Какие вопросы задать", "discovery_assist", "discovery_assist"),
    ("Делаете ли стелы", "category_clarify", "category_clarify"),
    ("Делаете ли окна, сколько стоит", "general", "general"),
    ("Покажи примеры", "historical_request", "historical_request"),
    ("Клиент сомневается", "describe", "describe"),
    ("Что входит в работы", "bundle_query", "bundle_query"),
    ("Нужен логотип", "product_query", "product_query"),
    (" ", "underspec", "underspec"),
]


@query(
    f"""with o as (select o_orderkey as request_id, o_orderkey % {len(ASKED)} + 1 as i, o_custkey % 2 = 1 as later from orders),
n as (select request_id, case when later then ({_sql([a[2] for a in ASKED])})[i] else ({_sql([a[1] for a in ASKED])})[i] end as intent, ({_sql([a[0] for a in ASKED])})[i] as request from o)
select request_id, intent, coalesce(case when request like '%баннер%' then 0.85 end, case intent when 'underspec' then 0.99 when 'general' then 0.3 when 'bundle_query' then 0.85 when 'objection_arguments' then 0.92 when 'discovery_assist' then 0.92 when 'consultation' then 0.95 when 'out_of_scope' then 0.95
when 'financial_modifier' then 0.95 when 'empty_context_smeta' then 0.95 when 'product_query' then 0.95 else 0.9 end)::double as confidence, case when request like '%баннер%' then 'regex_hybrid' when intent = 'general' then 'default' else 'regex' end as source from n"""
)
def request_intents(spark, d):
    """Every order asks in one of the phrases above; orders of odd customers are later turns."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), _pick([a[0] for a in ASKED], F.col("o_orderkey")).alias("text"), (F.col("o_custkey") % 2 == 1).alias("later"))
    return o.select("request_id", A.request_intent(F.col("text"), F.col("later")).alias("i")).select("request_id", "i.*")


WANTED = ["буклеты", "брошюры", "каталог и буклет", "флагшток", "вывеска", "брандмауэр"]
OFFERED = ["листовки", "буклет с листовками", "флаеры", "каталог", "штендер", "объёмные буквы", "ручки"]
#: What of OFFERED is a mistake for each of WANTED, by place (1 to 7).
MISTAKES = [[1, 3], [1, 2, 3], [1, 3], [3, 5], [], [6]]


@query(
    f"""with r as (select distinct l_suppkey as query_id, l_partkey as doc_id from lineitem), m as (select query_id, doc_id, list_contains(({MISTAKES})[query_id % {len(WANTED)} + 1], doc_id % {len(OFFERED)} + 1) as wrong from r),
k as (select *, bool_or(not wrong) over (partition by query_id) as ok from m) select query_id, doc_id from k where not (wrong and ok)"""
)
def without_collisions(spark, d):
    """Suppliers ask, the parts that they ship are what is offered."""
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).distinct()
    rows = r.withColumn("request", _pick(WANTED, F.col("query_id"))).withColumn("text", _pick(OFFERED, F.col("doc_id")))
    return A.without_collisions(rows, "request", "text", ["query_id"]).select("query_id", "doc_id")


KINDS = ["bundle", "product", "faq", "knowledge", "roadmap", "historical_deal", "service_page", "offer_profile"]
INTENTS = ["smeta_request", "consultation", "out_of_scope", "historical_request", "category_clarify", "general"]
_ALLOWED = [["bundle", "offer_profile", "product", "historical_deal"], ["knowledge", "faq", "roadmap", "service_page"], ["knowledge", "faq"], ["historical_deal", "offer_profile"], ["service_page", "knowledge", "faq"], KINDS]
_MOST = [20, 20, 10, 20, 12, 20]


@query(
    f"""with l as (select o_custkey as query_id, l_partkey as doc_id, sum(l_quantity) as score from lineitem join orders on o_orderkey = l_orderkey group by 1, 2),
r as (select query_id, doc_id, score, query_id % 6 + 1 as i, ({_sql(KINDS)})[doc_id % 8 + 1] as doc_type, case when query_id % 3 > 0 then 60 end as height_cm, doc_id % 150 as h from l),
f as (select * from r where list_contains(({[list(a) for a in _ALLOWED]})[i], doc_type) and (i <> 1 or height_cm is null or h * 10 between height_cm * 7 and height_cm * 13)),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) select query_id, doc_id, doc_type, score, rank from k where rank <= ({_MOST})[i]"""
)
def strategy_results(spark, d):
    """Customers ask, the parts that they bought are scored by quantity."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = lines.groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_quantity").alias("score"))
    rows = r.select(
        "query_id", "doc_id", "score", _pick(INTENTS, F.col("query_id")).alias("intent"), _pick(KINDS, F.col("doc_id")).alias("doc_type"),
        F.when(F.col("query_id") % 3 > 0, 60).alias("height_cm"), F.pmod("doc_id", F.lit(150)).alias("letter_height_cm"),
    )
    return A.by_strategy(rows, 10).select("query_id", "doc_id", "doc_type", "score", "rank")


LESSONS = (
    retrieval.DENSE
    + """, bo as (select query_id, doc_id, round(score + case when label = ql then 0.1 else 0 end, 6) as score from sc),
le as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bo where score >= 0.45) where rank <= 3)
"""
)


def _lessons(spark, d):
    docs, queries = retrieval._vectors(spark, d)
    return A.boosted_lessons(dense_top_k(docs, queries, 3), dense_top_k(docs, queries, 3, group="label"))


@query(LESSONS + "select query_id, doc_id, score, rank from le")
def lesson_search(spark, d):
    return _lessons(spark, d)


@query(LESSONS + "select vec_id as doc_id, label, (vec_id % 3 + count(le.doc_id))::bigint as match_count from embeddings left join le on le.doc_id = vec_id group by vec_id, label")
def lesson_counts(spark, d):
    """Lessons start with a count by their id."""
    lessons = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", (F.col("vec_id") % 3).alias("match_count"))
    return A.with_match_counts(lessons, _lessons(spark, d))


@query(
    """with o as (select o_orderkey as order_id, floor(o_totalprice)::bigint as p, o_custkey % 4 as k from orders), t as (select *, 1000 + p % 9000 as q from o)
select order_id, list_sort(list_distinct(list_filter(case k when 3 then []::bigint[] else [p, q] end, lambda x: x >= 100))) as prices, (case k when 0 then case when p <= q then p else q end when 1 then q when 2 then p end)::double as low,
(case k when 0 then q when 1 then q when 2 then p end)::double as high from t"""
)
def quoted_prices(spark, d):
    """Orders quote their value, grouped by thousands, and a second price: as a range, a list, or not at all."""
    p, k = F.floor("o_totalprice").cast("long"), F.col("o_custkey") % 4
    many = F.replace(F.format_number(p, 0), F.lit(","), F.lit(" "))
    few = (1000 + p % 9000).cast("string")
    said = F.when(k == 0, F.concat(F.lit("Бюджет "), many, F.lit(" – "), few, F.lit(" руб. (итого "), many, F.lit(" руб)")))
    said = said.when(k == 1, F.concat(F.lit("доставка "), few, F.lit(" ₽, всего "), many, F.lit(" ₽"))).when(k == 2, F.concat(many, F.lit(" рублей и "), few, F.lit(" р.")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), said.otherwise(F.lit("без цены 12")).alias("t"))
    return o.select("order_id", quotes.price_list(F.col("t")).alias("prices"), quotes.price_range(F.col("t")).alias("r")).select("order_id", "prices", "r.low", "r.high")


@query(
    """with p as (select p_partkey as product_id, 100 + p_size as a, 1000 + p_size * 7 as b, p_partkey % 3 as k, p_name as n from part),
r as (select product_id, unnest(case k when 0 then [{'package': n, 'low': a, 'high': b}, {'package': 'Макс', 'low': b, 'high': b}] when 1 then [{'package': '', 'low': a, 'high': b}, {'package': '', 'low': b, 'high': b}] else [] end, recursive := true) from p)
select product_id, package, low::bigint as low, high::bigint as high from r"""
)
def package_offers(spark, d):
    """Catalogue texts that offer packages by name, prices alone, or nothing."""
    a, b, k = (100 + F.col("p_size")).cast("string"), (1000 + F.col("p_size") * 7).cast("string"), F.col("p_partkey") % 3
    named = F.concat(F.lit("Пакеты: «"), "p_name", F.lit("» ("), a, F.lit(" – "), b, F.lit(" руб.), «Макс» "), b, F.lit(" руб"))
    plain = F.concat(F.lit("Цена "), a, F.lit("-"), b, F.lit(" рублей, монтаж "), b, F.lit(" руб, наценка 20 руб"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.when(k == 0, named).when(k == 1, plain).otherwise(F.col("p_name")).alias("t"))
    return rows.select("product_id", F.inline(quotes.package_prices(F.col("t"))))


@query(
    """select p_partkey as product_id, case when p_size % 2 = 0 then least(p_size, 100)::bigint end as romi_min, case when p_size % 2 = 0 then greatest(p_size, 100)::bigint end as romi_max,
case when p_size % 3 = 0 then p_size::bigint end as roi_min, case when p_size % 3 = 0 then p_size::bigint end as roi_max, (case when p_size % 5 = 0 then 2.5 end)::double as conversion_min, (case when p_size % 5 = 0 then greatest(p_size, 2.5) end)::double as conversion_max from part"""
)
def stated_returns(spark, d):
    """Catalogue texts that state returns by size."""
    n = F.col("p_size")
    parts = [F.when(n % 2 == 0, F.concat(F.lit("ROMI от "), n, F.lit("%, ROMI составляет 100 %"))), F.when(n % 3 == 0, F.concat(F.lit("ROI ~"), n, F.lit("%"))), F.when(n % 5 == 0, F.concat(F.lit("конверсия 2,5%, CR до "), n, F.lit(" %")))]
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), quotes.returns(F.concat_ws("; ", *parts)).alias("r")).select("product_id", "r.*")


NAMES = ["лента мп", "плёнка кв.м", "короб м2", "набор компл", "импорт"]
SHOPS = ["Цех 2", "дизайн", "Офсетная печать", "Склад", ""]


@query(
    f"""select p_partkey as product_id, (['мп', 'кв.м', 'кв.м', 'компл', 'шт'])[p_partkey % 5 + 1] as unit, (['мп', 'кв.м', 'шт', 'мп', 'мп'])[p_partkey % 5 + 1] as loose_unit, (['Цех', 'Дизайн', 'Печатная', 'Склад', ''])[p_size % 5 + 1] as section,
case p_size % 5 when 4 then (['Цех', 'Сольвент', 'Цех'])[p_partkey % 3 + 1] else (['Цех', 'Сольвент', ({_sql(SHOPS)})[p_size % 5 + 1]])[p_partkey % 3 + 1] end as parent_section, (['Печатка', 'Цех', 'Дизайн'])[p_size % 3 + 1] || ', ' || case p_size when 8 then 'Печатка' when 10 then 'Цех' when 12 then 'Дизайн' when 14 then 'Аутсорсинг' else (100 + p_size)::varchar end as directions from part"""
)
def trade_labels(spark, d):
    """Units, sections and labels of ids for names of the trade, by catalogue id and size."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("long").alias("n"))
    name, shop, parent = _pick(NAMES, F.col("product_id")), _pick(SHOPS, F.col("n")), _pick(["Буквы", "Баннер", "Иное"], F.col("product_id"))
    known = F.get(F.array(F.lit(108), F.lit(110), F.lit(112)), F.pmod("n", F.lit(3)).cast("int")).cast("long")
    return p.select(
        "product_id", quotes.unit_of(name).alias("unit"), quotes.loose_unit_of(name).alias("loose_unit"), quotes.section_of(shop).alias("section"),
        quotes.parent_section(parent, shop).alias("parent_section"), quotes.decoded(F.array(known, F.col("n") + 100), quotes.DIRECTIONS).alias("directions"),
    )


@query(
    """with t as (select doc_id, lang, source, list_filter(string_split(replace(replace(replace(text, '#', ' '), chr(13), ' '), '. ', '.' || chr(10) || '## '), chr(10) || '## '), lambda x: true)[2:] as s from documents where text is not null),
c as (select doc_id, lang, source, list_filter(list_transform(s, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 50) as s from t)
select doc_id, unnest(range(len(s)))::integer as chunk, source as title, 'Шаг 1.' as section, lang as category, unnest(list_transform(s, lambda x: length(x)))::bigint as n from c where len(s) > 0"""
)
def roadmap_chunks(spark, d):
    """Documents as roadmaps: a head with source and language, and a section from every second sentence on."""
    text = F.replace(F.replace("text", F.lit("#"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    head = F.concat(F.lit("# **Дорожная карта услуги: "), "source", F.lit("**\n* **Категория:** "), "lang", F.lit("\\\n"))
    body = F.replace(text, F.lit(". "), F.lit(".\n## **Шаг 1\\.**\n"))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(head, body).alias("t"))
    out = chunks_of(docs, "doc_id", "t").filter("section <> 'Полный документ'")
    return out.select("doc_id", "chunk", "title", "section", "category", F.length("body").cast("long").alias("n"))


@query("select 'd' || label as direction, count(*) as lessons from embeddings where label > 0 group by 1")
def lessons_by_direction(spark, d):
    """Vectors as lessons; label 0 stands for a lesson without direction."""
    direction = F.when(F.col("label") > 0, F.concat(F.lit("d"), F.col("label").cast("string"))).otherwise("")
    return A.lessons_by_direction(table(spark, d, "embeddings").select(direction.alias("direction")))
