"""Queries of the document builders, request understanding and the rest of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import dialogs as D
from tallyforge.operators import documents as B
from tallyforge.operators import evaluation as E
from tallyforge.operators import sales as S
from tallyforge.operators import texts as P
from tallyforge.plans.retrieval import SPARSE, _sparse
from tallyforge.plans.sales import DEALS, LINES, narrow_deals, shared_deals
from tallyforge.plans.sales import O as SALES
from tallyforge.sources.roles import lines, table
from tallyforge.sources.stored import stored

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_DOC = """, r as (select * from lines where dataset = '{0}'), a as (select deal_id, count(*) as lines, round(sum(line_total), 2) as total from r group by 1 having count(*) >= 2),
n as (select *, row_number() over (partition by deal_id order by first) as rank from (select deal_id, product_name, min(line) as first from r group by 1, 2)), nl as (select deal_id, string_agg(product_name, ', ' order by rank) as products from n where rank <= 30 group by 1),
s as (select *, row_number() over (partition by deal_id order by t desc, section) as rank from (select deal_id, section, round(sum(line_total), 2) as t from r group by 1, 2)), sl as (select deal_id, string_agg(section, '|' order by rank) as sections from s where rank <= 3 group by 1)
select deal_id, lines, total, products, sections, 'products: ' || products || ' | sections: ' || sections || ' | total: ' || format('{{:,.2f}}', total) as searchable_text from a join nl using (deal_id) join sl using (deal_id)"""


@query(LINES + _DOC.format("orders"))
def historical_documents(spark, d):
    return B.deal_documents(lines(spark, d), "orders")


@query(LINES + _DOC.format("offers"))
def offer_compositions(spark, d):
    return B.deal_documents(lines(spark, d), "offers")


@query(
    DEALS
    + """, t as (select 'timeline:' || primary_direction as doc_id, 'timeline' as doc_type, 'typical days: ' || coalesce(floor(median(duration_days) + 0.5)::bigint::varchar, 'unknown') as searchable_text from deals group by primary_direction),
k as (select 'kpi:' || dataset as doc_id, 'kpi' as doc_type, 'deals: ' || count(*) || ', value: ' || format('{:,.2f}', round(sum(line_total), 2)) as searchable_text from deals group by dataset),
u as (select * from t union all select * from k) select *, case doc_type when 'timeline' then 'How long work takes (' || doc_id || ').' else 'Figures of ' || doc_id || '.' end || chr(10) || searchable_text as contextual_text from u"""
)
def fact_documents(spark, d):
    deals = narrow_deals(spark, d, "dataset", "primary_direction", "duration_days", "line_total")
    # both kinds of documents build on these few rows
    per = stored(deals.groupBy("dataset", "primary_direction", "duration_days").agg(F.count(F.lit(1)).alias("n"), F.sum("line_total").alias("v")), "durations")
    t = per.groupBy("primary_direction").agg(F.floor(F.percentile("duration_days", F.lit(0.5), F.col("n")) + 0.5).cast("long").alias("m"))
    t = B.as_documents(t, "timeline", F.col("primary_direction"), F.concat(F.lit("typical days: "), F.coalesce(F.col("m").cast("string"), F.lit("unknown"))))
    k = per.groupBy("dataset").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v"))
    k = B.as_documents(k, "kpi", F.col("dataset"), F.concat(F.lit("deals: "), F.col("n").cast("string"), F.lit(", value: "), F.format_number("v", 2)))
    return B.with_context(t.unionByName(k), {"timeline": "How long work takes (%s).", "kpi": "Figures of %s."})


@query(SPARSE + ", x as (select query_id, rank, '[' || rank || '] ' || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 200) as line from sp join documents using (doc_id) where rank <= 12) select query_id, string_agg(line, chr(10) order by rank) as context, count(*) as documents from x group by 1")
def context_blocks(spark, d):
    return B.context_blocks(_sparse(spark, d, 12), table(spark, d, "documents").select("doc_id", "text"))


@query("select page_id, len(list_distinct(list_concat(case when page_id % 2 = 0 then ['/home', '/The'] else [] end, regexp_extract_all(html, '(?i)<a[^>]+href=\"([^\"]+)\"', 1)))) as links from pages")
def merged_page_links(spark, d):
    pages = P.page_fields(table(spark, d, "pages")).select("page_id", "links")
    extra = pages.filter("page_id % 2 = 0").select("page_id", F.array(F.lit("/home"), F.lit("/The")).alias("links"))
    return B.merged_lists(pages, extra, "page_id", "links").select("page_id", F.size("links").alias("links"))


@query(DEALS + "select deal_id, dataset, case when line_count >= 5 and len(string_split(sections, '|')) >= 3 then 'full' when line_count >= 3 and unique_products >= 2 then 'partial' else 'bare' end as completeness from deals")
def deal_completeness(spark, d):
    deals = S.deal_facts(lines(spark, d))
    return deals.select("deal_id", "dataset", B.completeness(F.col("line_count"), F.size(F.split("sections", r"\|")), F.col("unique_products")).alias("completeness"))


@query(
    SPARSE
    + """, f as (select item_id as query_id, item_id * 3 as doc_id from benchmark), m as (select query_id, max(score) as m from sp where rank <= 5 group by 1),
e as (select query_id, doc_id, score from sp where rank <= 5 union all select f.query_id, f.doc_id, coalesce(m, 0) + 0.01 from f left join m using (query_id)), g as (select query_id, doc_id, round(max(score), 6) as score from e group by 1, 2)
select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from g"""
)
def injected_results(spark, d):
    forced = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).alias("doc_id"))
    return B.injected(_sparse(spark, d, 5), forced)


_RULES = [("greeting", "^(the|le|la|der) ", False), ("follow_up", "(^| )(and|et|und|y) ", True), ("price", "[0-9]+", False)]


@query(
    "with m as (select conv_id, turn, lower(text) as t, turn > 0 as h from conversations where role = 'user') select conv_id, turn, case when regexp_matches(t, '^(the|le|la|der) ') then 'greeting' when regexp_matches(t, '(^| )(and|et|und|y) ') and h then 'follow_up' when regexp_matches(t, '[0-9]+') then 'price' else 'general' end as intent, regexp_matches(t, '[?]') as asks, regexp_matches(t, 'http|@') as links from m"
)
def turn_intents(spark, d):
    m = table(spark, d, "conversations").filter("role = 'user'")
    p = D.predicates(F.col("text"), {"asks": "[?]", "links": "http|@"})
    return m.select("conv_id", "turn", D.intent(F.col("text"), _RULES, F.col("turn") > 0).alias("intent"), *[c.alias(k) for k, c in p.items()])


_PARTS = {"face": ("red|blue", ("frame",)), "frame": ("bolt|gear", ()), "light": ("hot", ("frame", "power")), "power": ("ring", ())}


@query(
    """with t as (select p_partkey as request_id, lower(p_name) as t from part), n as (select request_id, list_distinct(flatten([case when regexp_matches(t, 'red|blue') then ['face', 'frame'] else [] end, case when regexp_matches(t, 'bolt|gear') then ['frame'] else [] end,
case when regexp_matches(t, 'hot') then ['light', 'frame', 'power'] else [] end, case when regexp_matches(t, 'ring') then ['power'] else [] end])) as c from t), u as (select request_id, unnest(c) as component from n) select request_id, component, list_position(['face', 'frame', 'light', 'power'], component) as place from u"""
)
def request_components(spark, d):
    return D.components(table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("text")), _PARTS)


@query("select p_partkey as id, round(length(p_name) * p_size / 100.0::double * 0.65::double + 1e-9, 2) as metres, case when not p_size > 10 then 'size' when not length(p_name) > 9 then 'text' end as ask from part")
def request_gaps(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), D.linear_metres(F.length("p_name"), F.col("p_size")).alias("metres"), D.next_question({"size": F.col("p_size") > 10, "text": F.length("p_name") > 9}).alias("ask"))


@query(
    """with x as (select p_partkey as id, case when p_size > 25 then p_retailprice * 1.1 end as template, case when p_partkey % 3 = 0 then p_retailprice * 0.9 end as deal, p_retailprice as base from part)
select id, case when template is not null and base > 940 then 'template' when deal is not null then 'deal' when base > 960 then 'catalogue' else 'manual' end as source,
round(case when template is not null and base > 940 then template when deal is not null then deal when base > 960 then base end + 1e-9, 2) as price,
array_to_string(list_filter([case when not base > 940 then 'no_template' end, case when not base > 960 then 'no_catalogue' end], lambda v: v is not null), '|') as flags, coalesce(abs(coalesce(template, deal) - base) / base > 0.095, false) as drifts from x"""
)
def gate_cascade(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_retailprice") * 1.1).alias("template"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") * 0.9).alias("deal"), F.col("p_retailprice").alias("base"))
    f = D.final_price([("template", F.col("base") > 940, F.col("template")), ("deal", F.lit(True), F.col("deal")), ("catalogue", F.col("base") > 960, F.col("base"))])
    return x.select("id", f["source"].alias("source"), F.round(f["price"] + 1e-9, 2).alias("price"), f["flags"].alias("flags"), D.drifts(F.coalesce("template", "deal"), F.col("base"), 0.095).alias("drifts"))


@query(
    """with s as (select lang, lower(text) as t, 1 + toxic as sv from documents join labels using (doc_id)), e as (select lang, sv, unnest(list_filter([case when regexp_matches(t, '[0-9]') then 'numbers' end, case when regexp_matches(t, '@') then 'contact' end, case when regexp_matches(t, '[|]') then 'table' end], lambda x: x is not null)) as critique from s)
select lang, critique, count(*) as n, sum(sv)::bigint as severity from e group by 1, 2"""
)
def critique_clusters(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return E.critiques(rows, "text", {"numbers": "[0-9]", "contact": "@", "table": "[|]"}, "lang", 1 + F.col("toxic"))


@query("select item_id, array_to_string(list_filter([case when not contains(lower(text), 'the') then 'missing:the' end, case when contains(lower(text), 'http') then 'forbidden:http' end, case when not (contains(lower(text), 'and') or contains(lower(text), 'of')) then 'none_of_any' end], lambda x: x is not null), ',') as failed from benchmark")
def phrase_grading(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(E.phrase_failures(F.col("text"), ["the"], ["and", "of"], ["http"]), ",").alias("failed"))


@query(SPARSE + ", l as (select query_id, doc_id, max(case when score > 100 then 1.0::double when score > 50 then 0.6::double else 0.2::double end) as label from sp where rank <= 20 group by 1, 2), k as (select *, row_number() over (partition by query_id order by label desc, doc_id) as rank from l where label >= 0.5) select * from k where rank <= 5")
def training_pairs(spark, d):
    rows = _sparse(spark, d, 20).drop("rank")
    return E.labelled_pairs(rows, F.when(F.col("score") > 100, 1.0).when(F.col("score") > 50, 0.6).otherwise(0.2), 0.5, 5)


@query(
    """with p as (select doc_id, coalesce(source, '') as q, coalesce(text, '') as t from documents), k as (select *, row_number() over (partition by left(q, 200), left(t, 200) order by doc_id) as rn from p)
select doc_id, q as query, length(t) as n from k where rn = 1"""
)
def distinct_text_pairs(spark, d):
    """A source and a text as a pair; copies, and texts that go on differently after 200 characters, once."""
    pairs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("passage"))
    return E.distinct_pairs(pairs, "query", "passage", ["doc_id"]).select("doc_id", "query", F.length("passage").cast("long").alias("n"))


@query("select a as artefact, r as rows, l as least, r >= l as ok from (select 'part' as a, (select count(*) from part) as r, 100::bigint as l union all select 'orders', (select count(*) from orders), 1000000000 union all select 'none', 0, 1)")
def artefact_gates(spark, d):
    counts = None
    for t in ("part", "orders"):
        c = table(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("artefact"), "rows")
        counts = c if counts is None else counts.unionByName(c)
    return E.artefact_gates(counts, {"part": 100, "orders": 1_000_000_000, "none": 1})


@query("select doc_id, case when doc_id % 4 = 1 then 'old' else upper(lang) end as result from documents")
def resumed_work(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    done = docs.filter("doc_id % 2 = 1").select("doc_id", F.when(F.col("doc_id") % 4 == 1, "old").alias("result"))
    return E.resumed(docs, done, "doc_id", F.upper("lang"))


@query("select event_type, round(avg(value), 1) as mean, count(*) as n from events group by 1")
def mean_by_direction(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("select n_nationkey as id, case n_regionkey when 0 then 'south' when 1 then 'west' else 'other' end as region, n_name || coalesce(' / ' || r_name, '') as path from nation left join region on n_regionkey = r_regionkey")
def section_paths(spark, d):
    """Ids decoded by a map literal, and a section's path by a lookup of its parent."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    code = F.create_map(*[F.lit(x) for x in (0, "south", 1, "west")])
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("n_nationkey").alias("id"), F.coalesce(F.try_element_at(code, "n_regionkey"), F.lit("other")).alias("region"), F.concat("n_name", F.coalesce(F.concat(F.lit(" / "), "r_name"), F.lit(""))).alias("path"))


@query()
def embedded_search(spark, d):
    """Documents and items embedded without a model, then searched by cosine."""
    from tallyforge.operators.retrieval import dense_top_k

    docs = B.hashed_embeddings(table(spark, d, "documents"))
    items = B.hashed_embeddings(table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")).withColumnRenamed("doc_id", "query_id")
    return dense_top_k(docs, items, 5)


@query(
    DEALS
    + """, b as (select dataset, bundle_key, max(unique_products) as pc, count(*) as n, round(median(line_total) filter (payment <> 'barter') + 1e-9, 2) as med from deals group by 1, 2),
un as (select bundle_key, len(product_keys) as k, unnest(product_keys) as product from (select distinct bundle_key, product_keys from deals where dataset = 'offers')), oi as (select deal_id, unnest(product_keys) as product from deals where dataset = 'orders'),
hit as (select bundle_key, deal_id from un join oi using (product) group by bundle_key, deal_id, k having count(*) = k), cn as (select bundle_key, count(*) as c from hit group by 1)
select 'bundle:' || dataset || ':' || bundle_key as doc_id, 'bundle' as doc_type, 'products: ' || pc || ' | deals: ' || n || coalesce(' | median: ' || format('{:,.2f}', med), '') || case when c > 0 then ' | contained in orders: ' || c else '' end as searchable_text from b left join cn using (bundle_key)"""
)
def bundle_documents(spark, d):
    deals = shared_deals(spark, d)
    return B.bundle_documents(S.bundle_facts(deals), S.template_matches(deals))


@query(f"select 'deal_profile:' || deal_id as doc_id, 'deal_profile' as doc_type, 'direction: ' || primary_direction || chr(10) || 'shares: ' || direction_breakdown || chr(10) || 'parts: ' || substr(components, 1, 500) as searchable_text from ({SALES['deal_profiles']})")
def profile_documents(spark, d):
    return B.profile_documents(S.deal_profiles(lines(spark, d), shared_deals(spark, d)))


@query()
def marker_chunks(spark, d):
    return B.marker_chunks(table(spark, d, "documents"), r"^[A-Z][a-z]+ ")
