"""Queries of the matching operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.text import labels, tokens
from tallyforge.operators import matching as M
from tallyforge.operators.similarity import edit_pairs, set_pairs
from tallyforge.operators.texts import heading_chunks
from tallyforge.sources.roles import table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_NAMES = """with l as (select distinct p_name as id, string_split(p_name, ' ') as t from part), r as (select distinct p_name || ' ' || lower(p_type) as other, string_split(p_name || ' ' || lower(p_type), ' ') as u from part)
"""


def _names(spark, d):
    p = table(spark, d, "part")
    left = p.select(F.col("p_name").alias("id")).distinct().withColumn("t", tokens(F.col("id")))
    right = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("other")).distinct().withColumn("u", tokens(F.col("other")))
    return left, right


@query(
    _NAMES
    + """, p as (select id, other, array_to_string(list_sort(list_intersect(t, u)), ' ') as c, trim(array_to_string(list_sort(list_intersect(t, u)), ' ') || ' ' || array_to_string(list_sort(list_filter(t, lambda x: not list_contains(u, x))), ' ')) as a,
    trim(array_to_string(list_sort(list_intersect(t, u)), ' ') || ' ' || array_to_string(list_sort(list_filter(u, lambda x: not list_contains(t, x))), ' ')) as b from l, r),
s as (select id, other, round(100 * greatest(1 - levenshtein(a, b) / greatest(length(a), length(b)), case when c <> '' then 1 - levenshtein(c, a) / greatest(length(c), length(a)) else 0 end, case when c <> '' then 1 - levenshtein(c, b) / greatest(length(c), length(b)) else 0 end), 2) as score from p),
k as (select *, row_number() over (partition by id order by score desc, other) as rank from s where score >= 76) select * from k where rank <= 3"""
)
def token_set_links(spark, d):
    return M.ratio_links(*_names(spark, d), 76, 3)


@query(
    _NAMES
    + """, p as (select id, other, 10 * len(list_filter(list_intersect(t, u), lambda x: x not in ('red', 'old'))) + len(list_intersect(t, u)) as score from l, r where len(list_intersect(t, u)) > 0),
k as (select *, row_number() over (partition by id order by score desc, other) as rn from p) select id, other, score from k where rn = 1"""
)
def noise_aware_links(spark, d):
    return M.noise_aware_match(*_names(spark, d), ("red", "old"))


@query(
    _NAMES
    + """, p as (select id, other, len(list_intersect(t, u)) as common, len(list_distinct(t)) as n, len(list_distinct(u)) as m from l, r where len(list_intersect(t, u)) > 0),
s as (select 'overlap' as kind, id, other, common, common / greatest(n, m) as v from p where 5 * common >= 3 * greatest(n, m) union all select 'jaccard', id, other, common, common / (n + m - common) from p where 2 * common >= n + m - common union all select 'containment', id, other, common, common / least(n, m) from p where common = least(n, m))
select kind, id, other, common::int as common, round(v, 6) as score from s"""
)
def set_links(spark, d):
    """Names whose token sets are near enough, by three measures."""
    left, right = _names(spark, d)
    out = None
    for kind, least in (("overlap", 0.6), ("jaccard", 0.5), ("containment", 1.0)):
        found = set_pairs(left, right, kind, least).select(F.lit(kind).alias("kind"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query("select c_custkey as id, s_suppkey as other, levenshtein(a, b)::int as edits from (select c_custkey, replace(c_name, 'Customer', '') || c_nationkey as a from customer), (select s_suppkey, replace(s_name, 'Supplier', '') || s_nationkey as b from supplier) where 10 * levenshtein(a, b) <= 2 * greatest(length(a), length(b))")
def edit_links(spark, d):
    """Customers and suppliers whose numbers are near enough by edits."""
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.replace("c_name", F.lit("Customer"), F.lit("")), F.col("c_nationkey").cast("string")).alias("a"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("other"), F.concat(F.replace("s_name", F.lit("Supplier"), F.lit("")), F.col("s_nationkey").cast("string")).alias("b"))
    return edit_pairs(left, right, "a", "b", 0.8).select("id", "other", "edits")


@query("select event_id, json_extract_string(props, '$.k') as value from events")
def unwrapped_values(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", M.unwrapped(F.concat(F.lit('[{"value": '), F.get_json_object("props", "$.k"), F.lit("}]"))).alias("value"))


@query("with s as (select contains(lower(text), 'the') as a, length(text) % 2 = 0 as b from documents) select count(*) filter (a and b) as both, count(*) filter (a and not b) as only_old, count(*) filter (not a and b) as only_new, count(*) filter (not a and not b) as neither from s")
def citation_table(spark, d):
    docs = table(spark, d, "documents")
    return M.two_by_two(docs, F.lower("text").contains("the"), F.length("text") % 2 == 0)


@query(
    """with m as (select case when regexp_matches(lower(p_name), 'bolt|gear') then 'metal' when regexp_matches(lower(p_name), 'red') then 'colour' else p_type end as label, p_name as text from part), u as (select distinct label, text from m),
k as (select *, row_number() over (partition by label order by text) as rank from u) select label, text, rank from k where rank <= 5"""
)
def rebalanced_labels(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("text"))
    return M.rebalanced(p, [("bolt|gear", "metal"), ("red", "colour")], "text", "label", 5).select("label", "text", "rank")


@query("select doc_id, array_to_string(list_filter([case when regexp_matches(lower(text), 'license') then 'legal' end, case when regexp_matches(lower(text), '[|]') then 'table' end, case when regexp_matches(lower(text), '[0-9]{4}') then 'figures' end], lambda x: x is not null), '|') as topics, case when regexp_matches(lower(text), 'license') then 'terms' when regexp_matches(lower(text), '[|]') then 'columns' when regexp_matches(lower(text), '[0-9]{4}') then 'numbers' else 'text' end as schema_block from documents")
def topic_schemas(spark, d):
    t = labels(F.lower("text"), {"legal": "license", "table": "[|]", "figures": "[0-9]{4}"})
    block = F.create_map(*[F.lit(x) for x in ("legal", "terms", "table", "columns", "figures", "numbers")])
    return table(spark, d, "documents").select("doc_id", F.array_join(t, "|").alias("topics"), F.coalesce(F.try_element_at(block, F.get(t, 0)), F.lit("text")).alias("schema_block"))


@query()
def chunk_fields(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.concat(F.lit("# Price\n"), "text", F.lit("\n## Terms\n"), "text"))
    return M.section_fallback(heading_chunks(docs, "doc_id", "text"), "doc_id", {"price": "price", "terms": "terms"}).select("doc_id", "chunk", "title", F.length("price").alias("price"), F.length("terms").alias("terms"))
