"""Queries of the text functions, chunkers, page readers, fuzzy joins and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions import numeric as N
from tallyforge.functions import text as X
from tallyforge.operators import texts as P
from tallyforge.operators.similarity import fuzzy_of, top_sharing
from tallyforge.sources.roles import table
from tallyforge.streaming import events as S

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


TOK = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)"


@query(f"select doc_id, len(list_distinct({TOK.format('text')})) as distinct_tokens, len({TOK.format('text')}) as tokens from documents")
def token_counts(spark, d):
    t = F.col("text")
    n = X.all_tokens(F.regexp_replace(t, "_", " "))
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(t)).cast("long").alias("distinct_tokens"), F.size(n).cast("long").alias("tokens"))


@query("select p_partkey as product_id, substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) as slug, trim(regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) as plain, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as title from part")
def name_forms(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.plain_name(F.col("p_brand")).alias("plain"), X.title_words(F.col("p_name")).alias("title"))


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+')) as numbers, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: x::double)) as largest, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+'))) as addresses from documents")
def extracted_numbers(spark, d):
    n = X.numbers_in(F.col("text"), "([0-9]+)")
    return table(spark, d, "documents").select("doc_id", F.size(n).cast("long").alias("numbers"), F.array_max(n).alias("largest"), F.size(X.distinct_matches(F.col("text"), "[A-Za-z0-9._]+@[A-Za-z0-9.]+")).cast("long").alias("addresses"))


@query(
    """select doc_id, case when contains(lower(text), 'license') and not contains(lower(text), 'mit') then 'other_license' when contains(lower(text), 'mit license') then 'mit' when contains(lower(text), 'http') or contains(lower(text), '@') then 'contact' else 'plain' end as category,
array_to_string(list_filter([case when regexp_matches(text, '(?i)license') then 'license' end, case when regexp_matches(text, '@[a-z]') then 'address' end, case when regexp_matches(text, '[|]') then 'table' end], lambda x: x is not null), ',') as labels from documents"""
)
def rule_taxonomy(spark, d):
    t = F.col("text")
    rules = [(X.term_rule(t, all_of=("license",), none_of=("mit",)), "other_license"), (X.term_rule(t, all_of=("mit license",)), "mit"), (X.term_rule(t, any_of=("http", "@")), "contact")]
    found = X.labels(t, {"license": "(?i)license", "address": "@[a-z]", "table": "[|]"})
    return table(spark, d, "documents").select("doc_id", X.first_rule(rules, "plain").alias("category"), F.array_join(found, ",").alias("labels"))


@query("select doc_id, length(array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: not regexp_matches(s, '[0-9@]')), ' ')) as kept from documents")
def sentence_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.sentences_without(F.col("text"), "[0-9@]")).cast("long").alias("kept"))


@query("select doc_id, round(case when length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 then length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) else 0 end, 4) as ascii_share from documents")
def script_share(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.script_share(F.col("text"), "[A-Za-z]"), 4).alias("ascii_share"))


@query("select doc_id, i::int as chunk, length(trim(p, chr(10) || ' ')) as n from (select doc_id, unnest(range(0, len(ps))) as i, unnest(ps) as p from (select doc_id, string_split(text, chr(10) || '#') as ps from documents)) where length(trim(p, chr(10) || ' ')) >= 80")
def heading_chunks(spark, d):
    out = P.heading_chunks(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk", (F.length("body")).cast("long").alias("n"))


#: Lines of a document are taken one by one: i is the next line, s the first one of the chunk that is open.
PARAGRAPHS = """with recursive u as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as l from documents),
f(doc_id, i, s, done_from, done_to) as (
    select doc_id, 1, 1, 0, 0 from u where len(l) > 0
    union all
    select doc_id, i + 1, case when over and i - s > 2 then i - 2 when over then i else s end, case when over then s else 0 end, case when over then i - 1 else 0 end
    from (select f.*, i > s and list_sum(list_transform(l[s:i - 1], lambda x: length(x))) + (i - s) + length(l[i]) > 1000 as over from f join u using (doc_id) where i <= len(l))),
c as (select doc_id, done_from as a, done_to as b from f where done_to > 0 union all select f.doc_id, s, len(l) from f join u using (doc_id) where i = len(l) + 1)
select doc_id, (row_number() over (partition by doc_id order by a, b) - 1)::int as chunk, array_to_string(l[a:b], chr(10)) as body from c join u using (doc_id)"""


@query(PARAGRAPHS)
def paragraph_chunks(spark, d):
    return P.paragraph_chunks(table(spark, d, "documents"))


@query(PARAGRAPHS)
def paragraph_chunks_in_sql(spark, d):
    """The same rows from SQL, by the table function."""
    from tallyforge.functions.table_functions import register

    register(spark)
    return spark.sql("select doc_id, c.chunk, c.body from {docs}, lateral paragraph_chunks(text) c", docs=table(spark, d, "documents"))


@query(
    """with t as (select page_id, html, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as h1, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as tt from pages)
select page_id, case when h1 <> '' then h1 else tt end as title, len(list_distinct(regexp_extract_all(html, '(?i)<a[^>]+href="([^"]+)"', 1))) as links, len(regexp_extract_all(html, '(?i)<p[ >]')) as paragraphs from t"""
)
def page_fields(spark, d):
    return P.page_fields(table(spark, d, "pages")).select("page_id", "title", F.size("links").cast("long").alias("links"), "paragraphs")


_HTML = """case when page_id % 2 = 0 then regexp_replace(html, '(?is)<h1[^>]*>.*?</h1>', '', 'g') || '<meta property="og:title" content="Page ' || page_id || '">' else html end
    || case when page_id % 3 = 0 then '<img src="/assets/images/resources/' || page_id % 7 || '/smallwebp/ab12.webp"><img src="https://x.org/assets/images/resources/' || page_id % 7 || '/mediumwebp/cd.jpg"><img src="https://x.org/assets/images/resources/99/big/ef.png">' when page_id % 3 = 1 then '<meta content="https://x.org/' || page_id || '.png" property="og:image">' else '' end"""


@query(
    f"""with h as (select page_id, {_HTML} as html from pages), t as (select *, trim(regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)) as h1 from h)
select page_id, case when h1 <> '' then h1 when page_id % 2 = 0 then 'Page ' || page_id else '' end as title, case when page_id % 3 = 0 then 'https://x.org/assets/images/resources/' || page_id % 7 || '/mediumwebp/ab12.webp|https://x.org/assets/images/resources/99/big/ef.png' when page_id % 3 = 1 then 'https://x.org/' || page_id || '.png' else '' end as images from t"""
)
def page_media(spark, d):
    i = F.col("page_id").cast("string")
    seven = (F.col("page_id") % 7).cast("string")
    bare = F.regexp_replace("html", "(?is)<h1[^>]*>.*?</h1>", "")
    html = F.when(F.col("page_id") % 2 == 0, F.concat(bare, F.lit('<meta property="og:title" content="Page '), i, F.lit('">'))).otherwise(F.col("html"))
    sizes = F.concat(F.lit('<img src="/assets/images/resources/'), seven, F.lit('/smallwebp/ab12.webp"><img src="https://x.org/assets/images/resources/'), seven, F.lit('/mediumwebp/cd.jpg"><img src="https://x.org/assets/images/resources/99/big/ef.png">'))
    tail = F.when(F.col("page_id") % 3 == 0, sizes).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<meta content="https://x.org/'), i, F.lit('.png" property="og:image">'))).otherwise("")
    return P.page_media(table(spark, d, "pages").select("page_id", F.concat(html, tail).alias("html")), "https://x.org").withColumn("images", F.array_join("images", "|"))


@query("with p as (select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages), q as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p) select page_id, path, len(parts) as depth from q where len(parts) >= 2 and not list_contains(parts, 'fr')")
def deep_urls(spark, d):
    return P.deep_urls(table(spark, d, "pages"), 2, ["fr"]).select("page_id", "path", "depth")


@query("select p_partkey as product_id, p_name || ', direction: ' || p_type || ', price: ' || format('{:,.2f}', p_retailprice) || ', brand: ' || p_brand as searchable_text from part")
def product_documents(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), P.search_text(F.col("p_name"), F.col("p_type"), F.col("p_retailprice"), brand=F.col("p_brand")).alias("searchable_text"))


@query("select source, doc_id, length(text) as n from (select *, row_number() over (partition by source order by length(text) desc, doc_id) as rn from documents) where rn = 1")
def longest_versions(spark, d):
    return P.longest_version(table(spark, d, "documents"), "source", "text", "doc_id").select("source", "doc_id", F.length("text").cast("long").alias("n"))


@query("select 'text' as column, count(*) as rows, count(*) filter (trim(text) <> '') as filled, round(count(*) filter (trim(text) <> '') / count(*), 4) as share from documents union all select 'lang', count(*), count(lang), round(count(lang) / count(*), 4) from documents union all select 'source', count(*), count(source), round(count(source) / count(*), 4) from documents")
def field_fill(spark, d):
    return P.field_fill(table(spark, d, "documents"), ["text", "lang", "source"])


@query(
    f"""with a as (select s_suppkey as id, list_distinct({TOK.format("'supplier ' || s_name || ' nation ' || s_nationkey")}) as t from supplier), b as (select n_nationkey as nid, list_distinct({TOK.format("n_name || ' nation ' || n_nationkey")}) as u from nation),
p as (select id, nid, round(0.7 * len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) + 0.3 * len(list_intersect(t, u)) / least(len(t), len(u)), 4) as score from a, b where len(list_intersect(t, u)) > 0),
k as (select *, row_number() over (partition by id order by score desc, nid) as rn from p where score >= 0.2) select id, nid, score from k where rn = 1"""
)
def fuzzy_names(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.tokens(F.concat(F.lit("supplier "), "s_name", F.lit(" nation "), "s_nationkey")).alias("t"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nid"), X.tokens(F.concat("n_name", F.lit(" nation "), "n_nationkey")).alias("u"))
    found = top_sharing(s, n.withColumnRenamed("nid", "other"), lambda c, n, m: F.round(fuzzy_of(c, n, m), 4), 1).filter("score >= 0.2")
    return found.select("id", F.col("other").alias("nid"), "score")


@query("select o_custkey as key, round(case when min(o_totalprice) <= 0 then 0 else count(*) / sum(1 / o_totalprice) end, 4) as harmonic, list_sort(list(o_totalprice))[least(floor(count(*) * 0.5), count(*) - 1)::int + 1] as element, floor(avg(o_totalprice) + 0.5) as rounded from orders group by 1")
def named_means(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_totalprice").alias("v"), F.avg("o_totalprice").alias("a"))
    return o.select("key", F.round(N.harmonic_mean(F.col("v")), 4).alias("harmonic"), N.nth_quantile(F.col("v"), 0.5).alias("element"), N.round_half_up(F.col("a"), 0).alias("rounded"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def hourly_events(spark, d):
    return S.windowed(table(spark, d, "events"))


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as no from g) select user_id, min(ts) as start, count(*) as n, round(sum(value), 2) as total from s group by user_id, no")
def user_sessions(spark, d):
    return S.sessions(table(spark, d, "events"))


@query(
    """with e as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, coalesce(max(n) filter (event_type = 'view'), 0) as view, coalesce(max(n) filter (event_type = 'click'), 0) as click, coalesce(max(n) filter (event_type = 'purchase'), 0) as purchase from e group by 1"""
)
def event_pivot(spark, d):
    out = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1)))
    return out.fillna(0)


@query("select page_id, url, rank from (select page_id, url, row_number() over (order by length(html) desc, page_id) as rank from pages) where rank > 10 and rank <= 30")
def paged_list(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.length("html").alias("n")).orderBy(F.desc("n"), "page_id").limit(30)
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "page_id"))).filter("rank > 10").select("page_id", "url", "rank")  # 30 rows at most


_MARKED = "translate(p_name, 'aeo', 'äéo') || case when p_partkey % 2 = 0 then ' A' else ' á' end"


@query(
    f"""with n as (select p_brand as brand, p_partkey as id, {_MARKED} as name, 'P' || p_size || '-' || (p_partkey % 13 + 1) as code from part),
l as (select *, row_number() over (partition by brand order by strip_accents(lower(name)), id) as rank, regexp_extract(code, 'P([0-9]+)', 1)::int as k1, regexp_extract(code, '-([0-9]+)', 1)::int as k2 from n),
c as (select *, row_number() over (partition by brand order by k1, k2, id) as place from l)
select brand, id, name, code, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) as folded, rank, place from c where rank <= 3 or place <= 3"""
)
def ordered_names(spark, d):
    """Names of a brand by locale without case and marks, codes by the numbers in them: the first three of each."""
    marked = F.concat(F.translate("p_name", "aeo", "äéo"), F.when(F.col("p_partkey") % 2 == 0, " A").otherwise(" á"))
    code = F.concat(F.lit("P"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 13 + 1).cast("string"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), marked.alias("name"), code.alias("code"))
    by = W.partitionBy("brand")
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy(X.in_locale(F.col("name"), "UNICODE", "CI_AI"), "id")))
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(X.natural_key(F.col("code")), "id"))).filter("rank <= 3 or place <= 3")
    return rows.select("brand", "id", "name", "code", X.folded_name("name").alias("folded"), "rank", "place")
