"""Queries of the retrieval operators, on documents, embeddings and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import dense_index, sparse_index
from tallyforge.operators import retrieval as R
from tallyforge.operators.windows import keep_if_any, merge_tiers
from tallyforge.sources.files import upsert_index, uuid5
from tallyforge.sources.roles import table
from tallyforge.sources.stored import scratch

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sparse(spark, d, k):
    return R.sparse_top_k(table(spark, d, "documents").select("doc_id", "text"), _asked(spark, d), k)


SPARSE = """with dt as (select doc_id, token, count(*) as tf from (select doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) as token from documents) group by 1, 2),
qt as (select query_id, token, count(*) as qtf from (select item_id as query_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) as token from benchmark) group by 1, 2),
idf as (select token, ln(1 + ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)) as idf from dt group by 1),
sc as (select query_id, doc_id, round(sum(qtf * tf * idf), 6) as score from dt join idf using (token) join qt using (token) group by 1, 2),
sp as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc)
"""
DENSE = """with qv as (select vec_id as query_id, embedding as q, label as ql from embeddings where vec_id % 100 = 0),
sc as (select query_id, vec_id as doc_id, label, ql, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as score from qv, embeddings),
de as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc)
"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return e, e.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


@query(SPARSE + "select query_id, doc_id, score, rank from sp where rank <= 20")
def sparse_search(spark, d):
    return _sparse(spark, d, 20)


@query(DENSE + "select query_id, doc_id, score, rank from de where rank <= 10")
def dense_search(spark, d):
    docs, queries = _vectors(spark, d)
    return R.dense_top_k(docs, queries.drop("label"), 10)


@query(SPARSE + "select query_id, doc_id, score, rank from sp where rank <= 20")
def posting_search(spark, d):
    """The same rows as sparse_search from stored posting lists, whose blocks are skipped by their bounds."""
    path = scratch(spark, "postings")
    docs = table(spark, d, "documents").select("doc_id", "text")
    sparse_index.build(sparse_index.with_sparse(docs), path, ids=docs)
    return sparse_index.search(spark, path, sparse_index.with_sparse(_asked(spark, d)), 20)[0]


@query("select doc_id, lower(md5(text)) as digest from documents where doc_id is not null")
def keyed_upserts(spark, d):
    """Documents put into a keyed table in two turns; the second replaces what the first had wrong."""
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", uuid5(F.concat(F.lit("doc-"), "doc_id")).alias("key"), F.md5("text").alias("digest"))
    path = scratch(spark, "keyed")
    upsert_index(docs.withColumn("digest", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("digest"))).withColumn("version", F.lit(1)), path, "key", "version", 16)
    upsert_index(docs.filter("doc_id % 3 = 0").withColumn("version", F.lit(2)), path, "key", "version", 16)
    return spark.read.parquet(path).select("doc_id", "digest")


def _cells(spark, d, exact):
    docs, queries = _vectors(spark, d)
    path = scratch(spark, "cells")
    dense_index.build(docs, path)
    # these vectors have no clusters: four fifths of the cells hold 0.95 of the best
    probes = -(-4 * spark.read.parquet(f"{path}/centres").count() // 5)
    return dense_index.search(spark, path, queries, 10, probes=8 if exact else probes, exact=exact)


@query(DENSE + "select query_id, doc_id, score, rank from de where rank <= 10")
def cell_search_exact(spark, d):
    """The same rows as dense_search from an inverted-file index, whose cells are ruled out by angles."""
    return _cells(spark, d, True)


@query()
def cell_search(spark, d):
    """The nearest cells of each query; tests/test_dense_index.py measures the recall."""
    return _cells(spark, d, False)


@query(DENSE + ", f as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from sc where label = ql) select query_id, doc_id, score, r as rank from f where r <= 5")
def dense_search_filtered(spark, d):
    docs, queries = _vectors(spark, d)
    return R.dense_top_k(docs, queries, 5, group="label")


HYBRID = (
    SPARSE
    + """, q2 as (select doc_id as query_id, text from documents where doc_id % 100 = 0 and doc_id < (select count(*) from embeddings)),
t2 as (select query_id, token, count(*) as qtf from (select query_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) as token from q2) group by 1, 2),
s2 as (select query_id, doc_id, round(sum(qtf * tf * idf), 6) as score from dt join idf using (token) join t2 using (token) group by 1, 2),
r2 as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from s2),
qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
d2 as (select query_id, vec_id as doc_id, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as score from qv, embeddings),
r3 as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from d2),
fu as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 8) as score from (select * from r2 where rank <= 20 union all select * from r3 where rank <= 20) group by 1, 2),
fr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fu)
"""
)


def _hybrid(spark, d, k):
    docs, queries = _vectors(spark, d)
    texts = table(spark, d, "documents").select("doc_id", "text")
    asked = texts.join(queries.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    return R.fuse([R.sparse_top_k(texts, asked, 20), R.dense_top_k(docs, queries.drop("label"), 20)], k)


@query(HYBRID + "select query_id, doc_id, score, rank from fr where rank <= 10")
def hybrid_search(spark, d):
    return _hybrid(spark, d, 10)


@query(
    HYBRID
    + """, b as (select query_id, fr.doc_id, round(score + case when d1.lang = d0.lang then 0.1 else 0 end + case when d1.source = d0.source then 0.05 else 0 end, 6) as score from fr join documents d1 on d1.doc_id = fr.doc_id join documents d0 on d0.doc_id = query_id where rank <= 10)
select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b"""
)
def boosted_search(spark, d):
    meta = table(spark, d, "documents").select("doc_id", "lang", "source")
    res = _hybrid(spark, d, 10).join(meta, "doc_id").join(meta.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("ql"), F.col("source").alias("qs")), "query_id")
    return R.boosted(res, [(F.col("lang") == F.col("ql"), 0.1), (F.col("source") == F.col("qs"), 0.05)]).select("query_id", "doc_id", "score", "rank")


@query(SPARSE + ", x as (select sp.*, lang from sp join documents using (doc_id) where rank <= 20), h as (select *, max((lang = 'de' and score > 40)::int) over (partition by query_id) as hit from x) select query_id, doc_id, rank from h where (hit = 1 and lang = 'de' and score > 40) or (hit = 0 and rank <= 3)")
def filtered_with_fallback(spark, d):
    res = _sparse(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return keep_if_any(res, ["query_id"], (F.col("lang") == "de") & (F.col("score") > 40), F.col("rank"), 3).select("query_id", "doc_id", "rank")


@query(SPARSE + ", x as (select sp.*, substr(trim(text), 1, 120) as mark from sp join documents using (doc_id) where rank <= 20), k as (select *, row_number() over (partition by query_id, mark order by score desc, doc_id) as rn from x) select query_id, doc_id, score from k where rn = 1 or mark = ''")
def fingerprint_dedup(spark, d):
    res = _sparse(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.unique_texts(res, "text").select("query_id", "doc_id", "score")


@query(
    SPARSE
    + """, a as (select query_id, doc_id, score, 0 as tier from (select sp.*, row_number() over (partition by query_id order by score desc, sp.doc_id) as r from sp join documents using (doc_id) where lang = 'en') where r <= 5),
b as (select query_id, doc_id, score, 1 as tier from sp where rank <= 5), u as (select *, row_number() over (partition by query_id, doc_id order by tier, score desc) as rn from (select * from a union all select * from b))
select query_id, doc_id, score, tier from u where rn = 1"""
)
def tiered_search(spark, d):
    docs = table(spark, d, "documents")
    texts, cols = docs.select("doc_id", "text"), ["query_id", "doc_id", "score"]
    # both tiers weigh tokens by the whole corpus
    first = R.sparse_top_k(docs.filter("lang = 'en'").select("doc_id", "text"), _asked(spark, d), 5, corpus=texts)
    second = R.sparse_top_k(texts, _asked(spark, d), 5)
    return merge_tiers([first.select(*cols), second.select(*cols)], ["query_id", "doc_id"], [F.desc("score")]).select(*cols, "tier")


@query(DENSE + ", k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from sc where doc_id % 100 <> 0) select query_id, case when score >= 0.5 then label end as label, score from k where r = 1")
def prototype_labels(spark, d):
    docs, queries = _vectors(spark, d)
    return R.nearest_label(queries.drop("label"), docs.filter("doc_id % 100 <> 0"), 0.5)


@query(
    DENSE
    + """, n as (select label, count(*) as n from embeddings group by 1), b as (select query_id, doc_id, round(score * ((1 + 0.15 * log10(greatest(n, 1))) * case when n < 10 then 0.85 else 1.0 end), 6) as biased from de join n using (label)),
k as (select *, row_number() over (partition by query_id order by biased desc, doc_id) as rank from b) select * from k where rank <= 3"""
)
def volume_biased_search(spark, d):
    docs, queries = _vectors(spark, d)
    return R.volume_biased(docs, queries.drop("label"), "label", 3)


@query()
def diversified_search(spark, d):
    res = _sparse(spark, d, 60).join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("doc_type")), "doc_id")
    return R.diversified(res, 8, "en", 3, ["de", "es", "fr"])


@query(
    """with q as (select item_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: x::double) as p from benchmark), r as (select list(n_nationkey::double + 1 order by n_nationkey) as refs from nation)
select item_id, len(p) as stated, round(case when len(p) = 0 then 1.0 else len(list_filter(p, lambda x: len(list_filter(refs, lambda y: abs(x - y) / y <= 0.05)) > 0)) / len(p) end, 4) as share from q, r"""
)
def price_grounding(spark, d):
    from tallyforge.functions.text import numbers_in

    refs = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("double") + 1)).alias("refs"))
    rows = table(spark, d, "benchmark").select("item_id", numbers_in(F.col("text"), "([0-9]+)").alias("p")).join(F.broadcast(refs))
    return rows.select("item_id", F.size("p").cast("long").alias("stated"), F.round(R.grounded(F.col("p"), F.col("refs")), 4).alias("share"))
