"""Sparse, dense and fused retrieval for a set of queries over a corpus, filters, boosts and slots.

A query set is stated by the caller and small beside the corpus; each operator answers all of its
queries in one plan. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions.text import all_tokens
from tallyforge.operators.windows import top_n
from tallyforge.sources.stored import stored

QUERY_BLOCK = 4096
CELLS = 1 << 21
BROADCAST_TOKENS = 1_000_000


def sparse_vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): term frequencies of a text."""
    return docs.select(key, F.explode(all_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def _weights(queries: DataFrame, corpus: DataFrame, text: str) -> DataFrame:
    """(query_id, token, w): term frequency times inverse document frequency in the corpus. Only tokens
    of queries leave the scan, which counts them map-side."""
    q = stored(sparse_vectors(queries, "query_id", text), "terms")
    used = stored(q.select("token").distinct(), "tokens")
    if used.count() <= BROADCAST_TOKENS:
        used = F.broadcast(used)
    df = corpus.select(F.explode(F.array_distinct(all_tokens(F.col(text)))).alias("token")).join(used, "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.count()
    return q.join(df, "token").select("query_id", "token", (F.col("tf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, text: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by the dot product of term frequencies and inverse document
    frequencies (of corpus, docs where not given), exactly.

    Queries are taken in blocks of QUERY_BLOCK by hash. A document is scored where it lies, against the
    block's tokens; each partition keeps k of each query, so a common token costs no shuffle.
    """
    weights = stored(_weights(queries, docs if corpus is None else corpus, text), "weights")
    parts = max(1, -(-queries.count() // (QUERY_BLOCK // 2)))
    rows, out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), all_tokens(F.col(text)).alias("tokens")), None
    for part in range(parts):
        block = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        if not block.num_rows:
            continue
        ids, at = np.unique(block.column("query_id").to_numpy(), return_inverse=True)
        words, w = block.column("token").to_pylist(), block.column("w").to_numpy()
        index: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            index.setdefault(word, []).append(i)
        shared = docs.sparkSession.sparkContext.broadcast((ids, {word: (at[i], w[i]) for word, i in index.items()}))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            best_s, best_d = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            step = max(1, min(1024, CELLS // len(ids)))
            for whole in batches:
                for first in range(0, whole.num_rows, step):
                    b = whole.slice(first, step)
                    s = np.zeros((b.num_rows, len(ids)))
                    row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().fill_null(0).to_numpy())
                    coded = b.column(1).flatten().dictionary_encode()
                    known = [index.get(t) for t in coded.dictionary.to_pylist()]
                    code = coded.indices.to_numpy().astype(np.int64)
                    hit = np.flatnonzero(np.array([x is not None for x in known], bool)[code]) if len(code) else code
                    # times of each token in each row, by token
                    seen, times = np.unique(code[hit] * b.num_rows + row[hit], return_counts=True)
                    token, docs_of = np.divmod(seen, b.num_rows)
                    ends = np.flatnonzero(np.diff(token)) + 1
                    for lo, hi in zip((0, *ends), (*ends, len(token)), strict=True) if len(token) else ():
                        at, w = known[token[lo]]
                        s[docs_of[lo:hi, None], at] += times[lo:hi, None] * w
                    best_s, best_d = _merged(best_s, best_d, s, b.column(0).to_numpy())
            ok = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1]).reshape(best_s.shape)[ok]), pa.array(best_d[ok]), pa.array(best_s[ok])], names=["query_id", "doc_id", "score"])

        found = rows.mapInArrow(task, "query_id bigint, doc_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return top_n(out, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _best_of(s: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest entries of each row by score, then by the smaller document."""
    order = np.lexsort((d, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)


def _merged(best_s: np.ndarray, best_d: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of each query (rows of best_s, best_d) after documents d with scores s (documents by queries)
    have been seen: scores above 0, rounded to six digits. Only what reaches a query's last score is sorted."""
    n, k = best_s.shape
    doc, query = np.nonzero(s >= np.maximum(best_s[:, -1] - 1e-6, np.nextafter(0, 1)))
    if not len(doc):
        return best_s, best_d
    some, place = np.unique(query, return_inverse=True)
    row = np.concatenate((np.repeat(np.arange(len(some)), k), place))
    score = np.concatenate((best_s[some].ravel(), np.round(s[doc, query], 6)))
    ids = np.concatenate((best_d[some].ravel(), d[doc]))
    order = np.lexsort((ids, -score, row))
    first = np.searchsorted(row[order], np.arange(len(some)))
    order = order[first[:, None] + np.arange(k)]
    best_s, best_d = best_s.copy(), best_d.copy()
    best_s[some], best_d[some] = score[order], ids[order]
    return best_s, best_d


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, group: str | None = None, weight: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine of ``embedding`` columns, exactly.

    Queries are taken in blocks of QUERY_BLOCK by hash; each partition multiplies its vectors with a
    block, so many at a time that CELLS scores are held, and keeps k of each query; what is shuffled is
    k rows a query and partition. group: a column that query and document must agree in. weight: a
    column of docs by which rounded cosines are multiplied before the best are taken; the score is
    then the product. Null and zero vectors match nothing.
    """
    cols = ["query_id", "embedding"] + ([group] if group else [])
    rows = queries.select(*cols).filter("embedding is not null")
    parts = max(1, -(-rows.count() // (QUERY_BLOCK // 2)))
    spark, out = docs.sparkSession, None
    for part in range(parts):
        block = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").collect()
        if not block:
            continue
        m = np.array([r.embedding for r in block], np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        kinds = {g: i for i, g in enumerate(sorted({r[group] for r in block if r[group] is not None}))} if group else {}
        own = np.array([kinds.get(r[group], -2) for r in block]) if group else None
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in block], np.int64), m / np.where(norm > 0, norm, 1), norm[:, 0] > 0, kinds, own))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m, real, kinds, own = shared.value
            best_s, best_d = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            step = max(1, CELLS // len(ids))
            for whole in batches:
                whole = whole.filter(whole.column(1).is_valid())
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    n = np.linalg.norm(x, axis=1)
                    s = np.round(m @ (x / np.where(n > 0, n, 1)[:, None]).T, 6)
                    if weight:
                        s = np.round(s * b.column(2).to_numpy(zero_copy_only=False)[None], 6)
                    s[~real] = -np.inf
                    s[:, ~(n > 0)] = -np.inf
                    if own is not None:
                        s[own[:, None] != np.array([kinds.get(g, -1) for g in b.column(b.num_columns - 1).to_pylist()])[None]] = -np.inf
                    d = np.repeat(b.column(0).to_numpy()[None], len(ids), axis=0)
                    if s.shape[1] > 4 * k:  # those below the k-th score can't be among the best
                        cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        some = np.flatnonzero((s >= cut).any(axis=0))
                        s, d = s[:, some], d[:, some]
                    best_s, best_d = _best_of(np.concatenate((best_s, s), axis=1), np.concatenate((best_d, d), axis=1), k)
            ok = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1]).reshape(best_s.shape)[ok]), pa.array(best_d[ok]), pa.array(best_s[ok])], names=["query_id", "doc_id", "score"])

        more = ([F.col(weight).cast("double").alias("_weight")] if weight else []) + ([group] if group else [])
        source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding", *more)
        found = source.mapInArrow(task, "query_id bigint, doc_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return top_n(out, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) tables."""
    every = None
    for r in rankings:
        r = r.select("query_id", "doc_id", "rank")
        every = r if every is None else every.unionByName(r)
    scores = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    return top_n(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def boosted(results: DataFrame, boosts: list[tuple[Column, float]], factor: bool = False) -> DataFrame:
    """Scores with additive (or multiplicative) boosts where conditions hold, ranked anew."""
    score = F.col("score")
    for cond, b in boosts:
        score = score * F.when(cond, b).otherwise(1.0) if factor else score + F.when(cond, b).otherwise(0.0)
    out = results.withColumn("score", F.round(score, 6))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def lexical_boost(words: Column, name: Column, each: float = 0.05, most: float = 0.2) -> Column:
    """``each`` for every query token that a name contains, ``most`` at most."""
    return F.least(F.size(F.filter(words, lambda t: F.lower(name).contains(t))) * each, F.lit(most))


def unique_texts(results: DataFrame, text: str, n: int = 120) -> DataFrame:
    """Of results whose first n characters agree the best stays; empty texts all stay."""
    mark = F.substring(F.trim(F.col(text)), 1, n)
    rn = F.row_number().over(W.partitionBy("query_id", mark).orderBy(F.desc("score"), "doc_id"))
    return results.withColumn("_rn", F.when(F.coalesce(mark, F.lit("")) == "", 1).otherwise(rn)).filter("_rn = 1").drop("_rn")


def nearest_label(queries: DataFrame, prototypes: DataFrame, least: float) -> DataFrame:
    """(query_id, label, score): the label of the most similar prototype (doc_id, embedding, label),
    null below ``least``."""
    top = dense_top_k(prototypes, queries, 1)
    named = top.join(prototypes.select("doc_id", "label"), "doc_id")
    return named.select("query_id", F.when(F.col("score") >= least, F.col("label")).alias("label"), "score")


def volume_weight(count: Column) -> Column:
    """1 + 0.15 log10 n, less 15 % for categories of under ten deals."""
    return (1 + 0.15 * F.log10(F.greatest(count, F.lit(1)))) * F.when(count < 10, 0.85).otherwise(1.0)


def volume_biased(docs: DataFrame, queries: DataFrame, label: str, k: int) -> DataFrame:
    """(query_id, doc_id, biased, rank): the k best by cosine times the weight of the label's volume.
    Every document is weighed, not only those that lie near."""
    n = docs.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    weighed = docs.join(n, label).withColumn("_w", volume_weight(F.col("_n")))
    return dense_top_k(weighed, queries, k, weight="_w").withColumnRenamed("score", "biased")


def _slots(limit_type: str, limit: int, wanted: list[str], n: int):
    def task(group: pa.Table) -> pa.Table:
        rows = group.sort_by("rank").to_pylist()
        kept, over, used = [], [], 0
        for r in rows:
            if r["doc_type"] == limit_type and used >= limit:
                over.append(r)
                continue
            used += r["doc_type"] == limit_type
            kept.append(r)
        head, tail = kept[:n], kept[n:]
        head += over[: n - len(head)]
        for kind in wanted:  # a wanted type that is missing replaces the last result of a frequent type
            if head and all(r["doc_type"] != kind for r in head):
                new = next((r for r in tail if r["doc_type"] == kind), None)
                types = [r["doc_type"] for r in head]
                old = next((i for i in range(len(head) - 1, -1, -1) if types.count(types[i]) > 1), None)
                if new is not None and old is not None:
                    head[old] = new
        return pa.table({"query_id": [r["query_id"] for r in head], "doc_id": [r["doc_id"] for r in head], "slot": list(range(1, len(head) + 1))}, schema=pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("slot", pa.int32())]))

    return task


def diversified(results: DataFrame, n: int, limit_type: str, limit: int, wanted: list[str], pool: int = 100) -> DataFrame:
    """The first n results of each query (query_id, doc_id, doc_type, rank) with at most ``limit`` of
    one type and at least one of each wanted type that its first ``pool`` results hold. Filling slots
    is sequential, so it is done per query, over pool rows at most."""
    some = results.filter(F.col("rank") <= pool).select("query_id", "doc_id", "doc_type", "rank")
    return some.groupBy("query_id").applyInArrow(_slots(limit_type, limit, wanted, n), "query_id bigint, doc_id bigint, slot int")


def grounded(prices: Column, references: Column, tolerance: float = 0.05) -> Column:
    """Share of stated prices within a tolerance of any reference; 1 if none is stated."""
    ok = F.filter(prices, lambda p: F.exists(references, lambda r: (r > 0) & (F.abs(p - r) / r <= tolerance)))
    return F.when(F.size(prices) == 0, 1.0).otherwise(F.size(ok) / F.size(prices))
