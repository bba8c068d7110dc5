"""Evaluation and training data: checks, roll-ups, run comparison, selection, seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.operators.windows import top_n


def failures(checks: dict[str, Column]) -> Column:
    """Names of the checks that are not met (null counts as not met), in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def rolled_up(results: DataFrame, by: list[str], passed: Column, value: str) -> DataFrame:
    """Count, pass rate, mean, element int(0.95 n) of the sorted values, and most."""
    agg = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(passed.cast("double")), 4).alias("pass_rate"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("most"))
    per = results.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*by).orderBy(value)
    per = per.withColumn("_to", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    p95 = per.filter(F.col("_to") > F.floor(F.col("_n") * 0.95)).groupBy(*by).agg(F.min(value).alias("p95"))
    return agg.join(p95, by)


def win_rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: wins, ties, losses of rows with a winner column, and wins over decided ones."""
    out = runs.groupBy(*by).agg(*[F.count_if(F.col("winner") == w).alias(f"n_{w}") for w in ("a", "b", "tie")], F.count(F.lit(1)).alias("n"))
    return out.withColumn("win_rate", F.round(F.try_divide(F.col("n_a"), F.col("n_a") + F.col("n_b")), 4))


def flips(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How often a verdict of one run became another in the next."""
    return a.select(key, F.col("winner").alias("before")).join(b.select(key, F.col("winner").alias("after")), key).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def against_baseline(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """regression, fix, same or new for each case of the current run."""
    b = baseline.select(key, F.col("passed").alias("_was"))
    kind = F.when(F.col("_was").isNull(), "new").when(F.col("_was") & ~F.col("passed"), "regression").when(~F.col("_was") & F.col("passed"), "fix").otherwise("same")
    return current.join(b, key, "left").select(key, kind.alias("kind"))


def per_topic_best(rows: DataFrame, topic: str, order: list[Column], per: int, most: int) -> DataFrame:
    """At most ``per`` rows a topic, then the best ``most`` of all (a top-k, not a full sort)."""
    return top_n(rows, [topic], order, per, "in_topic").orderBy(*order).limit(most)


def quota_sample(rows: DataFrame, priority: Column, quotas: list[int], total: int, key: str) -> DataFrame:
    """Disjoint picks: quotas[i] rows of priority i, then the rest by key up to total."""
    r = rows.withColumn("priority", priority)
    parts = None
    for i, n in enumerate(quotas):
        some = r.filter(F.col("priority") == i).orderBy(key).limit(n)
        parts = some if parts is None else parts.unionByName(some)
    rest = r.join(F.broadcast(parts.select(key)), key, "left_anti").orderBy(key).limit(max(0, total - sum(quotas)))
    return parts.unionByName(rest.select(parts.columns))


def split(rows: DataFrame, key: Column, percent: int, seed: int) -> DataFrame:
    """Train or validation by a seeded hash of the row's key: the same in every run."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("part", F.when(h % 100 < percent, "validation").otherwise("train"))


def negatives(positives: DataFrame, pool: DataFrame, n: int, seed: int) -> DataFrame:
    """(query_id, doc_id, label): n passages of the pool for each query, of another topic 0.0 and of
    the same topic but not its own 0.3, by a seeded hash.

    The pool is cut to a hash-ranked handful per topic first; queries meet those, not all passages.
    """
    h = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in c]))
    few = top_n(pool, ["topic"], [h(F.col("doc_id")), F.col("doc_id")], 4 * n, "_rank").select("doc_id", F.col("topic").alias("pool_topic"))
    q = positives.select("query_id", "topic", F.col("doc_id").alias("own")).distinct()
    # a handful per topic: bounded by topics, not by passages
    pairs = q.join(F.broadcast(few), F.col("own") != F.col("doc_id"))
    pairs = pairs.withColumn("label", F.when(F.col("topic") == F.col("pool_topic"), 0.3).otherwise(0.0))
    return top_n(pairs, ["query_id", "label"], [h(F.col("query_id"), F.col("doc_id")), F.col("doc_id")], n, "_rank").select("query_id", "doc_id", "label")


def distinct_pairs(pairs: DataFrame, query: str, passage: str, order: list[str], n: int = 200) -> DataFrame:
    """Of pairs whose queries and passages agree in their first ``n`` characters, the first by ``order``.

    Nulls count as empty texts. A map-side aggregation on digests of the prefixes, so texts that very many
    pairs share are one row a task before they are shuffled. Of equals in ``order`` the least row stays.
    """
    start = lambda c: F.sha2(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n), 256)
    rest = [c for c in pairs.columns if c not in order]
    best = pairs.groupBy(start(query).alias("_q"), start(passage).alias("_p")).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return best.select(*[F.col("r")[c].alias(c) for c in pairs.columns])


def greedy_prototypes(rows: DataFrame, by: str, least_distance: float, most: int) -> DataFrame:
    """Per label the vectors, by id, that are not too similar to one taken before, ``most`` at most.

    Taking is sequential within a label, so it runs on blocks of a label's first 50 * most rows; the
    rows after a block are filtered against all vectors taken so far, in parallel, before the next
    block is cut. A block's first row is always taken, so there are at most ``most`` + 1 rounds. What
    is taken (``most`` vectors a label) is held by the driver. Rows without id or vector are skipped.
    """
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col(by).cast("int").alias(by))
    rows = rows.filter("id is not null and embedding is not null")
    taken: dict = {}  # label: (last id seen, ids, unit vectors)

    def unseen(batches, taken):
        for batch in batches:
            labels, ids = batch.column(by).to_pylist(), batch.column("id").to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            for label in set(labels):
                at = [i for i, x in enumerate(labels) if x == label]
                last, had, kept = taken.get(label, (None, [], []))
                if len(had) >= most:
                    continue
                at = [i for i in at if last is None or ids[i] > last]
                if at and had:
                    v = np.array([batch.column("embedding")[i].as_py() for i in at], np.float64)
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    near = (v / np.where(norm == 0, 1, norm)) @ np.array(kept).T
                    at = np.array(at)[near.max(axis=1) < least_distance]
                ok[at] = True
            yield batch.filter(pa.array(ok))

    def task(t: pa.Table, taken) -> pa.Table:
        t = t.sort_by("id")
        label = t.column(by)[0].as_py()
        _, had, kept = taken.get(label, (None, [], []))
        kept, new = list(kept), []
        for i, v in zip(t.column("id").to_pylist(), t.column("embedding").to_pylist(), strict=True):
            v = np.array(v, np.float64)
            v /= np.linalg.norm(v) or 1
            if np.isfinite(v).all() and len(had) + len(new) < most and (not kept or (np.array(kept) @ v).max() < least_distance):
                kept.append(v)
                new.append((i, v.tolist()))
        last = t.column("id")[-1].as_py()
        new.append((None, None))  # a block that adds nothing still moves on
        return pa.table({by: pa.array([label] * len(new), pa.int32()), "id": pa.array([i for i, _ in new], pa.int64()), "last": pa.array([last] * len(new), pa.int64()), "v": pa.array([v for _, v in new], pa.list_(pa.float64()))})

    def chooser(shared):
        return lambda t: task(t, shared.value)  # of one argument, as a second one would be the table

    while True:
        shared = spark.sparkContext.broadcast(dict(taken))
        left = rows.mapInArrow(lambda batches, shared=shared: unseen(batches, shared.value), rows.schema)
        # rank, not row_number: rows of one id stay in one block
        block = left.withColumn("_rank", F.rank().over(W.partitionBy(by).orderBy("id"))).filter(F.col("_rank") <= 50 * most).drop("_rank")
        found = block.groupBy(by).applyInArrow(chooser(shared), f"{by} int, id bigint, last bigint, v array<double>").collect()
        if not found:
            break
        for r in found:
            _, ids, kept = taken.get(r[by], (None, [], []))
            taken[r[by]] = (r["last"], ids + [r["id"]] * (r["id"] is not None), kept + [r["v"]] * (r["id"] is not None))
    return spark.createDataFrame([(label, i) for label, (_, ids, _) in taken.items() for i in ids], f"{by} int, id bigint")


def critiques(rows: DataFrame, text: str, patterns: dict[str, str], by: str, severity: Column) -> DataFrame:
    """Clusters of critique types by topic: how many rows and how severe in all."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    out = rows.withColumn("_s", severity).select(by, "_s", F.explode(found).alias("critique"))
    return out.groupBy(by, "critique").agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("severity"))


def phrase_failures(text: Column, required: list[str], any_of: list[str], forbidden: list[str]) -> Column:
    """What a text misses or must not hold, as a list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda t: low.contains(t.lower())
    parts = [F.when(~has(t), F.lit(f"missing:{t}")) for t in required] + [F.when(has(t), F.lit(f"forbidden:{t}")) for t in forbidden]
    if any_of:
        hit = has(any_of[0])
        for t in any_of[1:]:
            hit = hit | has(t)
        parts.append(F.when(~hit, F.lit("none_of_any")))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def labelled_pairs(rows: DataFrame, label: Column, least: float, per: int) -> DataFrame:
    """Training pairs (query_id, doc_id, label) from ``least`` on, the best ``per`` of a query, each
    pair of texts once."""
    some = rows.withColumn("label", label).filter(F.col("label") >= least)
    some = some.groupBy("query_id", "doc_id").agg(F.max("label").alias("label"))
    return top_n(some, ["query_id"], [F.desc("label"), F.col("doc_id")], per)


def artefact_gates(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """(artefact, rows, least, ok) for tables of (artefact, rows); a missing artefact has no rows."""
    spark = counts.sparkSession
    want = spark.createDataFrame(list(least.items()), "artefact string, least long")
    out = want.join(counts, "artefact", "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))
    return out.select("artefact", "rows", "least", (F.col("rows") >= F.col("least")).alias("ok"))


def resumed(rows: DataFrame, done: DataFrame, key: str, work) -> DataFrame:
    """Results so far and those of the rows that are not done yet; failed ones (null) are tried again."""
    good = done.filter("result is not null")
    rest = rows.join(good.select(key), key, "left_anti")
    return good.select(key, "result").unionByName(rest.select(key, work.alias("result")))
