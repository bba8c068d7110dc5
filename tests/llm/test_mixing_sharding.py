import collections

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing, sharding
from tallyforge.llm.queries import op3_feistel_shards

SF = "/root/testdata/sf0.001"


def _water(sizes):
    """Targets by repeated resharing, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return target
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            capped.add(s)


def test_targets(spark):
    sizes = {"a": 100, "b": 5, "c": 1000, "d": 0, "é": 70, None: 300}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(_water(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_of_awkward_rows(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}" if i % 5 else None, 1) for i in range(300)] + [(None, None, "s1", 1), (4, "w w", "s1", 1), (4, "w w", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(5)))
    assert a == b
    copies = collections.Counter(r.doc_id for r in out.collect() if r.doc_id not in (4, None))
    assert max(copies.values()) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_taken_is_near_the_target(spark):
    d = mixing.with_copies(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text"))
    per = d.groupBy("source").agg(F.sum(F.col("_q_size") * F.col("_q_copies")).alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 0.15 * r.target for r in per)
    assert abs(sum(r.t for r in per) / sum(r.target for r in per) - 1) < 0.02


@pytest.mark.parametrize("n", [1, 2, 7, 100, 997])
def test_permutation_is_a_bijection(spark, n):
    out = sharding.shard_rows(spark.range(n).withColumnRenamed("id", "doc_id").withColumn("slot", F.lit("old")), 4)
    rows = out.collect()
    per = collections.Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.get(s, 0) for s in range(4)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(k)) for s, k in per.items())


def test_place_can_be_computed_without_spark(spark):
    n = 50
    rows = sharding.number_rows(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", []).collect()
    place = {r.doc_id: sharding.python_place(r._q_row, n, 7) for r in rows}
    got = sharding.shard_rows(spark.range(n).withColumnRenamed("id", "doc_id"), 4).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {k: (p % 4, p // 4) for k, p in place.items()}


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(200)] + [(None, "a"), (None, "a"), (3, "t")], "doc_id long, text string")
    key = lambda df: sorted(map(str, sharding.shard_rows(df, 8).collect()))
    assert key(docs) == key(docs.repartition(7))
    assert sharding.shard_rows(docs.limit(0), 8).count() == 0


def test_query(spark):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_feistel_shards(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" for r in rows)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "s", "w " * 2_000_000), (2, "s", "x" * 4_000_000), (3, "s", "a b"), (4, None, None)], "doc_id long, source string, text string")
    out = sharding.shard_rows(docs, 2).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    sizes = {r.doc_id: r._q_size for r in mixing.with_copies(docs).collect()}
    assert sizes == {1: 2_000_000, 2: 1, 3: 2, 4: 0}
