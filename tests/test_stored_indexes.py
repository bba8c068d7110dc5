"""Stored posting lists and keyed upserts."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import retrieval as R
from tallyforge.operators import sparse_index as X
from tallyforge.sources.files import upsert_index, uuid5


def test_murmur3():
    """Published values of the 32-bit x86 variant."""
    assert [X.murmur3(b"", 0), X.murmur3(b"", 1), X.murmur3(b"test", 0), X.murmur3(b"Hello, world!", 0x9747B28C), X.murmur3(b"aaa", 0x9747B28C)] == [0, 0x514E28B7, 0xBA6BD213, 0x24884CBA, 0x283E0130]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """4,000 documents with one word in all of them; a few ids hold rare words."""
    rng = random.Random(1)
    text = lambda i: " ".join(["common"] * rng.randint(1, 3) + [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(12)] + (["needle"] * 5 if i % 997 == 0 else []))
    docs = spark.createDataFrame([(i, text(i)) for i in range(4000)], "doc_id long, text string").repartition(4)
    path = str(tmp_path_factory.mktemp("postings"))
    X.build(X.with_sparse(docs), path, width=64)
    return docs, path


def test_search_equals_the_scan(spark, corpus):
    docs, path = corpus
    queries = spark.createDataFrame([(1, "common needle"), (2, "w3 w5 common"), (3, "absent"), (4, ""), (5, None), (6, "w1 w1 w2")], "query_id long, text string")
    found, _ = X.search(spark, path, X.with_sparse(queries), 10)
    full = R.sparse_top_k(docs, queries, 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, full.select(found.columns).collect()))


def test_blocks_are_skipped(spark, corpus):
    """Ranges without the rare word can't reach the fifth score: of 63 ranges those with it are scored."""
    _, path = corpus
    queries = X.with_sparse(spark.createDataFrame([(1, "common needle")], "query_id long, text string"))
    found, scored = X.search(spark, path, queries, 5)
    assert {r.doc_id for r in found.collect()} == {i for i in range(4000) if i % 997 == 0}
    every = X.blocks(spark, path).filter(F.col("term") == X.murmur3(b"common")).count()
    assert every == 63 and scored.count() <= 8
    plan = X.blocks(spark, path).filter(F.col("bucket") == 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_index_rows_carry_their_vector(spark):
    df = spark.createDataFrame([(1, "b a b", "x"), (2, " ", "y"), (3, None, "z")], "doc_id long, text string, sparse string")
    rows = {r.doc_id: r.sparse for r in X.with_sparse(df).collect()}
    assert rows == {1: None, 2: None, 3: None}  # tokens have two characters at least
    long = X.with_sparse(spark.createDataFrame([(1, "bb aa bb", "x")], "doc_id long, text string, other string")).first()
    assert long.other == "x" and dict(zip(long.sparse.indices, long.sparse["values"], strict=True)) == {X.murmur3(b"aa"): 1.0, X.murmur3(b"bb"): 2.0}
    assert long.sparse.indices == sorted(long.sparse.indices)


def test_uuid5(spark):
    names = ["", "doc-1", "é ü", "a" * 500, None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(uuid5(F.col("n"))).collect()]
    assert got == [None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_are_not_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("version"), F.lit("old").alias("v"))
    assert upsert_index(rows, path, "key", "version", 32) == 32
    before = _files(path)
    new = spark.createDataFrame([("k5", 2, "new"), ("k5", 3, "newest"), ("k6", 0, "late"), ("added", 1, "new"), (None, 9, "x")], "key string, version int, v string")
    touched = upsert_index(new, path, "key", "version", 32)
    after = _files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert 1 <= touched <= 3 and len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in same}) == touched
    got = {r.key: (r.version, r.v) for r in spark.read.parquet(path).collect()}
    assert len(got) == 2001 and got["k5"] == (3, "newest") and got["k6"] == (1, "old") and got["added"] == (1, "new")
    assert upsert_index(new.limit(0), path, "key", "version", 32) == 0 and _files(path) == after
    upsert_index(new, path, "key", "version", 32)
    assert {r.key: (r.version, r.v) for r in spark.read.parquet(path).collect()} == got


def test_postings_travel_once(spark, tmp_path, monkeypatch):
    """Weights are added and blocks are made where they are written: one shuffle of postings."""
    from pyspark.sql import DataFrameWriter

    from tallyforge.operators import sparse_index

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append((path, self._df)) or write(self, path, *a, **k))
    docs = spark.createDataFrame([(k // 2, {"indices": [1, k + 2], "values": [1.0, 2.0]}) for k in range(6)], "doc_id long, sparse struct<indices: array<bigint>, values: array<double>>")
    sparse_index.build(docs, str(tmp_path))
    plan = next(df for path, df in plans if path.endswith("/blocks"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    blocks = {r.term: sorted((p.doc_id, p.tf) for p in r.postings) for r in sparse_index.blocks(spark, str(tmp_path)).collect()}
    assert blocks == {1: [(0, 2.0), (1, 2.0), (2, 2.0)]} | {k + 2: [(k // 2, 2.0)] for k in range(6)}
