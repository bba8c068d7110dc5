"""The inverted-file index against full comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import dense_index as D
from tallyforge.operators import retrieval as R

SF = "/root/testdata/sf0.1"
KIND = "doc_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """6,000 vectors around 40 directions, an index of them, and 60 queries."""
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(40, 24))
    x = heads[rng.integers(40, size=6000)] + rng.normal(scale=0.25, size=(6000, 24))
    docs = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], KIND).repartition(5)
    path = str(tmp_path_factory.mktemp("index"))
    D.build(docs, path)
    return docs, path, docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _recall(found, full):
    a, b = ({(r.query_id, r.doc_id) for r in x.collect()} for x in (found, full))
    return len(a & b) / len(b)


def test_recall_of_few_cells(spark, clustered):
    docs, path, queries = clustered
    full = R.dense_top_k(docs, queries, 10)
    assert _recall(D.search(spark, path, queries, 10, probes=8), full) >= 0.95
    assert spark.read.parquet(f"{path}/centres").count() >= 60


def test_recall_on_vectors_without_clusters(spark, tmp_path):
    """Directions drawn at random have no near cells to speak of: three quarters of them must be read."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    D.build(e, str(tmp_path), cells=32)
    queries = e.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    assert _recall(D.search(spark, str(tmp_path), queries, 10, probes=25), R.dense_top_k(e, queries, 10)) >= 0.95


def test_folders_are_pruned(spark, clustered):
    _, path, queries = clustered
    out = D.search(spark, path, queries.limit(1), 5, probes=2, where=F.col("label") == 1)
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,1)]" in plan
    read = {f for f in D.vectors(spark, path).inputFiles()}
    assert len(read) >= 60 and out.count() == 5


@pytest.mark.parametrize("where", [None, "label = 1", "doc_id < 4"])
def test_exact_search_is_the_full_comparison(spark, clustered, where):
    docs, path, queries = clustered
    full = R.dense_top_k(docs if where is None else docs.filter(where), queries, 7)
    found = D.search(spark, path, queries, 7, probes=2, where=None if where is None else F.expr(where), exact=True)
    assert _rows(found) == _rows(full.select(found.columns))


def test_awkward_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [0.0, 2.0], None), *[(k, [1.0, 1.0], 0) for k in range(10, 60)]]
    df = spark.createDataFrame(rows, KIND)
    D.build(df, str(tmp_path / "a"), cells=3)
    assert D.vectors(spark, str(tmp_path / "a")).count() == len(rows)
    queries = spark.createDataFrame([(7, [3.0, 0.0]), (8, None), (9, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = D.search(spark, str(tmp_path / "a"), queries, 3, probes=1, exact=True).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(7, 1, 1.0), (7, 1, 1.0), (7, 10, round(2**-0.5, 6))]
    D.build(df.limit(0), str(tmp_path / "b"))
    assert D.search(spark, str(tmp_path / "b"), queries, 3).count() == 0


def test_recall_of_the_query(spark):
    from tallyforge.plans import QUERIES

    for sf in (SF, "/root/testdata/sf0.01"):
        assert _recall(QUERIES["cell_search"](spark, sf), QUERIES["dense_search"](spark, sf)) >= 0.95
