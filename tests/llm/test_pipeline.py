"""The pipeline stage by stage against plain versions, and the promises that its entry makes."""

import pytest

import __spark_entry__
import corpus_pipeline
from tallyforge.llm import mixing, toxicity
from tallyforge.llm.decontamination import matches
from tallyforge.llm.near_duplicates import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, current, ids = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF).cache()
        ids[name] = [r.doc_id for r in current.select("doc_id").collect()]
        if name != "sharding":
            assert current.columns == names
    every = {r.doc_id for r in docs.collect()}
    net_out = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(ids["toxicity"]) == {i for i in every if not net_out[i]}
    rest = docs.filter(docs.doc_id.isin(ids["toxicity"]))
    assert set(ids["near_duplicates"]) == {r.doc_id for r in near_duplicates(rest).collect() if r.kept}
    leaked = {r.doc_id for r in matches(rest, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - leaked
    assert sorted(ids["mixing"]) == sorted(ids["sharding"])
    copies = {r.doc_id: r._q_copies for r in mixing.with_copies(rest.filter(rest.doc_id.isin(ids["decontamination"]))).collect()}
    assert sorted(ids["mixing"]) == sorted(i for i, n in copies.items() for _ in range(n))
    per = {}
    for r in current.collect():
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_run_equals_its_stages(spark):
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_registered():
    q = __spark_entry__.queries()
    assert sorted({n.split("_")[0] for n in q if n.startswith("op") and n[2].isdigit()}) == sorted(f"op{i}" for i in range(1, 14))
    assert "pipeline" in q and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, stage):
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 3), (2, "", "de", None, 0), (3, "x " * 30_000, "en", "s", 1), (3, "x " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, docs, SF).count() >= 1
    assert f(spark, docs.limit(0), SF).count() == 0
