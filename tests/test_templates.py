"""Canonical deals that are not gathered by category, and deal facts of few columns."""

import random

import pytest

from tallyforge.operators import sales as S
from tallyforge.operators import templates as T
from tallyforge.plans import QUERIES, documents, templates
from tallyforge.plans.sales import narrow_deals
from tallyforge.sources.roles import lines

SF = "/root/testdata/sf0.001"


def _shuffles(df):
    """Of each shuffle in the plan of df: names of its columns, and records written so far."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            out = node.output()
            found.append(({out.apply(i).name() for i in range(out.size())}, node.metrics().apply("shuffleRecordsWritten").value()))
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        kids = node.children()
        for k in inner + [kids.apply(i) for i in range(kids.size())]:
            walk(k)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture
def large(spark):
    """Plans as for tables too large to be broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def _canonical(rows):
    out = {}
    for category in {r[0] for r in rows} - {None}:
        pool = [r for r in rows if r[0] == category and r[3] >= 2]
        if not pool:
            continue
        at = lambda v, q: sorted(v)[min(int(len(v) * q), len(v) - 1)] if v else None
        p60, median = at([r[3] for r in pool], 0.6), at([r[4] for r in pool if r[4] is not None and r[4] > 0], 0.5)
        some = [r for r in pool if r[3] >= p60]
        best = min((r[1] != "orders", abs((r[4] or 0.0) - (median or 0.0)), r[2], r[1]) for r in some)
        out[category] = (best[2], best[3], len(some))
    return out


@pytest.mark.parametrize("values", ["distinct", "repeated", "odd"])
def test_canonical_deals_are_found_where_deals_lie(spark, tmp_path, monkeypatch, values):
    rng = random.Random(values)
    opportunity = {"distinct": lambda k: 1000 + k / 30, "repeated": lambda k: float(k % 5), "odd": lambda k: rng.choice([None, 0.0, -5.0, 1e-300, 0.5, 7.0, 1e300])}[values]
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["orders", "offers", "open"]), k, rng.randint(1, 5), opportunity(k)) for k in rng.sample(range(3000), 3000)]
    rows += [("none", "offers", 3000, 1, 5.0), ("zero", "offers", 3001, 2, 0.0), ("one", "open", 3002, 2, 9.0), ("one", "open", 3003, 2, None)]
    schema = "category string, dataset string, deal_id long, unique_products long, opportunity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "deals"))
    plans, stored = [], T.stored
    monkeypatch.setattr(T, "stored", lambda df, name: (plans.append(df), df.collect(), stored(df, name))[-1])
    out = T.canonical_deals(spark.read.parquet(str(tmp_path / "deals")), "category")
    assert {r.category: (r.deal_id, r.dataset, r.eligible) for r in out.collect()} == _canonical(rows)
    assert sum(n for df in [*plans, out] for _, n in _shuffles(df)) < 1500


def test_canonical_deals_read_narrow_deals(large, monkeypatch):
    plans, stored = {}, templates.stored
    monkeypatch.setattr(templates, "stored", lambda df, name: plans.update({name: df}) or stored(df, name))
    QUERIES["canonical_deals"](large, SF)
    by_deal = [names for names, _ in _shuffles(plans["pool"]) if "deal_id" in names and "product_id" in names]
    assert sorted(map(sorted, by_deal)) == [["_manual", "deal_id", "direction", "l_linenumber", "product_id"], ["deal_id", "l_linenumber", "product_id"]]


def test_fact_documents_read_narrow_deals_once(large, monkeypatch):
    plans, stored = {}, getattr(documents, "stored", None)
    monkeypatch.setattr(documents, "stored", lambda df, name: plans.update({name: df}) or stored(df, name), raising=False)
    out = QUERIES["fact_documents"](large, SF)
    assert list(plans) == ["durations"]
    moved = set().union(*(names for names, _ in _shuffles(plans["durations"])))
    assert not moved & {"title", "client_id", "payment", "opportunity", "section", "_manual", "product_name", "l_suppkey"}, moved
    assert not any("deal_id" in names for names, _ in _shuffles(out))


def test_names_of_products_stay_with_the_catalogue(large):
    """Deals take the name of a product only where there is no other key."""
    by_deal = [names for names, _ in _shuffles(S.deal_facts(lines(large, SF))) if "l_linenumber" in names and "direction" in names]
    assert by_deal and not any("product_name" in names for names in by_deal), by_deal


@pytest.mark.parametrize("of", [("dataset", "deal_id", "primary_direction", "unique_products", "opportunity"), ("deal_id", "dataset", "duration_days", "line_total"), ("deal_id", "dataset", "gap_pct", "bundle_key", "close_month"), ("deal_id", "dataset", "sections")])
def test_narrow_deals_are_the_wide_ones(spark, of):
    wide = S.deal_facts(lines(spark, SF)).select(*of)
    narrow = narrow_deals(spark, SF, *of)
    assert narrow.columns == list(of) and narrow.count() == wide.count()
    assert wide.exceptAll(narrow).count() == 0
