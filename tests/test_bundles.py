"""Bundles from one shuffle of their deals."""

import re

from tallyforge.operators import sales as S


def test_deals_of_bundles_travel_once(spark):
    """Facts, most frequent direction and samples of a bundle from one shuffle of its deals."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("orders", k, "p|q", "a" if k % 3 else "b", 2, "money", float(k), k, "s", "t") for k in range(9)] + [("orders", 9, "r", "b", 1, "barter", 5.0, None, "s|u", "t")]
        deals = spark.createDataFrame(rows, "dataset string, deal_id long, bundle_key string, primary_direction string, unique_products long, payment string, line_total double, duration_days long, sections string, title string")
        out = S.bundle_facts(deals)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = {r.bundle_key: (r.direction, r.sample_deals, r.median_value, r.deal_count, r.canonical_key) for r in out.collect()}
        assert got == {"p|q": ("a", "8|7|6|5|4", 4.0, 9, "s"), "r": ("b", "9", None, 1, "s|u")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heights_and_descriptions_of_bundles(spark):
    rows = [(1, 10, "bb"), (2, 30, None), (3, 30, "aa"), (4, 10, ""), (5, 0, "x" * 600), (6, 0, "y" * 600), (7, 0, "")]
    rows = [("orders", k, "p", "a", 1, "money", 1.0, 1, "s", "t", h, d) for k, h, d in rows] + [("orders", 8, "q", "a", 1, "money", 1.0, 1, "s", "t", 0, None)]
    deals = spark.createDataFrame(rows, "dataset string, deal_id long, bundle_key string, primary_direction string, unique_products long, payment string, line_total double, duration_days long, sections string, title string, letter_height_cm long, description string")
    out = S.bundle_facts(deals)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.bundle_key: (r.letter_height_cm, r.description) for r in out.collect()} == {"p": (10, "x" * 500), "q": (None, "")}


def test_sets_of_templates_do_not_travel_with_each_product(spark):
    rows = [("offers", 1, "t", 1.0, "p|q", ["p", "q"]), ("orders", 2, "t", 5.0, "p|q|r", ["p", "q", "r"]), ("orders", 3, "t", 7.0, "p|q", ["p", "q"]), ("orders", 4, "t", 9.0, "q", ["q"])]
    deals = spark.createDataFrame(rows, "dataset string, deal_id long, title string, line_total double, bundle_key string, product_keys array<string>")
    out = S.template_matches(deals)
    found = re.findall(r"Generate explode\(keys#\d+\), \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert found and all("," not in x and x.startswith("bundle_key") for x in found), found
    r = out.first()
    assert (r.products, r.exact_matches, r.contained_matches, r.matched_median) == (2, 1, 2, 6.0)
