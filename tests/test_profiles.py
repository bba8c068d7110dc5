"""Profiles of deals: totals do not depend on how lines are dealt to tasks."""

import itertools
import math

from tallyforge.operators import sales as S

COLUMNS = "dataset string, deal_id long, line int, product_name string, quantity double, line_total double, direction string"


def _percent(values, part):
    """The share of the lines in part, added from the highest line down."""
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    total = share = 0.0
    for i in order:
        total += values[i]
        share += values[i] if i in part else 0.0
    return math.floor(share / total * 100 + 0.5)


def test_shares_on_a_half_are_added_from_the_highest_line_down(spark):
    deals = {}
    for units in itertools.combinations(range(1, 14), 5):
        values = [1234.56 * u for u in units]  # ascending, as the rows are given
        if 200 * sum(units[:3]) % sum(units) == 0 and _percent(values, {0, 1, 2}) != math.floor(sum(values[:3]) / sum(values) * 100 + 0.5):
            deals[len(deals)] = values
    assert len(deals) >= 3
    rows = [("orders", k, i, "p", 1.0, v, "a" if i < 3 else "b") for k, values in deals.items() for i, v in enumerate(values)]
    facts = [("orders", k, 2, sum(v), "money", "a") for k, v in deals.items()]
    facts = spark.createDataFrame(facts, "dataset string, deal_id long, unique_products long, line_total double, payment string, primary_direction string")
    for lines in (spark.createDataFrame(rows, COLUMNS).coalesce(1), spark.createDataFrame(rows[::-1], COLUMNS).repartition(3)):
        got = {r.deal_id: dict(x.split(": ") for x in r.direction_breakdown.split("; ")) for r in S.deal_profiles(lines, facts).collect()}
        assert {k: r["a"] for k, r in got.items()} == {k: f"{_percent(v, {0, 1, 2})}%" for k, v in deals.items()}


def test_profiles_of_long_and_of_missing_lines(spark):
    """Ten components at most over all directions, whole quantities as SQL rounds them, lines without a total."""
    rows = [("orders", 1, i, f"p{i}", 2.5 + i % 2, 100.0 + i, "__x" if i % 2 else "a") for i in range(12)] + [("orders", 1, 12, "none", 1.0, None, "a")]
    facts = spark.createDataFrame([("orders", 1, 13, 1266.0, "money", "a")], "dataset string, deal_id long, unique_products long, line_total double, payment string, primary_direction string")
    r = S.deal_profiles(spark.createDataFrame(rows, COLUMNS), facts).first()
    assert r.components == "; ".join(f"p{i} x{4 if i % 2 else 2} = {100 + i}" for i in range(11, 1, -1))
    assert (r.direction_count, r.direction_breakdown) == (2, "other: 50%; a: 50%")


def test_lines_of_profiles_travel_once(spark):
    """Deals join the lines where these lie: beside the joins that make lines, only the deals are shuffled."""
    from tallyforge.sources.roles import lines

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lines(spark, "/root/testdata/sf0.001")
        deals = S.deal_facts(rows).localCheckpoint()
        plan = S.deal_profiles(rows, deals)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4 + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
