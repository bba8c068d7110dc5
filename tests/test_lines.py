"""Lines and deals without shuffles that their size does not need."""

from pyspark.sql import functions as F

from tallyforge.operators import sales as S
from tallyforge.sources.roles import lines

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_deals_are_grouped_where_their_lines_were_joined(spark):
    """With tables too large to be broadcast: both sides of two joins, and nothing for the aggregations."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lines(spark, SF)
        deals = S.deal_facts(rows)
        assert _exchanges(rows) == 4
        assert _exchanges(deals) == 4
        assert deals.agg(F.sum("line_count")).first()[0] == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_stay_where_they_lie_for_a_join_by_deal(spark):
    """One more shuffle for the deals, none for the lines; a join by dataset and deal shuffles both."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lines(spark, SF).select("dataset", "deal_id", "line")
        deals = rows.select("deal_id", F.col("dataset").alias("_in")).limit(50)
        assert _exchanges(rows.join(deals, "deal_id")) - _exchanges(deals) == 4 + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_of_a_deal_are_combined_where_its_lines_lie(spark):
    """The wider deals shuffle lines for their two joins only; what a deal's names say is one row when it travels."""
    from tallyforge.plans import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["deal_details"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert moved and not any("product_name#" in x for x in moved), moved
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_products_of_a_deal_are_counted_where_its_lines_lie(spark, monkeypatch):
    """One pass for deals by category and by product: beside the two joins only counts by product are shuffled."""
    from tallyforge.operators import templates as T

    plans = []
    monkeypatch.setattr(T, "stored", lambda df, name: plans.append(df) or df, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        T.good_frequency(lines(spark, SF), "direction")
        assert [_exchanges(p) for p in plans] == [4 + 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequencies_of_repeated_and_missing_values(spark):
    from tallyforge.operators import templates as T

    rows = [("o", 1, "a", "x"), ("o", 1, "a", "x"), ("f", 1, "a", "x"), ("o", 2, "a", "y"), ("o", 2, None, "y"), ("o", None, "a", "z"), ("o", 3, "a", None)]
    out = T.good_frequency(spark.createDataFrame(rows, "dataset string, deal_id long, category string, product_key string"), "category")
    assert {(r.category, r.product_key, r.deals, r.frequency) for r in out.collect()} == {("a", "x", 2, 0.5), ("a", "y", 1, 0.25), ("a", "z", 0, 0.0), ("a", None, 1, 0.25)}
