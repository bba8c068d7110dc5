"""Range joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import intervals as I
from tallyforge.operators.templates import bracket_price


def _tables(spark, seed, floats):
    rng = random.Random(seed)
    number = (lambda a, b: round(rng.uniform(a, b), 2)) if floats else rng.randint
    points = [(i, rng.choice("ab"), rng.choice([None, number(-50, 50), 7.0 if floats else 7])) for i in range(150)]
    ranges = []
    for i in range(120):
        low = number(-60, 60)
        length = rng.choice([0, 1, 3, 10, 1000, -5]) * (1.0 if floats else 1)
        ranges.append((i, rng.choice(["a", "b", None]), rng.choice([low, low, None]), rng.choice([low + length, low + length, None])))
    kind = "double" if floats else "long"
    return points, ranges, spark.createDataFrame(points, f"p long, k string, x {kind}"), spark.createDataFrame(ranges, f"r long, k string, low {kind}, high {kind}")


@pytest.mark.parametrize("floats", [False, True])
@pytest.mark.parametrize(("hot", "named"), [(1000, 10), (5, 1000), (5, 0)], ids=["plain", "split", "all split"])
def test_equals_all_pairs(spark, monkeypatch, floats, hot, named):
    monkeypatch.setattr(I, "NAMED", named)
    points, ranges, a, b = _tables(spark, hot + floats, floats)
    inside = lambda x, low, high: x is not None and (low is None or low <= x) and (high is None or x < high)
    got = sorted((r.p, r.r) for r in I.interval_join(a, b, "x", "low", "high", ("k",), hot=hot, salts=3).collect())
    assert got == sorted((p, r) for p, k, x in points for r, k2, low, high in ranges if k == k2 and inside(x, low, high))
    got = sorted((r.p, r.r) for r in I.interval_join(a, b.drop("k"), "x", "low", "high", hot=hot, salts=3).collect())
    assert got == sorted((p, r) for p, _, x in points for r, _, low, high in ranges if inside(x, low, high))


def test_no_nested_loop_and_no_rows(spark):
    _, _, a, b = _tables(spark, 0, False)
    plan = I.interval_join(a, b, "x", "low", "high", ("k",))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert I.interval_join(a.limit(0), b, "x", "low", "high", ("k",)).count() == 0
    assert I.interval_join(a, b.limit(0), "x", "low", "high", ("k",)).count() == 0


def test_an_interval_lies_in_two_bins_at_most(spark):
    """One interval of a million among short ones makes no million rows."""
    a = spark.range(100).select(F.col("id").alias("x"))
    b = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(-1_000_000, 1_000_000)], "low long, high long")
    assert I.interval_join(a, b, "x", "low", "high").count() == 150


def test_long_price_lists(spark):
    """The same rates from the expression over few steps and the join over many."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([None, -5.0, 0.0, 9.99, 10.0, 4999.5, 24999.0, 25000.0])], "i int, v double")
    steps = spark.range(1, 2501).select((F.col("id") * 10).cast("double").alias("below"), F.col("id").cast("double").alias("rate"))
    got = {r.i: r.rate for r in bracket_price(rows, F.col("v"), steps).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 500.0, 6: 2500.0, 7: None}
    few = {r.i: r.rate for r in bracket_price(rows, F.col("v"), steps.filter("below <= 9000")).collect()}
    assert {i: v for i, v in few.items() if i < 6} == {i: v for i, v in got.items() if i < 6}
