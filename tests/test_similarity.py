"""Similarity joins against comparisons of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import similarity as S


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _names(rng, n, base):
    out = ["", "a"]
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(s))
            s[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "é", "ab"])
        out.append("".join(s))
    return out


@pytest.mark.parametrize("least", [0.51, 0.6, 0.76, 0.9, 1.0])
def test_edit_pairs_are_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    base = ["warehouse", "red bolt large", "ab", "abab", "customer_12", "aaaaaaaaaa", "blue gear"]
    left, right = _names(rng, 90, base), _names(rng, 90, base)
    a = spark.createDataFrame([(i, s) for i, s in enumerate([*left, None])], "id int, x string")
    b = spark.createDataFrame([(i, s) for i, s in enumerate([*right, right[5]])], "other int, y string")
    got = sorted((r.id, r.other, r.edits) for r in S.edit_pairs(a, b, "x", "y", least).collect())
    right.append(right[5])
    want = [(i, j, _distance(s, t)) for i, s in enumerate(left) for j, t in enumerate(right) if s and t]
    assert got == sorted((i, j, d) for i, j, d in want if 1 - d / max(len(left[i]), len(right[j])) >= least - 1e-9)
    assert S.edit_pairs(a.limit(0), b, "x", "y", least).count() == 0


def test_edit_pairs_have_no_nested_loop(spark):
    a = spark.createDataFrame([("abc",)], "x string")
    plan = S.edit_pairs(a, a.withColumnRenamed("x", "y"), "x", "y", 0.7)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        S.edit_pairs(a, a.withColumnRenamed("x", "y"), "x", "y", 0.5)


def _sets(rng, n, hot):
    return [sorted({hot, *(f"t{int(rng.paretovariate(0.5)) % 60}" for _ in range(rng.randint(0, 6)))} - ({hot} if rng.random() < 0.05 else set())) for _ in range(n)]


SCORES = {"overlap": lambda a, b: len(a & b) / max(len(a), len(b)), "jaccard": lambda a, b: len(a & b) / len(a | b), "containment": lambda a, b: len(a & b) / min(len(a), len(b))}


@pytest.mark.parametrize("kind", SCORES)
@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_set_pairs_are_all_pairs(spark, kind, least):
    rng = random.Random(3)
    left, right = _sets(rng, 80, "all"), _sets(rng, 80, "all")
    a = spark.createDataFrame([*enumerate(left), (99, None), (98, [])], "id int, t array<string>")
    b = spark.createDataFrame([*enumerate(right), (99, [])], "other int, u array<string>")
    got = {(r.id, r.other): (r.common, r.score) for r in S.set_pairs(a, b, kind, least).collect()}
    sets = [(i, j, set(x), set(y)) for i, x in enumerate(left) for j, y in enumerate(right) if x and y]
    assert got == {(i, j): (len(x & y), round(SCORES[kind](x, y), 6)) for i, j, x, y in sets if SCORES[kind](x, y) >= least - 1e-9}


def test_a_token_of_all_names_makes_no_pairs(spark):
    """1,000 names with one common token: candidates that leave the join on tokens, by the plan's metrics."""
    names = spark.range(1000).select(F.col("id"), F.array(F.lit("all"), F.concat(F.lit("own"), F.col("id")), F.concat(F.lit("pair"), F.floor(F.col("id") / 2).cast("string"))).alias("t"))
    right = names.select(F.col("id").alias("other"), F.col("t").alias("u"))
    out = S.set_pairs(names, right, "jaccard", 0.5)
    rows = out.collect()
    assert len(rows) == 2000
    joined = _join_rows(out)
    assert joined and max(joined) <= 3000 * 2  # a row per token and a few pairs; all pairs would be a million
    best = S.top_sharing(names, right, lambda c, n, m: F.size(c) / F.greatest(n, m), 3, frequent=20)
    rows = best.collect()
    assert len(rows) == 3000 and max(_join_rows(best)) <= 20_000


def _join_rows(df):
    """Output rows of every join of an executed plan."""
    found = []

    def walk(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        name = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        kids = node.children()
        for k in inner + [kids.apply(i) for i in range(kids.size())]:
            walk(k)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("frequent", [0, 3, 25, 1000])
def test_top_sharing_is_the_best_of_all_pairs(spark, frequent):
    rng = random.Random(frequent)
    left, right = _sets(rng, 60, "all"), _sets(rng, 120, "all")
    side = lambda k: "xy"[k % 2] if k % 7 else None
    a = spark.createDataFrame([(i, side(i), s) for i, s in enumerate(left)], "id int, d string, t array<string>")
    b = spark.createDataFrame([(i, side(i), s) for i, s in enumerate(right)], "other int, e string, u array<string>")
    score = lambda c, n, m: F.round(F.size(c) / F.greatest(n, m) + F.when(F.col("d") == F.col("e"), 0.15).otherwise(0.0), 4)
    got = {}
    for r in S.top_sharing(a, b, score, 3, ("d",), ("e",), frequent).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.score))
    want = {}
    for i, s in enumerate(left):
        found = [(round(len({*s} & {*t}) / max(len(s), len(t)) + (0.15 if side(i) and side(i) == side(j) else 0), 4), j) for j, t in enumerate(right) if {*s} & {*t}]
        if found:
            want[i] = [(j, v) for v, j in sorted(found, key=lambda x: (-x[0], x[1]))[:3]]
    assert got == want


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_a_beginning_that_all_names_share_makes_no_pairs(spark, least):
    """2,000 x 500 names that begin alike: the rows that leave the joins, by the plan's metrics."""
    a = spark.range(2000).select(F.col("id"), F.concat(F.lit("00000"), (F.col("id") * 7919 % 100003).cast("string")).alias("x"))
    b = spark.range(500).select(F.col("id").alias("other"), F.concat(F.lit("00000"), (F.col("id") * 104729 % 100003).cast("string")).alias("y"))
    out = S.edit_pairs(a, b, "x", "y", least)
    got = out.count()
    want = a.crossJoin(b).filter(F.levenshtein("x", "y") <= F.greatest(F.length("x"), F.length("y")) * (1 - least) + 1e-6).count()
    assert got == want
    out.collect()
    assert max(_join_rows(out)) <= 100_000  # all pairs are a million
