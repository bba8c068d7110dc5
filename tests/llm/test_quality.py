import re
from collections import Counter

import pytest

from tallyforge.llm import quality as Q
from tallyforge.llm.queries import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def _counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    cover = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "a b c a b c", "x y z", "l1\nl1\n\n \nl2\nl1", "é中 #|<>", "a b c d " * 300, "one two three\rone two three", "w " * 5000]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, lang string, source string, n_words string")
    got = {r.doc_id: tuple(r)[3:8] for r in Q.measures(df).collect()}
    assert got == {i: _counts(t) for i, t in enumerate(TEXTS)}


def test_outliers_of_a_group_go(spark):
    good = [(i, " ".join(f"word{(i * 31 + j) % 997}" for j in range(80 + i % 9)), "en", "s") for i in range(60)]
    bad = [(100, " ".join(f"w%%%%{j}" for j in range(90)), "en", "s"), (101, " ".join("x" * 40 + str(j) for j in range(90)), "en", "s"), (102, "short", "en", "s")]
    kept = {r.doc_id: r.kept for r in Q.quality(spark.createDataFrame(good + bad, "doc_id int, text string, lang string, source string")).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "a b", "en", None)], "doc_id int, text string, lang string, source string")
    assert [r.kept for r in Q.quality(df).collect()] == [False, False]
    assert Q.quality(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"pipeline"}))
def test_query_equals_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck.sql(ORACLES[name]))
