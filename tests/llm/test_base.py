"""Words, hashes, tables in the shared folder."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import base


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB \t\n\x0b\x0c\r\xa0é中", max_size=30), max_size=5))
def test_word_hashes_follow_the_word_rule(texts):
    h, starts = base.WordHashes().of(texts)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = [re.findall(base.WORD, low(t)) for t in texts]
    assert list(np.diff(starts)) == [len(w) for w in words]
    seen = {}
    for word, x in zip([w for ws in words for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shared_tables_survive_dropping_the_source(spark):
    shared = base.Shared(spark, "t")
    df = shared.save(spark.range(5), "a")
    assert df.count() == 5
    shared.drop("a")


def test_look_up_beyond_the_broadcast_limit(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    small = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    for limit in (100, 0):
        out = {r.v: r.w for r in base.look_up(rows, small, ["k"], limit=limit, salts=4).collect()}
        assert out == {1: 10, 2: 20, 3: None}
