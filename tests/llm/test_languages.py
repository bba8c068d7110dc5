"""Language identification: features and updates against plain versions, held-out accuracy, odd rows."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import languages as L

SF = "/root/testdata/sf0.01"


def _plain_grams(text):
    read = [c.lower() if len(c.lower()) == 1 else c for c in text]
    read = [c if unicodedata.category(t)[0] in "LM" else " " for c, t in zip(read, text, strict=True)]
    s = [c for i, c in enumerate([" ", *read, " "]) if not (c == " " and i and [" ", *read, " "][i - 1] == " ")]
    return Counter("".join(s[i : i + n]) for n in L.LENGTHS for i in range(len(s) - n + 1))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB é.\n1", max_size=80), st.integers(1, 7))
def test_grams_are_those_of_the_text_in_any_slices(text, size):
    whole = np.concatenate(list(L.grams(text)))
    kept, L.SLICE = L.SLICE, size
    try:
        cut = np.concatenate(list(L.grams(text)))
    finally:
        L.SLICE = kept
    assert sorted(whole) == sorted(cut)
    assert sorted(Counter(whole.tolist()).values()) == sorted(_plain_grams(text).values())  # no two of so few collide


def test_update_equals_a_scalar_loop():
    leader, rng = L.Leader(6, 3), np.random.default_rng(1)
    z, n = np.zeros((7, 3)), np.zeros((7, 3))
    for _ in range(60):
        ids = rng.choice(6, 3, replace=False)
        x, label = rng.random(3), int(rng.integers(3))
        leader.learn(ids, x, label)
        at, v = [*ids, 6], [*x, 1.0]
        w = {}
        for i in at:
            for k in range(3):
                l1 = 0 if i == 6 else L.L1
                w[i, k] = 0 if abs(z[i, k]) <= l1 else -(z[i, k] - math.copysign(l1, z[i, k])) / ((L.BETA + math.sqrt(n[i, k])) / L.ALPHA + L.L2)
        logit = [sum(w[i, k] * y for i, y in zip(at, v, strict=True)) for k in range(3)]
        total = sum(map(math.exp, logit))
        for i, y in zip(at, v, strict=True):
            for k in range(3):
                g = y * (math.exp(logit[k]) / total - (k == label))
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / L.ALPHA * w[i, k]
                n[i, k] += g * g
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_penalty_leaves_weights_at_zero():
    leader = L.Leader(2, 2)
    for k in range(50):
        leader.learn(np.array([0, 1]), np.array([1.0 if k % 2 else -1.0, 1e-6]), k % 2)
    w = leader.weights(np.arange(2))
    assert w[0].any() and not w[1].any()


def test_temperature_undoes_a_factor():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, (4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in L.softmax(logits)])
    assert abs(L.temperature(logits * 5, labels) / 5 - 1) < 0.15
    assert L.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_document_frequencies(spark):
    texts = ["ab", "b a", None, "ab ab", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    idf = L.inverse_frequencies(df)
    count = Counter(int(h) for t in texts for h in set(np.concatenate(list(L.grams(t or ""))).tolist()))
    for h, n in count.items():
        assert idf[h] == pytest.approx(math.log(6 / (1 + n)) + 1, rel=1e-6)


def test_held_out_accuracy_and_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in L.languages(docs).collect()}
    assert {r.held_out for r in rows.values()} == {True, False}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[r.doc_id].held_out for r in held)
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    # neither held-out languages nor the way rows are dealt change anything
    moved = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).repartition(5)
    again = {r.doc_id: r for r in L.languages(moved).collect()}
    assert again == rows


def test_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, right, n = L.train(docs), 0, 0
    for r in docs.filter(L.held_out(F.col("doc_id"))).select("text", "lang").collect():
        words = r.text.split()[:8]
        n, right = n + 1, right + (model.predict(" ".join(words))[0] == r.lang)
    assert right >= 0.9 * n


def test_awkward_rows(spark):
    rows = [(k, f"the quick brown thing {k}", "en", "x") for k in range(40)] + [(k + 100, f"der schnelle braune Hund {k}", "de", "x") for k in range(40)]
    rows += [(None, "the thing", "en", "x"), (500, None, "en", "x"), (501, "", None, "x"), (502, "12 34 !?", "de", "x"), (503, "the thing " * 400_000, None, "x"), (504, "中", "en", "x"), (1, rows[1][1], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.languages(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    assert got[500] == got[501] == got[502] == [("und", 0.0)]
    assert got[None][0][0] == got[503][0][0] == "en" and got[504][0][0] in ("en", "de")
    assert L.languages(df.limit(0)).count() == 0
    alone = L.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}
    one = L.languages(df.filter("lang = 'en'")).filter("doc_id < 10").collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
