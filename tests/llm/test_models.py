"""Trained operators: gradients, held-out accuracy, awkward rows."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from tallyforge.llm import lm_scores as L
from tallyforge.llm import toxicity as T
from tallyforge.llm.base import WordHashes

rng = random.Random(6)
VOICES = [f"wo{i}" for i in range(300)]


def _docs(n):
    out = []
    for i in range(n):
        w = [rng.choice(VOICES) for _ in range(rng.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grumble", "grumblest", "fzzark"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def _numeric(loss, p, picks, eps=1e-2):
    out = []
    for k, i in picks:
        v = p[k].reshape(-1)
        old = v[i]
        v[i] = old + eps
        a = loss()
        v[i] = old - eps
        b = loss()
        v[i] = old
        out.append((a - b) / (2 * eps))
    return np.array(out)


def test_toxicity_gradients():
    net = T.Network()
    for k in ("words", "chars"):
        net.p[k] *= 10
    f = T.Features(["a bb ccc dd", "e ff", "gg h " * 12], WordHashes())
    first, n, _ = f.windows()
    y = np.array([1, 0, 1], np.float32)[: len(first)]
    g, _ = net._gradients(f, first, n, y)
    r = np.random.default_rng(0)
    picks = [(k, int(r.integers(v.size))) for k, v in net.p.items() if k not in ("words", "chars") for _ in range(4)]
    picks += [("words", int(f.words[0]) * T.DIM + 2), ("chars", int(f.chars[1]) * T.DIM + 1)]
    got = np.array([g[k].reshape(-1)[i] for k, i in picks])
    assert got == pytest.approx(_numeric(lambda: net._gradients(f, first, n, y)[1], net.p, picks), abs=2e-3)


def test_toxicity_pieces_hold_the_windows_of_a_text():
    texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 400, 2000)] + ["x" * 5000 + " y " + "z" * 9000, " \n ", None]

    def windows(f, owners):
        first, n, piece = f.windows()
        return sorted((int(owners[p]), f.words[a : a + k].tobytes()) for a, k, p in zip(first, n, piece, strict=True))

    whole = windows(T.Features(texts, WordHashes()), np.arange(len(texts)))
    for most in (200, 700, 5000, 1 << 18):
        cut = [w for owners, held in T.slices(texts, most) for w in windows(T.Features(held, WordHashes()), owners)]
        assert sorted(cut) == whole
    net = T.Network()
    a = net.highest(texts, WordHashes())
    T.SLICE, old = 700, T.SLICE
    try:
        assert net.highest(texts, WordHashes()) == pytest.approx(a, abs=1e-5)
    finally:
        T.SLICE = old


@pytest.mark.parametrize("kb", [2, 200, 20_000])
def test_toxicity_training_memory(kb):
    """Tasks of the training need the same memory whatever the length of the texts."""
    code = f"""
import resource, random
import numpy as np, pyarrow as pa
from tallyforge.llm import toxicity as T
from types import SimpleNamespace as S
r = random.Random(1)
base = " ".join("word%d" % r.randint(0, 3000) for _ in range({kb} * 125))[: {kb} * 1000]
n, per = {{2: (5000, 1000), 200: (80, 40), 20000: (1, 1)}}[{kb}]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
batches = lambda: (pa.RecordBatch.from_pydict({{"label": pa.array([i % 2 for i in range(at, at + per)], pa.int32()), "doc_id": pa.array(range(at, at + per), pa.int64()), "text": ["%d " % i + base for i in range(at, at + per)]}}) for at in range(0, n, per))
before = peak()
for b in T._occurrences(batches()): pass
odds = {{"words": np.zeros(1 << T.WORD_BITS, np.float32), "chars": np.zeros(1 << T.CHAR_BITS, np.float32)}}
net = T.Network()
net.start(odds)
T.ROUNDS, T.EPOCHS, T.LEAST_STEPS = 1, 1, 2
chosen = list(T._choose(S(value=odds), 0)(batches())) + list(T._choose(S(value=net), 1)(batches()))
list(T._fit(S(value=net), 0)(iter(chosen)))
list(T._highest(S(value=net))(batches()))
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500, out.stdout


def test_toxicity_on_held_out_rows(spark):
    rows = _docs(900)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, ""), (5001, None), (None, "grumble")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, 0) for i, _, t in rows], "doc_id long, toxic int, score int")
    out = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.97
    assert out[5000].predicted == 0 and out[5001].predicted == 0 and out[5000].score == out[5001].score
    assert out[None].predicted == 1


def test_toxicity_without_labels_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", [1]), (2, None, None)], "doc_id long, text string, label array<int>")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.drop_toxic(docs, none).columns == docs.columns and T.drop_toxic(docs, none).count() == 2
    assert T.toxicity(docs.limit(0), none).count() == 0
    same = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in T.toxicity(docs, same).collect()} == {1}


def test_lm_gradients():
    net, ids = L.WindowNetwork(), L.Ids(np.zeros((2, 0), np.uint64))
    seq, place, _ = ids.of(["a b c d e f g", "h i", ""])
    g = net.gradients(seq, place)
    loss = lambda: float(-net.log_probabilities(seq, place).astype(np.float64).mean())
    r = np.random.default_rng(0)
    picks = [(k, int(r.integers(v.size))) for k, v in net.p.items() if k not in ("tables", "R") for _ in range(4)]
    t = int(seq[place[0]])
    picks += [("tables", (2 * L.IDS + int(seq[place[0] - 1])) * L.HIDDEN + 3), ("R", (t // L.PER) * L.HIDDEN * L.PER + t % L.PER)]
    got = np.array([g[k].reshape(-1)[i] for k, i in picks])
    assert got == pytest.approx(_numeric(loss, net.p, picks), abs=2e-3)


def test_lm_probabilities_sum_to_one():
    net, ids = L.WindowNetwork(1), L.Ids(np.zeros((2, 0), np.uint64))
    seq, place, _ = ids.of(["a b c d"])
    at, total = place[1], 0.0
    for i in range(L.IDS):  # the masked word itself must not matter to its context
        s = seq.copy()
        s[at] = i
        total += float(np.exp(net.log_probabilities(s, np.array([at]))[0]))
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_prefers_the_language_it_saw(spark):
    def text(order):
        w = []
        for _ in range(60):
            w += order if rng.random() < 0.9 else [rng.choice(order)]
        return " ".join(w)

    rows = [(i, text(["one", "two", "three", "four", "five"])) for i in range(300)]
    odd = [(1000, " ".join(["five", "one", "four", "two", "three", "one"] * 50)), (1001, None), (1002, " "), (None, "one")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(2)
    out = {r.doc_id: r for r in L.lm_scores(docs).collect()}
    assert np.mean([out[i].mean_log_probability for i in range(300)]) > out[1000].mean_log_probability + 0.5
    assert (out[1001].n_words, out[1001].log_likelihood, out[1001].mean_log_probability) == (0, 0.0, None)
    assert out[3].log_likelihood == pytest.approx(out[3].mean_log_probability * out[3].n_words)


def test_lm_counts_and_averages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "A a b"), (2, "b\tb c"), (3, None)], "doc_id long, text string")
    assert sorted(r.n for r in L.word_counts(docs).collect()) == [1, 2, 3]
    monkeypatch.setattr(L, "FAN", 2)
    net = L.train(docs.repartition(3), L.vocabulary(docs))
    assert np.isfinite(net.p["tables"]).all()
    assert L.lm_scores(docs.limit(0)).count() == 0


def test_lm_every_word_has_its_own_probability(spark, monkeypatch):
    known = [f"known{i}" for i in range(L.WORDS)]
    rare = [f"rare{i}" for i in range(2000)]
    rows = [(i, " ".join(known)) for i in range(12)] + [(100 + i, " ".join(rare[: 1 + i * 250])) for i in range(9)]
    rows += [(500, " ".join(f"gibberish{i}" for i in range(300))), (None, "rare0 known1"), (None, "rare0 known1"), (502, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = {r.h: r.n for r in L.word_counts(docs).collect()}
    vocab = L.vocabulary(docs)
    rows_of_leaves, unseen = L.leaves(L.word_counts(docs), vocab)
    leaf = {r.h: r.lp for r in rows_of_leaves.collect()}
    assert len(leaf) == len(counts) - L.WORDS == 2300 - (L.WORDS - len(known))
    each = np.exp(unseen).tolist()
    for h, lp in leaf.items():
        each[h % L.SHARED_IDS] += float(np.exp(lp))
    assert each == pytest.approx([1.0] * L.SHARED_IDS)  # so all words of the corpus sum to one
    ordered = lambda rows: sorted(map(tuple, rows), key=str)
    out = ordered(L.lm_scores(docs).collect())
    scores = {r[0]: r[3] for r in out if r[3] is not None}
    assert scores[101] > scores[500] + 0.5  # repeated rare words against words seen once
    monkeypatch.setattr(L, "LEAVES", 0)
    joined = ordered(L.lm_scores(docs).collect())
    assert [r[:2] for r in joined] == [r[:2] for r in out] and len(out) == len(rows)
    assert [r[2] for r in joined] == pytest.approx([r[2] for r in out], rel=0.02)


def test_lm_beats_word_frequencies_on_unseen_texts(spark, monkeypatch):
    """Texts that the model was not made of: their words are likelier by context than by frequency."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text is not null").dropDuplicates(["text"])
    seen, new = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    count, total = {}, 0
    hasher = WordHashes()
    for r in seen.collect():
        for h in hasher.of([r.text])[0].tolist():
            count[h] = count.get(h, 0) + 1
            total += 1
    plain, words = 0.0, 0
    for r in new.collect():
        h = hasher.of([r.text])[0].tolist()
        plain += sum(np.log(count.get(x, 1) / (total + 1)) for x in h)
        words += len(h)
    out = L.lm_scores(new, seen).collect()
    assert sum(r.n_words for r in out) == words
    assert sum(r.log_likelihood for r in out) / words > plain / words + 0.02
    monkeypatch.setattr(L, "LEAVES", 0)
    joined = {r.doc_id: r.log_likelihood for r in L.lm_scores(new, seen).collect()}
    assert joined == pytest.approx({r.doc_id: r.log_likelihood for r in out}, rel=0.02, abs=1)


def test_lm_training_does_not_follow_the_files(spark):
    order = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(order * 5)) for i in range(600)], "doc_id long, text string")
    mean = [np.mean([r.mean_log_probability for r in L.lm_scores(docs.repartition(n)).collect()]) for n in (1, 60)]
    assert abs(mean[0] - mean[1]) < 0.1 and min(mean) > -2.5


def test_lm_blocks_hold_every_word_once_with_its_context(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    vocab = np.zeros((2, 0), np.uint64)
    texts = ["a b c d e f g h i j k l m n o p", None, "", "q", "r s t " * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = L.blocks(docs, vocab).orderBy("k").collect()
    seq, place = L._joined([bytes(r.ids) for r in got])
    whole, at, _ = L.Ids(vocab).of(texts)
    around = lambda s, p: [s[x - L.SIDE : x + L.SIDE + 1].tolist() for x in p]
    assert sum(r.n for r in got) == len(at) and around(seq, place) == around(whole, at)
