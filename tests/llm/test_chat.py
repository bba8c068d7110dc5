import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def _model(seed=2):
    r = np.random.default_rng(seed)
    start, step, tables = C.Model.prior()
    return C.Model.of(start + r.random(C._S), step + r.random((C._S, C._S)) * (step > 0), r.random((C.CODES, C._S)) * 3)


def _paths(model, seq, start):
    """Every path of states and its probability."""
    for path in itertools.product(range(C._S), repeat=len(seq)):
        lp = start[path[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(path)) + sum(model.emission[c, s] for c, s in zip(seq, path, strict=True))
        if lp > -np.inf:
            yield path, float(np.exp(lp))


def test_viterbi_and_expected_counts_equal_enumeration():
    model, r = _model(), np.random.default_rng(5)
    seqs = [r.integers(0, C.CODES, n) for n in (1, 4, 2, 0, 4, 3)]
    before = np.array([-1, -1, 2, -1, 4, -1])
    got = C.decode(model, seqs, before, np.full(6, -1))
    for s, b, states in zip(seqs, before, got, strict=True):
        if len(s):
            best = max(_paths(model, s, model.start if b < 0 else model.step[b]), key=lambda x: x[1])
            assert tuple(states) == best[0]
    later = np.array([False, True, False, False, False, True])
    start, step, codes = np.zeros(C._S), np.zeros((C._S, C._S)), np.zeros((C.CODES, C._S))
    for s, go in zip(seqs, later, strict=True):
        if len(s):
            found = list(_paths(model, s, np.full(C._S, -np.log(C._S)) if go else model.start))
            total = sum(p for _, p in found)
            for path, p in found:
                start[path[0]] += 0 if go else p / total
                for a, b in itertools.pairwise(path):
                    step[a, b] += p / total
                for c, k in zip(s, path, strict=True):
                    codes[c, k] += p / total
    for x, y in zip(C.expected(model, seqs, later), (start, step, codes), strict=True):
        assert x == pytest.approx(y, abs=1e-9)


def test_markers():
    lines = [("Human: hi", 1, "hi"), ("**Assistant:** yes", 2, "yes"), ("<|system|> be nice", 3, "be nice"), ("### Instruction: do", 3, "do"), ("[Q]: why", 1, "why"), ("Note: x", 4, "Note: x"), ("plain", 0, "plain"), ("<|user|>", 1, "")]
    for line, mark, body in lines:
        code, got = C.seen(line, False)
        assert (C._VALUES[0][code], got) == (mark, body)
    assert C._VALUES[1][C.seen("a", True)[0]] == 1 and C._VALUES[3][C.seen("a? ", False)[0]] == 1 and C._VALUES[4][C.seen("- a", False)[0]] == 1


def _conversations(n, rng):
    out = []
    for conv in range(n):
        turn = 0
        if rng.random() < 0.3:
            out.append((conv, turn, "system", "s" + " s" * rng.randint(4, 15)))
            turn = 1
        for k in range(rng.randint(2, 9)):
            who = ("user", "assistant")[k % 2]
            lines = [" ".join([who[0]] * (rng.randint(2, 12) if who == "user" else rng.randint(15, 60))) for _ in range(1 if who == "user" else rng.randint(1, 5))]
            out.append((conv, turn + k, who, "\n".join(lines) + ("?" if who == "user" and rng.random() < 0.5 else "")))
    return out


def _lines(rows):
    """(role, line) of rendered turns in order, without blank lines."""
    return [(r.role, x) for r in rows for x in r.rendered.split("\n")[1:-1] if x.strip()]


def _accuracy(spark, rows, hidden, model=None):
    """Share of lines with the right role, over all turns and over those whose speaker is left out."""
    df = spark.createDataFrame(rows, TURNS)
    shown = {(r.conv_id, r.turn): r.shown for r in df.select("conv_id", "turn", (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) >= hidden).alias("shown")).collect()}
    out = C.parse_transcripts(C.transcripts(df, hidden)).orderBy("conv_id", "part", "turn").collect()
    got = {k: _lines(g) for k, g in itertools.groupby(out, lambda r: r.conv_id)}
    right = {True: [], False: []}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: r[:2]), lambda r: r[0]):
        want = [(role, line, shown[conv, turn]) for _, turn, role, text in group for line in text.split("\n") if line.strip()]
        assert [x[1] for x in got[conv]] == [x[1] for x in want]  # no line is lost, none changed
        for (role, _), (true, _, visible) in zip(got[conv], want, strict=True):
            right[visible].append(role == true)
    return np.mean(right[True]), np.mean(right[False] or [1])


def test_roles_of_hidden_speakers(spark):
    """The model sees no role; speakers are left out of 20 and of 50 turns in a hundred."""
    rows = _conversations(400, random.Random(3))
    for hidden, least in ((20, 0.97), (50, 0.93)):
        seen, blind = _accuracy(spark, rows, hidden)
        assert seen > 0.99 and blind > least


def test_roles_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    seen, blind = _accuracy(spark, rows, 20)
    print("table", seen, blind)
    assert seen > 0.99 and blind > 0.9


def test_parts_are_decoded_as_one(spark, monkeypatch):
    """Cut into parts of one or a few lines, and combined two at a time, the same states come out."""
    monkeypatch.setattr(C, "FAN_BITS", 1)
    rng, model = random.Random(1), _model(7)
    monkeypatch.setattr(C, "learn", lambda codes: model)
    pool = ["Human: a", "b c d", "", "Bot: e?", "- f g h i j", "x " * 40, "Note: k"]
    whole, cut = [], []
    for conv in range(12):
        lines = [rng.choice([p for p in pool if p]) for _ in range(rng.randint(2, 23))]
        whole.append((conv, "\n\n".join(lines)))
        at, part = 0, -3
        while at < len(lines):
            n = rng.randint(1, 3)
            cut.append((conv, part, "\n\n".join(lines[at : at + n])))  # a row begins as if after a blank line
            at, part = at + n, part + rng.randint(1, 5)
    one = C.parse_transcripts(spark.createDataFrame(whole, "conv_id long, text string")).orderBy("conv_id", "turn").collect()
    parts = C.parse_transcripts(spark.createDataFrame(cut, "conv_id long, part long, text string")).orderBy("conv_id", "part", "turn").collect()
    assert [(r.conv_id, *x) for r in one for x in _lines([r])] == [(r.conv_id, *x) for r in parts for x in _lines([r])]
    assert len(one) == sum(not r.goes_on for r in parts)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    rows = [(7, 3, "user", f"u {i % 50}") for i in range(5000)] + [(7, t, "assistant", "yes " * 30) for t in range(200)] + _conversations(20, random.Random(4))
    out = C.transcripts(spark.createDataFrame(rows, TURNS)).collect()
    parts = [r for r in out if r.conv_id == 7]
    assert sum(len(r.text.split("\n\n")) for r in parts) == 5200 + sum(r[0] == 7 for r in rows[5200:])
    assert max(len(r.text.split("\n\n")) for r in parts) < 1500 and len(parts) > 60
    got = C.format_chats(spark.createDataFrame(rows, TURNS)).filter("conv_id = 7").collect()
    assert sum(len(_lines([r])) for r in got) == sum(r[3].count("\n") + 1 for r in rows if r[0] == 7)


def test_awkward_rows(spark):
    rows = [(None, "User: a\n\nBot: b"), (None, "User: a\n\nBot: b"), (3, None), (4, "  \n\n "), (5, "one <|user|> two"), (6, "x" * 3_000_000 + "\nBot: " + "y " * 500_000)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, text string, Role string, turn int")
    out = C.parse_transcripts(df).collect()
    assert [len([r for r in out if r.conv_id == k]) for k in (None, 3, 4, 5)] == [4, 0, 0, 1]
    assert [r.rendered for r in out if r.conv_id == 5][0].split("\n")[1] == "one < |user|> two"
    assert sum(len(r.rendered) for r in out if r.conv_id == 6) > 3_900_000
    assert C.parse_transcripts(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 0, "User: a"), (1, 0, "Bot: b"), (1, 1, "Bot: c"), (2, None, "User: d")], "conv_id long, part long, text string")
    assert sorted((r.conv_id, r.role) for r in C.parse_transcripts(twice).collect()) == [(1, "assistant"), (1, "assistant"), (1, "user"), (2, "user")]


def test_rows_without_ids(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (3, None, "assistant", "b"), (3, 0, "user", None), (3, 0, "user", "z"), (4, 0, None, "plain"), (5, 0, "judge", "verdict")]
    out = C.format_chats(spark.createDataFrame([(*r, 0) for r in rows], TURNS + ", part int")).collect()
    assert sorted(x for r in out for _, x in _lines([r])) == ["a", "a", "b", "plain", "verdict", "z"]
    assert C.format_chats(spark.createDataFrame([], TURNS)).count() == 0
