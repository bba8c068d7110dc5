import hashlib
import random

import pytest
from tests.llm import brute

from tallyforge.llm.components import components
from tallyforge.llm.base import Shared
from tallyforge.llm.near_duplicates import drop_near_duplicates, near_duplicates
from tallyforge.llm import near_duplicates as nd
from tallyforge.llm.substrings import SuffixArray, remove_repeats
from tallyforge.llm import substrings as sub


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Shared(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def _sets(rows, k=5):
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def _brute(rows, percent):
    s = _sets(rows)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(s[a] & s[b])
            if s[a] and s[b] and 100 * i >= percent * (len(s[a]) + len(s[b]) - i):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small,block", [(8, 512), (2, 16)])
def test_near_copies_like_brute_force(spark, monkeypatch, small, block):
    """Families of near copies at every similarity around the threshold, and exact copies."""
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
        rows += [(len(rows) + i, " ".join(base).upper()) for i in range(5)]
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "a b"), (len(rows) + 3, "A  b\n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, bands=20).collect()}
    assert got == _brute(rows, 85)


def test_missing_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (5, "a b c d e f", "y", 2), (3, "a b c d e f", "y", 2), (3, "a b c d e f", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, sig int")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "3", "None", "None"]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for trial in range(100):
        t = bytes(rng.choice(b"ab" if trial % 2 else b"\x00abc\xff") for _ in range(rng.randint(1, 400)))
        got = SuffixArray(t, 16).order.tolist()
        assert sorted(got) == list(range(len(t)))
        cut = [t[i : i + 16] for i in got]
        assert cut == sorted(cut)


@pytest.mark.parametrize("hot,large,chunk", [(2000, 20_000, 4 << 20), (3, 20_000, 3000), (3, 4, 3000)])
def test_repeats_like_brute_force(spark, monkeypatch, hot, large, chunk):
    for k, v in (("HOT", hot), ("LARGE", large), ("CHUNK", chunk)):
        monkeypatch.setattr(sub, k, v)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    passages = [text(n) for n in (60, 90, 99, 130, 180, 400)]
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(0, 200)) + rng.choice(passages) + text(rng.randint(0, 50)) + rng.choice(passages[:3])))
    rows += [(60, rows[5][1]), (61, "ab" * 400), (62, "ab" * 300), (63, ""), (64, None), (65, "x" * 99), (66, "x" * 99), (67, rows[5][1][:-3])]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.remove_repeats(rows)


def test_repeats_without_or_with_equal_ids(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdef") for _ in range(200))
    out = remove_repeats(spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (4, "short")], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 200, 200, 200]
    assert next(r for r in out if r.doc_id == 4 and r.n_bytes == 5).kept_sha256 == hashlib.sha256(b"short").hexdigest()
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_rows_without_ids_and_of_one_id(spark):
    """Rows without ids follow in the order of the hash of their texts, as do rows of one id."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    passages = [text(n) for n in (120, 180)]
    rows = [(None if i % 2 else 9, text(rng.randint(20, 80)) + rng.choice(passages) + text(9)) for i in range(10_000)] + [(3, passages[0] + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((r.doc_id is None, r.doc_id or 0, r.h, r.text) for r in docs.selectExpr("doc_id", "xxhash64(text) as h", "text").collect())
    expected = brute.remove_repeats([(i, t) for i, (*_, t) in enumerate(order)])
    got = remove_repeats(docs).collect()
    assert sorted((r.doc_id is None, *tuple(r)[1:]) for r in got) == sorted((order[i][0], *x) for i, x in expected.items())


def test_repeats_in_a_text_beyond_a_part(spark):
    rng = random.Random(6)
    passage, part = "".join(rng.choice("abcdefgh") for _ in range(300)), 8 << 20
    long = rng.randbytes(part).hex()
    long = long[: part - 150] + passage + long[part + 150 : part + 400_000]
    out = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, long), (2, f"<{passage}>")], "doc_id long, text string")).collect()}
    assert (out[1].n_removed, out[2].n_removed, out[2].n_spans) == (0, 300, 1)
    assert out[2].kept_sha256 == hashlib.sha256(b"<>").hexdigest()


def test_similar_classes_in_one_bucket(spark, monkeypatch):
    """1,200 unlinked classes that share their buckets: full sets go only to those with a near partner."""
    monkeypatch.setattr(nd, "BLOCK", 128)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        t = list(base)
        for k in rng.sample(range(60), 6):
            t[k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(0, 1200, 300)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, bands=20).collect()}
    assert got == {d: c for d, (_, c) in _brute(rows, 85).items()}
