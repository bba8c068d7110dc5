"""Merkle trees against a plain version, for sizes around the fan-out's powers and any partitioning."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import merkle as M
from tallyforge.llm.base import Shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, g int"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _steps(levels, pos):
    for level in levels[:-1]:
        run = level[pos - pos % 8 : pos - pos % 8 + 8]
        yield run[: pos % 8], run[pos % 8 + 1 :]
        pos //= 8


def plain(rows):
    """{(doc_id, leaf): [(subroot, root, proof, folded, verified)]}; leaf and claim by hashing fields."""
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = lambda t: H(*map(_field, (doc_id, source, lang, n_chars, t)))  # noqa: B023, E731
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit else text
        trees[lang].append(((doc_id is not None, doc_id or 0), leaf(text), doc_id, leaf(changed)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: _levels([leaf for _, leaf, _, _ in sorted(trees[x])]) for x in langs}
    top = _levels([built[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for pos, (_, leaf, doc_id, claim) in enumerate(sorted(trees[x])):
            steps, folded = [*_steps(built[x], pos), *_steps(top, g)], claim
            for left, right in steps:
                folded = H(*left, folded, *right)
            proof = H(*[d for left, right in steps for d in left + right])
            out.append((doc_id, leaf, built[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def _rows(sizes):
    k = 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += 1
            yield (k * 7919 % 100_003, f"Text {k} É" if k % 11 else None, lang, None if k % 5 == 0 else "s", k, "x", 1)


SIZES = [({"en": 1}, 1), ({"a": 1, "b": 2, "c": 8, "d": 9, "e": 64, "é": 65, "": 520, None: 7, "Z": 63, "zz": 3}, 7), ({f"l{i}": i % 4 + 1 for i in range(70)}, 3)]


@pytest.mark.parametrize(("sizes", "parts"), SIZES, ids=["one leaf", "powers", "many languages"])
def test_equals_plain(spark, sizes, parts):
    rows = list(_rows(sizes))
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted(map(tuple, M.verified(df).collect()), key=str) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None, "x", 1), (None, "", "en", "", 0, "x", 1), (3, "A", "en", "s", 1, "x", 1), (3, "A", "en", "s", 1, "x", 1), (3, "B", "en", "s", 1, "x", 1), (9, "a\u0000b" + "Ab " * 2_000_000, "en", "s", -1, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, M.verified(df).collect()), key=str) == plain(rows)
    empty = M.verified(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_one_repeated_row_is_dealt_to_many_stretches(spark, monkeypatch):
    """A third of the rows are one row; beyond the broadcast bound the joins are by key."""
    rows = [*_rows({"en": 600, "de": 200}), *[(5, "same", "en", "s", 1, "x", 1)] * 400]
    for few in (M.FEW, 1):
        monkeypatch.setattr(M, "FEW", few)
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert sorted(map(tuple, M.verified(df).collect()), key=str) == plain(rows)
    tied = spark.range(1000).select(F.lit(1).alias("k"))
    shared = Shared(spark, "t")
    out = M.numbered(shared.save(tied.repartition(4), "rows"), [], ["k"], shared, "n").withColumn("part", F.spark_partition_id())
    assert sorted(r.pos for r in out.collect()) == list(range(1000))


def test_records_prove_each_other(spark):
    """Every node record is the hash of its children, and they are those of the height below."""
    rows = list(_rows({"en": 700, "de": 65}))
    _, heights, roots = M.manifest(spark.createDataFrame(rows, SCHEMA))
    below = None
    for h in heights:
        now = {(r.g, r.idx): r for r in h.collect()}
        for (g, idx), r in now.items():
            assert H(bytes(r.children).hex()) == bytes(r.digest).hex()
            if below is not None:
                assert bytes(r.children) == b"".join(bytes(below[g, idx * 8 + k].digest) for k in range(len(r.children) // 32))
        below = now
    assert {r.lang: r.n for r in roots.collect()} == {"en": 700, "de": 65}


@pytest.mark.parametrize(("first", "n"), [(0, 64), (3, 64), (5, 2), (8, 8), (15, 100), (63, 2)])
def test_range_leaves_unaligned_edges(first, n):
    """Records are the complete aligned runs; peaks are everything else, each exactly once."""
    out = []
    peaks = M.Range(out, 8)
    for i in range(first, first + n):
        peaks.push(i, hashlib.sha256(str(i).encode()).digest())
    peaks.close()
    covered = sorted(p for height, idx, _, _, peak in out if peak for p in range(idx * 8**height, (idx + 1) * 8**height))
    assert covered == list(range(first, first + n))
    records = {(h, i) for h, i, _, _, peak in out if not peak}
    assert records == {(h, i) for h in (1, 2) for i in range(200) if first <= i * 8**h and (i + 1) * 8**h <= first + n}
