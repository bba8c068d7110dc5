"""Token alignment against a plain version that compares byte ranges of all tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallyforge.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "a ", " a  b ", "Hello  world\n\n<|endoftext|> it's </s> <s> <0x0A>", "a▁b", "▁", "中文 ñandú 123 🙂  x​ y", "word.\n Next  line\t end \r\n", "é ﬁ",
    "same text here", "same text here", "tab\tx  \t y", "  a　 b\x85 c", "x" * 3000, "lorem ipsum dolor " * 300, "a\x00b c", "don't we'll   'tis", "\n", "\n a",
]


def _library():
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = {c: k for k, c in A.BYTES.items()}
    sizes = lambda text: ([(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    return sizes


def _ranges(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def plain(texts):
    """Rows without doc_id, and the pair counts, token range by token range."""
    encode, rows, counts = _library(), [], Counter()
    for t in texts:
        a, b = encode(t) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append(None)
            continue
        a, b = list(_ranges(a)), list(_ranges(b))
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([x for x, s, e in a if lo <= s and e <= hi], [y for y, s, e in b if lo <= s and e <= hi]) for lo, hi in zip([0, *both], both, strict=False)]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts.update(links)
        rows.append((len(a), len(b), groups, links, hashlib.sha256(text.encode()).hexdigest()))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in rows]
    return out, counts, rows


@pytest.mark.parametrize("links", [A.CHUNK_LINKS, 50])
def test_equals_plain(spark, monkeypatch, links):
    monkeypatch.setattr(A, "CHUNK_LINKS", links)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment(df, *PATHS).collect()}
    expected, _, _ = plain(TEXTS)
    assert [got[k] for k in range(len(TEXTS))] == expected


def test_groups_are_the_plain_ones(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    _, _, rows = plain(TEXTS)
    got = {}
    for r in A.groups(df, *PATHS).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.a, r.b))
        assert r.start < r.end
    assert got == {k: r[2] for k, r in enumerate(rows) if r}


def test_ids_that_lack_or_repeat_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, A.alignment(df, *PATHS).collect()), key=str)
    assert [r[0] for r in rows] == [1, 1, 2, None] and rows[0] == rows[1] and rows[0][1:] == rows[3][1:] and rows[0][6] == 3 * rows[0][4]
    assert A.alignment(df.limit(0), *PATHS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet=" aB.é\n\t'1 ▁", max_size=30), max_size=6))
def test_pieces_give_what_whole_texts_give(texts):
    pair, encode = A._pair(*PATHS), _library()
    for t, found in zip(texts, pair.of(texts), strict=True):
        if found:
            a, b = encode(t)
            sides = [g.split("|") for g in b"".join(x[0] for x in found).decode()[:-1].split(";")]
            assert [int(i) for x, _ in sides for i in x.split(",")] == [i for i, _ in a]
            assert [int(i) for _, y in sides for i in y.split(",")] == [i for i, _ in b]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.data())
def test_merge_of_ends(sizes, data):
    a = np.cumsum(sizes)
    cut = data.draw(st.sets(st.integers(1, int(a[-1]) - 1), max_size=20)) if a[-1] > 1 else set()
    b = np.array(sorted(cut | {int(a[-1])}))
    i, j, both = A.merged_ends(a, b)
    start = lambda x: np.append(0, x[:-1])
    pairs = [(p, q) for p in range(len(a)) for q in range(len(b)) if start(a)[p] < b[q] and start(b)[q] < a[p]]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == pairs
    assert both.sum() == len(set(a.tolist()) & set(b.tolist()))
