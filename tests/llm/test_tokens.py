import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm.tokens import EliasFano, Encoder, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    v = np.cumsum(steps)
    ef = EliasFano.encode(v, int(v[-1]))
    assert ef.select(np.arange(len(v))).tolist() == v.tolist()
    some = np.random.default_rng(len(v)).integers(0, len(v), 20)
    assert ef.select(some).tolist() == v[some].tolist()
    size = len(ef.low) + len(ef.high) + ef.samples.nbytes
    assert size * 8 <= len(v) * (2.6 + np.log2(max(2, v[-1] / len(v)))) + 64


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_encoder_equals_the_library(texts):
    enc = _encoder()
    assert [x.tolist() for x in enc(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


_cache = []


def _encoder():
    _cache or _cache.append(Encoder(PATH))
    return _cache[0]


def test_round_trip(spark):
    texts = {3: "Hello  world\n\n<|endoftext|> it's", 1: None, 2: "", 7: "中文 ñandú 123", 5: "same", 6: "same", 9: "x" * 300_000}
    df = spark.createDataFrame([(k, v, "n") for k, v in texts.items()], "doc_id long, text string, start string").repartition(3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in round_trip(df, PATH).collect()}
    tok, start = Tokenizer.from_file(PATH), 0
    for k in sorted(texts):
        ids = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, "d e f")], "doc_id long, text string")
    rows = round_trip(df, PATH).collect()
    assert sorted(r.start for r in rows) == list(np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1])
    assert min(rows, key=lambda r: r.start).doc_id is None


def test_names_far_apart(spark):
    ids = [-(2**63), -5, 0, 7, 7, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)] + [(None, "x"), (None, "y")], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in round_trip(df, PATH).orderBy("start").collect()] == [None, None, *ids]


def test_encoder_on_all_documents_and_letters():
    """Whole texts of documents, and each character from no-break space to the end of Latin Extended-B."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts = [t or "" for t in texts] + [f"a{chr(c)}b {chr(c)} 1{chr(c)}2 .{chr(c)}. {chr(c) * 2}" for c in range(0xA0, 0x250)]
    enc = _encoder()
    assert [x.tolist() for x in enc(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
