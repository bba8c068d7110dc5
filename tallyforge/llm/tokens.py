"""Token ids in binary files with Elias-Fano document boundaries.

A file is one partition of the corpus in ascending document order, as rows of blocks. A block holds
about ``BLOCK_IDS`` ids of whole documents: the concatenated ids (little-endian, two bytes wide
where the vocabulary allows it), and two Elias-Fano sequences, the ends of its documents and their
doc_ids: the low bits packed, the high parts as a unary bit string, and a select sample for every
64th number. That is at most 2 + log2(ids / documents) bits a document plus half a bit for the
samples; no 64-bit table of offsets or names exists. A reader finds where documents begin and end,
and who they are, by select. The rows are kept in Parquet so that Spark's commit protocol makes the files
whole in any store, and because a lost task is simply run again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.llm.base import Shared, arrow_batches, look_up

BLOCK_IDS = 1 << 18
SAMPLE = 64
BLOCKS = "part int, block int, part_start long, n_ids long, width int, ids binary, n_docs int, ends struct<n:int,low_bits:int,low:binary,high:binary,samples:binary>, n_nameless int, first_name long, names struct<n:int,low_bits:int,low:binary,high:binary,samples:binary>"
#: The place of the k-th one among the bits of each byte.
_ONES = np.array([([b for b in range(8) if byte >> b & 1] + [8] * 8)[:8] for byte in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of n numbers up to ``top``; ``select(i)`` returns the numbers at places i."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, np.frombuffer(samples, "<u4")

    @staticmethod
    def encode(values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        v = np.asarray(values, np.uint64)
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (int(top) >> low_bits) + 1, np.uint8)
        high[ones] = 1
        pack = lambda b: np.packbits(b.ravel(), bitorder="little").tobytes()
        return EliasFano(n, low_bits, pack(bits), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def row(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "low": self.low, "high": self.high, "samples": self.samples.tobytes()}

    def select(self, i: np.ndarray) -> np.ndarray:
        """Each starts at the sample before it and counts ones from there, byte by byte, all places at
        a time; numbers of 2**63 and more come out as negative ones."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        high, low = np.frombuffer(self.high, np.uint8), np.frombuffer(self.low, np.uint8)
        at = self.samples[i // SAMPLE].astype(np.int64)
        byte, left = at >> 3, i % SAMPLE
        word = high[byte] & (np.uint8(255) << (at & 7).astype(np.uint8))
        live = np.arange(len(i))
        while len(live):
            ones = np.bitwise_count(word[live]).astype(np.int64)
            live, ones = live[ones <= left[live]], ones[ones <= left[live]]
            left[live] -= ones
            byte[live] += 1
            word[live] = high[byte[live]]
        out = (byte * 8 + _ONES[word, left] - i) << self.low_bits
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            out |= (low[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(np.int64) << b
        return out


#: Letters, digits and white space among the characters below U+0250 that ODD lets pass.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r"
#: How byte-level tokenizers split a text before they merge (a fixed rule of that format). The
#: alternatives before the letters need an apostrophe, which letters don't start with, so letters,
#: the most frequent, may come first.
SPLIT = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Other characters, on whose classes regular expression engines may differ.
ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\u024f]")
CACHED = 600_000


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else
    the next one from 256 on (a fixed rule of that format)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_characters()


class Encoder:
    """A tokenizer of the tokenizers library with a table of the pieces that it has encoded.

    Merges never cross the pieces into which a byte-level tokenizer first splits a text, so the ids
    of a text are those of its pieces in a row. Pieces not yet in the table are encoded by the
    library's model. Texts with characters that engines may class differently, or with the
    string of an added token, and all texts of other kinds of tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        first = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tok_model = self.tok.model
        self.split, self.table = SPLIT.findall, {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.table) > CACHED:
            self.table.clear()
        for piece in pieces:
            if piece not in self.table:
                merged = self.tok_model.tokenize(piece.encode("utf-8").decode("latin-1").translate(BYTES))
                self.table[piece] = array("I", [t.id for t in merged]).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_piece and not ODD.search(t) and not any(a in t for a in self.added)]
        pieces = [self.split(texts[i]) for i in plain]
        self._learn(set().union(*pieces))
        for i, own in zip(plain, pieces, strict=True):
            out[i] = np.frombuffer(b"".join(map(self.table.__getitem__, own)), np.uint32)
        whole = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end_id: int, block_ids: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        width = 2 if max(encode.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, block, done = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0
        sequence = pa.struct([("n", pa.int32()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("n_docs", pa.int32()), ("ends", sequence), ("n_nameless", pa.int32()), ("first_name", pa.int64()), ("names", sequence)])

        def flush():
            nonlocal block, done, ids, docs, held
            ends = EliasFano.encode(np.cumsum([len(x) for x in ids]), held)
            named = np.array([d for d in docs if d is not None], np.int64)
            first = int(named[0]) if len(named) else 0
            steps = named.view(np.uint64) - np.array(first).astype(np.int64).view(np.uint64)
            names = EliasFano.encode(steps, int(steps[-1]) if len(steps) else 0)
            data = np.concatenate(ids).astype(f"<u{width}").tobytes()
            row = {"part": part, "block": block, "part_start": done, "n_ids": held, "width": width, "ids": data, "n_docs": len(docs), "ends": ends.row(), "n_nameless": len(docs) - len(named), "first_name": first, "names": names.row()}
            block, done, ids, docs, held = block + 1, done + held, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                for name, found in zip(names[at : at + 64], encode([t or "" for t in texts[at : at + 64]]), strict=True):
                    x = np.append(found, np.uint32(end_id))
                    ids.append(x)
                    docs.append(name)
                    held += len(x)
                    if held >= block_ids:
                        yield flush()
        if docs:
            yield flush()

    return task


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs (doc_id, text) and write the block files to ``path``.

    A null or empty text is the end id alone. Documents lie in ascending doc_id order, those
    without an id first; rows that repeat an id lie side by side in the order of a hash of their
    texts. A block always holds whole documents, so a very long text makes a longer block. Only id and text
    are shuffled, once, by range; sorting spills.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    rows.mapInArrow(_encode(tokenizer, end_id, block_ids), BLOCKS).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            ids = np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4")
            n, nameless = b["n_docs"], b["n_nameless"]
            ends = EliasFano(**b["ends"]).select(np.arange(n))
            names = EliasFano(**b["names"]).select(np.arange(n - nameless)) + b["first_name"]
            starts = np.concatenate(([0], ends[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * nameless + names.tolist(), pa.int64()), pa.array(starts + b["part_start"] + b["offset"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(ids[s:e]) for s, e in zip(starts, ends, strict=True)], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    The only global state is one row per file (its ids), whose number is that of the write's tasks;
    blocks are decoded where they are read and never shuffled.
    """
    arrow_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    files = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offset = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    out = look_up(blocks.select("part", "part_start", "width", "ids", "n_docs", "ends", "n_nameless", "first_name", "names"), files.select("part", offset.alias("offset")), ["part"])
    return out.mapInArrow(_decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs to the shared folder and read them back."""
    files = Shared(docs.sparkSession, "tokens")
    write_tokens(docs, files.path("ids"), tokenizer, end_id)
    files.drop_at_end("ids")
    return read_tokens(docs.sparkSession, files.path("ids"))
