"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids meet.

Both tokenizers are run over the same bytes (a space and the text). Where a token of both ends, a
group ends; a token of one and a token of the other are linked where their bytes overlap. Merging
the cumulative ends of both sides with two pointers gives both: every distinct end closes exactly
one link, and every shared end closes a group.

Neither tokenizer merges across a space after a visible character, so texts are cut there and the
alignment of each distinct piece is worked out once by the libraries and kept. Documents are packed
in chunks. A chunk names its distinct pairs once, with their number; Spark counts the pairs of all
chunks, finds the highest count of every second id, and joins both back to the pairs of each chunk,
where documents add them up. What is shuffled is a chunk's distinct pairs, not links of documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, arrow_batches
from tallyforge.llm.tokens import BYTES

#: Cuts lie before a space that follows one of these characters: none of them is white space.
PIECE = re.compile(r"(?<=[!-~\xa1-ɏ])(?= )")
CACHED = 200_000
CHUNK_LINKS = 1 << 20
CHUNKS = (
    "chunk bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, "
    "n_pairs binary, slots binary, times binary, a array<int>, b array<int>, n array<bigint>"
)
ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
GROUPS = "doc_id bigint, place bigint, start bigint, end bigint, a array<int>, b array<int>"


def merged_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising lists of ends with the same last one: for each distinct end in order, which
    token of a and of b it lies in, and whether both end there.

    The merge of two sorted runs is a stable sort (linear on runs); each pointer is the number of
    own ends before the place.
    """
    ends = np.concatenate((a, b))
    order = np.argsort(ends, kind="stable")
    ends, own = ends[order], order < len(a)
    last = np.append(ends[1:] != ends[:-1], True)
    i, j = np.cumsum(own), np.cumsum(~own)
    both = np.append(False, ends[1:] == ends[:-1])[last] if len(ends) else last
    i, j, own = i[last], j[last], own[last]
    # the token that ends here has been counted; the one that goes on has not
    ends_a, ends_b = both | own, both | ~own
    return i - ends_a, j - ends_b, both


class Pair:
    """Both tokenizers, and the alignment of the pieces met so far.

    An alignment is (groups as text, links as packed id pairs, tokens of a, of b, groups), or None
    where the joined bytes of one tokenizer's tokens are not the text's.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in BYTES.items()}
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        shown = lambda s: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        self.bytes_a = [shown(self.a.id_to_token(i) or "") for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a)), np.int64), np.array(list(map(len, self.bytes_b)), np.int64)
        self.space = self.b.piece_to_id("▁")
        # the cut is safe for b only if no piece of it goes on with a space
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        numbers = [str(i).encode() for i in range(max(n_a, n_b))]
        self.marked = [x + mark for mark in (b",", b"|", b";") for x in numbers]
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}  # known until ``known`` was last full

    def pieces(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers always end a token."""
        return PIECE.split(" " + text) if self.cuts else [" " + text]

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = [ids if p != " " else [self.space] for p, ids in zip(pieces, self.b.encode([p[1:] for p in pieces], num_threads=1), strict=True)]
        return a, b

    def learn(self, pieces: set[str]) -> None:
        """Align pieces that are not known: the ends of all of them are merged at once, one after another."""
        if len(self.known) > CACHED:
            self.known, self.before = {}, self.known
        known, before, new = self.known, self.before, []
        for p in pieces - known.keys():
            if p in before:
                known[p] = before[p]
            else:
                new.append(p)
        for at in range(0, len(new), 8192):
            self._align(new[at : at + 8192])

    def _align(self, new: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        a, b = self.encode(new)
        for side, shown in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(shown.__getitem__, chain.from_iterable(side))) != b"".join(raw):
                # tokens give other bytes than the text somewhere: piece by piece
                good = [r == b"".join(map(self.bytes_a.__getitem__, x)) == b"".join(map(self.bytes_b.__getitem__, y)) for r, x, y in zip(raw, a, b, strict=True)]
                self.known.update((p, None) for p, g in zip(new, good, strict=True) if not g)
                new, a, b = ([x for x, g in zip(xs, good, strict=True) if g] for xs in (new, a, b))
                break
        n = len(new)
        if not n:
            return
        count_a, count_b = list(map(len, a)), list(map(len, b))
        of_a, of_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        i, j, both = merged_ends(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
        links = self.links(ids_a[i], ids_b[j])
        # tokens in the order in which groups list them, each with what follows it
        last_a, last_b = i[both], j[both]
        group_a, group_b = (np.cumsum(np.bincount(x + 1, minlength=len(y) + 1))[: len(y)] for x, y in ((last_a, ids_a), (last_b, ids_b)))
        place_a, place_b = np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a], np.arange(len(ids_b)) + last_a[group_b] + 1
        token = np.empty(len(ids_a) + len(ids_b), np.int64)
        token[place_a], token[place_b] = ids_a, ids_b
        token[place_a[last_a]] += len(self.marked) // 3
        token[place_b[last_b]] += len(self.marked) // 3 * 2
        text = list(map(self.marked.__getitem__, token.tolist()))
        cut_links = np.append(0, np.cumsum(np.bincount(of_a[i], minlength=n))) * links.itemsize
        cut_text = np.append(0, np.cumsum(np.array(count_a) + count_b)).tolist()
        n_groups, cut_links, packed = np.bincount(of_a[last_a], minlength=n).tolist(), cut_links.tolist(), links.tobytes()
        for k, p in enumerate(new):
            self.known[p] = (b"".join(text[cut_text[k] : cut_text[k + 1]]), packed[cut_links[k] : cut_links[k + 1]], count_a[k], count_b[k], n_groups[k])

    def links(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = 15 if self.link_type is np.uint32 else 32
        return a.astype(self.link_type) << self.link_type(shift) | b.astype(self.link_type)

    @property
    def link_type(self) -> type:
        return np.uint32 if len(self.bytes_b) <= 1 << 15 and len(self.bytes_a) <= 1 << 17 else np.uint64

    def ids(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = links.dtype.type(15 if links.dtype == np.uint32 else 32)
        return (links >> shift).astype(np.int32), (links & ((links.dtype.type(1) << shift) - links.dtype.type(1))).astype(np.int32)

    def of(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """The alignments of each text's pieces in order; none where the text has no tokens."""
        for at in range(0, len(texts), 64):
            own = [self.pieces(t) if t else [] for t in texts[at : at + 64]]
            self.learn(set().union(*own))
            for pieces in own:
                found = list(map(self.known.__getitem__, pieces))
                yield [] if None in found else found


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _packed(paths: tuple[str, str]):
    """Chunks of rows (doc_id, text): what is known of each document, and its distinct pairs by slot."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, part, chunk = _pair(*paths), TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        links: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal docs, links, held, chunk
            owner = np.repeat(np.arange(len(docs), dtype=np.uint64), [len(x) for x in links])
            flat = np.concatenate(links)
            pairs = np.unique(flat)
            slot = np.searchsorted(pairs, flat).astype(np.uint64)
            key = np.sort(owner << np.uint64(32) | slot)
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(heads, len(key)))
            slots = (key[heads] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            n_pairs = np.bincount((key[heads] >> np.uint64(32)).astype(np.int64), minlength=len(docs))
            a, b = pair.ids(pairs)
            ids, n_a, n_b, n_groups, sha = zip(*docs, strict=True)
            row = {"chunk": part << 32 | chunk, "doc_ids": list(ids), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": [len(x) for x in links], "sha": list(sha)}
            row |= {"n_pairs": n_pairs.astype("<u4").tobytes(), "slots": slots.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes()}
            row |= {"a": a, "b": b, "n": np.bincount(slots, weights=times, minlength=len(pairs)).astype(np.int64)}
            docs, links, held, chunk = [], [], 0, chunk + 1
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for frame in frames:
            names = [None if pd.isna(x) else int(x) for x in frame.iloc[:, 0]]
            for name, found in zip(names, pair.of(frame.iloc[:, 1].tolist()), strict=True):
                if found:
                    groups, raw, n_a, n_b, n_groups = zip(*found, strict=True)
                    docs.append((name, sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(b"".join(groups)[:-1]).hexdigest()))
                    links.append(np.frombuffer(b"".join(raw), pair.link_type))
                else:
                    docs.append((name, 0, 0, 0, ""))
                    links.append(np.zeros(0, pair.link_type))
                held += len(links[-1]) + 64
                if held >= CHUNK_LINKS:
                    yield flush()
        if docs:
            yield flush()

    return task


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of chunks with the values of their pairs: twice the count, plus one where it is the best."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            n = len(r.doc_ids)
            value = np.zeros(len(r.slot) if r.slot is not None else 0, np.int64)
            if len(value):
                value[np.asarray(r.slot)] = np.asarray(r.value)
            slots, times = np.frombuffer(r.slots, "<u4"), np.frombuffer(r.times, "<u4").astype(np.int64)
            cut = np.append(0, np.cumsum(np.frombuffer(r.n_pairs, "<u4").astype(np.int64)))
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[cut])  # noqa: B023, E731
            out = {"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links}
            out |= {"n_best": total((value[slots] & 1) * times), "count_sum": total((value[slots] >> 1) * times), "groups_sha256": r.sha}
            if n:
                yield pd.DataFrame(out)


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, n): how many links of all chunks hold each pair of ids."""
    pairs = chunks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", "p.n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row of digests for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    path_a is a byte-level BPE of the tokenizers library, path_b a sentencepiece model with a space
    before the text. n_best counts links whose pair is met most often among the pairs of its b id;
    count_sum adds the counts of all links. Null and empty texts, and those that one of the tokenizers
    does not give back byte by byte, have no tokens: zeros and an empty digest, and nothing to count.
    Rows that repeat are counted each.
    """
    arrow_batches(docs.sparkSession)
    shared = Shared(docs.sparkSession, "alignment")
    chunks = shared.save(_rows_of(docs).mapInPandas(_packed((path_a, path_b)), CHUNKS), "chunks")
    counts = shared.save(pair_counts(chunks), "counts")
    best = counts.groupBy(F.col("b").alias("b2")).agg(F.max("n").alias("most"))  # one row per id of b: its vocabulary bounds it
    counts = counts.join(F.broadcast(best), F.col("b") == F.col("b2")).select(F.col("a").alias("a2"), "b2", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("slot", "p")).select("chunk", "slot", "p.a", "p.b")
    valued = pairs.join(counts, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    back = valued.groupBy(F.col("chunk").alias("chunk2")).agg(F.collect_list(F.struct("slot", "value")).alias("v"))  # a chunk's pairs
    back = back.select("chunk2", F.transform("v", lambda x: x["slot"]).alias("slot"), F.transform("v", lambda x: x["value"]).alias("value"))
    out = chunks.drop("a", "b", "n").join(back, F.col("chunk") == F.col("chunk2"), "left").drop("chunk2")
    return out.mapInPandas(_summed, ROWS)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups themselves, a row each: doc_id, place (from 0), start and end (bytes of a space and the
    text), and the ids of both sides. Texts without tokens have none."""
    arrow_batches(docs.sparkSession)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(path_a, path_b)
        for frame in frames:
            names = [None if pd.isna(x) else int(x) for x in frame.iloc[:, 0]]
            for name, found in zip(names, pair.of(frame.iloc[:, 1].tolist()), strict=True):
                if not found:
                    continue
                sides = [[[int(i) for i in side.split(",")] for side in g.split("|")] for g in b"".join(x[0] for x in found).decode()[:-1].split(";")]
                ends = np.cumsum([pair.size_a[a].sum() for a, _ in sides])
                out = {"doc_id": pd.array([name] * len(sides), dtype="Int64"), "place": range(len(sides)), "start": np.append(0, ends[:-1]), "end": ends, "a": [a for a, _ in sides], "b": [b for _, b in sides]}
                yield pd.DataFrame(out)

    return _rows_of(docs).mapInPandas(task, GROUPS)
