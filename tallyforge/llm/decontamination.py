"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, verification.

Every text is covered by windows of the lengths that items have (lengths within 15 % share a class)
at strides of a sixteenth of the length, from the text's first word on, and one ends it. A window's
fingerprint is the 64-bit SimHash of its words, each weighted by its length. The 16-bit blocks of the items' fingerprints are indexed with all values
up to three bits away: two fingerprints within ``RADIUS`` = 15 bits differ by at most three bits in at
least one of the four blocks, so the index loses none of them. What it finds is verified exactly:
the weighted Jaccard similarity of 5-word shingles (a shingle weighs the bytes of its words) between
the item and the best window of exactly the item's length around the hit.

Documents are never shuffled. The items are the stated query set: they are read in blocks of
``ITEMS`` (hash-dealt), each block's index is broadcast with a size that ITEMS bounds, and each block
meets all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, WordHashes, arrow_batches, mix64, shingle_hashes
from tallyforge.llm.near_duplicates import _slices

K = 5
RADIUS = 15
ITEMS = 4096
CLASS = 1.15
HEAVIEST = 12
STRIDES = 16
CHUNK = 12_000
RUN = 16
NONE, SEVERAL = -1, -2
_NEAR = np.array(sorted(sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(16), n)), np.int64)


def _signed(words: np.ndarray, lens: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the 64 signed bits; they may wrap, differences over up to ``longest`` words don't."""
    kind = np.int16 if longest * HEAVIEST < 1 << 15 else np.int32
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little").reshape(len(words), 64).astype(kind)
    bits += bits
    bits -= 1
    bits *= np.minimum(lens, HEAVIEST).astype(kind)[:, None]
    # sums inside runs of RUN rows, whole rows at a time, then the sums of the runs before them
    n = len(words)
    out = np.zeros((1 + -(-n // RUN) * RUN, 64), kind)
    out[1 : n + 1] = bits
    runs = out[1:].reshape(-1, RUN, 64)
    for j in range(1, RUN):
        runs[:, j] += runs[:, j - 1]
    before = np.cumsum(runs[:, -1], axis=0, dtype=kind)
    runs[1:] += before[:-1, None]
    return out[: n + 1]


def _prints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    over = sums.take(ends, axis=0)
    over -= sums.take(starts, axis=0)
    return np.packbits(over > 0, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(words: np.ndarray, lens: np.ndarray) -> np.uint64:
    return _prints(_signed(words, lens, len(words)), np.array([0]), np.array([len(words)]))[0]


def _shingles(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of every 5-word shingle; fewer words are one shingle."""
    n = len(words)
    k = min(K, n)
    h = shingle_hashes(words, k)
    total = np.concatenate(([0], np.cumsum(lens)))
    return (h if k == K else mix64(h + np.uint64(k))), total[k:] - total[: n - k + 1]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    x, y = Counter(a[0].tolist()), Counter(b[0].tolist())
    weight = dict(zip(a[0].tolist(), a[1].tolist(), strict=True)) | dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
    most = sum(weight[h] * max(x[h], y[h]) for h in weight)
    return sum(weight[h] * min(x[h], y[h]) for h in weight) / most if most else 0.0


class ItemIndex:
    """Fingerprints, multi-index tables and shingles of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.shingles, self.own, self.lengths, prints = [], [], [], [], []
        hasher = WordHashes()
        for item_id, text in items:
            words, _, first, end, _ = hasher.spans([text])
            if not len(words):
                continue
            lens = end - first
            self.ids.append(item_id)
            self.lengths.append(len(words))
            self.shingles.append(_shingles(words, lens))
            self.own.append(np.unique(self.shingles[-1][0]))
            prints.append(fingerprint(words, lens))
        self.prints = np.array(prints, np.uint64)
        n = np.array(self.lengths, np.int64)
        sizes = []
        for x in sorted(set(self.lengths)):
            if not sizes or x > sizes[-1][0] * CLASS:
                sizes.append((x, []))
            sizes[-1][1].append(x)
        self.classes = [(int(round((v[0] + v[-1]) / 2)), *self._tables(np.flatnonzero((n >= v[0]) & (n <= v[-1])))) for _, v in sizes]
        self.all = self._tables(np.arange(len(n)))
        self.longest = int(n.max()) if len(n) else 0

    def _tables(self, items: np.ndarray) -> tuple:
        """(four tables: for each 16-bit value the one item near it in that block, NONE or SEVERAL; then
        where the items near it begin, how many, and the items)."""
        tables = []
        for b in range(4):
            value = ((self.prints[items] >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            near = (value[:, None] ^ _NEAR[None, :]).ravel()
            owner = np.repeat(items, len(_NEAR))
            order = np.argsort(near, kind="stable")
            owner, count = owner[order].astype(np.int32), np.bincount(near, minlength=1 << 16)
            begin = np.cumsum(count) - count
            one = np.where(count > 1, SEVERAL, NONE).astype(np.int32)
            one[count == 1] = owner[begin[count == 1]]
            tables.append((one, begin.astype(np.int32), count.astype(np.int32), owner))
        return (tables,)

    def near(self, prints: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) with fingerprints within RADIUS."""
        found = []

        def keep(w: np.ndarray, item: np.ndarray) -> None:
            ok = np.bitwise_count(prints[w] ^ self.prints[item]) <= RADIUS
            if ok.any():
                found.append((w[ok], item[ok].astype(np.int64)))

        parts = prints.view("<u2").reshape(-1, 4)
        for b, (one, begin, count, owner) in enumerate(tables):
            v = parts[:, b]
            x = one.take(v)
            w = np.flatnonzero(x >= 0)
            keep(w, x[w])
            hit = np.flatnonzero(x == SEVERAL)
            if len(hit):
                n, lo = count[v[hit]], begin[v[hit]]
                keep(np.repeat(hit, n), owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, item = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(w * len(self.prints) + item)
        return pairs // len(self.prints), pairs % len(self.prints)

    def search(self, words: np.ndarray, lens: np.ndarray, starts: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item_id, first word, words, similarity): the best window of each text and item.

        words, lens: of several texts in a row; starts: where each text begins, and the end.
        """
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        place = (np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.int32)  # within its text
        for at in range(0, len(words), CHUNK):
            stop = min(len(words), at + CHUNK + self.longest)
            sums = _signed(words[at:stop], lens[at:stop], self.longest)
            for size, tables in self.classes:
                stride = max(1, size // STRIDES)
                # windows start at multiples of the stride from each text's own first word, and one ends it
                first = at + np.flatnonzero(place[at : at + CHUNK] % np.int32(stride) == 0)
                last = starts[1:] - size
                last = last[(last >= at) & (last < at + CHUNK) & (last >= starts[:-1])]
                first = np.concatenate([first, last])
                first = first[first + size <= stop]
                first = first[text_of[first] == text_of[first + size - 1]]
                w, item = self.near(_prints(sums, first - at, first - at + size), tables)
                for p, i in zip(first[w].tolist(), item.tolist(), strict=True):
                    hits.setdefault((int(text_of[p]), i), []).append((p, size))
            n = np.diff(starts)
            short = np.flatnonzero((n > 0) & (n < self.longest) & (starts[:-1] >= at) & (starts[:-1] < at + CHUNK))
            if len(short):  # texts that longer items don't fit in are a window of their own
                w, item = self.near(_prints(sums, starts[short] - at, starts[short + 1] - at), self.all[0])
                for t, i in zip(short[w].tolist(), item.tolist(), strict=True):
                    hits.setdefault((t, i), []).append((int(starts[t]), int(n[t])))
        out = []
        for (t, i), places in hits.items():
            best = self._best(words, lens, int(starts[t]), int(starts[t + 1]), i, places, least)
            if best[0] >= least:
                out.append((t, self.ids[i], best[1], best[2], best[0]))
        return out

    def _best(self, words, lens, begin, end, i, places, least) -> tuple[float, int, int]:
        """(similarity, first word, words) of the best window of the item's length around the places;
        windows that can't reach ``least`` are left out."""
        m, item = self.lengths[i], self.shingles[i]
        best, total, ranges = (0.0, 0, 0), float(item[1].sum()), []
        for p, size in sorted(places):
            pad = max(2, size // 8) + abs(size - m) + 2
            lo, hi = max(begin, p - pad), min(end, p + size + pad)
            if ranges and lo <= ranges[-1][1] - m:
                ranges[-1][1] = max(ranges[-1][1], hi)
            else:
                ranges.append([lo, hi])
        for lo, hi in ranges:
            first = np.arange(lo, max(lo, hi - m) + 1)
            if m >= K and hi - lo >= m:  # the weight that a window has of the item's shingles
                h, w = _shingles(words[lo:hi], lens[lo:hi])
                own = self.own[i]
                common = np.concatenate(([0], np.cumsum(np.where(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h, w, 0))))
                first = first[common[first - lo + m - K + 1] - common[first - lo] >= least * total]
            for s in first.tolist():
                n = min(m, end - s)
                found = similarity(_shingles(words[s : s + n], lens[s : s + n]), item)
                if found > best[0]:
                    best = (found, s - begin, n)
        return best


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str, int]]]:
    """(item_id, text, how often this row repeats), ITEMS at most: repeated rows are counted before they
    are dealt, so they can't fill one part."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-rows.count() // (ITEMS // 2)))
    for part in range(parts):
        found = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        for at in range(0, max(1, len(found)), ITEMS):
            yield [(r.item_id, r.text, r.n) for r in found[at : at + ITEMS]]


def _index(block: list[tuple[int | None, str, int]]) -> ItemIndex:
    """An index whose item ids are places in the block."""
    return ItemIndex([(i, text) for i, (_, text, _) in enumerate(block)])


def _found(index, least: float, texts: list) -> Iterator[tuple[int, tuple]]:
    hasher = WordHashes()
    for a, b in _slices(texts, 1 << 18):
        words, starts, first, end, _ = hasher.spans(texts[a:b])
        if len(words) and index.longest:
            for t, *rest in index.search(words, end - first, starts, least):
                yield a + t, tuple(rest)


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for each document and item that it holds.

    docs (doc_id, text), items (item_id, text). One row per document row and item: the best window.
    Null or empty texts and items match nothing; items of fewer than five words are one shingle.
    Rows and items that repeat are reported each.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast((_index(block), [(item_id, n) for item_id, _, n in block]))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, names = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = ((ids[t], names[x[0]], x[1:]) for t, x in _found(index, least, batch.column(1).to_pylist()))
                found = [(doc_id, item_id, *rest) for doc_id, (item_id, n), rest in rows for _ in range(n)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = rows.mapInArrow(task, "doc_id bigint, item_id bigint, start_word bigint, n_words int, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """docs without the rows that hold an item; all columns pass through, nothing is shuffled. Null
    and empty texts hold none and stay. Between blocks of items the rest is written to the shared
    folder, so a worker never holds two indexes."""
    arrow_batches(docs.sparkSession)
    at, files = docs.columns.index("text"), Shared(docs.sparkSession, "decontamination")
    for no, block in enumerate(_blocks(items)):
        shared = docs.sparkSession.sparkContext.broadcast(_index(block))
        if no:
            docs = files.save(docs, f"block{no}")

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for t, _ in _found(shared.value, least, batch.column(at).to_pylist()):
                    clean[t] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
