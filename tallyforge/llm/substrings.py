"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

Of every string of ``SPAN`` = 100 bytes that occurs more than once, all occurrences but the first
(by doc_id, then by place) are removed; overlapping removals join.

Which strings can repeat is found through anchors. The anchor of a string is the smallest-hashed of
its 20-byte pieces, so equal strings have equal anchors at equal places, and each place in a text
belongs to the strings of one anchor. Only anchors that occur twice or more are looked at again:

1. exact copies of a text are told apart by SHA-256; the first one stands for them all;
2. anchors of the other texts are counted (an id and a hash are shuffled for about 40 bytes of text);
3. the bytes around each repeated anchor (its context: the strings that it belongs to) are cut out
   and equal contexts collapse into the first, with map-side aggregation;
4. contexts are dealt by anchor; each task concatenates those of a few anchors, builds their suffix
   array, and equal neighbours of 100 common bytes tell for each string where it occurs first;
5. the removed ranges go back to their texts.

An anchor with very many occurrences (a common line) is split: its strings are dealt by the 81 bytes
that neighbouring ones share. Where over ``LARGE`` different contexts have even those in common, dealing
goes on to the strings themselves: each is dealt by a 128-bit hash of its 100 bytes, and an aggregation
finds its first place; no suffix array is built for those. Equal contexts are found by the hash of their
key and one of their bytes, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, arrow_batches, look_up, mix64

SPAN = 100
PIECE = 20
WIDTH = SPAN - PIECE + 1
HOT = 2000  # occurrences beyond which an anchor's strings are dealt by more of their bytes
STEP = 20
LARGE = 20_000  # contexts beyond which strings are compared one by one
CHUNK = 1 << 20  # bytes whose suffix array is built at once; the word table then stays in cache
BROADCAST_IDS = 1_000_000
REPEATED = 100  # rows of one doc_id beyond which their texts tell them apart
LAST = (1 << 63) - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _pieces(a: np.ndarray) -> np.ndarray:
    """64-bit hashes of the PIECE bytes from each place on."""
    h = a.astype(np.uint64) + np.uint64(1)
    parts = []
    for i, w in enumerate((1, 2, 4, 8)):
        h = h[:-w] * _M[i] + h[w:]
        h ^= h >> np.uint64(29)
        parts.append(h)
    n = len(a) - PIECE + 1
    return mix64(parts[3][:n] * _M[0] + parts[1][16 : 16 + n])


def anchors(a: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts a[begins:ends]: anchor hash, anchor place, first and last start of its strings, text."""
    n = np.maximum(ends - begins - SPAN + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    start = np.repeat(begins, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    none = np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none, none
    g = _pieces(a)
    low = np.uint64((1 << 24) - 1)
    x, w = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1  # smallest hash, then leftmost
    while w * 2 <= WIDTH:
        x, w = np.minimum(x[:-w], x[w:]), w * 2
    x = np.minimum(x[: len(x) - (WIDTH - w)], x[WIDTH - w :])
    place = (x[start] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)])) - 1
    return g[place[first]], place[first], start[first], start[last], text[first]


def _joined(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Texts in runs of about ``most`` bytes: array, begins, ends, index of each text, offset bytes.
    A text beyond 8 MB comes in parts that overlap by SPAN - 1 bytes."""
    held, index, offset, size = [], [], [], 0
    part = 8 << 20
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - SPAN + 1), part):
            piece = raw[at : at + part + SPAN - 1]
            if held and size + len(piece) > most:
                yield _run(held, index, offset)
                held, index, offset, size = [], [], [], 0
            held.append(piece)
            index.append(i)
            offset.append(at)
            size += len(piece)
    if held:
        yield _run(held, index, offset)


def _run(held, index, offset):
    ends = np.cumsum([len(p) for p in held])
    return np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], ends[:-1])), ends, np.array(index), np.array(offset)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, begins, ends, index, _ in _joined(batch.column(2).to_pylist()):
            g, _, _, _, text = anchors(a, begins, ends)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[index[text]], pa.int64())], names=["g", "k"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the listed anchors: key, bytes, owner, first start and its place in the text."""
    names = ["key", "ctx", "id", "h", "lo"]
    for batch in batches:
        ids, hs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        lists, hot_lists = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for a, begins, ends, index, offset in _joined(batch.column(2).to_pylist()):
            g, place, lo, hi, text = anchors(a, begins, ends)
            own, raw = g.view(np.int64), a.tobytes()
            cuts = np.searchsorted(text, np.arange(len(begins) + 1)).tolist()
            keep, many = np.zeros(len(own), bool), np.zeros(len(own), bool)
            for t, i in enumerate(index.tolist()):
                s, e = cuts[t], cuts[t + 1]
                keep[s:e] = np.isin(own[s:e], np.array(lists[i], np.int64))
                if hot_lists[i]:
                    many[s:e] = np.isin(own[s:e], np.array(hot_lists[i], np.int64))
            shift = offset - begins
            some = np.flatnonzero(keep & ~many)
            keys = own[some].tolist()
            ctx = [raw[b:e] for b, e in zip(lo[some].tolist(), (hi[some] + SPAN).tolist(), strict=True)]
            doc = index[text[some]]
            rid, rh, rlo = ids[doc].tolist(), hs[doc].tolist(), (lo[some] + shift[text[some]]).tolist()
            for j in np.flatnonzero(many).tolist():
                k, p, b, z, t = int(own[j]), int(place[j]), int(lo[j]), int(hi[j]), int(text[j])
                while b <= z:  # starts of one step share the bytes from the latest start on
                    c = (p - b) // STEP
                    last = min(z, p - c * STEP)
                    core = raw[p - c * STEP : p - (c + 1) * STEP + 1 + SPAN]
                    keys.append(int.from_bytes(hashlib.blake2b(k.to_bytes(8, "little", signed=True) + bytes([c]) + core, digest_size=8).digest(), "little", signed=True))
                    ctx.append(raw[b : last + SPAN])
                    rid.append(int(ids[index[t]]))
                    rh.append(int(hs[index[t]]))
                    rlo.append(b + int(shift[t]))
                    b = last + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ctx, pa.binary()), pa.array(rid, pa.int64()), pa.array(rh, pa.int64()), pa.array(rlo, pa.int64())], names=names)


class SuffixArray:
    """Suffixes of a byte array in the order of their first ``depth`` bytes, by two-stage sorting.

    valid: the places whose suffixes are wanted. Besides them only those are sorted that induction
    needs: from a wanted suffix that is larger than its successor on to the next that is not.
    """

    def __init__(self, text: bytes, depth: int = SPAN, valid: np.ndarray | None = None):
        self.t = np.frombuffer(text, np.uint8)
        self.n, self.depth = len(self.t), depth
        w = np.concatenate((self.t, np.zeros(depth + 16, np.uint8))).astype(np.uint64)
        for k in (1, 2, 4):
            w = (w[:-k] << np.uint64(8 * k)) | w[k:]
        self.words = w  # the 8 bytes from each place on, big-endian
        self.small = self._is_small()
        self.need = np.ones(self.n, bool) if valid is None else self._needed(valid)
        self.order = self._induce(self._small())

    def _needed(self, valid: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(valid & ~np.append(valid[1:], False) & ~self.small)
        smalls = np.append(np.flatnonzero(self.small), self.n - 1)
        to = smalls[np.minimum(np.searchsorted(smalls, ends), len(smalls) - 1)]
        delta = np.zeros(self.n + 1, np.int64)
        np.add.at(delta, ends, 1)
        np.add.at(delta, to + 1, -1)
        return valid | (np.cumsum(delta[:-1]) > 0)

    def _is_small(self) -> np.ndarray:
        """Suffixes smaller than their successors; in a run of equal bytes all follow its end."""
        step = np.diff(self.t.astype(np.int16), append=-1)
        place = np.where(step != 0, np.arange(self.n), self.n - 1)
        place = np.minimum.accumulate(place[::-1])[::-1]
        return step[place] > 0

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the suffixes at p and q have ``depth`` bytes in common."""
        same = np.ones(len(p), bool)
        for k in [*range(0, self.depth - 7, 8), self.depth - 8]:
            live = np.flatnonzero(same)
            same[live] = self.words[p[live] + k] == self.words[q[live] + k]
        return same

    def _small(self) -> np.ndarray:
        """The small suffixes, sorted directly, eight bytes at a time; a group of suffixes that are
        all equal to the full depth needs no further sorting."""
        idx = np.flatnonzero(self.small & self.need)
        if not len(idx):
            return idx
        first, whole = self.words[idx], np.zeros(len(idx), np.uint64)
        for k in [*range(0, self.depth - 7, 8), self.depth - 8]:
            whole = whole * _M[0] + mix64(self.words[idx + k])  # a hash of all depth bytes
        by = np.argsort(first, kind="stable")
        idx, first, whole = idx[by], first[by], whole[by]
        new = np.concatenate(([True], first[1:] != first[:-1]))
        live = np.arange(len(idx))
        for k in range(8, self.depth, 8):
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            some = size[group] > 1
            live, group = live[some], group[some]
            if not len(live):
                break
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            lens = np.diff(np.append(heads, len(group)))
            differs = whole[live] != np.repeat(whole[live[heads]], lens)
            mixed = np.repeat(np.logical_or.reduceat(differs, heads), lens)
            live, group = live[mixed], group[mixed]
            if not len(live):
                break
            key = self.words[idx[live] + k]
            by = np.lexsort((key, group))
            idx[live], whole[live] = idx[live[by]], whole[live[by]]
            key, group = key[by], group[by]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        return idx

    def _induce(self, small: np.ndarray) -> np.ndarray:
        """Scan the buckets of first bytes upwards; what precedes a sorted suffix and is large is
        next in its own bucket. All of a bucket that is known is scanned at once."""
        t, n = self.t, self.n
        large: list[list[np.ndarray]] = [[] for _ in range(256)]
        if n and self.need[-1]:
            large[t[-1]].append(np.array([n - 1]))
        heads = np.searchsorted(t[small], np.arange(257))
        out = []

        def spread(at: np.ndarray, c: int) -> np.ndarray:
            before = at[at > 0] - 1
            before = before[self.need[before] & ~self.small[before]]
            chars = t[before]
            stays = before[chars == c]
            before, chars = before[chars != c], chars[chars != c]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cuts = np.flatnonzero(np.diff(chars)) + 1
            for part in np.split(before, cuts) if len(before) else ():
                large[t[part[0]]].append(part)
            return stays

        for c in range(256):
            wave = np.concatenate(large[c]) if large[c] else np.zeros(0, np.int64)
            while len(wave):
                out.append(wave)
                wave = spread(wave, c)
            own = small[heads[c] : heads[c + 1]]
            if len(own):
                out.append(own)
                spread(own, c)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def first_equal(self, valid: np.ndarray) -> np.ndarray:
        """For each place, the first valid place whose ``depth`` bytes are the same (itself at last).
        valid: places from which on ``depth`` bytes count."""
        order = self.order[valid[self.order]]
        out = np.arange(self.n)
        if len(order):
            new = np.concatenate(([True], ~self.equal(order[1:], order[:-1])))
            heads = np.flatnonzero(new)
            out[order] = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
        return out


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """contexts in document order; for each the places whose string occurs before, in it or in an
    earlier one."""
    lens = np.array([len(c) for c in contexts])
    begins = np.cumsum(lens) - lens
    valid = np.zeros(lens.sum(), bool)
    for b, n in zip(begins.tolist(), lens.tolist(), strict=True):
        valid[b : b + n - SPAN + 1] = True
    sa = SuffixArray(b"".join(contexts), SPAN, valid)
    again = np.flatnonzero(sa.first_equal(valid) < np.arange(sa.n))
    cuts = np.searchsorted(again, np.append(begins, sa.n))
    return [again[cuts[i] : cuts[i + 1]] - begins[i] for i in range(len(contexts))]


def _ranges(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Removed bytes [from, to) of sorted starts."""
    if len(places):
        cuts = np.flatnonzero(np.diff(places) > SPAN) + 1
        for part in np.split(places, cuts):
            yield int(part[0]), int(part[-1]) + SPAN


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are gathered to about CHUNK bytes."""

    def solve(rows):
        rows.sort(key=lambda r: r[2:])
        ids, hs, los, his = [], [], [], []
        for (_, _, i, h, lo), places in zip(rows, repeated_starts([r[1] for r in rows]), strict=True):
            for b, e in _ranges(places):
                ids.append(i)
                hs.append(h)
                los.append(lo + b)
                his.append(lo + e)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hs, los, his)], names=["id", "h", "b", "e"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield solve(held)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for ctx, i, h, lo in zip(*[batch.column(c).to_pylist() for c in range(1, 5)], strict=True):
            for k in range(len(ctx) - SPAN + 1):
                d = hashlib.blake2b(ctx[k : k + SPAN], digest_size=16).digest()
                for x, v in zip(out, (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), i, h, lo + k), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["s1", "s2", "id", "h", "lo"])


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hs, texts, parts = (batch.column(i).to_pylist() for i in range(4))
        removed, spans, digests = [], [], []
        for t, ranges in zip(texts, parts, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            end, gone, runs, kept = 0, 0, 0, hashlib.sha256()
            last = -1
            for r in sorted(((r["b"], r["e"]) for r in ranges)):
                if r[0] > last:
                    kept.update(raw[end : r[0]])
                    runs += 1
                    gone += r[1] - r[0]
                elif r[1] > last:
                    gone += r[1] - last
                last = end = max(last, r[1])
            kept.update(raw[end:])
            removed.append(gone)
            spans.append(runs)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["id", "h", "removed", "spans", "digest"])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def removed_ranges(texts: DataFrame, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """(texts with something to remove: id, h, text), (id, h, b, e: byte ranges to remove).
    texts: id, h, k, text, each text once. k: a number that few texts share; a text's repeated
    anchors are listed by it."""
    rows = texts.select("k", "h", "text").mapInArrow(_anchor_rows, "g bigint, k bigint")
    often = shared.save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    lists = rows.join(often, "g").groupBy("k").agg(F.collect_set("g").alias("gs"), F.collect_set(F.when(F.col("n") > HOT, F.col("g"))).alias("hot"))
    lists = shared.save(lists, "lists")
    hit = texts.join(_few(shared.save(lists.select("k"), "hit_ids")), "k", "left_semi").join(lists, "k")
    hit = shared.save(hit.select("id", "h", "text", "gs", "hot"), "hit")
    shared.drop("lists")
    shared.drop("often")
    found = hit.mapInArrow(_context_rows, "key bigint, ctx binary, id bigint, h bigint, lo bigint")
    # the hash of a context is computed where it is needed: it would not compress
    found = shared.save(found, "contexts").withColumn("m", F.xxhash64("ctx"))
    first = found.groupBy("key", "m").agg(F.first("ctx").alias("ctx"), F.min(F.struct("id", "h", "lo")).alias("f"), F.count(F.lit(1)).alias("c"))
    first = shared.save(first.drop("m"), "first").withColumn("m", F.xxhash64("ctx"))
    # equal contexts after the first: every string of theirs occurs before
    copies = found.select("key", "m", "id", "h", "lo", (F.col("lo") + F.length("ctx")).alias("e")).join(first.filter("c > 1").select("key", "m", "f"), ["key", "m"])
    copies = copies.filter(F.struct("id", "h", "lo") != F.col("f")).select("id", "h", F.col("lo").alias("b"), "e")
    per = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rest = first.join(per, "key").select("key", "ctx", "f.id", "f.h", "f.lo", "n")
    dealt = rest.filter(F.col("n") <= LARGE).drop("n").repartition("key").sortWithinPartitions("key")
    ranges = copies.unionByName(dealt.mapInArrow(_sorted_rows, "id bigint, h bigint, b bigint, e bigint"))
    large = shared.save(rest.filter(F.col("n") > LARGE).drop("n"), "large")
    if large.limit(1).count():
        strings = large.mapInArrow(_string_rows, "s1 bigint, s2 bigint, id bigint, h bigint, lo bigint")
        least = strings.groupBy("s1", "s2").agg(F.min(F.struct("id", "h", "lo")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        again = strings.join(least, ["s1", "s2"]).filter(F.struct("id", "h", "lo") != F.col("f"))
        ranges = ranges.unionByName(again.select("id", "h", F.col("lo").alias("b"), (F.col("lo") + SPAN).alias("e")))
    ranges = shared.save(ranges, "ranges")
    for name in ("contexts", "first", "large"):
        shared.drop(name)
    cut = shared.save(ranges.select("id", "h").distinct(), "cut")
    return hit.select("id", "h", "text").join(_few(cut), ["id", "h"], "left_semi"), ranges


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs (doc_id, text).

    A null text is empty. Rows without doc_id come after all others, in the order of a hash of their
    texts, as do rows that repeat a doc_id; of equal ones, one stays. Texts under 100 bytes are never cut.
    """
    shared = Shared(docs.sparkSession, "repeats")
    arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("h", F.xxhash64("text"))
    slim = rows.select("doc_id", "id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    slim = shared.save(slim, "slim")
    long = slim.filter(F.col("n_bytes") >= SPAN)
    first = long.groupBy("sha").agg(F.min(F.struct("id", "row")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = _few(shared.save(first.select("sha", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row")), "copied"))
    slim = slim.join(first, "sha", "left")
    gone = slim.filter(F.col("id") > F.col("first_id")).select("id", "h").distinct()
    # rows without an id, and of an id that many rows repeat, are told apart by their texts
    by_text = F.lit(LAST) - F.col("h").bitwiseAND((1 << 40) - 1)
    repeated = shared.save(rows.filter("doc_id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REPEATED).select("id", F.lit(True).alias("many")), "repeated")
    named = look_up(rows, repeated, ["id"]) if repeated.limit(1).count() else rows.withColumn("many", F.lit(None).cast("boolean"))
    texts = named.filter(F.octet_length("text") >= SPAN).select("id", "h", F.when(F.col("doc_id").isNull() | F.col("many").isNotNull(), by_text).otherwise(F.col("id")).alias("k"), "text")
    texts = texts.join(_few(shared.save(gone, "gone")), ["id", "h"], "left_anti")
    hit, ranges = removed_ranges(texts, shared)
    parts = ranges.groupBy("id", "h").agg(F.collect_list(F.struct("b", "e")).alias("parts"))
    cut = hit.dropDuplicates(["id", "h"]).join(parts, ["id", "h"]).select("id", "h", "text", "parts").mapInArrow(_removals, "id bigint, h bigint, removed bigint, spans bigint, digest string")
    out = slim.join(cut, ["id", "h"], "left")
    whole = F.coalesce(F.col("row") != F.col("first_row"), F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"),
    )
