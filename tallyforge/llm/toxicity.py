"""Toxicity scores from a bidirectional gated recurrent network with attention, trained in numpy.

A word enters as the embedding of its hash beside the mean embedding of its hashed character
trigrams, so that inflected and foreign forms share what their letters share. Two gated recurrent
passes read windows of ``SPAN`` words, attention pools their states, a logistic output scores the
window. Every text is covered by windows at half their length; its score is that of its worst one.

Training sees documents with one label each, of which a few words may be the reason. It therefore
alternates: the window that scores highest stands for a toxic document; the highest ones and some
random ones for a clean document; then the network is fitted to them. The first choice comes from
the log-odds of the hashed words and trigrams, which also start the embeddings. Log-odds, choices
and scores are passes over the training texts in Spark tasks; only chosen windows of ``SPAN`` words,
whose number the bound on rows fixes, meet in the one task that fits the network.

Texts are read in slices of about ``SLICE`` bytes, a longer text in overlapping pieces that hold
exactly its own windows, so what a task needs does not grow with the length of a text.

Only ids and labels pick the training rows; the inputs of a score are the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, WordHashes, arrow_batches, mix64

SPAN, STEP = 32, 16
WORD_BITS, CHAR_BITS = 14, 13
DIM, HIDDEN, ATTEND = 8, 8, 8
PER_CLASS = 2500  # labelled rows of each class that training takes at most, by hash
ROUNDS, EPOCHS, BATCH, LEAST_STEPS = 3, 4, 128, 300
WORST, CHANCE = 3, 2  # windows of a clean text that training takes a round: its highest ones, random ones
SLICE = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Features:
    """Hashed words and trigrams of texts, as flat arrays."""

    def __init__(self, texts: list[str | bytes | None], hasher: WordHashes):
        h, self.starts, first, end, a = hasher.spans(texts)
        self.first, self.end, self.bytes = first, end, a
        self.words = (h >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        blank = (a == 32) | ((a >= 9) & (a <= 13))
        b = np.where(blank, 32, a).astype(np.uint32)
        left, right = np.concatenate(([32], b[:-1])).astype(np.uint32), np.concatenate((b[1:], [32])).astype(np.uint32)
        t = left * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
        t ^= t >> np.uint32(15)
        t *= np.uint32(0x2C1B3C6D)
        self.chars = (t >> np.uint32(32 - CHAR_BITS))[~blank].astype(np.int32)
        self.lens = end - first
        self.char_starts = np.cumsum(self.lens) - self.lens

    def mean_chars(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.chars], self.char_starts, axis=0) / self.lens[:, None].astype(np.float32) if len(self.lens) else np.zeros((0, table.shape[1]), np.float32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, words and text of every window; a text without words has none."""
        n = np.diff(self.starts)
        per = np.where(n > 0, 1 + np.maximum(0, -(-(n - SPAN) // STEP)), 0)
        text = np.repeat(np.arange(len(n)), per)
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = self.starts[:-1][text] + place * STEP
        return first, np.minimum(SPAN, self.starts[1:][text] - first), text


def _pieces(raw: bytes, most: int) -> Iterator[bytes]:
    """A long text in pieces of about ``most`` bytes: every window of the text is one of one piece."""
    a = np.frombuffer(raw, np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
    first, end = edge[0::2], edge[1::2]
    at = 0
    while at < len(first) and (not at or len(first) - at > SPAN - STEP):
        fit = int(np.searchsorted(first, first[at] + most)) - at
        words = max(STEP, fit // STEP * STEP)
        yield raw[first[at] : end[min(len(first), at + words + SPAN - STEP) - 1]]
        at += words


def slices(texts: list[str | None], most: int | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of about ``most`` bytes: texts or pieces of texts, and the index of each one's text."""
    most = most or SLICE
    owners, held, size = [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for piece in [raw] if len(raw) <= most else _pieces(raw, most):
            if held and size + len(piece) > most:
                yield np.array(owners), held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield np.array(owners), held


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n, h = 2 * DIM, HIDDEN
        normal = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"words": normal(1 << WORD_BITS, DIM, scale=0.05), "chars": normal(1 << CHAR_BITS, DIM, scale=0.05), "Wa": normal(2 * h, ATTEND), "va": normal(ATTEND), "wo": normal(2 * h), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": normal(n, 3 * h), f"U{d}": normal(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        self.shift, self.scale = 0.0, 1.0

    # Gates of a pass are [update, reset, candidate]; h' = (1 - z) h + z tanh(x + r * (h U)).
    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (T, B, 3h) input projections. Returns the states (T, B, h) and what backward needs."""
        h_dim, u = HIDDEN, self.p[f"U{d}"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], h_dim), np.float32)
        states, saved = np.empty((len(x), x.shape[1], h_dim), np.float32), []
        for t in steps:
            hu = h @ u
            zr = _sigmoid(x[t, :, : 2 * h_dim] + hu[:, : 2 * h_dim])
            z, r = zr[:, :h_dim], zr[:, h_dim:]
            c = np.tanh(x[t, :, 2 * h_dim :] + r * hu[:, 2 * h_dim :])
            zm = z * mask[t][:, None]
            new = h + zm * (c - h)
            if keep:
                saved.append((t, h, hu, z, r, c))
            h = states[t] = new
        return states, saved

    def _head(self, s: np.ndarray, mask: np.ndarray):
        """Attention over (T, B, 2h) states: logits and what backward needs."""
        a = np.tanh(s @ self.p["Wa"])
        e = np.where(mask > 0, a @ self.p["va"], -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, s, optimize=False)
        return pooled @ self.p["wo"] + self.p["bo"][0], (a, w, pooled)

    def score(self, f: Features, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of every window."""
        first, n, text = f.windows()
        if not len(first):
            return np.zeros(0, np.float32), text
        x = np.concatenate([self.p["words"][f.words], f.mean_chars(self.p["chars"])], axis=1)
        proj = {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), most):
            at_words, mask = self._grid(first[at : at + most], n[at : at + most])
            s = np.concatenate([self._pass(proj[d][at_words], mask, d, False)[0] for d in "fb"], axis=2)
            out[at : at + most] = self._head(s, mask)[0]
        return out, text

    @staticmethod
    def _grid(first, n):
        t = np.arange(int(n.max()))[:, None]
        mask = (t < n[None, :]).astype(np.float32)
        return np.where(mask > 0, first[None, :] + t, first[None, :]), mask

    def highest(self, texts: list[str | None], hasher: WordHashes) -> np.ndarray:
        """Logit of each text's highest window; without words, of an empty window."""
        best = np.full(len(texts), -np.inf)
        for owners, held in slices(texts):
            logits, piece = self.score(Features(held, hasher))
            np.maximum.at(best, owners[piece], logits)
        return np.where(np.isfinite(best), best, float(self.p["bo"][0]))

    def probabilities(self, texts: list[str | None], hasher: WordHashes) -> np.ndarray:
        """Score of each text: that of its highest window."""
        return _sigmoid(np.clip((self.highest(texts, hasher) - self.shift) * self.scale, -30, 30))

    def _gradients(self, f: Features, first, n, y):
        p, h = self.p, HIDDEN
        at, mask = self._grid(first, n)
        used, inverse = np.unique(at, return_inverse=True)
        inverse = inverse.reshape(at.shape)
        counts = f.lens[used]
        chars = f.chars[np.repeat(f.char_starts[used], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        owner = np.repeat(np.arange(len(used)), counts)
        mean = np.add.reduceat(p["chars"][chars], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)
        xs = np.concatenate([p["words"][f.words[used]], mean], axis=1)
        x = xs[inverse]
        runs = {d: self._pass(x @ p[f"W{d}"] + p[f"b{d}"], mask, d, True) for d in "fb"}
        s = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        logit, (a, w, pooled) = self._head(s, mask)
        prob = _sigmoid(logit)
        dl = ((prob - y) / len(y)).astype(np.float32)
        g = {"wo": pooled.T @ dl, "bo": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["wo"]
        ds = w[:, :, None] * dpool
        dw = np.einsum("tbh,bh->tb", s, dpool, optimize=False)
        de = w * (dw - (w * dw).sum(axis=0)) * (mask > 0)
        g["va"] = np.einsum("tb,tba->a", de, a, optimize=False)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["Wa"] = s.reshape(-1, 2 * h).T @ da.reshape(-1, ATTEND)
        ds += da @ p["Wa"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u, carry = p[f"U{d}"], np.zeros((len(y), h), np.float32)
            du, dproj = np.zeros_like(u), np.zeros((len(x), len(y), 3 * h), np.float32)
            for t, before, hu, z, r, c in reversed(runs[d][1]):
                dh = carry + ds[t, :, i * h : (i + 1) * h]
                m = mask[t][:, None]
                dzm = dh * (c - before)
                dc = dh * z * m * (1 - c * c)
                dhu = np.concatenate([dzm * m * z * (1 - z), dc * hu[:, 2 * h :] * r * (1 - r), dc * r], axis=1)
                dproj[t] = np.concatenate([dhu[:, : 2 * h], dc], axis=1)
                du += before.T @ dhu
                carry = dh * (1 - z * m) + dhu @ u.T
            g[f"U{d}"], g[f"b{d}"] = du, dproj.sum(axis=(0, 1))
            g[f"W{d}"] = x.reshape(-1, 2 * DIM).T @ dproj.reshape(-1, 3 * h)
            dx += dproj @ p[f"W{d}"].T
        dxs = np.zeros_like(xs)
        np.add.at(dxs, inverse.ravel(), dx.reshape(-1, 2 * DIM))
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], f.words[used], dxs[:, :DIM])
        np.add.at(g["chars"], chars, (dxs[:, DIM:] / counts[:, None])[owner])
        return g, float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))

    def constant(self, toxic: bool) -> None:
        """One score for every text, where there is nothing to tell apart."""
        self.p["bo"][0] = 5 if toxic else -5
        self.p["wo"][:] = 0

    def start(self, odds: dict[str, np.ndarray]) -> None:
        """Log-odds of the hashed words and trigrams start one dimension of the embeddings."""
        for name, x in odds.items():
            self.p[name][:, 0] = x * 0.3
        self.moment, self.step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0

    def fit(self, windows: list[bytes], labels: np.ndarray, seed: int) -> None:
        """Adam over windows, each a text of its own, going on from the rounds before. Deterministic
        for the same windows in the same order."""
        rng = np.random.default_rng(seed)
        f = Features(windows, WordHashes())
        first, n, text = f.windows()
        y = np.asarray(labels, np.float32)[text]
        repeat = np.where(y > 0, max(1, int(min(4, len(y) / (2 * max(1, y.sum()))))), 1)
        chosen, y = np.repeat(np.arange(len(first)), repeat), np.repeat(y, repeat)
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(chosen))))):
            shuffled = rng.permutation(len(chosen))
            for at in range(0, len(chosen), BATCH):
                some = chosen[shuffled[at : at + BATCH]]
                g, _ = self._gradients(f, first[some], n[some], y[shuffled[at : at + BATCH]])
                self.step += 1
                for k, v in g.items():
                    m, q = self.moment[k]
                    m += 0.1 * (v - m)
                    q += 0.01 * (v * v - q)
                    rate = 0.01 * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
                    self.p[k] -= rate * m / (np.sqrt(q) + 1e-8)

    def calibrate(self, best: np.ndarray, labels: np.ndarray) -> None:
        """Put probability 1/2 where training documents are told apart best."""
        order = np.argsort(best, kind="stable")
        x, y = best[order], labels[order]
        wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
        least = np.flatnonzero(wrong == wrong.min())
        i = int(least[len(least) // 2])
        self.shift = float(x[0] - 1 if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label (in one piece of them, if long) a hashed word or trigram occurs."""
    hasher, count = WordHashes(), {k: np.zeros((2, 1 << bits), np.int64) for k, bits in (("words", WORD_BITS), ("chars", CHAR_BITS))}
    for batch in batches:
        labels = batch.column(0).to_numpy()
        for owners, held in slices(batch.column(2).to_pylist()):
            f = Features(held, hasher)
            piece = np.repeat(np.arange(len(held)), np.diff(f.starts))
            for k, ids, owner in (("words", f.words, piece), ("chars", f.chars, np.repeat(piece, f.lens))):
                size = count[k].shape[1]
                pairs = np.unique(owner * size + ids)
                np.add.at(count[k], (labels[owners[pairs // size]], pairs % size), 1)
    for k, c in count.items():
        label, at = np.nonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(c[label, at], pa.int64())], names=["table", "label", "id", "n"])


def log_odds(sample: DataFrame) -> dict[str, np.ndarray]:
    """Log-odds of the hashed words and trigrams of sample (label, doc_id, text), summed over its tasks."""
    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    count = {k: np.zeros((2, 1 << bits)) for k, bits in (("words", WORD_BITS), ("chars", CHAR_BITS))}
    found = sample.mapInArrow(_occurrences, "table string, label int, id int, n bigint").groupBy("table", "label", "id").agg(F.sum("n").alias("n"))
    for r in found.collect():  # two labels times the two hashed tables at most
        count[r.table][r.label, r.id] = r.n
    return {k: np.clip(np.log((c[1] + 0.5) / (size.get(1, 0) + 1)) - np.log((c[0] + 0.5) / (size.get(0, 0) + 1)), -1, 5).astype(np.float32) for k, c in count.items()}


def _choose(shared, turn: int):
    """Windows that training takes of each text: (label, doc_id, place, window). shared: log-odds or a network."""

    def ranks(f: Features) -> np.ndarray:
        if turn:
            return shared.value.score(f)[0]
        odds, (first, n, _) = shared.value, f.windows()
        evidence = np.append(odds["words"][f.words] + f.mean_chars(odds["chars"][:, None])[:, 0], np.float32(-np.inf))
        return np.maximum.reduceat(evidence, np.stack([first, first + n], axis=1).ravel())[::2] if len(first) else np.zeros(0, np.float32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            labels, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held: list[tuple] = []  # text, place, rank, chance, window
            for owners, pieces in slices(batch.column(2).to_pylist()):
                f = Features(pieces, hasher)
                first, n, piece = f.windows()
                rank, text, place = ranks(f), owners[piece], first - f.starts[piece]
                chance = mix64(ids[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) + np.uint64(turn))
                raw = f.bytes.tobytes()
                for i in np.flatnonzero(_least(-rank, text, WORST) | _least(chance, text, CHANCE)).tolist():
                    held.append((int(text[i]), int(place[i]), float(rank[i]), int(chance[i]), raw[f.first[first[i]] : f.end[first[i] + n[i] - 1]]))
            if not held:
                continue
            text, _, rank, chance, _ = (np.array(x, t) for x, t in zip(zip(*held, strict=True), (np.int64, np.int64, np.float64, np.uint64, object), strict=True))
            clean = labels[text] == 0
            some = np.flatnonzero(_least(-rank, text, 1) | (clean & (_least(-rank, text, WORST) | _least(chance, text, CHANCE)))).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels[text[some]], pa.int32()), pa.array(ids[text[some]], pa.int64()), pa.array([held[i][1] for i in some], pa.int64()), pa.array([held[i][4] for i in some], pa.binary())],
                names=["label", "doc_id", "place", "window"],
            )

    return task


def _least(key: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k with the least key of their group."""
    order = np.lexsort((key, group))
    g = group[order]
    heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    place = np.arange(len(g)) - np.repeat(heads, np.diff(np.append(heads, len(g))))
    out = np.zeros(len(g), bool)
    out[order] = place < k
    return out


def _fit(shared, turn: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, windows = [], []
        for b in batches:
            labels += b.column(0).to_pylist()
            windows += b.column(3).to_pylist()
        net = shared.value
        net.fit(windows, np.array(labels), 9 + turn)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["model"])

    return task


def _highest(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.highest(b.column(2).to_pylist(), hasher).astype(np.float64))], names=["label", "doc_id", "best"])

    return task


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Fit the network to at most per_class toxic and per_class clean labelled rows, the first by
    the MD5 of their ids, held-out rows excepted. Of rows that repeat an id the least text is
    learned from. Without labels of both kinds every text gets one score, a low one without any."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("doc_id")))
    picked = None
    for label in (0, 1):
        some = rows.filter(F.col("label") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    shared = Shared(spark, "toxicity")
    sample = shared.save(sample.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id"), "sample")
    net, kinds = Network(), [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        net.constant(kinds == [1])
        return net
    odds = log_odds(sample)
    net.start(odds)
    for turn in range(ROUNDS):
        model = spark.sparkContext.broadcast(net)
        ranked = model if turn else spark.sparkContext.broadcast(odds)
        windows = sample.mapInArrow(_choose(ranked, turn), "label int, doc_id bigint, place bigint, window binary")
        fitted = windows.repartition(1).sortWithinPartitions("doc_id", "place", "window").mapInArrow(_fit(model, turn), "model binary")
        if found := fitted.first():
            net = pickle.loads(found.model)
    best = sample.mapInArrow(_highest(spark.sparkContext.broadcast(net)), "label int, doc_id bigint, best double").orderBy("doc_id").collect()
    net.calibrate(np.array([r.best for r in best]), np.array([r.label for r in best], np.float32))
    del net.moment
    shared.drop("sample")
    return net


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text); nothing is shuffled."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            found = shared.value.probabilities(batch.column(1).to_pylist(), hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    learn_from: the documents that labels belong to, docs where not given. Null and empty texts
    are scored as a window without words. Repeated rows are scored each.
    """
    out = scores(docs, train(docs if learn_from is None else learn_from, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns pass through. Null and empty texts are
    judged as a window without words, rows that repeat each by itself."""
    net = train(docs, labels)
    arrow_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.probabilities(batch.column(at).to_pylist(), hasher) < 0.5))

    return docs.mapInArrow(task, docs.schema)
