"""Language-model scores by masked pseudo-likelihood.

Words become ids: the most frequent words of the whole corpus have one each, all others share
hashed ids. A window network, trained in numpy, predicts the id of every word from ``SIDE`` words on
either side of it (the word itself is masked): a tanh layer over position-wise tables, then a softmax
over classes of ids and one inside the class. Below a shared id the tree has one leaf for every word
of the corpus that has this id, with its share of the id's words, and one that stands for all words
that the corpus does not have, as if they had occurred once: P(word) = P(id | context) P(word | id).
The score of a document is the sum of the conditional log-probabilities of its words.

Everything follows the input: word counts, and with them the leaves, are a shuffle over all documents.
Training texts become blocks of at most ``BLOCK`` words, dealt by hash to ``ROUNDS`` rounds and, in a
round, to replicas of about ``REPLICA`` words, however the files are cut. Every word is trained on
once. The replicas of a round start from the average of the round before and are averaged by their
words, ``FAN`` at a time, so neither the driver nor a task ever holds more than FAN of them. All
documents are then scored where they lie; leaves are broadcast up to ``LEAVES``, and joined beyond.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, WordHashes, arrow_batches
from tallyforge.llm.near_duplicates import _slices

SIDE, HIDDEN = 3, 24
CLASSES = PER = 32
IDS = CLASSES * PER  # 0 is the edge of a text, then words, then the shared ids
SHARED_IDS = 64
WORDS = IDS - 1 - SHARED_IDS
BATCH = 8192
RATE = 0.15
FAN = 32
BLOCK, REPLICA, ROUNDS = 16_384, 1 << 20, 4
LEAVES = 1_000_000
_OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word (as a hash) occurs in all texts of docs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHashes(), [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts):
                held.append(hasher.of(texts[a:b])[0])
                size += len(held[-1])
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "h bigint, n bigint")
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the WORDS most frequent words, sorted by hash, with their ranks."""
    top = (word_counts(docs) if counts is None else counts).orderBy(F.desc("n"), "h").limit(WORDS).collect()
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return np.stack([h[order], (order + 1).astype(np.uint64)]) if len(h) else np.zeros((2, 0), np.uint64)


def leaves(counts: DataFrame, vocab: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(h, lp): for every word without an id of its own, its log-probability among those that share its
    id; and for each shared id that of a word that the corpus does not have."""
    rare = counts.filter(~F.col("h").isin(vocab[0].view(np.int64).tolist())).withColumn("b", F.col("h").bitwiseAND(SHARED_IDS - 1))
    sizes = np.zeros(SHARED_IDS)
    for r in rare.groupBy("b").agg(F.sum("n").alias("all")).collect():  # one row per shared id: SHARED_IDS at most
        sizes[r.b] = r["all"]
    total = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), (F.col("b") + 1).cast("int"))
    return rare.select("h", F.log(F.col("n") / (total + 1)).alias("lp")), -np.log(sizes + 1)


class Ids:
    """Texts to sequences of ids: SIDE edges, the words of a text, SIDE edges, the next text ..."""

    def __init__(self, vocabulary: np.ndarray):
        self.known, self.rank = vocabulary
        self.hasher = WordHashes()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sequence, the places of words in it, and the text of each place."""
        return self.with_hashes(texts)[:3]

    def with_hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the hash of each place."""
        h, starts = self.hasher.of(texts)
        ids = (h % np.uint64(SHARED_IDS)).astype(np.int64) + 1 + WORDS
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            ids = np.where(self.known[at] == h, self.rank[at].astype(np.int64), ids)
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        place = np.arange(len(ids)) + SIDE * (text + 1)
        seq = np.zeros(len(ids) + SIDE * (len(texts) + 1), np.int64)
        seq[place] = ids
        return seq, place, text, h


_ONES = np.ones(max(CLASSES, PER), np.float32)


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the rows of x and their sums. States lie within one, so logits stay small;
    the bound only guards single precision. Sums by product are much faster than along rows."""
    e = np.exp(np.minimum(x, 60, out=x))
    return e, e @ _ONES[: x.shape[1]]


class WindowNetwork:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        normal = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"tables": normal(len(_OFFSETS), IDS, HIDDEN, scale=0.1), "b": np.zeros(HIDDEN, np.float32), "C": normal(HIDDEN, CLASSES, scale=0.1), "cb": np.zeros(CLASSES, np.float32), "R": normal(CLASSES, HIDDEN, PER, scale=0.1), "rb": np.zeros((CLASSES, PER), np.float32)}
        self.total = {k: np.full_like(v, 1e-4) for k, v in self.p.items()}

    def _hidden(self, seq, place):
        x = np.repeat(self.p["b"][None], len(place), axis=0)
        for k, o in enumerate(_OFFSETS):
            x += self.p["tables"][k][seq[place + o]]
        return np.tanh(x)

    def _classes(self, target):
        """Rows in the order of their class, and where each class begins."""
        c = target // PER
        order = np.argsort(c.astype(np.uint8), kind="stable")
        return c, order, np.searchsorted(c[order], np.arange(CLASSES + 1))

    def log_probabilities(self, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.float32)
        for at in range(0, len(place), BATCH):
            some = place[at : at + BATCH]
            h, target = self._hidden(seq, some), seq[some]
            c, order, cuts = self._classes(target)
            x = h @ self.p["C"] + self.p["cb"]
            got = -np.log(_softmax(x)[1]) + x[np.arange(len(some)), c]
            for k in np.flatnonzero(np.diff(cuts)):
                rows = order[cuts[k] : cuts[k + 1]]
                x = h[rows] @ self.p["R"][k] + self.p["rb"][k]
                got[rows] += x[np.arange(len(rows)), target[rows] % PER] - np.log(_softmax(x)[1])
            out[at : at + BATCH] = got
        return out

    def gradients(self, seq: np.ndarray, place: np.ndarray) -> dict:
        """Mean negative log-likelihood's gradients over the words at place."""
        n, p = len(place), self.p
        h, target = self._hidden(seq, place), seq[place]
        c, order, cuts = self._classes(target)
        dc, total = _softmax(h @ p["C"] + p["cb"])
        dc /= total[:, None]
        dc[np.arange(n), c] -= 1
        dh = dc @ p["C"].T
        g = {"C": h.T @ dc / n, "cb": np.ones(n, np.float32) @ dc / n, "R": np.zeros_like(p["R"]), "rb": np.zeros_like(p["rb"])}
        for k in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[k] : cuts[k + 1]]
            dr, total = _softmax(h[rows] @ p["R"][k] + p["rb"][k])
            dr /= total[:, None]
            dr[np.arange(len(rows)), target[rows] % PER] -= 1
            dh[rows] += dr @ p["R"][k].T
            g["R"][k], g["rb"][k] = h[rows].T @ dr / n, np.ones(len(rows), np.float32) @ dr / n
        dx = dh * (1 - h * h) / n
        g["b"] = np.ones(n, np.float32) @ dx
        g["tables"] = np.zeros_like(p["tables"])
        for k, o in enumerate(_OFFSETS):
            ids = seq[place + o]
            by = np.argsort(ids.astype(np.uint16), kind="stable")
            heads = np.flatnonzero(np.diff(ids[by], prepend=-1))
            g["tables"][k][ids[by][heads]] = np.add.reduceat(dx[by], heads, axis=0)
        return g

    def fit(self, sequences: Iterator[tuple[np.ndarray, np.ndarray]]) -> int:
        """One pass of Adagrad over all words, going on from the passes before; returns how many there were."""
        total, seen = self.total, 0
        for seq, place in sequences:
            for at in range(0, len(place), BATCH):
                some = place[at : at + BATCH]
                seen += len(some)
                for k, g in self.gradients(seq, some).items():
                    g *= np.float32(min(1.0, len(some) / 512))  # a few words are a weak sign
                    total[k] += g * g
                    self.p[k] -= RATE * g / np.sqrt(total[k])
        return seen


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words = None, 0
    for batch in batches:
        for blob, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = pickle.loads(blob)
            total = {k: v.astype(np.float64) * n for k, v in p.items()} if total is None else {k: total[k] + v.astype(np.float64) * n for k, v in p.items()}
            words += n
    if total is not None:
        yield _replica({k: (v / max(words, 1)).astype(np.float32) for k, v in total.items()}, words)


def _replica(state: dict, words: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary()), pa.array([words], pa.int64())], names=["p", "n"])


def _state(net: WindowNetwork) -> dict:
    return net.p | {f"sum of squares {k}": v for k, v in net.total.items()}


def _network(state: dict) -> WindowNetwork:
    net = WindowNetwork()
    net.p, net.total = {k: state[k] for k in net.p}, {k: state[f"sum of squares {k}"] for k in net.p}
    return net


def blocks(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(k, n, ids): all texts as blocks of at most BLOCK words; ids has SIDE ids of context on either end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, k = Ids(vocab), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts, 1 << 19):
                seq, place, _ = ids.of(texts[a:b])
                if not len(place):
                    continue
                seq = seq.astype(np.uint16)
                cuts = [seq[at : at + BLOCK + 2 * SIDE] for at in range(0, len(seq) - 2 * SIDE, BLOCK)]
                n = [np.count_nonzero(c[SIDE : len(c) - SIDE]) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(cuts)), pa.int64()), pa.array(n, pa.int64()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["k", "n", "ids"])
                k += len(cuts)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "k bigint, n bigint, ids binary")


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as one sequence, and the places of their own words in it."""
    seqs = [np.frombuffer(r, np.uint16) for r in rows]
    starts = np.cumsum([0] + [len(s) for s in seqs[:-1]])
    return np.concatenate(seqs).astype(np.int64), np.concatenate([np.flatnonzero(s[SIDE : len(s) - SIDE]) + SIDE + at for s, at in zip(seqs, starts, strict=True)])


def _fitted(start):
    def task(t: pa.Table) -> pa.Table:
        t, net = t.sort_by("k"), _network({k: v.copy() for k, v in start.value.items()})
        n = net.fit(_joined(t.column("ids").slice(at, 8).to_pylist()) for at in range(0, t.num_rows, 8))
        return pa.Table.from_batches([_replica(_state(net), n)])

    return task


def train(docs: DataFrame, vocab: np.ndarray) -> WindowNetwork:
    """ROUNDS averages of replicas, each fitted to about REPLICA words."""
    spark = docs.sparkSession
    shared, net = Shared(spark, "lm"), WindowNetwork()
    dealt = shared.save(blocks(docs, vocab), "blocks")
    words = dealt.agg(F.sum("n")).first()[0] or 0
    replicas = max(1, -(-words // (ROUNDS * REPLICA)))
    place = F.pmod(F.xxhash64("k"), F.lit(ROUNDS * replicas))
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(_state(net))
        arrow_batches(spark)
        some = dealt.withColumn("place", place).filter(F.pmod("place", F.lit(ROUNDS)) == turn)
        rows, step = shared.save(some.groupBy("place").applyInArrow(_fitted(start), "p binary, n bigint"), f"replicas{turn}_0"), 0
        while (n := rows.count()) > FAN:
            arrow_batches(spark)
            step += 1
            rows = shared.save(rows.repartition(-(-n // FAN)).mapInArrow(_average, "p binary, n bigint"), f"replicas{turn}_{step}")
            shared.drop(f"replicas{turn}_{step - 1}")
        last = list(_average(iter([pa.RecordBatch.from_pylist([{"p": bytes(r.p), "n": r.n}]) for r in rows.collect()])))
        if last:
            net = _network(pickle.loads(last[0].column(0)[0].as_py()))
        shared.drop(f"replicas{turn}_{step}")
    shared.drop("blocks")
    return net


def lm_scores(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_probability for each row of docs (doc_id, text).

    learn_from: the documents that the model is made of, docs where not given. A text without words
    (null ones too) scores 0 with a null mean. Repeated rows score alike.
    """
    corpus = docs if learn_from is None else learn_from
    spark = docs.sparkSession
    arrow_batches(spark)
    files = Shared(spark, "lm")
    counts = files.save(word_counts(corpus), "counts")
    vocab = vocabulary(corpus, counts)
    net = train(corpus, vocab)
    arrow_batches(spark)
    leaf, unseen = leaves(counts, vocab)
    few = counts.count() <= LEAVES
    held = (np.zeros(0, np.uint64), np.zeros(0))
    if few:
        got = leaf.toArrow()
        h = got.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        held = h[order], got.column("lp").to_numpy()[order]
    shared = spark.sparkContext.broadcast((vocab, net, held))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net, (known, lp) = shared.value
        ids, key = Ids(vocab), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, n, total, rare = batch.column(1).to_pylist(), [], [], []
            for a, b in _slices(texts, 1 << 19):
                seq, place, text, h = ids.with_hashes(texts[a:b])
                got = net.log_probabilities(seq, place).astype(np.float64)
                below = np.flatnonzero(seq[place] > WORDS)
                if few and len(below):
                    x = h[below]
                    at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                    own = lp[at] if len(known) else np.zeros(len(x))
                    got[below] += np.where(known[at] == x if len(known) else False, own, unseen[(x % np.uint64(SHARED_IDS)).astype(np.int64)])
                n.append(np.bincount(text, minlength=b - a))
                total.append(np.bincount(text, got, minlength=b - a))
                if not few:
                    cuts = np.searchsorted(text[below], np.arange(1, b - a))
                    rare += [np.unique(x.view(np.int64), return_counts=True) for x in np.split(h[below], cuts)]
            n, total = (np.concatenate(n), np.concatenate(total)) if n else (np.zeros(0, np.int64), np.zeros(0))
            columns = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(total)]
            if few:
                mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*columns, mean], names=["doc_id", "n_words", "log_likelihood", "mean_log_probability"])
            else:
                more = [pa.array(range(key, key + len(n)), pa.int64()), pa.array([h for h, _ in rare], pa.list_(pa.int64())), pa.array([c for _, c in rare], pa.list_(pa.int64()))]
                key += len(n)
                yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "n_words", "log_likelihood", "key", "rare", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if few:
        return rows.mapInArrow(task, "doc_id bigint, n_words bigint, log_likelihood double, mean_log_probability double")
    scored = files.save(rows.mapInArrow(task, "doc_id bigint, n_words bigint, log_likelihood double, key bigint, rare array<bigint>, times array<bigint>"), "scored")
    words = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    none = F.element_at(F.array(*[F.lit(float(x)) for x in unseen]), (F.col("h").bitwiseAND(SHARED_IDS - 1) + 1).cast("int"))
    # a corpus has all of its own words
    below = words.join(leaf, "h", "inner" if learn_from is None else "left").groupBy("key").agg(F.sum(F.col("times") * F.coalesce("lp", none)).alias("below"))
    total = F.col("log_likelihood") + F.coalesce("below", F.lit(0.0))
    out = scored.join(below, "key", "left").select("doc_id", "n_words", total.alias("log_likelihood"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
