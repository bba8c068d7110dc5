"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is read as letters and marks in lower case, with one blank for whatever lies between them;
its features are all n-grams of one to four of these, hashed to 2**18 numbers. The document
frequencies of all learnable texts are counted (each task counts on its own, Spark adds up). Weights
are fitted by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty on excerpts of
a bounded sample, and a temperature is chosen on the fifth of the sample that the fit has not seen.

The logit of a text is the mean of its n-grams' weights, each times its inverse document frequency,
so a text of any length is scored in slices, and only n-grams with a weight are looked up.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, arrow_batches, mix64

BITS = 18
LENGTHS = (1, 2, 3, 4)
#: Rows of the training sample at most, shared evenly by languages; the rows with the least hashes.
SAMPLE = 8000
#: Characters of the two excerpts of a sampled text.
LONG, SHORT = 2000, (8, 100)
SLICE = 1 << 20
UNKNOWN = "und"
#: FTRL: rate, its offset, elastic net (absolute and squared), passes.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1e-3, 2e-3, 1e-3, 4
_BLANK = 32


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the decimal doc_id leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """For each code point the one it is read as: lower case for letters and marks, else a blank."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, in slices; those of up to four characters that end in the slice."""
    table = _characters()
    before = np.zeros(0, np.uint32)
    text = f" {text} "
    for at in range(0, len(text), SLICE):
        x = table[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = x == _BLANK
        last = bool(len(before)) and before[-1] == _BLANK
        x = x[~(blank & np.append(last, blank[:-1]))]
        own, x = len(before), np.concatenate((before, x)).astype(np.uint64)
        h, found = np.zeros(len(x) + 1, np.uint64), []
        for n in LENGTHS:
            # of the n-grams that end at each place, by those one shorter that end before it
            h = h[:-1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
            found.append(h[max(own - n + 1, 0) :] + np.uint64(n << 58))
        yield (mix64(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)
        before = x[-(max(LENGTHS) - 1) :].astype(np.uint32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each n-gram occurs."""
    count, seen = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for g in grams(text or ""):
                seen[g] = True
            at = np.flatnonzero(seen)
            count[at] += 1
            seen[at] = False
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], names=["gram", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the n-gram)) + 1, over all texts (one column)."""
    found = texts.mapInArrow(_frequencies, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found, out = found.toPandas(), np.zeros(1 << BITS)  # 2**BITS rows at most
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    # every text has the n-gram of a blank
    return (np.log((1 + out.max(initial=0)) / (1 + out)) + 1).astype(np.float32)


def _excerpts(idf: np.ndarray):
    """Two excerpts of each sampled text as features: (lang, doc_id, part, ids, values)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                chance = [int(v) for v in mix64(np.array([doc_id & (1 << 64) - 1], np.uint64) + np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
                for part, size in enumerate((LONG, SHORT[0] + chance[0] % (SHORT[1] - SHORT[0]))):
                    at = chance[1 + part] % max(len(text) - size + 1, 1)
                    ids, n = np.unique(next(grams(text[at : at + size])), return_counts=True)
                    rows.append((lang, doc_id, part, ids.astype("<i4").tobytes(), (n / n.sum() * idf[ids]).astype("<f4").tobytes()))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "doc_id", "part", "ids", "vals"])

    return task


class Leader:
    """FTRL-proximal for a softmax over languages: each n-gram has its own rate and elastic net."""

    def __init__(self, n_features: int, n_classes: int):
        self.z, self.n = (np.zeros((n_features + 1, n_classes)) for _ in range(2))  # the last row is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, L1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(ids, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits, between e**-4 and e**4, under which labels are likeliest (golden section)."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, part = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _fit(langs: list[str]):
    """The fitted weights and the temperature, pickled, from all excerpts (a bounded number)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
        if not rows:
            return
        number = {x: i for i, x in enumerate(langs)}
        labels = np.array([number[r[0]] for r in rows])
        features = [(np.frombuffer(r[3], "<i4"), np.frombuffer(r[4], "<f4")) for r in rows]
        fold = mix64(np.array([r[1] & (1 << 64) - 1 for r in rows], np.uint64)) % np.uint64(5) == 0
        fitted, kept_back = np.flatnonzero(~fold), np.flatnonzero(fold)
        leader, rng = Leader(1 << BITS, len(langs)), np.random.default_rng(0)
        for _ in range(PASSES):
            for i in rng.permutation(fitted):
                leader.learn(*features[i], labels[i])
        w = np.concatenate([leader.weights(np.arange(a, min(a + 4096, len(leader.z)))) for a in range(0, len(leader.z), 4096)])
        logits = np.array([x @ w[i] + w[-1] for i, x in (features[k] for k in kept_back)]).reshape(-1, len(langs))
        some = np.flatnonzero(np.append(w[:-1].any(axis=1), False))
        model = some.astype(np.int32), w[some].astype(np.float32), w[-1].astype(np.float32), temperature(logits, labels[kept_back])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return task


class Model:
    """Languages, and for each n-gram the row of its weights (times its inverse document frequency)."""

    def __init__(self, langs: list[str], ids: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float, idf: np.ndarray):
        self.langs, self.bias, self.heat = langs, bias, heat
        self.row = np.zeros(1 << BITS, np.int32)
        self.row[ids] = np.arange(1, len(ids) + 1)
        self.table = np.concatenate((np.zeros((1, len(langs)), np.float32), weights * idf[ids, None]))

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            at = self.row[g]
            total += self.table[at[at > 0]].sum(axis=0, dtype=np.float64)
            n += len(g)
        return softmax((total / max(n, 1) + self.bias) / self.heat)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs (doc_id, text, lang): rows with a language whose id is not held out, null ids excepted.

    Document frequencies come from all of these rows. The weights come from ``sample`` rows at most,
    an even share of each language (rows that repeat an id within a language count once, by their
    least text). Languages are learned as they are spelled.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    shared = Shared(spark, "languages")
    sizes = shared.save(sizes.orderBy(F.desc("n"), "lang").limit(sample), "sizes")  # more languages than sampled rows can't be learned
    langs = sorted((r.lang for r in sizes.collect()), key=lambda x: x.encode())
    idf = inverse_frequencies(rows.select("text"))
    if not langs:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 1.0, idf)
    # hashes are even, so the least 'share / n' of them are about 'share' rows
    share, even = sample // len(langs), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(sizes), "lang").filter(even * F.col("n") < share)
    picked = picked.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")
    shared_idf = spark.sparkContext.broadcast(idf)
    excerpts = picked.mapInArrow(lambda b: _excerpts(shared_idf.value)(b), "lang string, doc_id bigint, part int, ids binary, vals binary")
    found = excerpts.repartition(1).sortWithinPartitions("doc_id", "lang", "part").mapInArrow(_fit(langs), "model binary").first()
    shared.drop("sizes")
    if found is None:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 1.0, idf)
    return Model(langs, *pickle.loads(found.model), idf)


def languages(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the probability of that language) for each row of docs.

    learn_from: the rows to learn from, docs where not given. A null text, a text without letters and
    every text where nothing could be learned is ``und`` with score 0. Of equal probabilities the
    language that comes first by its bytes wins. Rows that repeat are judged each; other columns are
    not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs if learn_from is None else learn_from))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = rows.mapInArrow(task, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
