"""What the corpus operators share: words, hashing, tables in the shared folder, Arrow batches.

Conventions that hold for every operator of this subpackage:

* a null text counts as an empty one;
* input columns that an operator does not name are carried or ignored, never read; an input
  column with the name of a result column is replaced by the result column;
* helper columns start with ``_q_`` and never leave an operator.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a few very long texts never fill a worker. The bound is
    the same for all operators: results are lazy, and what counts is the setting when a query runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ctx = spark.sparkContext
        if ctx._jsc.sc().getCheckpointDir().isEmpty():
            if not ctx.master.startswith("local[") and ctx.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            ctx.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        folder = ctx._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


class Shared:
    """Tables written to the shared folder: they cut lineage and outlive lost executors. They go
    when the driver's JVM ends; results that read them must be read or written before."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.drop_at_end(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop_at_end(self, name: str) -> None:
        fs, at = self._file_system(name)
        fs.deleteOnExit(at)

    def _file_system(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def drop(self, name: str) -> None:
        fs, at = self._file_system(name)
        fs.delete(at, True)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; those of the same name (whatever the case) in df are replaced."""
    taken = {c.lower() for c in columns}
    kept = [df[c] for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 with A-Z in lower case (other letters keep their case)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of the words of texts, by a polynomial over their UTF-8 bytes.

    One pass of numpy over the joined bytes of many texts; words never become Python objects.
    ``of(texts)`` gives the hashes of all words in order and, for each text, where its words
    start (one entry more than texts). ``lower`` folds A-Z only.
    """

    BASE = np.uint64(0x100000001B3)

    def __init__(self, lower: bool = True):
        self.lower = lower
        self._powers = np.ones(1, np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self._powers) < n:
            p = np.full(max(n, 1 << 16), self.BASE, np.uint64)
            p[0] = 1
            self._powers = np.multiply.accumulate(p)
        return self._powers

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        h, starts, _, _, _ = self.spans(texts)
        return h, starts

    def spans(self, texts: list[str | bytes | None]):
        """Hashes, text starts among words, and of each word first and end byte; then all bytes."""
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        if self.lower:
            joined = joined.translate(_UPPER)
        a = np.frombuffer(joined, np.uint8)
        blank = (a == 32) | ((a >= 9) & (a <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8)))))
        first, end = edge[0::2], edge[1::2]  # the last byte is blank, so every word ends
        at = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        starts = np.searchsorted(first, np.concatenate(([0], at)))
        if not len(first):
            return np.zeros(0, np.uint64), starts, first, end, a
        lens = end - first
        # sum of byte * BASE^(place from the word's end): powers never exceed the longest word
        place = np.repeat(end, lens) - 1 - (np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first, lens))
        terms = (a[~blank].astype(np.uint64) + np.uint64(1)) * self.powers(int(lens.max()))[place]
        h = np.add.reduceat(terms, np.cumsum(lens) - lens)
        return mix64(h + lens.astype(np.uint64) * _M1), starts, first, end, a


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _M1
        h += words[j : j + n]
    return mix64(h)


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def look_up(rows: DataFrame, small: DataFrame, keys: list[str], limit: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join on keys, nulls equal. ``small`` (one row per key, already a written table) is
    counted: up to limit rows it is broadcast; beyond that the join is on key and salt, so that a
    key with a third of the rows is spread."""
    small = small.withColumnsRenamed({k: f"_q_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(small[f"_q_{k}"])
    if small.count() <= limit:
        return rows.join(F.broadcast(small), cond, "left").drop(*[f"_q_{k}" for k in keys])
    rows = rows.withColumn("_q_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    small = small.withColumn("_q_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(small, cond & (F.col("_q_salt") == F.col("_q_salt2")), "left").drop("_q_salt", "_q_salt2", *[f"_q_{k}" for k in keys])
