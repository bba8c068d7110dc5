"""A stored index of sparse vectors: posting lists by term in blocks with their greatest weight.

A term is the unsigned 32-bit MurmurHash3 of a token (seed 42), its weight in a document the number of
times it occurs; inverse document frequencies belong to the index. Documents are dealt to ranges of
ids; a block holds the postings of a term in a range. A search first reads only the blocks' greatest
weights, which bound the score of any document of a range. The most promising ranges are scored,
which gives each query a score that its best k reach; of the rest, only ranges whose bound reaches it
are scored as well. Skipped ranges can't hold a result, so the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import all_tokens
from tallyforge.operators.windows import top_n
from tallyforge.sources.stored import stored

SEED = 42
BUCKETS, WIDTH = 64, 256
_M = 0xFFFFFFFF


def murmur3(data: bytes, seed: int = SEED) -> int:
    """Unsigned 32-bit MurmurHash3 (x86 variant)."""

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & _M
        return ((k << 15 | k >> 17) & _M) * 0x1B873593 & _M

    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & _M) * 5 + 0xE6546B64 & _M
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    return h ^ h >> 16


def with_sparse(docs: DataFrame, text: str = "text", name: str = "sparse") -> DataFrame:
    """docs with a column struct<indices: array<bigint>, values: array<double>> of a text's terms, indices
    ascending; null for a text without tokens. Each distinct token of a batch is hashed once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("indices", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
        for b in batches:
            known: dict[str, int] = {}
            out = []
            for tokens in b.column(b.num_columns - 1).to_pylist():
                count: dict[int, float] = {}
                for t in tokens or []:
                    if t not in known:
                        known[t] = murmur3(t.encode())
                    count[known[t]] = count.get(known[t], 0.0) + 1
                out.append({"indices": (keys := sorted(count)), "values": [count[k] for k in keys]} if count else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], names=[*b.schema.names[:-1], name])

    rows = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_tokens", all_tokens(F.col(text))).mapInArrow(task, f"{schema}, `{name}` struct<indices:array<bigint>,values:array<double>>")


def build(docs: DataFrame, path: str, name: str = "sparse", width: int = WIDTH, ids: DataFrame | None = None) -> None:
    """Write the posting lists of docs (doc_id, struct column ``name``), partitioned by term.

    A block is the postings of a term in ``width`` consecutive ids: it is grouped by (term, range), so a
    term of all documents is in many groups of ``width`` rows at most, where ids are distinct. Rows that
    repeat an id are one document, whose weights are added. Rows without id or vector are left out. ``ids``:
    the same documents where they can be counted without making their vectors again.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.explode(F.arrays_zip(f"{name}.indices", f"{name}.values")).alias("p"))
    term, rng = F.col("p")["indices"], F.floor(F.col("doc_id") / width).cast("bigint")
    rows = rows.select("doc_id", term.alias("term"), F.col("p")["values"].alias("tf"), rng.alias("range"), (term % BUCKETS).cast("int").alias("bucket"), F.pmod(F.xxhash64(rng), F.lit(8)).alias("slot"))
    # one shuffle, to where blocks are written: both groupings are inside of its keys
    place = ["bucket", "slot", "term", "range"]
    rows = rows.repartition("bucket", "slot").groupBy(*place, "doc_id").agg(F.sum("tf").alias("tf"))
    blocks = rows.groupBy(*place).agg(F.max("tf").alias("most"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings")).drop("slot")
    blocks.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    (docs if ids is None else ids).select("doc_id").filter("doc_id is not null").agg(F.count_distinct("doc_id").alias("documents")).write.mode("overwrite").parquet(f"{path}/size")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def weights(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, term, bucket, w) of queries (query_id, sparse): count times inverse document frequency."""
    n = spark.read.parquet(f"{path}/size").first().documents
    q = queries.select("query_id", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("p")).select("query_id", F.col("p")["indices"].alias("term"), F.col("p")["values"].alias("qtf"))
    df = blocks(spark, path).join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q.join(df, "term").select("query_id", "term", (F.col("term") % BUCKETS).cast("int").alias("bucket"), w.alias("w"))


def _scored(found: DataFrame, asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the documents in the given ranges of each query."""
    rows = asked.join(ranges, "query_id").join(found, ["bucket", "term", "range"])
    rows = rows.select("query_id", "w", F.explode("postings").alias("p"))
    return rows.groupBy("query_id", F.col("p")["doc_id"].alias("doc_id")).agg(F.round(F.sum(F.col("w") * F.col("p")["tf"]), 6).alias("score")).filter("score > 0")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score, rank) of the k best documents of each query (query_id, sparse), and the
    ranges (query_id, range, bound) whose blocks were scored. Ties are broken by id. ``first`` ranges of a
    query (k where not given, so that each may hold one of the best) are scored before others are ruled out."""
    asked, found = stored(weights(spark, path, queries), "terms"), blocks(spark, path)
    bounds = found.select("bucket", "term", "range", "most").join(asked, ["bucket", "term"])
    bounds = stored(bounds.groupBy("query_id", "range").agg(F.sum(F.col("w") * F.col("most")).alias("bound")), "bounds")
    start = top_n(bounds, ["query_id"], [F.desc("bound"), F.col("range")], first or k).select("query_id", "range", "bound")
    early = stored(top_n(_scored(found, asked, start.drop("bound")), ["query_id"], [F.desc("score"), F.col("doc_id")], k).drop("rank"), "early")
    reach = early.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select("query_id", F.when(F.col("n") == k, F.col("s")).otherwise(0.0).alias("reach"))
    # bounds are sums in another order than scores: half a unit of the sixth decimal is left to them
    more = bounds.join(start.select("query_id", "range"), ["query_id", "range"], "left_anti").join(reach, "query_id", "left").filter(F.col("bound") >= F.coalesce("reach", F.lit(0.0)) - 1e-6)
    late = _scored(found, asked, more.select("query_id", "range"))
    out = top_n(early.unionByName(late), ["query_id"], [F.desc("score"), F.col("doc_id")], k)
    return out, start.unionByName(more.select("query_id", "range", "bound"))
