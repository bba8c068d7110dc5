"""An inverted-file index of vectors: rows lie partitioned by their nearest centre, a search reads few cells.

Centres are fitted by spherical k-means on a bounded sample in one task; every row is assigned to its
nearest one and written to that cell's folder, large cells in several files. A search finds the
nearest cells of each query, so the scan prunes folders, and scores their rows exactly. Cells know
how far their rows lie from the centre: an exact search reads, beside the nearest cells, those that
may still hold one of the best by the triangle inequality of angles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.retrieval import QUERY_BLOCK, _best_of
from tallyforge.operators.windows import top_n

#: Rows that centres are fitted to at most (those with the least hashes), cells at most, rows of one file.
SAMPLE, MOST_CELLS, FILE_ROWS = 50_000, 4096, 1_000_000
STEPS = 12
_ANGLE_SLACK = 2e-3  # scores are rounded to six decimals, which moves small angles by up to this


def _unit(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which of them had a direction."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    norm = np.linalg.norm(x, axis=1) if n else np.zeros(0)
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _k_means(cells: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x[real] for x, real in (_unit(b.column(0), b.num_rows) for b in batches)]
        x = np.concatenate([p for p in parts if len(p)]) if any(map(len, parts)) else np.zeros((0, 0))
        if not len(x):
            return
        x = np.unique(x, axis=0)  # in an order that does not depend on partitions
        rng = np.random.default_rng(0)
        centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(STEPS):
            near = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)])
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1)
            centres = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], centres)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(centres.tolist(), pa.list_(pa.float64()))], names=["cell", "centre"])

    return task


def _assign(shared, at: int):
    """Rows with their nearest cell and the angle to its centre; -1 for those without a direction."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            cell, angle = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            valid = np.flatnonzero(b.column(at).is_valid().to_numpy(zero_copy_only=False))
            x, real = _unit(b.column(at).take(pa.array(valid)), len(valid))
            if len(valid) and len(centres):
                s = x @ centres.T
                near = s.argmax(axis=1)
                cell[valid[real]] = near[real]
                angle[valid] = np.where(real, np.arccos(np.clip(s[np.arange(len(valid)), near], -1, 1)), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle), pa.array(cell)], names=[*b.schema.names, "_angle", "cell"])

    return task


def build(docs: DataFrame, path: str, cells: int | None = None) -> None:
    """Write an index of docs (doc_id, embedding, other columns) to ``path``: ``vectors`` by cell, and ``centres``
    with each cell's rows and widest angle.

    cells: the square root of the number of rows where not given, MOST_CELLS at most. Rows without an
    embedding, or with a zero one, are kept in cell -1, which no search reads. Rows that repeat stay.
    """
    spark, n = docs.sparkSession, docs.count()
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
    even = F.pmod(F.xxhash64("doc_id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter("embedding is not null").filter(even * n < SAMPLE).select("embedding").repartition(1)
    found = sample.mapInArrow(_k_means(cells), "cell int, centre array<double>").orderBy("cell").collect()
    centres = np.array([r.centre for r in found]) if found else np.zeros((0, 1))
    at = docs.columns.index("embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _angle double, cell int"
    rows = docs.mapInArrow(_assign(spark.sparkContext.broadcast(centres), at), schema)
    size = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("_angle").alias("widest"))
    size.write.mode("overwrite").parquet(f"{path}/sizes")
    size = spark.read.parquet(f"{path}/sizes")
    names = spark.createDataFrame([(r.cell, r.centre) for r in found], "cell int, centre array<double>")
    names.join(size, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    # a cell of very many rows is dealt to several files
    deal = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / FILE_ROWS))
    rows = rows.join(F.broadcast(size.select("cell", F.col("n").alias("_n"))), "cell")  # MOST_CELLS + 1 rows at most
    rows.repartition("cell", deal).drop("_n").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def _score(shared, k: int):
    """The k best of each query among a partition's rows (doc_id, embedding, cell), cell by cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m, asking = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cells = b.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                own, mine = asking.get(cell), np.flatnonzero(cells == cell)
                for at in range(0, len(mine) if own is not None else 0, max(k, 1 << 14)):
                    part = pa.array(mine[at : at + max(k, 1 << 14)])
                    x, _ = _unit(b.column(1).take(part), len(part))
                    s = np.round(m[own] @ x.T, 6)
                    d = np.repeat(b.column(0).take(part).to_numpy()[None], len(own), axis=0)
                    if cell in best:
                        s, d = np.concatenate((best[cell][0], s), axis=1), np.concatenate((best[cell][1], d), axis=1)
                    best[cell] = _best_of(s, d, k)
        for cell, (s, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asking[cell]], s.shape[1])), pa.array(d.ravel()), pa.array(s.ravel())], names=["query_id", "doc_id", "score"])

    return task


def _scan(spark: SparkSession, path: str, ids: np.ndarray, m: np.ndarray, asked: np.ndarray, k: int, where: Column | None) -> DataFrame:
    """Scores of the rows of asked cells (query, cell: true where it is to be read)."""
    asking = {c: np.flatnonzero(asked[:, c]) for c in np.flatnonzero(asked.any(axis=0)).tolist()}
    rows = vectors(spark, path).filter(F.col("cell").isin(list(asking)))
    rows = rows if where is None else rows.filter(where)
    return rows.select(F.col("doc_id").cast("bigint"), "embedding", "cell").mapInArrow(_score(spark.sparkContext.broadcast((ids, m, asking)), k), "query_id bigint, doc_id bigint, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None, exact: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best rows of an index by cosine for queries (query_id, embedding).

    The ``probes`` nearest cells of each query are read. ``where`` is a condition on the index's columns,
    part of the scan. exact: cells that may hold a better row than the k-th found are read as well, so the
    result is that of a full comparison; queries of fewer than k rows found so far then read all cells.
    Queries are a stated set, taken in blocks of QUERY_BLOCK; null and zero vectors match nothing.
    """
    cells = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
    parts, out = max(1, -(-queries.count() // (QUERY_BLOCK // 2))), None
    for part in range(parts):
        block = queries.select(F.col("query_id").cast("bigint"), "embedding").filter("embedding is not null").filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").collect()
        if not block or not cells:
            continue
        m = np.array([r.embedding for r in block], np.float64)
        norm = np.linalg.norm(m, axis=1)
        ids, m = np.array([r.query_id for r in block], np.int64)[norm > 0], m[norm > 0] / norm[norm > 0, None]
        if not len(ids):
            continue
        angle = np.arccos(np.clip(m @ np.array([r.centre for r in cells]).T, -1, 1))
        order = np.argsort(angle, axis=1, kind="stable")[:, :probes]
        asked = np.zeros((len(ids), max(r.cell for r in cells) + 1), bool)
        asked[np.arange(len(ids))[:, None], np.array([r.cell for r in cells])[order]] = True
        found = _scan(spark, path, ids, m, asked, k, where)
        if exact:
            so_far = top_n(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()
            place = {q: i for i, q in enumerate(ids.tolist())}
            reach = np.full(len(ids), np.inf)
            for r in so_far:
                if r.n == k:
                    reach[place[r.query_id]] = math.acos(max(-1.0, min(1.0, r.s))) + _ANGLE_SLACK
            # no row of a cell is nearer than the angle to its centre less its widest
            may = angle - np.array([r.widest for r in cells])[None] <= reach[:, None]
            wide = np.zeros_like(asked)
            wide[:, [r.cell for r in cells]] = may
            found = _scan(spark, path, ids, m, wide | asked, k, where)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return top_n(out, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
