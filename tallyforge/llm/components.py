"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node connects its larger neighbours to its smallest one (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node connects its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(links: DataFrame, shared: Shared, name: str = "stars", most: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v); the component is its smallest node.

    Links may repeat, be given in either direction or join a node to itself. A node with very many
    links is aggregated map-side; the joins are inner ones that AQE may split. Each round is
    written to the shared folder and replaces the one before. Only counts reach the driver.
    """
    edges = shared.save(links.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).filter("u <> v").distinct(), f"{name}0")
    state = _state(edges)
    for i in range(1, most + 1):
        edges = shared.save(_small_star(_large_star(edges)), f"{name}{i}")
        shared.drop(f"{name}{i - 1}")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
