"""Reproducible shuffle and sharding by a keyed permutation of global row numbers (DataFrame only).

Rows get the numbers 0 .. N-1 in the order of (bucket, key, tie), where the bucket is taken from
the MD5 of the key; a Feistel network over pairs of digits to the base ceil(sqrt(N)) permutes the
numbers, and cycle walking brings the few results that are N or more back below N. Row number p
after the permutation means shard ``p mod n`` and slot ``p div n``, so shard sizes differ by one at
most, slots have no gaps, and place and number can be computed from each other anywhere.

No step sorts all rows: numbering sorts inside buckets, and the bucket offsets are a table of at
most ``BUCKETS`` rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.llm.base import replace_columns

BUCKETS = 4096  # three hexadecimal digits; the offsets of so many buckets are broadcast
ROUNDS = 6
WALK = 64
_P = 2147483647


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.md5(f"{seed}:{i}".encode()).digest()[:4], "big") % _P for i in range(ROUNDS)]


def _scramble(right: Column, key: Column, base: Column) -> Column:
    x = (right + key) % _P * 48271 % _P
    x = x.bitwiseXOR(F.shiftright(x, 11)) % _P * 69621 % _P
    return x % base


def permute(number: Column, base: Column, keys: list[int]) -> Column:
    """One pass of the network: a bijection of 0 .. base*base-1."""
    start = F.struct(((number - number % base) / base).cast("long").alias("l"), (number % base).alias("r"))
    step = lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _scramble(s["r"], k, base)) % base).alias("r"))
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), start, step, lambda s: s["l"] * base + s["r"])


def walked(number: Column, total: Column, base: Column, keys: list[int]) -> Column:
    """The permutation of 0 .. total-1. At most 2*base+1 numbers lie between total and base*base:
    for base <= 31 WALK steps always suffice, beyond that they fail with odds below 1e-70; if they
    ever do, the row raises an error instead of getting a wrong place."""
    once = permute(number, base, keys)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x < total, x).otherwise(permute(x, base, keys)))
    return F.when(once < total, once).otherwise(F.when(more < total, more).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long")))


def number_rows(docs: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Adds _q_row (0 .. N-1), _q_total and _q_base. Rows that agree in key and ties are
    interchangeable. Rows without a key are spread by their ties."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in ties]))
    bucket = F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int")
    docs = docs.withColumn("_q_bucket", bucket)
    counts = docs.groupBy("_q_bucket").agg(F.count(F.lit(1)).alias("_q_n"))
    order = W.orderBy("_q_bucket")
    root = F.ceil(F.sqrt(F.col("_q_total").cast("double")))
    offsets = (
        counts.withColumn("_q_offset", F.sum("_q_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_q_n"))
        .withColumn("_q_total", F.sum("_q_n").over(W.partitionBy()))
        .withColumn("_q_base", F.when(root * root < F.col("_q_total"), root + 1).otherwise(root))
        .select("_q_bucket", "_q_offset", "_q_total", "_q_base")
    )
    inside = F.row_number().over(W.partitionBy("_q_bucket").orderBy(F.col(key).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]))
    return (
        docs.withColumn("_q_inside", inside.cast("long"))
        .join(F.broadcast(offsets), "_q_bucket")
        .withColumn("_q_row", F.col("_q_offset") + F.col("_q_inside") - 1)
        .drop("_q_bucket", "_q_inside", "_q_offset")
    )


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 7, key: str = "doc_id", ties: list[str] | None = None) -> DataFrame:
    """docs with ``shard`` (int) and ``slot`` (long).

    Empty input gives an empty result. Null keys and repeated rows get places of their own. With
    the same rows, shard count and seed the result is the same, whatever the partitions.
    """
    ties = [c for c in docs.columns if c != key] if ties is None else ties
    out = number_rows(docs, key, ties)
    place = walked(F.col("_q_row"), F.col("_q_total"), F.col("_q_base"), round_keys(seed))
    out = out.withColumn("_q_place", place)
    shard, slot = (F.col("_q_place") % n_shards).cast("int"), ((F.col("_q_place") - F.col("_q_place") % n_shards) / n_shards).cast("long")
    return replace_columns(out, {"shard": shard, "slot": slot}).drop("_q_row", "_q_total", "_q_base", "_q_place")


def python_place(row: int, total: int, seed: int) -> int:
    """The same permutation for one number: where a row lies without running a job."""
    base = int(total**0.5)
    while base * base < total:
        base += 1
    keys = round_keys(seed)
    while True:
        left, right = divmod(row, base)
        for k in keys:
            x = (right + k) % _P * 48271 % _P
            x = (x ^ (x >> 11)) % _P * 69621 % _P
            left, right = right, (left + x % base) % base
        row = left * base + right
        if row < total:
            return row
