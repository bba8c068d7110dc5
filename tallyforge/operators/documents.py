"""Documents for retrieval from facts, their context blocks, and a model-free embedder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions.text import joined
from tallyforge.operators.windows import top_n


def _list(rank: str, value: Column | str, sep: str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), v.alias("v")))), lambda x: x["v"]), sep)


def deal_documents(lines: DataFrame, dataset: str, items: int = 30, sections: int = 3) -> DataFrame:
    """One document per deal of at least two lines: its products in the order of first mention (30 at
    most), its largest sections, its total. Lists are cut before they are collected."""
    rows = lines.filter(F.col("dataset") == dataset)
    all_ = rows.groupBy("deal_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("line_total"), 2).alias("total")).filter("lines >= 2")
    names = rows.groupBy("deal_id", "product_name").agg(F.min("line").alias("first"))
    names = top_n(names, ["deal_id"], [F.col("first")], items).groupBy("deal_id").agg(_list("rank", "product_name", ", ").alias("products"))
    per = rows.groupBy("deal_id", "section").agg(F.sum("line_total").alias("t"))
    per = top_n(per, ["deal_id"], [F.desc(F.round("t", 2)), F.col("section")], sections).groupBy("deal_id").agg(_list("rank", "section", "|").alias("sections"))
    out = all_.join(names, "deal_id").join(per, "deal_id")
    text = joined(" | ", F.concat(F.lit("products: "), "products"), F.concat(F.lit("sections: "), "sections"), F.concat(F.lit("total: "), F.format_number("total", 2)))
    return out.select("deal_id", "lines", "total", "products", "sections", text.alias("searchable_text"))


def as_documents(facts: DataFrame, doc_type: str, key: Column, text: Column) -> DataFrame:
    return facts.select(F.concat(F.lit(f"{doc_type}:"), key.cast("string")).alias("doc_id"), F.lit(doc_type).alias("doc_type"), text.alias("searchable_text"))


def with_context(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """searchable_text with the sentence of its type ahead; %s stands for the doc_id."""
    prefix = reduce(lambda c, k: c.when(F.col("doc_type") == k, F.format_string(templates[k], "doc_id")), templates, F.when(F.lit(False), ""))
    return docs.withColumn("contextual_text", F.concat_ws("\n", prefix, "searchable_text"))


def context_blocks(results: DataFrame, docs: DataFrame, n: int = 12, most: int = 200) -> DataFrame:
    """Per query its first n documents as numbered lines, each cut to ``most`` characters."""
    rows = results.filter(F.col("rank") <= n).join(docs, "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, most))
    return rows.groupBy("query_id").agg(_list("rank", line, "\n").alias("context"), F.count(F.lit(1)).alias("documents"))


def merged_lists(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Lists of both tables under one key: those of b first, each value once."""
    empty = F.array().cast("array<string>")
    other = b.select(key, F.col(name).alias("_b"))
    return a.join(other, key, "full_outer").select(key, F.array_distinct(F.concat(F.coalesce("_b", empty), F.coalesce(name, empty))).alias(name))


def completeness(lines: Column, sections: Column, products: Column) -> Column:
    """full, partial or bare by what a deal holds."""
    return F.when((lines >= 5) & (sections >= 3), "full").when((lines >= 3) & (products >= 2), "partial").otherwise("bare")


def injected(results: DataFrame, forced: DataFrame, delta: float = 0.01) -> DataFrame:
    """Forced documents (query_id, doc_id) rise above a query's best score; a document that was found
    already is moved, not doubled."""
    best = results.groupBy("query_id").agg(F.max("score").alias("_m"))
    up = forced.join(best, "query_id", "left").select("query_id", "doc_id", (F.coalesce("_m", F.lit(0.0)) + delta).alias("score"))
    every = results.select("query_id", "doc_id", "score").unionByName(up).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    return every.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id"))))


def hashed_embeddings(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, embedding): a stand-in for a model. Tokens are dealt to signed dimensions by hash, the
    vector has length one; a text without tokens is the zero vector."""
    import zlib

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, dim), np.float32)
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    out[i, h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((out / np.where(n > 0, n, 1)).tolist(), pa.list_(pa.float32()))], names=["doc_id", "embedding"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id bigint, embedding array<float>")


def bundle_documents(bundles: DataFrame, matches: DataFrame) -> DataFrame:
    """Bundle facts with how often orders contain them, as documents."""
    m = matches.select("bundle_key", "contained_matches", "match_rate")
    rows = bundles.join(m, "bundle_key", "left")
    text = joined(
        " | ",
        F.concat(F.lit("products: "), F.col("product_count").cast("string")),
        F.concat(F.lit("deals: "), F.col("deal_count").cast("string")),
        F.concat(F.lit("median: "), F.format_number("median_value", 2)),
        F.when(F.col("contained_matches") > 0, F.concat(F.lit("contained in orders: "), F.col("contained_matches").cast("string"))),
    )
    return as_documents(rows, "bundle", F.concat_ws(":", "dataset", "bundle_key"), text)


def profile_documents(profiles: DataFrame, most: int = 500) -> DataFrame:
    text = joined("\n", F.concat(F.lit("direction: "), "primary_direction"), F.concat(F.lit("shares: "), "direction_breakdown"), F.concat(F.lit("parts: "), F.substring("components", 1, most)))
    return as_documents(profiles, "deal_profile", F.col("deal_id"), text)


def projected_answers(candidates: DataFrame, most: int = 50) -> DataFrame:
    """Answers as one row each: references, their distinct types, whether any has a price. At most
    ``most`` candidates of a query are gathered."""
    some = candidates.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_type", "p50"))).alias("refs"))
    return some.select("query_id", F.size("refs").alias("references"), F.size(F.array_distinct(F.transform("refs", lambda r: r["doc_type"]))).alias("types"), F.exists("refs", lambda r: r["p50"].isNotNull()).alias("priced"))


def marker_cut(text: str | None, marker: str, size: int, least: int) -> list[str]:
    """A text cut before lines that match a marker, short parts joined to the one before, long ones cut at ``size``."""
    pattern, parts = re.compile(marker), []
    for line in (text or "").split("\n"):
        if not parts or pattern.search(line):
            parts.append([])
        parts[-1].append(line)
    out: list[str] = []
    for part in ("\n".join(p).strip() for p in parts):
        if not part:
            continue
        if out and len(part) < least and len(out[-1]) + len(part) < size:
            out[-1] += "\n" + part
        else:
            out += [part[i : i + size] for i in range(0, len(part), size)]
    return out


def marker_chunks(docs: DataFrame, marker: str, size: int = 1800, least: int = 200) -> DataFrame:
    """(doc_id, chunk, body): texts cut before lines that match a marker; a part under ``least``
    characters joins the one before while both fit ``size``; longer ones are cut at ``size``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = marker_cut(t, marker, size, least)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["doc_id", "chunk", "body"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id bigint, chunk int, body string")
