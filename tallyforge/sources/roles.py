"""Sales roles on star-schema tables: catalogue, deals and their lines.

``lines`` is one row per line of a deal with the deal's columns repeated, as operators expect it:

dataset, deal_id, title, client_id, begin, close, payment, opportunity, line (position and ties, a
struct that orders the lines of a deal), product_id, product_name, price, quantity, base_price,
direction, section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("base_price"), F.col("p_type").alias("direction"), F.col("p_brand").alias("section"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("deal_id"),
        F.when(F.col("o_orderstatus") == "F", "orders").when(F.col("o_orderstatus") == "O", "offers").otherwise("open").alias("dataset"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("begin"),
        F.col("o_totalprice").alias("opportunity"),
        F.when(F.col("o_orderpriority") == "5-LOW", "barter").otherwise("money").alias("payment"),
        F.col("o_orderpriority").alias("title"),
    )


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with flat columns, as they are shuffled; ``_shaped`` makes the others of them."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_partkey").alias("product_id"), "l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("ship"))


def _shaped(lines: DataFrame) -> DataFrame:
    line = F.struct("l_linenumber", F.col("product_id").alias("l_partkey"), "l_suppkey", "l_extendedprice")
    return lines.withColumns({"line": line, "price": F.col("l_extendedprice") / F.col("quantity")}).drop("l_linenumber", "l_suppkey", "l_extendedprice")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before the catalogue is joined: product_id, price, quantity and the deal's columns."""
    return _shaped(_items(spark, folder).join(_orders(spark, folder), "deal_id"))


def lines(spark: SparkSession, folder: str, by_deal: bool = False) -> DataFrame:
    """Normalised lines. Deals are joined last, so where tables are too large to be broadcast the rows of a
    deal lie together and what is grouped by deal needs no further shuffle. With ``by_deal`` they do so at any
    size: rows of few columns are smaller than what a deal's groups would be shuffled as."""
    from tallyforge.operators.sales import normalised, with_goods

    rows = with_goods(_items(spark, folder), catalogue(spark, folder))
    rows = rows.repartition("deal_id") if by_deal else rows
    return normalised(_shaped(rows.join(_orders(spark, folder), "deal_id")))
