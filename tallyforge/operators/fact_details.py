"""The wider columns of deal and product facts: built beside ``sales.deal_facts`` and ``product_facts``,
whose other readers need none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.sales import MISSING_CLIENT
from tallyforge.operators.taxonomy import heights
from tallyforge.operators.windows import mode, top_n

DEAL = ["dataset", "deal_id"]


def client_status(client_key: Column) -> Column:
    """Whether a client is known."""
    return F.when(client_key == MISSING_CLIENT, "missing").otherwise("known")


def deal_details(lines: DataFrame, deals: DataFrame, samples: int = 5) -> DataFrame:
    """Deals with client_status, close_year, letter_height_cm and sample_products.

    Samples are the first ``samples`` distinct product names of a deal by its lines. The height is the
    most frequent one that product names state, of equally frequent ones that of the first line; where
    they state none, that of the title and, where lines have one, the description. A name is read once
    for all lines of a deal that carry it, so a deal with very many lines is combined before the shuffle;
    only ``samples`` names of a deal are ever in one list. Nulls: a null name is no sample and has no
    height; a deal without samples has an empty string, one without heights a null.
    """
    names = lines.groupBy(*DEAL, "product_name").agg(F.min("line").alias("_l"), F.count(F.lit(1)).alias("_n"))
    named = names.filter("product_name is not null")
    first = top_n(named.select(*DEAL, "product_name", "_l"), DEAL, [F.col("_l"), F.col("product_name")], samples)
    listed = F.array_sort(F.collect_list(F.struct("rank", "product_name")))
    sampled = first.groupBy(*DEAL).agg(F.array_join(F.transform(listed, lambda x: x["product_name"]), " | ").alias("sample_products"))

    stated = named.select(*DEAL, "_l", "_n", F.posexplode(heights(F.col("product_name"))).alias("_i", "height"))
    per = stated.groupBy(*DEAL, "height").agg(F.sum("_n").alias("_n"), F.min(F.struct("_l", "_i")).alias("_first"))
    high = per.groupBy(*DEAL).agg(F.min_by("height", F.struct(-F.col("_n"), "_first")).alias("_height"))
    told = F.concat_ws(" ", "title", *(["description"] if "description" in deals.columns else []))
    fallback = mode(deals.select(*DEAL, F.posexplode(heights(told)).alias("_i", "height")), DEAL, "height", F.col("_i"), "_told")

    out = deals.join(sampled, DEAL, "left").join(high, DEAL, "left").join(fallback, DEAL, "left")
    return out.select(
        *deals.columns,
        client_status(F.col("client_key")).alias("client_status"),
        F.year("close").alias("close_year"),
        F.coalesce("_height", "_told").alias("letter_height_cm"),
        F.coalesce("sample_products", F.lit("")).alias("sample_products"),
    )


def product_details(facts: DataFrame, lines: DataFrame, goods: DataFrame, barter: str = "barter") -> DataFrame:
    """Product facts with the name on the first order (else offer) line, the catalogue's own name, section
    and further columns (cost, coefficient, parent section, where goods have them), the least and the
    highest price ratio, barter left out, and the base price, that of the lines where the catalogue has none.

    One aggregation over orders and offers, joined to the facts by product.
    """
    some = lines.filter(F.col("dataset").isin("orders", "offers"))
    ratio = F.when((F.col("dataset") == "orders") & (F.col("payment") != barter), F.col("price_ratio"))
    place = F.struct(F.when(F.col("dataset") == "orders", 0).otherwise(1), "deal_id", "line")
    per = some.groupBy("product_key").agg(
        F.min_by(F.struct("product_id", "product_name", "direction", "base_price"), place).alias("_s"),
        F.min(ratio).alias("_low"),
        F.max(ratio).alias("_high"),
    )
    own = [c for c in ("section", "parent_section", "cost_price", "coefficient") if c in goods.columns]
    known = goods.select(F.col("product_id").cast("string").alias("product_key"), F.col("name").alias("catalog_name"), *own)
    out = facts.join(known, "product_key", "left").join(per, "product_key", "left")
    rest = [c for c in facts.columns if c not in ("product_key", "product_name", "base_price", "direction")]
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    return out.select(
        "product_key",
        F.coalesce(F.col("_s.product_id").cast("string"), F.when(F.col("goods_present") == "Y", F.col("product_key")), F.lit("")).alias("product_id"),
        F.coalesce(filled(F.col("product_name"), F.col("_s.product_name")), F.lit("")).alias("product_name"),
        F.coalesce(filled(F.col("catalog_name"), F.col("_s.product_name")), F.lit("")).alias("catalog_name"),
        F.when(F.col("goods_present") == "Y", F.col("direction")).otherwise(F.coalesce("_s.direction", "direction")).alias("direction"),
        F.coalesce("base_price", "_s.base_price").alias("base_price"),
        *rest,
        *own,
        F.round("_low", 4).alias("ratio_min"),
        F.round("_high", 4).alias("ratio_max"),
    )
