"""Dimension joins and per-transaction derived columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.functions import columns as C
from pricewise.operators.joins import lookup

STORE_ATTRS = ["brand", "store_name", "state", "region", "store_type", "cluster"]
PRODUCT_ATTRS = ["product_name", "category", "group_name", "brand_prod", "base_price",
                 "initial_ticket_price", "costos"]


def is_open(cutoff: dt.date, closedate: str = "closedate"):
    """Open at the cutoff: not closed on or before it."""
    return (F.col(closedate) > F.lit(cutoff)) | F.col(closedate).isNull()


def open_stores(stores: DataFrame, clusters: DataFrame, cutoff: dt.date) -> DataFrame:
    """Stores open at ``cutoff`` with their cluster (P9 + J1).

    The right side keeps only the key and its new column, so clashing names
    (brand, store_name) never need suffixes.
    """
    right = clusters.select("store_id", "cluster")
    return stores.filter(is_open(cutoff)).join(right, "store_id", "left")


def label_unknown(df: DataFrame, column: str = "store_type", label: str = "Unknown") -> DataFrame:
    """Null -> default label."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(label)))


def with_products(tx_products: DataFrame, products: DataFrame) -> DataFrame:
    """The products that transactions name, with their attributes: the second lookup of ``enrich_transactions``
    made on the small side, so the fact is joined (and shuffled) once for both."""
    pm = products.select("sku", "subgroup", *PRODUCT_ATTRS)
    return lookup(tx_products, pm, ["sku", "subgroup"], "left")


def enrich_transactions(tx: DataFrame, stores_open: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Transactions with store and product attributes and the margin columns.

    The store join is written as the original left join followed by the not-null
    brand filter; Catalyst turns the pair into an inner join.  Products join on
    (sku, subgroup): sku alone is not unique.  Without ``products`` the transactions have their attributes already.
    """
    st = stores_open.select("store_id", *STORE_ATTRS)
    out = lookup(tx, st, "store_id", "left").filter(F.col("brand").isNotNull())
    if products is not None:
        out = lookup(out, products.select("sku", "subgroup", *PRODUCT_ATTRS), ["sku", "subgroup"], "left")
    return out.select(
        "*",
        F.month("sale_date").alias("sale_month"),
        F.year("sale_date").alias("sale_year"),
        C.month_start("sale_date").alias("year_month"),
        C.margin().alias("margin"),
        C.ganancia_as_coded().alias("ganancia"),
        C.impute_quantity().alias("quantity_filled"),
    ).withColumn("profit", C.profit(quantity="quantity_filled"))


def with_key_parts(df: DataFrame, key: str = "store_subgroup_date_id") -> DataFrame:
    """Split the composite id into store_id, subgroup, date_id."""
    return df.select("*", *C.split_key(key))
