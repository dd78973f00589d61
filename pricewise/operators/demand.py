"""Demand aggregates.

All are ``groupBy().agg()`` with built-in aggregates, so Spark plans a partial
(map-side) aggregate before the shuffle and a final one after it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.functions import columns as C

DAILY_KEYS = ["store_id", "subgroup", "sale_date"]
# Store attributes are functionally dependent on store_id: grouping by them as
# well gives the same groups and saves a second join with the stores table.
DAILY_CARRY = ["category", "group_name", "brand", "store_name", "region", "store_type"]


def daily_demand(tx_enriched: DataFrame, rounded_quantity: bool = False) -> DataFrame:
    """One row per store x subgroup x day (x category x group) with six sums (A1).

    PRICE_, base_price_, costos_ are sums of line values, as in the original.
    """
    q = C.quantity_from_sales(rounded=rounded_quantity)
    agg = tx_enriched.groupBy(*DAILY_KEYS, *DAILY_CARRY).agg(
        F.sum("total_sales").alias("total_sales_"),
        F.sum(q).alias("quantity_"),
        F.sum("price").alias("price_"),
        F.sum("base_price").alias("base_price_"),
        F.sum("costos").alias("costos_"),
        F.sum("initial_ticket_price").alias("initial_ticket_price_"),
    )
    return agg.select(
        C.format_key(day="sale_date").alias("store_subgroup_date_id"),
        "store_id", "subgroup", F.col("sale_date").alias("date_id"),
        "category", "group_name", "total_sales_", "quantity_", "price_", "base_price_",
        "costos_", "initial_ticket_price_", "brand", "store_name", "region",
        F.coalesce("store_type", F.lit("Unknown")).alias("store_type"),
        F.month("sale_date").alias("mes"), F.dayofmonth("sale_date").alias("dia"),
        F.year("sale_date").alias("anio"),
    )


def total_by(df: DataFrame, dims, measure: str = "total_sales", name: str = "demand",
             with_quantity: str | None = None) -> DataFrame:
    """Sum of a measure by one or more dimensions."""
    dims = [dims] if isinstance(dims, str) else list(dims)
    aggs = [F.sum(measure).alias(name)]
    if with_quantity:
        aggs.append(F.sum(with_quantity).alias("quantity"))
    return df.groupBy(*dims).agg(*aggs)


def chain_total(df: DataFrame, brand: str, measure: str = "total_sales", name: str = "demand") -> DataFrame:
    """One chain's total by subgroup (A4)."""
    return total_by(df.filter(F.col("brand") == brand), "subgroup", measure, name)


def mean_of_store_totals(df: DataFrame, by: str = "store_type", measure: str = "margin") -> DataFrame:
    """Sum per store, then the mean of those sums per store attribute (A5).

    Store totals are exact decimal sums (line values at 1e-6), so the mean does not
    depend on the order in which partial sums meet; one double division at the end.
    """
    per_store = df.groupBy("store_id", by).agg(
        F.sum(F.col(measure).cast("decimal(38,6)")).alias("store_total"))
    return per_store.groupBy(by).agg(
        (F.sum("store_total").cast("double") / F.count("*")).alias("mean_store_total"))


def monthly_trend(df: DataFrame, dims=(), measure: str = "total_sales", name: str = "demand") -> DataFrame:
    """Demand by first-of-month (and optional dimensions)."""
    return df.groupBy(C.month_start("sale_date").alias("year_month"), *dims).agg(
        F.sum(measure).alias(name))


def mean_sd(df: DataFrame, measure: str = "price_") -> DataFrame:
    """Global mean and sample standard deviation."""
    return df.agg(F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"))


def distinct_stores_by(df: DataFrame, by: str = "state", measure: str = "total_sales",
                       name: str = "demand") -> DataFrame:
    """Total, distinct store count, and total per store."""
    return (df.groupBy(by).agg(F.sum(measure).alias(name),
                               F.countDistinct("store_id").alias("n_stores"))
            .withColumn(f"{name}_per_store", F.try_divide(F.col(name), F.col("n_stores"))))


def count_by(df: DataFrame, by: str, name: str = "n_stores") -> DataFrame:
    """Row count by a dimension."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def recent_mean_price(daily: DataFrame, since: dt.date) -> DataFrame:
    """Mean daily PRICE_ since a date per subgroup, store, category, group."""
    return (daily.filter(F.col("date_id") >= F.lit(since))
            .groupBy("subgroup", "store_id", "category", "group_name")
            .agg(C.stable_mean("price_").alias("price_mean")))


def recent_median_price(daily: DataFrame, since: dt.date) -> DataFrame:
    """Median daily PRICE_ since a date (A14).  Groups are bounded by the window length,
    so the exact percentile's buffer is bounded too."""
    return (daily.filter(F.col("date_id") >= F.lit(since))
            .groupBy("subgroup", "store_id", "category", "group_name", "store_type")
            .agg(F.percentile("price_", 0.5).alias("price_median")))


def early_january_profile(daily: DataFrame, days: int = 7) -> DataFrame:
    """Mean price and quantity on each of the first ``days`` days of January
    over all years, per store and subgroup (A13, P14)."""
    return (daily.filter((F.col("dia") <= days) & (F.col("mes") == 1))
            .groupBy("dia", "mes", "store_id", "subgroup")
            .agg(C.stable_mean("price_").alias("price_avg"),
                 C.stable_mean("quantity_").alias("quantity_avg")))


def horizon_profile(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Mean units sold on the calendar days (mes, dia) of a horizon in earlier years, per
    store and subgroup (A13 for any horizon)."""
    return (daily.join(days.select("mes", "dia").distinct(), ["mes", "dia"], "left_semi")
            .groupBy("store_id", "subgroup", "mes", "dia").agg(C.stable_mean("quantity_").alias("quantity_avg")))


def series_facts(daily: DataFrame) -> DataFrame:
    """Per store and subgroup: mean units on the days it sells, and its category and group
    (the first by name if it has several)."""
    return daily.groupBy("store_id", "subgroup").agg(
        C.stable_mean("quantity_").alias("quantity_usual"), F.min("category").alias("category"), F.min("group_name").alias("group_name"))


def item_day(tx_enriched: DataFrame) -> DataFrame:
    """Store x SKU x day: units, lowest price, sales, lowest cost, validity flag."""
    agg = tx_enriched.groupBy("store_id", "sku", "sale_date", "brand", "category",
                              "group_name", "region").agg(
        F.sum(C.quantity_from_sales(rounded=True)).alias("quantity"),
        F.min("price").alias("price"),
        F.sum("total_sales").alias("total_sales"),
        F.min("costos").alias("costos"),
    )
    return agg.select("*", C.valid_flag().alias("valid"),
                      F.month("sale_date").cast("string").alias("mes"),
                      F.year("sale_date").alias("anio"))


def item_price_range(items: DataFrame) -> DataFrame:
    """Historical lowest and highest price and lowest cost per store x SKU."""
    return items.groupBy("store_id", "sku", "category", "group_name", "brand", "region").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min("costos").alias("costos"))


def colliding_sku_means(products: DataFrame) -> DataFrame:
    """Mean base price, ticket price, cost per subgroup over SKUs listed under more
    than one subgroup, rounded to cents (A26)."""
    shared = (products.groupBy("sku").agg(F.countDistinct("subgroup").alias("n"))
              .filter(F.col("n") > 1).select("sku"))
    return (products.join(shared, "sku", "left_semi").groupBy("subgroup").agg(
        F.round(F.avg("base_price"), 2).alias("base_price_avg"),
        F.round(F.avg("initial_ticket_price"), 2).alias("initial_ticket_price_avg"),
        F.round(F.avg("costos"), 2).alias("costos_avg")))
