"""Queries for data quality, report KPIs, windows, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewise.operators import demand, enrich, kpi, quality
from pricewise.plans.oracle import with_fixtures as W
from pricewise.plans.registry import Pipeline, register, rounded
from pricewise.session import work_path
from pricewise.sources import io
from pricewise.sources.fixtures import RetailTables

TX_ORDER_SQL = "markup, profit, quantity_filled, transaction_id, sku, store_id, sale_date"

# ----------------------------------------------------------------------------- quality


@register("a17_null_counts_transactions", W("""
select count_if(transaction_id is null) as transaction_id, count_if(sale_date is null) as sale_date,
       count_if(store_id is null) as store_id, count_if(sku is null) as sku, count_if(quantity is null) as quantity,
       count_if(price is null) as price, count_if(total_sales is null) as total_sales,
       count_if(subgroup is null) as subgroup, count_if(store_subgroup_date_id is null) as store_subgroup_date_id
from transactions"""))
def a17(spark, sf):
    return quality.null_counts(RetailTables(spark, sf).transactions)


@register("a17_null_counts_stores", W("""
select count_if(store_id is null) as store_id, count_if(brand is null) as brand,
       count_if(store_name is null) as store_name, count_if(state is null) as state,
       count_if(region is null) as region, count_if(store_type is null) as store_type,
       count_if(opendate is null) as opendate, count_if(closedate is null) as closedate from stores"""))
def a17b(spark, sf):
    return quality.null_counts(RetailTables(spark, sf).stores)


@register("a18_quantile_profile_price", W("""
select quantile_disc(price, 0.01) as q_low, quantile_disc(price, 0.99) as q_high,
       min(price) as min, max(price) as max from transactions"""))
def a18(spark, sf):
    return quality.quantile_profile(RetailTables(spark, sf).transactions, "price")


@register("a18_quantile_profile_quantity", W("""
select quantile_disc(quantity, 0.01) as q_low, quantile_disc(quantity, 0.99) as q_high,
       min(quantity) as min, max(quantity) as max from transactions"""))
def a18b(spark, sf):
    return quality.quantile_profile(RetailTables(spark, sf).transactions, "quantity")


@register("a19_count_outside_p1_p99", W("""
with q as (select quantile_disc(total_sales, 0.01) as lo, quantile_disc(total_sales, 0.99) as hi from transactions)
select count(*) as n_outside from transactions, q where total_sales < lo or total_sales > hi"""))
def a19(spark, sf):
    return quality.count_outside(RetailTables(spark, sf).transactions, "total_sales")


@register("a18_quantile_profile_total_sales", W("""
select quantile_disc(total_sales, 0.01) as q_low, quantile_disc(total_sales, 0.99) as q_high,
       min(total_sales) as min, max(total_sales) as max from transactions"""))
def a18c(spark, sf):
    return quality.quantile_profile(RetailTables(spark, sf).transactions, "total_sales")


def _outside_sql(column: str) -> str:
    return W(f"""
with q as (select quantile_disc({column}, 0.01) as lo, quantile_disc({column}, 0.99) as hi from transactions)
select count(*) as n_outside from transactions, q where {column} < lo or {column} > hi""")


@register("a19_count_outside_quantity", _outside_sql("quantity"))
def a19b(spark, sf):
    return quality.count_outside(RetailTables(spark, sf).transactions, "quantity")


@register("a19_count_outside_price", _outside_sql("price"))
def a19c(spark, sf):
    return quality.count_outside(RetailTables(spark, sf).transactions, "price")


PROFILED = ["transactions", "stores", "store_clusters", "product_master", "product_groups", "customers", "ids_test"]
PROFILED_COLUMNS = {
    "transactions": ["transaction_id", "sale_date", "store_id", "sku", "quantity", "price", "total_sales", "subgroup", "store_subgroup_date_id"],
    "stores": ["store_id", "brand", "store_name", "state", "region", "store_type", "opendate", "closedate"],
    "store_clusters": ["store_id", "brand", "store_name", "cluster"],
    "product_master": ["sku", "product_name", "category", "group_name", "subgroup", "brand_prod", "base_price", "initial_ticket_price", "costos"],
    "product_groups": ["sku", "product_name", "price_group_id", "price_group_name", "group_type"],
    "customers": ["client_id", "state", "occupation", "loyalty_member", "loyalty_points"],
    "ids_test": ["store_subgroup_date_id"],
}


def _profile_sql() -> str:
    ids = """
select store_id || '_' || subgroup || '_' || strftime(g.d, '%Y-%m-%d') as store_subgroup_date_id
from (select distinct store_id, subgroup from transactions where store_id in (select store_id from stores_open)
      union all select distinct store_id, 'twin small ring' from transactions
      where subgroup = 'small ring' and store_id in (select store_id from stores_open)) p,
     unnest(generate_series(timestamp '2001-11-05', timestamp '2001-11-11', interval 1 day)) as g(d)"""
    parts = [f"select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, cast(count_if({c} is null) as bigint) as n_null from {t}"
             for t in PROFILED for c in PROFILED_COLUMNS[t]]
    return W(f"with ids_test as ({ids})\n" + "\nunion all ".join(parts))


@register("a17_profile_of_all_tables", _profile_sql())
def a17_all(spark, sf):
    """Nulls of every column of the seven tables, counted while they are written as parquet."""
    rt = RetailTables(spark, sf)
    return quality.write_profiled({t: getattr(rt, t) for t in PROFILED}, lambda df, name: io.write_parquet(df, work_path(spark, f"profiled-{name}")))


@register("a20_extreme_prices", W("""
select quantity, price, total_sales from transactions
where price > (select quantile_disc(price, 0.9999) from transactions)"""))
def a20(spark, sf):
    return quality.extreme_rows(RetailTables(spark, sf).transactions, "price", 0.9999,
                                keep=["quantity", "price", "total_sales"])


# ----------------------------------------------------------------------------- KPIs

@register("a21_rollup_tree", W("""
select case when grouping_id(group_name, subgroup) = 0 then subgroup
            when grouping_id(group_name, subgroup) = 1 then group_name else 'Total' end as label,
       case when grouping_id(group_name, subgroup) = 0 then group_name
            when grouping_id(group_name, subgroup) = 1 then 'Total' else '' end as parent,
       round(sum(total_sales_), 2) as value, cast(grouping_id(group_name, subgroup) as int) as level
from daily group by rollup(group_name, subgroup)"""))
def a21(spark, sf):
    t = kpi.rollup_tree(Pipeline(spark, sf).tx, "group_name", "subgroup", "total_sales")
    return rounded(t.withColumn("level", F.col("level").cast("int")), 2, "value")


@register("a22_top9_share_of_demand", W("""
with t as (select subgroup, round(sum(total_sales_), 2) as demand from daily group by subgroup),
r as (select *, rank() over (order by demand desc) <= 9 as in_set from t),
g as (select in_set, sum(demand) as total from r group by in_set)
select in_set, round(total, 2) as total, round(100 * total / sum(total) over (), 6) as pct from g"""))
def a22(spark, sf):
    t = rounded(demand.total_by(Pipeline(spark, sf).tx, "subgroup", "total_sales"), 2, "demand")
    top = kpi.top_k_with_ties(t, "demand", 9).select("subgroup", F.lit(True).alias("in_set"))
    flagged = t.join(top, "subgroup", "left").withColumn("in_set", F.coalesce("in_set", F.lit(False)))
    out = kpi.share_of_total(flagged, F.col("in_set"), "demand")
    return rounded(out, 2, "total").withColumn("pct", F.round("pct", 6))


@register("a23_t2_top20_products_by_units", W("""
with k as (select product_name, category, sum(quantity_filled) as quantity,
                  round(sum(price), 8) / count(price) as price_mean from tx_enriched group by 1, 2)
select product_name, category, quantity, price_mean from
(select *, rank() over (order by quantity desc) as r from k) where r <= 20"""))
def a23(spark, sf):
    k = kpi.product_kpis(Pipeline(spark, sf).tx).select("product_name", "category", "quantity", "price_mean")
    return kpi.top_k_with_ties(k, "quantity", 20)


@register("a24_t2_top20_products_by_profit", W("""
with k as (select product_name, category, round(sum(profit), 2) as profit,
                  round(sum(price), 8) / count(price) as price_mean from tx_enriched group by 1, 2)
select product_name, category, profit, price_mean from
(select *, rank() over (order by profit desc) as r from k) where r <= 20"""))
def a24(spark, sf):
    k = rounded(kpi.product_kpis(Pipeline(spark, sf).tx), 2, "profit").select(
        "product_name", "category", "profit", "price_mean")
    return kpi.top_k_with_ties(k, "profit", 20)


@register("a25_profit_per_unit", W("""
select product_name, round(sum(profit), 2) / sum(quantity_filled) as profit_per_unit
from tx_enriched group by product_name"""))
def a25(spark, sf):
    k = Pipeline(spark, sf).tx.groupBy("product_name").agg(
        F.round(F.sum("profit"), 2).alias("p"), F.sum("quantity_filled").alias("q"))
    return k.select("product_name", F.try_divide("p", "q").alias("profit_per_unit"))


@register("a27_markup_quintiles", W(f"""
with b as (select *, (price - costos) / nullif(costos, 0) as markup from tx_enriched),
n as (select markup, profit, quantity_filled, ntile(5) over (order by {TX_ORDER_SQL}) as bin
      from b where markup is not null),
t as (select bin, round(sum(profit), 2) as total_profit, sum(quantity_filled) as total_quantity from n group by bin),
q as (select quantile_cont(markup, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as l from b where markup is not null)
select t.bin, total_profit, total_quantity, round(l[bin], 8) as lower_limit, round(l[bin + 1], 8) as upper_limit
from t, q"""))
def a27(spark, sf):
    out = kpi.markup_bins(Pipeline(spark, sf).tx, 5)
    return rounded(out, 2, "total_profit").withColumns({
        "lower_limit": F.round("lower_limit", 8), "upper_limit": F.round("upper_limit", 8)})


@register("a28_mean_price_of_top20", W("""
with k as (select product_name, category, sum(quantity_filled) as quantity,
                  round(sum(price), 8) / count(price) as price_mean from tx_enriched group by 1, 2),
top as (select * from (select *, rank() over (order by quantity desc) as r from k) where r <= 20)
select round(sum(price_mean), 8) / count(*) as mean_price, count(*) as n_products from top"""))
def a28(spark, sf):
    k = kpi.product_kpis(Pipeline(spark, sf).tx)
    top = kpi.top_k_with_ties(k, "quantity", 20)
    return top.agg((F.round(F.sum("price_mean"), 8) / F.count(F.lit(1))).alias("mean_price"),
                   F.count(F.lit(1)).alias("n_products"))


# ----------------------------------------------------------------------------- windows, ranking, sets

@register("w5_markup_ntile", W(f"""
select {TX_ORDER_SQL}, ntile(5) over (order by {TX_ORDER_SQL}) as bin
from (select *, (price - costos) / nullif(costos, 0) as markup from tx_enriched) where markup is not null"""))
def w5(spark, sf):
    from pricewise.functions import columns as C
    base = Pipeline(spark, sf).tx.select(C.markup().alias("markup"), "profit", "quantity_filled",
                                         "transaction_id", "sku", "store_id", "sale_date")
    base = base.filter(F.col("markup").isNotNull())
    return kpi.ntile(base, base.columns, 5)


@register("w6_group_totals_on_rows", W("""
select transaction_id, sku, store_subgroup_date_id, total_sales,
       round(sum(total_sales) over (partition by store_subgroup_date_id), 8) as total_sales_group
from transactions"""))
def w6(spark, sf):
    tx = RetailTables(spark, sf).transactions.select("transaction_id", "sku", "store_subgroup_date_id",
                                                     "total_sales")
    out = kpi.group_totals_on_rows(tx, "store_subgroup_date_id", ["total_sales"])
    return rounded(out, 8, "total_sales_group")


@register("t1_top10_subgroups_by_demand", W("""
select subgroup, demand from (select subgroup, round(sum(total_sales_), 2) as demand,
       rank() over (order by round(sum(total_sales_), 2) desc) as r from daily group by subgroup) where r <= 10"""))
def t1(spark, sf):
    t = rounded(demand.total_by(Pipeline(spark, sf).tx, "subgroup", "total_sales"), 2, "demand")
    return kpi.top_k_with_ties(t, "demand", 10)


@register("t1_top10_subgroups_by_margin", W("""
select subgroup, margin from (select subgroup, round(sum(margin), 2) as margin,
       rank() over (order by round(sum(margin), 2) desc) as r from tx_enriched group by subgroup) where r <= 10"""))
def t1b(spark, sf):
    t = rounded(demand.total_by(Pipeline(spark, sf).tx, "subgroup", "margin", "margin"), 2, "margin")
    return kpi.top_k_with_ties(t, "margin", 10)


@register("t3_top5_products_by_profit", W("""
select product_name, round(sum(profit), 2) as profit from tx_enriched group by product_name
order by profit desc, product_name limit 5"""))
def t3(spark, sf):
    t = rounded(Pipeline(spark, sf).tx.groupBy("product_name").agg(F.sum("profit").alias("profit")),
                2, "profit")
    return kpi.top_k(t, "profit", 5, ["product_name"])


@register("t5_multi_column_sort", W("""
select category, cast(date_trunc('month', date_id) as date) as year_month, round(sum(total_sales_), 2) as demand
from daily group by 1, 2 order by category, year_month"""))
def t5(spark, sf):
    d = Pipeline(spark, sf).daily.withColumnRenamed("date_id", "sale_date")
    out = rounded(demand.monthly_trend(d, ["category"], "total_sales_"), 2, "demand")
    return out.orderBy("category", "year_month").select("category", "year_month", "demand")


@register("j10_semi_join_top5", W("""
with top5 as (select product_name from tx_enriched group by product_name
              order by round(sum(profit), 2) desc, product_name limit 5)
select product_name, year_month, round(sum(profit), 2) as profit from tx_enriched
where product_name in (select product_name from top5) group by 1, 2"""))
def j10(spark, sf):
    tx = Pipeline(spark, sf).tx
    totals = rounded(tx.groupBy("product_name").agg(F.sum("profit").alias("profit")), 2, "profit")
    top5 = kpi.top_k(totals, "profit", 5, ["product_name"]).select("product_name")
    monthly = demand.monthly_trend(tx.join(top5, "product_name", "left_semi"), ["product_name"],
                                   "profit", "profit")
    return rounded(monthly, 2, "profit")


@register("j11_aggregate_join_aggregate", W("""
with d as (select store_type, round(sum(total_sales_), 2) as demand from daily group by store_type),
s as (select coalesce(store_type, 'Unknown') as store_type, count(*) as n_stores from stores group by 1)
select d.store_type, demand, n_stores from d left join s on d.store_type = s.store_type"""))
def j11(spark, sf):
    p = Pipeline(spark, sf)
    d = rounded(demand.total_by(enrich.label_unknown(p.tx), "store_type", "total_sales"), 2, "demand")
    s = demand.count_by(enrich.label_unknown(p.rt.stores), "store_type")
    return d.join(s, "store_type", "left")


@register("u3_distinct_series", W("select distinct store_id, subgroup from daily"))
def u3(spark, sf):
    return Pipeline(spark, sf).tx.select("store_id", "subgroup").distinct()
