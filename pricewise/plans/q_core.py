"""Queries for sources/sinks (S), projections/filters (P), joins (J) and demand aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pricewise.functions import columns as C
from pricewise.operators import demand, enrich
from pricewise.plans.oracle import with_fixtures as W
from pricewise.plans.registry import Pipeline, register, rounded
from pricewise.session import materialize, work_path
from pricewise.sources import io, schemas
from pricewise.sources.fixtures import CUTOFF, PROXY_DONOR, PROXY_TARGET, RetailTables

RECENT_SINCE = dt.date(2001, 10, 1)     # "last month" of the data (reference: 2023-12-01)
CHAIN = "BRAND_3"
IN_LIST = ("red plate", "small widget", "hot plate")

# ----------------------------------------------------------------------------- S: sources, sinks

TX_COLS = "transaction_id, sale_date, store_id, sku, quantity, price, total_sales, subgroup, store_subgroup_date_id"


@register("s1_csv_explicit_schema", W(f"select {TX_COLS} from transactions"))
def s1(spark, sf):
    path = work_path(spark, "s1-csv")
    io.write_csv(RetailTables(spark, sf).transactions, path)
    return io.read_csv(spark, path, schemas.TRANSACTIONS)


@register("s2_csv_inferred_schema", W("select * from stores"))
def s2(spark, sf):
    path = work_path(spark, "s2-csv")
    io.write_csv(RetailTables(spark, sf).stores, path)
    return io.read_csv_inferred(spark, path, schemas.STORES)


@register("s3_parquet_scan_pruned", W("""
select store_id, sku, total_sales from transactions where sale_date >= date '2001-01-01'"""))
def s3(spark, sf):
    return (RetailTables(spark, sf).transactions
            .filter(F.col("sale_date") >= F.lit(dt.date(2001, 1, 1)))
            .select("store_id", "sku", "total_sales"))


@register("s4_csv_to_parquet", W(f"select {TX_COLS} from transactions"))
def s4(spark, sf):
    csv_path, pq_path = work_path(spark, "s4-csv"), work_path(spark, "s4-parquet")
    io.write_csv(RetailTables(spark, sf).transactions, csv_path)
    io.csv_to_parquet(spark, csv_path, pq_path, schemas.TRANSACTIONS)
    return io.read_parquet(spark, pq_path)


@register("s5_parquet_sink_partitioned", W("""
select store_id, subgroup, date_id, category, group_name, round(total_sales_, 2) as total_sales_, anio
from daily"""))
def s5(spark, sf):
    path = work_path(spark, "s5-parquet")
    daily = rounded(Pipeline(spark, sf).daily, 2, "total_sales_").select(
        "store_id", "subgroup", "date_id", "category", "group_name", "total_sales_", "anio")
    io.write_parquet(daily, path, mode="overwrite", partition_by=["anio"])
    return io.read_parquet(spark, path)


@register("s5_append_partitions", W("""
select store_id, subgroup, date_id, category, group_name, round(total_sales_, 2) as total_sales_, anio
from daily"""))
def s5_append(spark, sf):
    """The daily table year by year: the last year arrives as a batch of its own, and once more."""
    path = work_path(spark, "s5-append")
    p = Pipeline(spark, sf)
    daily = rounded(p.daily, 2, "total_sales_").select("store_id", "subgroup", "date_id", "category", "group_name", "total_sales_", "anio")
    daily = materialize(daily, "daily-columns")
    last = daily.agg(F.max("anio")).first()[0]
    io.write_parquet(daily.filter(F.col("anio") < F.lit(last)), path, mode="overwrite", partition_by=["anio"])
    for _ in range(2):
        io.append_batch(daily.filter(F.col("anio") == F.lit(last)), path, ["anio"])
    return spark.read.schema(daily.schema).parquet(path)


@register("s6_csv_sink", W("select * from item_range"))
def s6(spark, sf):
    path = work_path(spark, "s6-csv")
    ranges = Pipeline(spark, sf).item_range
    io.write_csv(ranges, path)
    return io.read_csv(spark, path, ranges.schema)


S8_KEY_SQL = "concat_ws('|', cast(transaction_id as varchar), sku, store_id, cast(sale_date as varchar))"


@register("s8_sample_hash_bucket", W(f"""
select {TX_COLS} from transactions
where ('0x' || substr(md5({S8_KEY_SQL}), 1, 8))::bigint % 100 < 2"""))
def s8(spark, sf):
    """2 % sample, reproducible on any engine: keep rows whose key hashes into 2 of 100 buckets."""
    tx = RetailTables(spark, sf).transactions
    key = F.concat_ws("|", F.col("transaction_id").cast("string"), "sku", "store_id",
                      F.col("sale_date").cast("string"))
    return io.sample_by_hash(tx, key, 0.02)


SAMPLE_ROWS = 10_000


@register("s8_sample_fixed_size", W(f"""
select {TX_COLS} from transactions
order by ('0x' || substr(md5({S8_KEY_SQL}), 1, 15))::bigint, {TX_COLS} limit {SAMPLE_ROWS}"""))
def s8c(spark, sf):
    """A sample of a fixed number of rows, the same on any layout."""
    tx = RetailTables(spark, sf).transactions
    key = F.concat_ws("|", F.col("transaction_id").cast("string"), "sku", "store_id", F.col("sale_date").cast("string"))
    return io.sample_fixed_size(tx, key, SAMPLE_ROWS)


@register("s8_sample_bernoulli")
def s8b(spark, sf):
    """Seeded Bernoulli sample without replacement (rows-only check)."""
    return RetailTables(spark, sf).transactions.sample(False, 0.02, seed=4177)


@register("s9_row_count", W("""
select 'transactions' as table_name, count(*) as n_rows from transactions
union all select 'daily_demand', count(*) from daily"""))
def s9(spark, sf):
    p = Pipeline(spark, sf)
    return io.row_count(p.rt.transactions, "transactions").unionByName(
        io.row_count(p.daily, "daily_demand"))


# ----------------------------------------------------------------------------- P: projections, filters

@register("p1_rename", W("""
select sku as item_sku, subgroup as item_subgroup, brand_prod as product_brand, product_name, category,
       group_name, base_price, initial_ticket_price, costos from product_master"""))
def p1(spark, sf):
    return RetailTables(spark, sf).product_master.withColumnsRenamed(
        {"sku": "item_sku", "subgroup": "item_subgroup", "brand_prod": "product_brand"})


@register("p2_drop_columns", W("select store_id, brand, store_name, region, store_type from stores_open"))
def p2(spark, sf):
    return Pipeline(spark, sf).stores_open.drop("state", "opendate", "closedate", "cluster")


@register("p3_keep_by_pattern", W("""
select store_subgroup_date_id, round(total_sales_, 8) as total_sales_, round(quantity_, 8) as quantity_,
       round(price_, 8) as price_, round(base_price_, 8) as base_price_, round(costos_, 8) as costos_,
       round(initial_ticket_price_, 8) as initial_ticket_price_ from daily"""))
def p3(spark, sf):
    d = Pipeline(spark, sf).daily
    kept = d.select("store_subgroup_date_id", d.colRegex("`.*_$`"))
    return kept.withColumns({c: F.round(c, 8) for c in kept.columns[1:]})


@register("p4_margin", W("select transaction_id, store_id, sku, sale_date, margin from tx_enriched"))
def p4(spark, sf):
    return Pipeline(spark, sf).tx.select("transaction_id", "store_id", "sku", "sale_date", "margin")


@register("p5_ganancia_as_coded", W("select transaction_id, store_id, sku, sale_date, ganancia from tx_enriched"))
def p5(spark, sf):
    return Pipeline(spark, sf).tx.select("transaction_id", "store_id", "sku", "sale_date", "ganancia")


@register("p6_profit", W("select transaction_id, store_id, sku, sale_date, profit from tx_enriched"))
def p6(spark, sf):
    return Pipeline(spark, sf).tx.select("transaction_id", "store_id", "sku", "sale_date", "profit")


@register("p7_quantity_reconstruction", W("""
select transaction_id, sku, quantity, coalesce(quantity, round(total_sales / nullif(price, 0))) as quantity_filled,
       total_sales / nullif(price, 0) as quantity_implied from transactions"""))
def p7(spark, sf):
    return RetailTables(spark, sf).transactions.select(
        "transaction_id", "sku", "quantity", C.impute_quantity().alias("quantity_filled"),
        C.quantity_from_sales().alias("quantity_implied"))


@register("p8_markup", W("""
select transaction_id, sku, price, costos, (price - costos) / nullif(costos, 0) as markup from tx_enriched"""))
def p8(spark, sf):
    return Pipeline(spark, sf).tx.select("transaction_id", "sku", "price", "costos",
                                         C.markup().alias("markup"))


@register("p9_open_at_cutoff", W("""
select store_id, brand, store_type, closedate from stores
where closedate > date '2001-12-31' or closedate is null"""))
def p9(spark, sf):
    return (RetailTables(spark, sf).stores.filter(enrich.is_open(CUTOFF))
            .select("store_id", "brand", "store_type", "closedate"))


@register("p10_not_null_filter", W("""
select t.transaction_id, t.store_id, so.brand from transactions t
left join stores_open so on t.store_id = so.store_id where so.brand is not null"""))
def p10(spark, sf):
    p = Pipeline(spark, sf)
    st = p.stores_open.select("store_id", "brand")
    return (p.rt.transactions.join(st, "store_id", "left").filter(F.col("brand").isNotNull())
            .select("transaction_id", "store_id", "brand"))


@register("p11_in_list", W(f"""
select transaction_id, subgroup, total_sales from transactions where subgroup in {IN_LIST}"""))
def p11(spark, sf):
    return (RetailTables(spark, sf).transactions.filter(F.col("subgroup").isin(*IN_LIST))
            .select("transaction_id", "subgroup", "total_sales"))


@register("p12_equality_filters", W(f"""
select store_subgroup_date_id, subgroup from daily
where subgroup != '{PROXY_DONOR}' and subgroup != '{PROXY_TARGET}' and store_type = 'Mall'"""))
def p12(spark, sf):
    d = Pipeline(spark, sf).daily
    return (d.filter((F.col("subgroup") != PROXY_DONOR) & (F.col("subgroup") != PROXY_TARGET)
                     & (F.col("store_type") == "Mall"))
            .select("store_subgroup_date_id", "subgroup"))


@register("p13_date_lower_bound", W("""
select store_subgroup_date_id, date_id, round(price_, 8) as price_ from daily where date_id >= date '2001-10-01'"""))
def p13(spark, sf):
    d = Pipeline(spark, sf).daily
    return rounded(d.filter(F.col("date_id") >= F.lit(RECENT_SINCE))
                   .select("store_subgroup_date_id", "date_id", "price_"), 8, "price_")


@register("p14_day_month_filter", W("""
select store_subgroup_date_id, dia, mes from daily where dia <= 7 and mes = 1"""))
def p14(spark, sf):
    d = Pipeline(spark, sf).daily
    return d.filter((F.col("dia") <= 7) & (F.col("mes") == 1)).select("store_subgroup_date_id", "dia", "mes")


@register("p15_null_label", W("select store_id, coalesce(store_type, 'Unknown') as store_type from stores"))
def p15(spark, sf):
    return enrich.label_unknown(RetailTables(spark, sf).stores).select("store_id", "store_type")


@register("p16_zero_or_round_even", W("""
select dia, mes, store_id, subgroup,
       coalesce(round_even(round(sum(quantity_), 8) / count(quantity_), 0), 0) as quantity_
from daily where dia <= 7 and mes = 1 group by dia, mes, store_id, subgroup"""))
def p16(spark, sf):
    prof = demand.early_january_profile(Pipeline(spark, sf).daily)
    return prof.select("dia", "mes", "store_id", "subgroup",
                       C.zero_or_round_even("quantity_avg").alias("quantity_"))


@register("p17_key_split", W("""
select store_subgroup_date_id, split_part(store_subgroup_date_id, '_', 1) as store_id,
       split_part(store_subgroup_date_id, '_', 2) as subgroup,
       try_cast(split_part(store_subgroup_date_id, '_', 3) as date) as date_id from transactions"""))
def p17(spark, sf):
    tx = RetailTables(spark, sf).transactions.select("store_subgroup_date_id")
    return enrich.with_key_parts(tx)


@register("p18_calculation_check", W("""
select transaction_id, quantity, price, total_sales, abs(quantity * price - total_sales) as dif
from transactions where quantity is not null and abs(quantity * price - total_sales) > 0.1"""))
def p18(spark, sf):
    from pricewise.operators import quality
    return quality.calculation_errors(RetailTables(spark, sf).transactions, 0.1)


@register("p19_validity_flag", W("select valid, count(*) as n from item_day group by valid"))
def p19(spark, sf):
    return Pipeline(spark, sf).item_day.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- J: joins

@register("j1_stores_clusters", W("select * from stores_open"))
def j1(spark, sf):
    return Pipeline(spark, sf).stores_open


@register("j2_fact_store_join", W("""
select t.transaction_id, t.store_id, so.brand, so.region, so.store_type from transactions t
join stores_open so on t.store_id = so.store_id"""))
def j2(spark, sf):
    p = Pipeline(spark, sf)
    from pricewise.operators.joins import lookup
    st = p.stores_open.select("store_id", "brand", "region", "store_type")
    return lookup(p.rt.transactions, st, "store_id", "inner").select(
        "transaction_id", "store_id", "brand", "region", "store_type")


@register("j3_two_key_join", W("""
select t.transaction_id, t.sku, t.subgroup, pm.category, pm.costos from transactions t
left join product_master pm on t.sku = pm.sku and t.subgroup = pm.subgroup"""))
def j3(spark, sf):
    rt = RetailTables(spark, sf)
    from pricewise.operators.joins import lookup
    pm = rt.product_master.select("sku", "subgroup", "category", "costos")
    return lookup(rt.transactions, pm, ["sku", "subgroup"], "left").select(
        "transaction_id", "sku", "subgroup", "category", "costos")


@register("j4_product_promo_groups", W("""
select pm.sku, pm.subgroup, pm.product_name, pg.price_group_id, pg.price_group_name, pg.group_type
from product_master pm left join product_groups pg on pm.sku = pg.sku and pm.product_name = pg.product_name"""))
def j4(spark, sf):
    rt = RetailTables(spark, sf)
    return rt.product_master.join(rt.product_groups, ["sku", "product_name"], "left").select(
        "sku", "subgroup", "product_name", "price_group_id", "price_group_name", "group_type")


@register("j5_enriched_transactions", W("""
select transaction_id, store_id, sku, subgroup, brand, region, category, group_name, costos, year_month,
       sale_month, sale_year from tx_enriched"""))
def j5(spark, sf):
    return Pipeline(spark, sf).tx.select(
        "transaction_id", "store_id", "sku", "subgroup", "brand", "region", "category", "group_name",
        "costos", "year_month", "sale_month", "sale_year")


# ----------------------------------------------------------------------------- A: aggregates

DAILY_SUMS = ["total_sales_", "quantity_", "price_", "base_price_", "costos_", "initial_ticket_price_"]


@register("a1_daily_demand", W("""
select store_subgroup_date_id, store_id, subgroup, date_id, category, group_name,
       round(total_sales_, 8) as total_sales_, round(quantity_, 8) as quantity_, round(price_, 8) as price_,
       round(base_price_, 8) as base_price_, round(costos_, 8) as costos_,
       round(initial_ticket_price_, 8) as initial_ticket_price_,
       brand, store_name, region, store_type, mes, dia, anio from daily"""))
def a1(spark, sf):
    return rounded(Pipeline(spark, sf).daily, 8, *DAILY_SUMS)


@register("a2_demand_by_subgroup", W("""
select subgroup, round(sum(total_sales_), 2) as demand, round(sum(quantity_), 2) as quantity
from daily group by subgroup"""))
def a2(spark, sf):
    out = demand.total_by(Pipeline(spark, sf).tx.withColumn("quantity_", C.quantity_from_sales()), "subgroup", "total_sales", with_quantity="quantity_")
    return rounded(out, 2, "demand", "quantity")


@register("a2_demand_by_store_type", W("""
select store_type, round(sum(total_sales), 2) as demand from tx_enriched group by store_type"""))
def a2b(spark, sf):
    return rounded(demand.total_by(Pipeline(spark, sf).tx, "store_type"), 2, "demand")


@register("a2_demand_by_category", W("""
select category, round(sum(total_sales), 2) as demand from tx_enriched group by category"""))
def a2c(spark, sf):
    return rounded(demand.total_by(Pipeline(spark, sf).tx, "category"), 2, "demand")


@register("a2_demand_by_brand", W("""
select brand, round(sum(total_sales_), 2) as demand from daily group by brand"""))
def a2d(spark, sf):
    return rounded(demand.total_by(Pipeline(spark, sf).tx, "brand", "total_sales"), 2, "demand")


@register("a2_demand_by_group", W("""
select group_name, round(sum(total_sales), 2) as demand from tx_enriched group by group_name"""))
def a2e(spark, sf):
    return rounded(demand.total_by(Pipeline(spark, sf).tx, "group_name"), 2, "demand")


@register("a3_margin_by_subgroup", W("""
select subgroup, round(sum(margin), 2) as margin from tx_enriched group by subgroup"""))
def a3(spark, sf):
    return rounded(demand.total_by(Pipeline(spark, sf).tx, "subgroup", "margin", "margin"), 2, "margin")


@register("a3_margin_by_category", W("""
select category, round(sum(margin), 2) as margin from tx_enriched group by category"""))
def a3b(spark, sf):
    return rounded(demand.total_by(Pipeline(spark, sf).tx, "category", "margin", "margin"), 2, "margin")


@register("a4_chain_demand_by_subgroup", W(f"""
select subgroup, round(sum(total_sales), 2) as demand from tx_enriched where brand = '{CHAIN}' group by subgroup"""))
def a4(spark, sf):
    return rounded(demand.chain_total(Pipeline(spark, sf).tx, CHAIN), 2, "demand")


@register("a4_chain_margin_by_subgroup", W(f"""
select subgroup, round(sum(margin), 2) as margin from tx_enriched where brand = '{CHAIN}' group by subgroup"""))
def a4b(spark, sf):
    return rounded(demand.chain_total(Pipeline(spark, sf).tx, CHAIN, "margin", "margin"), 2, "margin")


@register("a5_mean_store_margin_by_type", W("""
select store_type, round(cast(sum(store_total) as double) / count(*), 2) as mean_store_total from
(select store_id, store_type, sum(cast(margin as decimal(38,6))) as store_total from tx_enriched
 group by store_id, store_type)
group by store_type"""))
def a5(spark, sf):
    return rounded(demand.mean_of_store_totals(Pipeline(spark, sf).tx), 2, "mean_store_total")


@register("a6_monthly_demand", W("""
select year_month, round(sum(total_sales), 2) as demand from tx_enriched group by year_month"""))
def a6(spark, sf):
    return rounded(demand.monthly_trend(Pipeline(spark, sf).tx), 2, "demand")


@register("a6_monthly_demand_by_category", W("""
select cast(date_trunc('month', date_id) as date) as year_month, category,
       round(sum(total_sales_), 2) as demand from daily group by 1, 2"""))
def a6b(spark, sf):
    d = Pipeline(spark, sf).daily.withColumnRenamed("date_id", "sale_date")
    return rounded(demand.monthly_trend(d, ["category"], "total_sales_"), 2, "demand")


@register("a6_monthly_demand_by_subgroup", W("""
select year_month, subgroup, round(sum(total_sales), 2) as demand from tx_enriched group by 1, 2"""))
def a6c(spark, sf):
    return rounded(demand.monthly_trend(Pipeline(spark, sf).tx, ["subgroup"]), 2, "demand")


@register("x16_random_folds", W("""
select count(*) as n_rows, 0::bigint as n_outside, true as balanced from daily"""))
def x16_rand(spark, sf):
    """Seeded rand(): a random fold 1..4 per row, written once so that it is drawn once."""
    folds = materialize(Pipeline(spark, sf).daily.select((F.floor(F.rand(2741) * 4) + 1).cast("int").alias("fold")), "random-folds")
    share = [F.count_if(F.col("fold") == k) / F.count(F.lit(1)) for k in (1, 2, 3, 4)]
    return folds.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("fold").between(1, 4)).alias("n_outside"),
                     (F.least(*share) > 0.22).alias("balanced"))


@register("a7_monthly_profit_by_product", W("""
select year_month, product_name, round(sum(profit), 2) as profit from tx_enriched group by 1, 2"""))
def a7(spark, sf):
    return rounded(demand.monthly_trend(Pipeline(spark, sf).tx, ["product_name"], "profit", "profit"),
                   2, "profit")


@register("a8_mean_sd_price", W("""
select round(avg(price_), 6) as mean, round(stddev_samp(price_), 6) as sd from daily"""))
def a8(spark, sf):
    return rounded(demand.mean_sd(Pipeline(spark, sf).daily), 6, "mean", "sd")


@register("a9_a10_demand_per_store_by_state", W("""
select state, round(sum(total_sales), 2) as demand, count(distinct store_id) as n_stores,
       round(sum(total_sales), 2) / count(distinct store_id) as demand_per_store
from tx_enriched group by state"""))
def a9(spark, sf):
    out = rounded(demand.distinct_stores_by(Pipeline(spark, sf).tx), 2, "demand")
    return out.withColumn("demand_per_store", F.col("demand") / F.col("n_stores"))


@register("a9_clients_by_state", W("select state, count(distinct client_id) as n_clients from customers group by state"))
def a9b(spark, sf):
    return RetailTables(spark, sf).customers.groupBy("state").agg(
        F.countDistinct("client_id").alias("n_clients"))


@register("a10_profit_per_store_by_state", W("""
select state, round(sum(profit), 2) as profit, count(distinct store_id) as n_stores,
       round(sum(profit), 2) / count(distinct store_id) as profit_per_store
from tx_enriched group by state"""))
def a10(spark, sf):
    out = rounded(demand.distinct_stores_by(Pipeline(spark, sf).tx, measure="profit", name="profit"), 2, "profit")
    return out.withColumn("profit_per_store", F.col("profit") / F.col("n_stores"))


@register("a11_store_count_by_type", W("""
select coalesce(store_type, 'Unknown') as store_type, count(*) as n_stores from stores group by 1"""))
def a11(spark, sf):
    return demand.count_by(enrich.label_unknown(RetailTables(spark, sf).stores), "store_type")


@register("a11_store_count_by_brand", W("select brand, count(*) as n_stores from stores group by brand"))
def a11b(spark, sf):
    return demand.count_by(RetailTables(spark, sf).stores, "brand")


@register("a12_recent_mean_price", W("""
select subgroup, store_id, category, group_name, round(sum(price_), 8) / count(price_) as price_mean from daily
where date_id >= date '2001-10-01' group by subgroup, store_id, category, group_name"""))
def a12(spark, sf):
    return demand.recent_mean_price(Pipeline(spark, sf).daily, RECENT_SINCE)


@register("a13_early_january_profile", W("""
select dia, mes, store_id, subgroup, round(sum(price_), 8) / count(price_) as price_avg,
       round(sum(quantity_), 8) / count(quantity_) as quantity_avg
from daily where dia <= 7 and mes = 1 group by dia, mes, store_id, subgroup"""))
def a13(spark, sf):
    return demand.early_january_profile(Pipeline(spark, sf).daily)


@register("a14_recent_median_price", W("""
select subgroup, store_id, category, group_name, store_type, round(quantile_cont(price_, 0.5), 8) as price_median
from daily where date_id >= date '2001-10-01' group by subgroup, store_id, category, group_name, store_type"""))
def a14(spark, sf):
    return rounded(demand.recent_median_price(Pipeline(spark, sf).daily, RECENT_SINCE), 8, "price_median")


@register("a15_item_day", W("""
select store_id, sku, sale_date, brand, category, group_name, region, quantity, price,
       round(total_sales, 8) as total_sales, costos, valid, mes, anio from item_day"""))
def a15(spark, sf):
    return rounded(Pipeline(spark, sf).item_day, 8, "total_sales")


@register("a16_item_price_range", W("select * from item_range"))
def a16(spark, sf):
    return Pipeline(spark, sf).item_range


@register("a26_colliding_sku_means", W("""
select subgroup, round(avg(base_price), 2) as base_price_avg,
       round(avg(initial_ticket_price), 2) as initial_ticket_price_avg, round(avg(costos), 2) as costos_avg
from product_master where sku in (select sku from product_master group by sku having count(distinct subgroup) > 1)
group by subgroup"""))
def a26(spark, sf):
    return demand.colliding_sku_means(RetailTables(spark, sf).product_master)
