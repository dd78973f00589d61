"""DuckDB SQL for the fixture tables and shared derived tables.

DuckDB only has the raw testdata views, so every oracle query starts with these
CTEs (the same mapping as ``pricewise.sources.fixtures``), then its own.
"""

from __future__ import annotations

FIXTURES = {
    "stores": """
select printf('S%04d', s_suppkey) as store_id,
       'BRAND_' || cast(s_nationkey % 9 as varchar) as brand, s_name as store_name,
       n_name as state, r_name as region,
       case when s_suppkey % 50 = 7 then null when s_suppkey % 4 = 0 then 'Mall'
            when s_suppkey % 4 = 1 then 'Street' when s_suppkey % 4 = 2 then 'Outlet'
            else 'Online' end as store_type,
       date '1994-01-01' as opendate,
       case when s_suppkey % 20 = 3 then date '2000-06-30'
            when s_suppkey % 20 = 13 then date '2002-01-31' end as closedate
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "store_clusters": """
select printf('S%04d', s_suppkey) as store_id,
       'BRAND_' || cast(s_nationkey % 9 as varchar) as brand, s_name as store_name,
       'CLUSTER_' || cast(s_suppkey % 6 as varchar) as cluster
from supplier""",
    "product_master": """
select printf('P%06d', p_partkey) as sku, p_name || ' #' || cast(p_partkey as varchar) as product_name,
       p_type as category, p_brand as group_name, p_name as subgroup, p_brand as brand_prod,
       p_retailprice as base_price, p_retailprice * 1.1::double as initial_ticket_price,
       p_retailprice * 0.6::double as costos
from part
union all
select printf('P%06d', p_partkey), p_name || ' #' || cast(p_partkey as varchar),
       p_type, p_brand, 'twin ' || p_name, p_brand,
       p_retailprice, p_retailprice * 1.1::double, p_retailprice * 0.6::double
from part where p_name = 'small ring'""",
    "product_groups": """
select printf('P%06d', p_partkey) as sku, p_name || ' #' || cast(p_partkey as varchar) as product_name,
       'PG' || cast(p_size as varchar) as price_group_id,
       'Promo ' || cast(p_size as varchar) as price_group_name,
       case when p_size % 2 = 0 then 'bundle' else 'seasonal' end as group_type
from part where p_size <= 10""",
    "transactions": """
select l_orderkey as transaction_id, cast(l_shipdate as date) as sale_date,
       printf('S%04d', l_suppkey) as store_id, printf('P%06d', l_partkey) as sku,
       case when l_linenumber = 7 and l_tax = 0 then null else l_quantity end as quantity,
       l_extendedprice / nullif(l_quantity, 0) as price,
       l_extendedprice as total_sales, p_name as subgroup,
       printf('S%04d', l_suppkey) || '_' || p_name || '_' || strftime(cast(l_shipdate as date), '%Y-%m-%d')
           as store_subgroup_date_id
from lineitem join part on l_partkey = p_partkey""",
    "customers": """
select c_custkey as client_id, n_name as state, c_mktsegment as occupation,
       c_acctbal > 5000 as loyalty_member, c_acctbal as loyalty_points
from customer join nation on c_nationkey = n_nationkey""",
    "stores_open": """
select s.*, c.cluster from stores s left join (select store_id, cluster from store_clusters) c
    on s.store_id = c.store_id
where s.closedate > date '2001-12-31' or s.closedate is null""",
    "tx_enriched": """
select *, total_sales - quantity_filled * costos as profit from (
select t.*, so.brand, so.store_name, so.state, so.region, so.store_type, so.cluster,
       pm.product_name, pm.category, pm.group_name, pm.brand_prod, pm.base_price,
       pm.initial_ticket_price, pm.costos,
       cast(month(t.sale_date) as int) as sale_month, cast(year(t.sale_date) as int) as sale_year,
       cast(date_trunc('month', t.sale_date) as date) as year_month,
       t.total_sales - (t.total_sales / nullif(t.price, 0)) * pm.costos as margin,
       (t.price - pm.costos) * t.total_sales as ganancia,
       coalesce(t.quantity, round(t.total_sales / nullif(t.price, 0))) as quantity_filled
from transactions t
left join stores_open so on t.store_id = so.store_id
left join product_master pm on t.sku = pm.sku and t.subgroup = pm.subgroup
where so.brand is not null)""",
    "daily": """
select store_id || '_' || subgroup || '_' || strftime(sale_date, '%Y-%m-%d') as store_subgroup_date_id,
       store_id, subgroup, sale_date as date_id, category, group_name,
       sum(total_sales) as total_sales_, sum(total_sales / nullif(price, 0)) as quantity_,
       sum(price) as price_, sum(base_price) as base_price_, sum(costos) as costos_,
       sum(initial_ticket_price) as initial_ticket_price_,
       brand, store_name, region, coalesce(store_type, 'Unknown') as store_type,
       cast(month(sale_date) as int) as mes, cast(day(sale_date) as int) as dia,
       cast(year(sale_date) as int) as anio
from tx_enriched
group by store_id, subgroup, sale_date, category, group_name, brand, store_name, region, store_type""",
    "item_day": """
select *, case when round(total_sales - quantity * price) = 0 then 1 else 0 end as valid,
       cast(month(sale_date) as varchar) as mes, cast(year(sale_date) as int) as anio
from (select store_id, sku, sale_date, brand, category, group_name, region,
             sum(round(total_sales / nullif(price, 0))) as quantity, min(price) as price,
             sum(total_sales) as total_sales, min(costos) as costos
      from tx_enriched group by store_id, sku, sale_date, brand, category, group_name, region)""",
    "item_range": """
select store_id, sku, category, group_name, brand, region,
       min(price) as min_price, max(price) as max_price, min(costos) as costos
from item_day group by store_id, sku, category, group_name, brand, region""",
}

# Fixed order: every CTE only refers to earlier ones.
_ORDER = ["stores", "store_clusters", "product_master", "product_groups", "transactions",
          "customers", "stores_open", "tx_enriched", "daily", "item_day", "item_range"]


def with_fixtures(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixture ctes>[, <extra ctes>] <body>``."""
    ctes = [(name, FIXTURES[name]) for name in _ORDER] + list(extra or [])
    head = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    body = body.strip()
    if body[:5].lower() == "with ":          # the query's own CTEs continue the list
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
