"""Transactions meet their products once."""

from pricewise.operators import enrich
from pricewise.plans.registry import Pipeline
from tests.conftest import SF_SMALL


def _shuffles_above_the_fact(df) -> int:
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "Scan" in x and "l_orderkey" in x)
    n, least = 0, depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < least:
            least = depth(x)
            n += "Exchange" in x
    return n


def test_products_joined_first_give_the_same_rows_with_one_join_of_the_fact_less(spark):
    p = Pipeline(spark, SF_SMALL)
    want = enrich.enrich_transactions(p.rt.transactions, p.stores_open, p.rt.product_master)
    columns = sorted(want.columns)
    got, want = p.tx.select(columns), want.select(columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count = [_shuffles_above_the_fact(df.select("transaction_id", "brand", "category")) for df in (got, want)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert count == [2, 3]
