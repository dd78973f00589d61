"""Streaming forms of daily demand: event-time windows with a watermark, compared
with the batch aggregate (A1) on the smallest data set."""

from pyspark.sql import functions as F

from pricewise.operators import enrich
from pricewise.plans.registry import Pipeline
from pricewise.session import work_path
from pricewise.sources import schemas
from pricewise.streaming import daily_demand_windowed, merged_daily_demand, run_incremental_daily_demand
from tests.conftest import SF_SMALL


def test_windowed_stream_equals_batch_daily_totals(spark):
    p = Pipeline(spark, SF_SMALL)
    src, ckpt = work_path(spark, "stream-src"), work_path(spark, "stream-ckpt")
    p.rt.transactions.repartition(3, F.col("sale_date")).write.parquet(src)
    stream = spark.readStream.schema(schemas.TRANSACTIONS).option("maxFilesPerTrigger", 1).parquet(src)
    enriched = enrich.enrich_transactions(stream, p.stores_open, p.rt.product_master)
    q = (daily_demand_windowed(enriched, "3650 days").writeStream.format("memory")
         .queryName("windowed_daily").outputMode("complete")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    keys = ["date_id", "store_id", "subgroup", "category", "group_name"]
    got = spark.table("windowed_daily").select(*keys, F.round("total_sales_", 6).alias("s"))
    want = p.daily.select(*keys, F.round("total_sales_", 6).alias("s"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_batches_do_not_shuffle_the_dimensions(spark):
    """With dimensions too large to broadcast, a batch moves its own rows only; the sums equal the batch build."""
    p = Pipeline(spark, SF_SMALL)
    src, sink, ckpt = (work_path(spark, f"st-{n}") for n in ("src", "sink", "ckpt"))
    p.rt.transactions.repartition(3, F.col("sale_date")).write.parquet(src)
    products = p.rt.product_master.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("_i"))
    products = products.withColumn("sku", F.when(F.col("_i") == 0, F.col("sku")).otherwise(F.concat_ws("-", "sku", "_i")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run_incremental_daily_demand(spark, src, p.stores_open, products, sink, ckpt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got, want = merged_daily_demand(spark, sink), p.daily
    rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if c.endswith("_") else F.col(c) for c in sorted(want.columns)])
    assert sorted(got.columns) == sorted(want.columns) and got.count() == want.count() > 0
    assert rounded(got).exceptAll(rounded(want)).count() == 0
