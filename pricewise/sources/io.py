"""Readers and writers.

Writers always target a caller-given folder, normally ``session.work_path`` under
the shared checkpoint folder — never a machine-local temp folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewise.functions.columns import hash_bucket
from pricewise.operators.quality import select_ranks


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a declared schema (S1): no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_inferred(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with an inferred schema (S2), then cast to the declared one so later
    plans never depend on what inference guessed."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if schema is None:
        return df
    return df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (S3); column pruning and filter pushdown come from Catalyst."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink, overwrite or append, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_batch(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Adds a batch to a partitioned table by replacing the partitions it holds (S5): a batch that is
    written again, after a failure or by mistake, leaves the table as it is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header line."""
    df.write.mode(mode).option("header", True).csv(path)


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str,
                   schema: T.StructType) -> None:
    """Convert a CSV folder to parquet in one distributed pass."""
    write_parquet(read_csv(spark, csv_path, schema), parquet_path)


def sample_by_hash(df: DataFrame, key, fraction: float, buckets: int = 100) -> DataFrame:
    """Deterministic sample (S8): rows whose key hashes below ``fraction`` of the buckets.
    Same rows on every run and every engine, unlike a seeded RNG."""
    return df.filter(hash_bucket(key, buckets) < int(round(fraction * buckets)))


def sample_fixed_size(df: DataFrame, key, k: int) -> DataFrame:
    """``k`` rows with the smallest hash of their key, all if there are fewer.

    The k-th hash is found by exact selection, so rows are only filtered: no task takes the sample, and it is
    the same on any layout.  Rows of one hash are taken in the order of all columns."""
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    rows = df.withColumn("_hash", h)
    n = rows.count()
    if n <= k:
        return df
    kth = select_ranks(rows.select("_hash"), "_hash", [k], n)[k]
    below = rows.filter(F.col("_hash") < kth)
    last = rows.filter(F.col("_hash") == kth).orderBy(*df.columns).limit(k - below.count())
    return below.unionByName(last).select(*df.columns)


def row_count(df: DataFrame, name: str) -> DataFrame:
    """One-row table (table_name, n_rows)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows")
