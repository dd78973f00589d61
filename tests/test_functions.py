"""Scalar helpers (X1-X17, P4-P8, P16, P17) on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from pricewise.functions import columns as C


def test_half_even_and_half_away(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    out = df.select(F.bround("x").alias("even"), F.round("x").alias("away")).collect()
    assert [r.even for r in out] == [0.0, 2.0, 2.0]
    assert [r.away for r in out] == [1.0, 2.0, 3.0]


def test_zero_or_round_even(spark):
    df = spark.createDataFrame([(None,), (2.5,), (3.5,)], "q double")
    assert [r[0] for r in df.select(C.zero_or_round_even("q")).collect()] == [0.0, 2.0, 4.0]


def test_week_labels_2021_01_01(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1),)], "d date")
    r = df.select(C.iso_week("d").alias("w"), C.iso_year("d").alias("iy"), F.year("d").alias("y"),
                  C.simple_week("d").alias("sw"), C.week_start("d").alias("ws")).first()
    assert (r.w, r.iy, r.y, r.sw) == (53, 2020, 2021, 1)
    assert r.ws == dt.date(2020, 12, 28)


def test_period_index_is_consecutive(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 28),), (dt.date(2021, 1, 4),)], "d date")
    idx = [r[0] for r in df.select(C.period_index("d", "week")).orderBy(F.col("d")).collect()]
    assert idx[1] - idx[0] == 1


def test_price_zero_gives_null_quantity(spark):
    df = spark.createDataFrame([(3.0, 0.0, 1.0)], "total_sales double, price double, costos double")
    r = df.select(C.quantity_from_sales().alias("q"), C.margin().alias("m"),
                  C.impute_quantity(F.lit(None).cast("double")).alias("qi")).first()
    assert r.q is None and r.m is None and r.qi is None


def test_profit_formulas(spark):
    df = spark.createDataFrame([(10.0, 2.0, 5.0, 3.0)], "total_sales double, quantity double, price double, costos double")
    r = df.select(C.profit().alias("p6"), C.ganancia_as_coded().alias("p5"),
                  C.markup().alias("p8"), C.margin().alias("p4")).first()
    assert r.p6 == 10 - 2 * 3
    assert r.p5 == (5 - 3) * 10
    assert abs(r.p8 - 2 / 3) < 1e-12
    assert r.p4 == 10 - (10 / 5) * 3


def test_composite_key_round_trip(spark):
    df = spark.createDataFrame([("S0001", "small ring", dt.date(2001, 11, 5))],
                               "store_id string, subgroup string, date_id date")
    key = df.select(C.format_key().alias("store_subgroup_date_id"))
    assert key.first()[0] == "S0001_small ring_2001-11-05"
    back = key.select(*C.split_key()).first()
    assert tuple(back) == ("S0001", "small ring", dt.date(2001, 11, 5))


def test_bad_date_text_is_null(spark):
    df = spark.createDataFrame([("2001-13-45",), ("2001-02-03",)], "s string")
    assert [r[0] for r in df.select(C.parse_date("s")).collect()] == [None, dt.date(2001, 2, 3)]


def test_hash_bucket_is_stable_and_in_range(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a = df.select("k", C.hash_bucket("k", 4).alias("b"))
    got = {r.k: r.b for r in a.collect()}
    again = {r.k: r.b for r in df.repartition(7).select("k", C.hash_bucket("k", 4).alias("b")).collect()}
    assert got == again
    assert set(got.values()) == {0, 1, 2, 3}
