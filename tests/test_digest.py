"""Panel digests made in the series' tasks equal those of the panel's rows."""

import datetime as dt
import hashlib

import numpy as np
from pyspark.sql import functions as F

from pricewise.operators import digest, panel


def _by_rows(filled, keys):
    price = lambda c: F.floor(F.col(c) * 10000).cast("string")
    row = F.concat_ws("|", "t", "idx", "iso_week", "iso_year", "simple_week", "year", F.coalesce(price("v"), F.lit("-")), price("f"))
    return filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_observed"), F.min("f").alias("lowest"), F.max("f").alias("highest"), F.round(F.sum("f"), 2).alias("total"),
        F.round(F.sum(F.col("f") * (F.col("idx") % 7)), 2).alias("by_idx"), F.sum(F.col("iso_week") + F.col("iso_year") + F.col("simple_week") + F.col("year")).cast("long").alias("labels"),
        F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")).alias("digest"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def test_md5_of_many_texts():
    rng = np.random.default_rng(1)
    labels = [f"1996-0{i + 1}-01|{9496 + i}|{i + 1}|1996|{i * 6 + 1}|1996|" for i in range(9)]
    row = rng.integers(0, 9, 20_000)
    price = np.concatenate([rng.integers(0, 10 ** 9, 19_000), rng.integers(0, 10 ** 17, 900), 10 ** rng.integers(0, 17, 90), [0, 9, 10, 99, 100, -5, -123456, 10 ** 18, 2 ** 62, 1]])
    want = [int(hashlib.md5(f"{labels[r]}-|{p}".encode()).hexdigest()[:8], 16) for r, p in zip(row, price)]
    assert digest.Texts(labels).unobserved(row, price).tolist() == want


def test_summary_equals_the_panels_rows(spark):
    rng = np.random.default_rng(3)
    start = dt.date(1999, 11, 3)
    obs = [(f"s{i}", start + dt.timedelta(days=int(d)), round(float(rng.uniform(0.01, 9000)), 8)) for i in range(30) for d in np.unique(rng.integers(0, 150, 7))]
    obs += [("none", start + dt.timedelta(days=5), None), (None, start, 1.0), ("one", start + dt.timedelta(days=9), 7.0), ("below", start, -3.25), ("below", start + dt.timedelta(days=7), 12345678.5)]
    for step, data in (("day", obs), ("week", [(k, t - dt.timedelta(days=t.weekday()), v) for k, t, v in obs])):
        df = spark.createDataFrame(data, "k string, t date, v double").groupBy("k", "t").agg(F.max("v").alias("v"))
        want = _by_rows(panel.filled_panel(df, ["k"], step, "v", "f"), ["k"])
        got = digest.panel_summary(df, ["k"], step, "v", panel.bounds(df))
        assert sorted(got.columns) == sorted(want.columns)
        a, b = (sorted(map(str, x.select(*sorted(want.columns)).collect())) for x in (got, want))
        assert len(a) == 34 and a == b
        assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()        # no row a period
