"""Dense panels and gap filling (J7-J9, W2-W4, F4, F5) on literal series."""

import datetime as dt

from pyspark.sql import functions as F

from pricewise.operators import panel, quality
from tests.conftest import rows


def _series(spark, values, key="A"):
    data = [(key, i + 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, t int, v double").withColumn("idx", F.col("t"))


def _filled(spark, values):
    df = panel.fill_gaps(_series(spark, values), ["k"], "v", "f")
    return [r.f for r in df.orderBy("t").collect()]


def test_inner_gap_interpolated_and_edges_carried(spark):
    assert _filled(spark, [None, 10.0, None, None, 16.0, None]) == [10, 10, 12, 14, 16, 16]


def test_all_null_series_stays_null(spark):
    assert _filled(spark, [None, None]) == [None, None]


def test_one_point_series_is_constant(spark):
    assert _filled(spark, [None, 5.0, None]) == [5, 5, 5]


def test_series_do_not_leak_into_each_other(spark):
    a = _series(spark, [1.0, None, 3.0], "A")
    b = _series(spark, [None, 7.0, None], "B")
    out = panel.fill_gaps(a.unionByName(b), ["k"], "v", "f")
    assert rows(out, "k", "t", "f") == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0),
                                        ("B", 1, 7.0), ("B", 2, 7.0), ("B", 3, 7.0)]


def test_dense_weekly_panel_has_every_series_period(spark):
    d = dt.date
    obs = spark.createDataFrame(
        [("S1", "c", d(2021, 1, 4), 1.0), ("S1", "c", d(2021, 1, 25), 4.0), ("S2", "c", d(2021, 1, 11), 2.0)],
        "store_id string, category string, t date, price double")
    p = panel.dense_panel(obs, ["store_id", "category"], "week", "price")
    assert p.count() == 2 * 4                       # 2 series x 4 weeks
    assert p.filter(F.col("price").isNotNull()).count() == 3
    assert quality.duplicate_keys(p, ["store_id", "category"], "t").count() == 0
    assert quality.irregular_steps(p, ["store_id", "category"], "t", "week").count() == 0
    filled = panel.fill_gaps(p, ["store_id", "category"], "price", "f")
    s1 = [r.f for r in filled.filter("store_id = 'S1'").orderBy("t").collect()]
    assert s1 == [1.0, 2.0, 3.0, 4.0]


def test_contract_finds_duplicates_and_gaps(spark):
    d = dt.date
    obs = spark.createDataFrame(
        [("A", d(2021, 1, 1)), ("A", d(2021, 1, 1)), ("A", d(2021, 1, 3))], "k string, t date")
    assert quality.duplicate_keys(obs, ["k"], "t").count() == 1
    gaps = quality.irregular_steps(obs.dropDuplicates(), ["k"], "t", "day").collect()
    assert [g.gap for g in gaps] == [2]


def test_short_series_guard(spark):
    df = spark.createDataFrame([("A", i) for i in range(6)] + [("B", i) for i in range(5)], "k string, t int")
    assert rows(panel.long_series(df, ["k"], 5), "k", "n_obs") == [("A", 6)]


def _panels(spark):
    """(filled in place, the same by the windows over a panel joined up here) of series with gaps, one point, no values and null keys."""
    d = dt.date
    data = [("A", "x", d(2021, 1, 4), 1.0), ("A", "x", d(2021, 2, 1), 4.5), ("A", "x", d(2021, 1, 18), None), ("B", "x", d(2021, 1, 18), 7.0),
            ("C", "x", d(2021, 1, 25), None), ("D", None, d(2021, 1, 11), 3.0), ("E", "x", d(2021, 1, 11), 2.0), ("E", "x", d(2021, 1, 18), 5.0)]
    obs = spark.createDataFrame(data, "k string, s string, t date, v double")
    keys = ["k", "s"]
    grid = obs.select(*keys).distinct().join(panel.calendar(obs, "week"))
    want = panel.fill_gaps(grid.join(obs, [*keys, "t"], "left"), keys, "v", "f")
    return panel.filled_panel(obs, keys, "week", "v", "f"), want


def test_filled_panel_equals_windows_over_the_joined_panel(spark):
    cols = ["k", "s", "t", "idx", "iso_week", "iso_year", "simple_week", "year", "v", "f"]
    got, want = (sorted(map(str, df.select(*cols).collect())) for df in _panels(spark))
    assert len(got) == 5 * 5 and got == want


def test_panel_is_not_shuffled_or_sorted_for_an_aggregate_by_series(spark):
    got, _ = _panels(spark)
    plan = got.groupBy("k", "s").agg(F.sum("f"))._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("Generate explode")]           # the steps above the panel's rows
    assert "Exchange hashpartitioning" not in after and "Sort" not in after


def test_irregular_series_are_found_even_if_a_duplicate_hides_a_gap(spark):
    d = dt.date
    days = {"A": [1, 2, 3], "B": [1, 1, 3], "C": [2], "D": [1, 2, 2, 3], "E": [1, 3]}
    p = spark.createDataFrame([(k, d(2021, 1, 1) + dt.timedelta(days=40 * x)) for k, v in days.items() for x in v], "k string, t date")
    p = p.unionByName(spark.createDataFrame([("F", d(2021, 2, 10) + dt.timedelta(days=x)) for x in range(80)], "k string, t date"))
    odd = quality.irregular_series(p, ["k"], "t", "day", panel.bounds(p))
    assert rows(odd, "k") == [("A",), ("B",), ("D",), ("E",)]


def test_previous_values_equal_a_lag_over_the_panel(spark):
    from pyspark.sql import Window
    d = dt.date
    obs = spark.createDataFrame([("A", d(2021, 1, 3), 1.0), ("A", d(2021, 1, 6), 4.7), ("A", d(2021, 1, 7), 2.2), ("B", d(2021, 1, 1), 7.0), ("B", d(2021, 1, 9), 3.0),
                                 ("C", d(2021, 1, 5), None)], "k string, t date, v double")
    p = panel.filled_panel(obs, ["k"], "day", "v", "f", lagged="b")
    want = F.lag("f").over(Window.partitionBy("k").orderBy("t"))
    assert p.select("*", want.alias("w")).filter(~F.col("b").eqNullSafe(F.col("w"))).count() == 0 and p.count() == 27
