"""Ranking, bins, rollup (T1-T4, W5, A21, A27) and per-series forecasts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewise.operators import forecast, kpi, panel, quality
from tests.conftest import rows


def test_top_k_with_ties_equals_rank(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcdefg", [5, 9, 9, 7, 7, 1, None])], "k string, v int")
    got = rows(kpi.top_k_with_ties(df, "v", 3), "k")
    df.createOrReplaceTempView("tk")
    want = rows(spark.sql("select k from (select k, rank() over (order by v desc) r from tk where v is not null) where r <= 3"))
    assert got == want == [("b",), ("c",), ("d",), ("e",)]


def test_global_row_number_and_ntile_match_sql(spark):
    df = spark.range(0, 1003).select((F.col("id") * 7919 % 1003).alias("x"), F.col("id"))
    got = kpi.ntile(df, ["x", "id"], 5)
    df.createOrReplaceTempView("nt")
    want = spark.sql("select x, id, ntile(5) over (order by x, id) as bin from nt")
    assert rows(got, "x", "id", "bin") == rows(want)
    sizes = [r[1] for r in rows(got.groupBy("bin").count())]
    assert max(sizes) - min(sizes) <= 1


def _values(kind, n=3000):
    rng = np.random.default_rng(3)
    return {"distinct": rng.permutation(n).astype(float), "ties": rng.choice([1.0, 2.0, 2.0, 2.0, 5.0, 9.0], n), "one": np.full(n, 7.0), "few": np.array([3.0, 1.0, 4.0]),
            "edge": np.concatenate([np.zeros(n // 3), rng.normal(0, 1, n // 3), np.full(n // 3, 0.5)]), "skewed": np.round(rng.lognormal(0, 3, n), 1)}[kind]


@pytest.mark.parametrize("ordered", [20_000, 5])
@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "few", "edge", "skewed"])
def test_exact_quantiles_at_any_bracket(spark, monkeypatch, kind, ordered):
    """Also where few values may be put in order, so that brackets are bracketed again."""
    monkeypatch.setattr(quality, "ORDERED", ordered)
    values = _values(kind)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "x double").repartition(7)
    probs = [0.0, 0.01, 0.2, 0.5, 0.77, 0.99, 1.0]
    ordered_values = np.sort(values)
    want = [ordered_values[quality.rank_of(p, len(values)) - 1] for p in probs]
    assert quality.exact_quantiles(df, "x", probs) == want


def test_no_rows_have_no_quantiles(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert quality.exact_quantiles(empty, "x", [0.5]) == [None]
    assert [tuple(r) for r in quality.quantile_profile(empty, "x").collect()] == [(None, None, None, None)]
    assert quality.count_outside(empty, "x").first()["n_outside"] == 0 and quality.extreme_rows(empty, "x").count() == 0


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "few", "edge"])
def test_bins_by_rank_ranges_match_sql(spark, kind):
    values = _values(kind)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "x double, i int")
    df.createOrReplaceTempView("rr")
    for k in (2, 5):
        want = spark.sql(f"select x, i, ntile({k}) over (order by x, i) as bin from rr")
        assert rows(kpi.ntile(df, ["x", "i"], k), "x", "i", "bin") == rows(want)


def test_bin_limits_match_numpy_and_the_fact_is_not_sorted(spark):
    rng = np.random.default_rng(4)
    price = rng.choice([2.0, 3.0, 3.5], 900) + rng.choice([0.0, 0.0, 0.25], 900)
    tx = spark.createDataFrame([(float(p), 1.0, float(p) * 2, 3.0, i, "a", "b", dt.date(2020, 1, 1)) for i, p in enumerate(price)],
                               "price double, costos double, profit double, quantity_filled double, transaction_id int, sku string, store_id string, sale_date date")
    got = {r.bin: r for r in kpi.markup_bins(tx, 5).collect()}
    limits = np.quantile(price - 1, [i / 5 for i in range(6)])
    order = np.sort(price)
    for i in range(5):
        assert abs(got[i + 1].lower_limit - limits[i]) < 1e-12 and abs(got[i + 1].upper_limit - limits[i + 1]) < 1e-12
        assert got[i + 1].total_quantity == 540 and abs(got[i + 1].total_profit - 2 * order[i * 180:(i + 1) * 180].sum()) < 1e-6
    far = kpi.RankRanges(tx.select("transaction_id"), ["transaction_id"], [0.5], lambda n: [n // 2])
    assert sum(far.inside) < 90 and far.outside().count() + sum(far.inside) == 900


def test_rollup_children_sum_to_parents(spark):
    df = spark.createDataFrame([("g1", "a", 1.0), ("g1", "b", 2.0), ("g2", "c", 4.0)],
                               "grp string, sub string, v double")
    tree = {(r.label, r.parent): r.value for r in kpi.rollup_tree(df, "grp", "sub", "v").collect()}
    assert tree[("Total", "")] == 7.0
    assert tree[("g1", "Total")] == tree[("a", "g1")] + tree[("b", "g1")]


def _panel(spark, ys, step="week"):
    start = dt.date(2021, 1, 4)
    data = [("S1", start + dt.timedelta(days=7 * i), float(y)) for i, y in enumerate(ys)]
    df = spark.createDataFrame(data, "store_id string, t date, y double")
    return df.withColumn("idx", F.floor((F.unix_date("t") + 3) / 7).cast("int"))


def test_baseline_forecasts_closed_form(spark):
    ys = [1, 2, 3, 4, 5, 6, 7, 8]
    out = forecast.baseline_forecasts(_panel(spark, ys), ["store_id"], "y", "week", 2, season=4)
    r = {x.h: x for x in out.collect()}
    assert r[1].f_last == 8 and r[1].f_drift == 9 and r[2].f_drift == 10
    assert r[1].t_forecast == dt.date(2021, 3, 1)            # F8: last week + 7 days
    assert abs(r[1].f_ar1 - 9) < 1e-9 and abs(r[2].f_ar1 - 10) < 1e-9   # y_t = y_{t-1} + 1
    assert r[1].f_snaive == 5 and r[2].f_snaive == 6


@pytest.mark.parametrize("step,horizon,season", [("week", 2, 4), ("day", 7, 7), ("week", 3, 2), ("week", 1, 400), ("month", 5, 12)])
def test_forecasts_from_observations_equal_those_of_the_filled_panel(spark, step, horizon, season):
    from pricewise.operators import panel
    rng = np.random.default_rng(horizon)
    day = {"week": lambda k: dt.date(2021, 1, 4) + dt.timedelta(7 * k), "day": lambda k: dt.date(2021, 1, 4) + dt.timedelta(k),
           "month": lambda k: dt.date(2021 + k // 12, k % 12 + 1, 1)}[step]
    data = [(f"s{s}", day(int(k)), round(float(50 + 10 * rng.normal()), 2)) for s in range(30) for k in rng.choice(50, rng.integers(1, 30), replace=False)]
    data += [("const", day(k), 7.1) for k in (3, 9, 20)] + [("one", day(11), 4.0), ("ends", day(0), 1.0), ("ends", day(49), 9.0)]
    data += [("gap", day(k), y) for k, y in ((2, None), (5, 3.0), (8, None), (30, 4.5), (49, None))]
    obs = spark.createDataFrame(data, "store_id string, t date, y double")
    filled = panel.fill_gaps(panel.dense_panel(obs, ["store_id"], step, "y"), ["store_id"], "y", "filled")
    want = forecast.baseline_forecasts(filled, ["store_id"], "filled", step, horizon, season)
    got = forecast.observed_forecasts(obs, ["store_id"], "y", step, horizon, season, panel.bounds(obs))
    assert got.columns == want.columns
    key = lambda r: (r.store_id, r.h)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) == 34 * horizon
    for a, b in zip(got, want):
        assert (a.store_id, a.h, a.t_forecast, a.n, a.f_last, a.f_snaive) == (b.store_id, b.h, b.t_forecast, b.n, b.f_last, b.f_snaive)
        for c in ("f_mean", "f_drift", "ar_slope", "ar_intercept", "f_ar1"):
            assert (a[c] is None) == (b[c] is None), (a.store_id, c)
            assert b[c] is None or a[c] == pytest.approx(b[c], rel=1e-7, abs=1e-7), (a.store_id, c)


def test_forecasts_from_observations_build_no_panel(spark):
    from pricewise.operators import panel
    obs = spark.createDataFrame([("a", dt.date(2021, 1, 4), 2.0), ("a", dt.date(2021, 3, 1), None), ("b", dt.date(2021, 3, 1), None)], "store_id string, t date, y double")
    out = forecast.observed_forecasts(obs, ["store_id"], "y", "week", 1, 52, panel.bounds(obs))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    got = {r.store_id: r for r in out.collect()}
    assert got["a"].f_last == 2.0 and got["a"].n == 9 and got["a"].ar_slope is None and got["b"].n == 0 and got["b"].f_last is None
    empty = obs.limit(0)
    assert forecast.observed_forecasts(empty, ["store_id"], "y", "week", 1, 52, panel.bounds(empty)).count() == 0


def test_ar_forecast_recovers_ar1(spark):
    rng = np.random.default_rng(0)
    y = [10.0]
    for _ in range(80):
        y.append(2 + 0.8 * y[-1] + rng.normal(0, 0.01))
    f, model = forecast.fit_ar(np.array(y), 3, season=0)
    want = [y[-1]]
    for _ in range(3):
        want.append(2 + 0.8 * want[-1])
    assert np.allclose(f, want[1:], atol=0.05)
    out = forecast.ar_forecasts(_panel(spark, y), ["store_id"], "y", "week", 3, season=0)
    assert out.count() == 3 and out.filter(F.col("f_ar").isNull()).count() == 0


def test_short_series_falls_back_to_last_value():
    f, model = forecast.fit_ar(np.array([3.0, 4.0]), 2, season=0)
    assert model == "last" and list(f) == [4.0, 4.0]


def _ar1_series(rng, n=250):
    y = [100.0]
    for _ in range(n):
        y.append(max(1.0, 30 + 0.7 * y[-1] + rng.normal(0, 5)))
    return np.array(y)


def test_order_choice_ignores_the_unit_and_seldom_finds_a_season():
    rng = np.random.default_rng(1)
    seasonal = 0
    for _ in range(40):
        y = _ar1_series(rng)
        f, model = forecast.fit_ar(y, 2, season=52)
        scaled, same = forecast.fit_ar(y * 1e-7, 2, season=52)
        assert model == same and np.allclose(scaled, f * 1e-7)
        assert (f >= y.min()).all()
        seasonal += "s=" in model or "D=" in model
    assert seasonal <= 8


def test_backtest_beats_seasonal_naive_and_finds_a_real_season():
    rng = np.random.default_rng(2)
    ar, naive = [], []
    for _ in range(30):
        y = _ar1_series(rng)
        ar.append(abs(forecast.fit_ar(y[:-1], 1, season=52)[0][0] - y[-1]))
        naive.append(abs(y[-53] - y[-1]))
    assert np.mean(ar) < np.mean(naive)
    t = np.arange(300)
    y = 100 + 20 * np.sin(2 * np.pi * t / 52) + rng.normal(0, 1, 300)
    f, model = forecast.fit_ar(y, 4, season=52)
    assert "52" in model and np.allclose(f, 100 + 20 * np.sin(2 * np.pi * (300 + np.arange(4)) / 52), atol=4)


def test_rolling_origins_see_nothing_later(spark):
    """Against a loop over one series at a time; a changed last value changes no forecast of it."""
    rng = np.random.default_rng(6)
    data = [(f"S{s}", int(i), float(rng.uniform(1, 9))) for s in range(6) for i in sorted(rng.choice(60, 12 + s, replace=False))]
    df = spark.createDataFrame(data, "store_id string, idx int, y double")
    h, season, origins = 2, 7, 3
    want = {}
    for s, g in pd.DataFrame(data, columns=["s", "idx", "y"]).groupby("s"):
        errors = []
        for t, y in list(zip(g.idx, g.y))[-origins:]:
            k = g[g.idx <= t - h]
            old = g[g.idx <= t - season]
            last = k.y.iloc[-1]
            slope = (last - k.y.iloc[0]) / (k.idx.iloc[-1] - k.idx.iloc[0]) if len(k) > 1 else 0.0
            errors.append([abs(y - f) for f in (last, k.y.mean(), last + (t - k.idx.iloc[-1]) * slope, old.y.iloc[-1] if len(old) else last)])
        want[s] = np.mean(errors, axis=0)
    got = {r.store_id: [r.mae_last, r.mae_mean, r.mae_drift, r.mae_snaive] for r in forecast.backtest_baselines(df, ["store_id"], "y", "idx", h, season, origins).collect()}
    assert set(got) == set(want) and all(np.allclose(got[s], want[s], atol=1e-4) for s in want)
    ar = {r.store_id: (r.n_ar, r.mae_ar) for r in forecast.backtest_ar(df, ["store_id"], "y", "idx", h, season, origins).collect()}
    assert all(ar[s][0] == 3 and ar[s][1] >= 0 for s in want)
    last = {s: max(i for a, i, _ in data if a == s) for s in want}
    moved = spark.createDataFrame([(s, i, y + 100 * (i == last[s])) for s, i, y in data], "store_id string, idx int, y double")
    before = forecast.backtest_targets(df, ["store_id"], "y", "idx", h, season, 1).drop("y")
    after = forecast.backtest_targets(moved, ["store_id"], "y", "idx", h, season, 1).drop("y")
    assert rows(before) == rows(after)


def _observed(spark):
    import datetime as d
    import numpy as np
    rng = np.random.default_rng(5)
    data = [(k, d.date(2021, 1, 1) + d.timedelta(days=int(i)), float(v)) for k in "ABC"
            for i, v in zip(sorted(rng.choice(120, 14, replace=False)), rng.uniform(10, 90, 14))]
    return spark.createDataFrame(data + [("D", d.date(2021, 1, 9), 5.0), ("D", d.date(2021, 4, 1), 5.0), ("E", d.date(2021, 1, 9), None)], "k string, t date, v double")


def test_ar_forecasts_from_observations_equal_those_of_the_panel(spark):
    from pricewise.operators import panel
    obs = _observed(spark)
    want = forecast.ar_forecasts(panel.filled_panel(obs, ["k"], "day", "v", "f"), ["k"], "f", "day", 3, 7)
    got = forecast.observed_ar_forecasts(obs, ["k"], "v", "day", 3, 7, panel.bounds(obs))
    a, b = (sorted(map(tuple, x.select("k", "h", "t_forecast", "model", "f_ar").collect())) for x in (got, want))
    assert len(a) == 12 and a == b
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan


def test_baselines_with_carried_lags_equal_those_by_windows(spark):
    from pricewise.operators import panel
    obs = _observed(spark)
    p = panel.filled_panel(obs, ["k"], "day", "v", "f", lagged="b")
    args = (["k"], "f", "day", 9, 7)
    last = panel.bounds(obs)[1]
    got, want = forecast.baseline_forecasts(p, *args, ylag="b", t_last=last), forecast.baseline_forecasts(p.drop("b"), *args)
    close = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert close(got) == close(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan[:plan.index("Generate explode(sequence(_from")]


def _gappy(rng, length):
    """A filled price series, as the AR models see it."""
    at = np.unique(np.concatenate([[0], rng.integers(0, length, 12), [length - 1]]))
    return np.interp(np.arange(length), at, np.round(rng.uniform(5, 90, len(at)), 2))


def test_many_series_are_fitted_as_one_by_one():
    rng = np.random.default_rng(5)
    series = [_gappy(rng, int(n)) for n in [*range(2, 40), *range(150, 166), *rng.integers(8, 500, 30)]]
    series += [np.cumsum(rng.normal(0, 1, int(n))) for n in rng.integers(40, 300, 20)] + [np.full(30, 4.0), np.array([3.0]), np.arange(1.0, 60.0), np.tile([1.0, 5.0], 40)]
    series += [50 + 10 * np.sin(np.arange(300) * 2 * np.pi / 7) + rng.normal(0, 1, 300) for _ in range(5)]
    for season, horizon in ((7, 7), (52, 1)):
        alone = 0
        for y, (f, kind) in zip(series, forecast.fit_ar_many(series, horizon, season)):
            g, same = forecast.fit_ar(y, horizon, season)
            assert kind == same and (f == g).all()
            usable, first = forecast._usable(len(y), season)
            alone += bool(usable) and np.ptp(y) > 0 and forecast._fit_group([y], tuple(usable), first, horizon, season)[0] is None
        assert alone < 50           # few series need to go alone
        for (f, kind), (g, same) in zip(forecast.fit_ar_many(series, horizon, season, refit=False), forecast.fit_ar_many(series, horizon, season)):
            assert kind == same and np.allclose(f, g, rtol=1e-6, atol=1e-8)


def test_dense_values_are_the_panels(spark):
    """Bit for bit ``filled_panel``, and forecasts of the filled values without its rows."""
    rng = np.random.default_rng(6)
    start = dt.date(2020, 1, 1)
    obs = [(f"s{i}", start + dt.timedelta(days=int(d)), round(float(rng.uniform(1, 9)), 3)) for i in range(12) for d in np.unique(rng.integers(0, 400, 9))]
    obs += [("flat", start + dt.timedelta(days=d), 2.5) for d in (3, 50, 200)] + [("none", start + dt.timedelta(days=5), None), (None, start, 1.0), ("one", start + dt.timedelta(days=9), 7.0)]
    df = spark.createDataFrame(obs, "k string, t date, y double")
    span = panel.bounds(df)
    filled = panel.filled_over(df, ["k"], "day", "y", "v", span, lagged="before")
    two = forecast.baseline_forecasts(filled, ["k"], "v", "day", 7, 7, ylag="before", t_last=span[1])
    one = forecast.dense_forecasts(df, ["k"], "y", "day", 7, 7, span)
    assert one.columns == two.columns
    order = lambda x: sorted((tuple(r) for r in x.collect()), key=lambda r: (r[0] or "", r[1]))
    one, two = order(one), order(two)
    assert len(one) == len(two) == 7 * 16
    for a, b in zip(one, two):
        assert a[:6] == b[:6] and all((x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)) for x, y in zip(a[6:], b[6:]))
    plan = forecast.dense_forecasts(df, ["k"], "y", "day", 7, 7, span)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan or "explode(sequence(1, 7" in plan       # no row a day
