"""Per-series point forecasts in one distributed job.

(a) ``baseline_forecasts``: closed-form forecasters written as aggregates and
    windows (last value, mean, drift, seasonal naive, AR(1) by least squares);
    ``observed_forecasts`` gives the same for a gap-filled panel without building it.
(b) ``ar_forecasts``: a small autoregressive model per series, order chosen by
    AICc, fitted with numpy inside ``groupBy(series).applyInPandas`` — one Arrow
    batch per series, each bounded by the calendar length.

Horizon dates are computed from each series' last period (F8), never attached by
row position.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from pricewise.functions import columns as C
from pricewise.session import ship_package


def _horizon_date(t_last, h, step: str):
    if step == "day":
        return F.date_add(t_last, h)
    if step == "week":
        return F.date_add(t_last, h * 7)
    return F.add_months(t_last, h)


def _season_places(horizon: int, season: int) -> range:
    """Places in the last season that the seasonal naive method needs for steps 1..horizon."""
    return range(min(horizon, season))


def _forecasts(stats: DataFrame, keys: list[str], step: str, horizon: int, season: int) -> DataFrame:
    """Every series and step 1..horizon from n, t_last, last, first, mean, ar_slope, ar_intercept and
    ``seasonal``, the values of the last season's first periods."""
    steps = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    b, c, h = F.col("ar_slope"), F.col("ar_intercept"), F.col("h")
    ar = F.when(b == 1, F.col("last") + h * c).otherwise(
        c * (1 - F.pow(b, h)) / (1 - b) + F.pow(b, h) * F.col("last"))
    return steps.select(
        *keys, "h", _horizon_date(F.col("t_last"), h, step).alias("t_forecast"), "n",
        F.col("last").alias("f_last"), F.col("mean").alias("f_mean"),
        (F.col("last") + h * F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1)).alias("f_drift"),
        "ar_slope", "ar_intercept", ar.alias("f_ar1"),
        F.get("seasonal", F.pmod(h - 1, F.lit(season))).alias("f_snaive"))


def baseline_forecasts(panel: DataFrame, keys: list[str], y: str, step: str, horizon: int,
                       season: int, t: str = "t", idx: str = "idx", ylag: str | None = None, t_last=None) -> DataFrame:
    """Closed-form forecasts for every series and step 1..horizon of a panel without gaps.

    If the panel carries each row's previous value (``ylag``) and all its series end with period ``t_last``,
    one hash aggregate is enough; otherwise the rows of a series are put in order for it."""
    places = _season_places(horizon, season)
    if ylag:
        back = C.period_index(F.lit(t_last).cast("date"), step) - F.col(idx)
        lagged = panel.select(*keys, t, idx, y, F.col(ylag).alias("_ylag"), *[F.when(back == season - 1 - k, F.col(y)).alias(f"_s{k}") for k in places])
        seasonal = [F.max(f"_s{k}") for k in places]
    else:
        w = Window.partitionBy(*keys).orderBy(idx)
        lagged = panel.select(*keys, t, idx, y, F.lag(y).over(w).alias("_ylag"),
                              *[F.lag(y, season - 1 - k).over(w).alias(f"_s{k}") for k in places])
        seasonal = [F.max_by(f"_s{k}", idx) for k in places]
    stats = lagged.groupBy(*keys).agg(
        F.count(y).alias("n"), F.max(t).alias("t_last"),
        F.max_by(y, idx).alias("last"), F.min_by(y, idx).alias("first"),
        C.stable_mean(y).alias("mean"),
        F.regr_slope(y, "_ylag").alias("ar_slope"), F.regr_intercept(y, "_ylag").alias("ar_intercept"),
        F.array(*seasonal).alias("seasonal"))
    return _forecasts(stats, keys, step, horizon, season)


def observed_forecasts(obs: DataFrame, keys: list[str], y: str, step: str, horizon: int, season: int,
                       span: tuple, t: str = "t") -> DataFrame:
    """``baseline_forecasts`` of the gap-filled panel over ``span`` (first and last period), from the
    observations alone: the panel is never built.

    Between two observations the filled panel is a straight line, before the first and after the last one
    it is constant, so each observation adds its stretch's sums in closed form.  The work and the shuffle
    follow the observations, not series x calendar.  Values are taken relative to the series' first
    one, so a constant series has a variance of exactly zero, and no AR coefficients.  A null value is a gap;
    a series without any value has n = 0 and null forecasts.
    """
    lo, hi = (C.period_index(F.lit(d).cast("date"), step) for d in span)
    w = Window.partitionBy(*keys).orderBy(F.col("_y").isNull(), "_i")
    known = obs.select(*keys, F.col(y).alias("_y"), C.period_index(t, step).alias("_i"))
    rows = known.select(
        *keys, "_y", "_i", F.first("_y").over(w).alias("_f"), F.lag("_i").over(w).isNull().alias("_opens"),
        F.lead("_y").over(w).alias("_ny"), F.lead("_i").over(w).alias("_ni"))
    v, i, closes = F.col("_y"), F.col("_i"), F.col("_ny").isNull()
    rows = rows.withColumns({
        "_g": F.when(closes, hi - i).otherwise(F.col("_ni") - i).cast("double"),       # steps to the next value
        "_d": F.when(closes, F.lit(0.0)).otherwise(F.col("_ny") - v),
        "_lead": F.when(F.col("_opens"), i - lo).otherwise(F.lit(0)).cast("double"),    # periods before the first value
        "_p": v - F.col("_f")})
    g, d, x = F.col("_g"), F.col("_d"), F.col("_p")
    slope = F.coalesce(F.try_divide(d, g), F.lit(0.0))
    ones, squares = g * (g - 1) / 2, (g - 1) * g * (2 * g - 1) / 6                      # sums of j and j^2 for j < g
    sx = g * x + slope * ones
    sxx = g * x * x + 2 * x * slope * ones + slope * slope * squares
    total = g * v + slope * ones + F.col("_lead") * v + F.when(closes, v).otherwise(F.lit(0.0))

    def at(k: int):
        """The panel's value at the k-th place of the last season, on the stretch that holds it."""
        place = hi - season + k + 1
        inside = (place >= i) & (closes | (place < F.col("_ni"))) | F.col("_opens") & (place < i)
        value = F.when(closes | (place <= i), v).otherwise(v + d * (place - i).cast("double") / g)
        return F.max(F.when(inside & (place >= lo) & v.isNotNull(), value))

    n = F.when(F.count("_y") > 0, F.max(hi - lo) + 1).otherwise(F.lit(0)).cast("long")
    sums = rows.groupBy(*keys).agg(
        n.alias("n"), F.max("_f").alias("first"), F.max(F.when(closes, v)).alias("last"),
        F.round(F.sum(total), 8).alias("_total"), F.sum(sx).alias("_sx"), F.sum(sx + d).alias("_sy"),
        F.sum(sxx).alias("_sxx"), F.sum(sxx + slope * sx).alias("_sxy"),
        F.array(*[at(k) for k in _season_places(horizon, season)]).alias("seasonal"))
    pairs, a, b = F.col("n") - 1, F.col("_sx"), F.col("_sy")
    fitted = sums.withColumn("ar_slope", F.try_divide(F.col("_sxy") - F.try_divide(a * b, pairs), F.col("_sxx") - F.try_divide(a * a, pairs)))
    stats = fitted.select(
        *keys, "n", F.lit(span[1]).cast("date").alias("t_last"), "last", "first", F.try_divide("_total", "n").alias("mean"), "ar_slope",
        (F.try_divide(b, pairs) + F.col("first") - F.col("ar_slope") * (F.try_divide(a, pairs) + F.col("first"))).alias("ar_intercept"), "seasonal")
    return _forecasts(stats, keys, step, horizon, season)


# ----------------------------------------------------------------------------- (b) AR per series

# Candidate models: autoregressive order, differences, a seasonal lag (0/1), a seasonal difference (0/1).
AR_CANDIDATES = [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (1, 1, 0, 0), (2, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1)]


def _needs(p: int, d: int, s: int, ds: int, season: int) -> int:
    """Observations before the first one that the candidate can predict."""
    return d + ds * season + max(p, s * season)


def _fit(y: np.ndarray, p: int, d: int, s: int, ds: int, season: int, first: int):
    """Least squares on the targets from ``first`` on; (errors, coefficients, lags, differenced series)."""
    z = y[season:] - y[:-season] if ds else np.diff(y) if d else y
    lags = list(range(1, p + 1)) + ([season] if s else [])
    at = np.arange(first - (len(y) - len(z)), len(z))
    x = np.column_stack([np.ones(len(at))] + [z[at - lag] for lag in lags])
    beta, *_ = np.linalg.lstsq(x, z[at], rcond=None)
    return z[at] - x @ beta, beta, lags, z


def _usable(length: int, season: int) -> tuple[list, int]:
    """(the candidates that a series of this length can fit, the first observation that all of them predict)"""
    usable = [c for c in AR_CANDIDATES if not (c[2] or c[3]) or (season > 1 and length - _needs(*c, season) >= 2 * season)]
    first = 0
    while usable:
        first = max(_needs(*c, season) for c in usable)
        if length - first >= max(c[0] + c[2] for c in usable) + 5:
            break
        usable.remove(max(usable, key=lambda c: _needs(*c, season)))
    return usable, first


def fit_ar(y: np.ndarray, horizon: int, season: int) -> tuple[np.ndarray, str]:
    """Best AICc model among AR_CANDIDATES; recursive multi-step forecast.

    All candidates predict the same observations (those that the longest one can), and a
    difference changes no error, so the criteria compare.  Positive series are modelled in
    logs: the choice does not depend on the unit of price, and no forecast leaves the range of
    prices seen.  Seasonal candidates need two seasons of targets.
    """
    y = np.asarray(y, dtype=float)
    logs = bool((y > 0).all())
    u = np.log(y) if logs else y
    usable, first = _usable(len(u), season)
    n = len(u) - first
    if not usable or np.ptp(u) == 0:
        return np.repeat(y[-1], horizon), "last"
    best = None
    for c in usable:
        errors, beta, lags, z = _fit(u, *c, season, first)
        k = len(beta) + 1
        floor = (1e-9 * np.ptp(u)) ** 2      # errors of rounding size are equal
        aicc = n * np.log(max(float(errors @ errors) / n, floor)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if best is None or aicc < best[0] - 1e-9:
            best = (aicc, c, beta, lags, z)
    _, c, beta, lags, z = best
    return _carried_on(y, u, logs, c, beta, lags, z, horizon, season)


def _carried_on(y, u, logs: bool, candidate: tuple, beta, lags, z, horizon: int, season: int) -> tuple[np.ndarray, str]:
    """The fitted model's recursive forecast, and its name."""
    p, d, s, ds = candidate
    hist, levels = list(z), list(u)
    for _ in range(horizon):
        hist.append(beta[0] + sum(b * hist[-lag] for b, lag in zip(beta[1:], lags)))
        levels.append(hist[-1] + (levels[-1] if d else levels[-season] if ds else 0.0))
    f = np.array(levels[len(u):])
    f = np.clip(np.exp(np.clip(f, u.min(), u.max())), y.min(), y.max()) if logs else f
    return f, f"AR({p}) d={d}" + (f" s={season}" if s else "") + (f" D={season}" if ds else "")


# Every candidate as a regression of a step on the columns 1, level, last step, the one before it, distance from the level a season ago,
# seasonal difference: the same span as its own lags, without their near collinearity.
_SHARED = {(1, 0, 0, 0): [0, 1], (2, 0, 0, 0): [0, 1, 2], (3, 0, 0, 0): [0, 1, 2, 3], (1, 1, 0, 0): [0, 2], (2, 1, 0, 0): [0, 2, 3],
           (1, 0, 1, 0): [0, 1, 4], (1, 0, 0, 1): [0, 5]}
SERIES_AT_ONCE = 64


def fit_ar_many(series: list[np.ndarray], horizon: int, season: int, refit: bool = True) -> list[tuple[np.ndarray, str]]:
    """``fit_ar`` of many series: all candidates of all series are solved from one table of products a series, and with ``refit``
    the chosen one again as ``fit_ar`` does (else its forecasts differ in their last digits).
    A series whose products do not determine the answer (nearly collinear, nearly exact, or two candidates nearly equal) goes to ``fit_ar``."""
    out, groups = [None] * len(series), {}
    for i, y in enumerate(series):
        usable, first = _usable(len(y), season)
        if usable and set(usable) <= set(_SHARED) and np.ptp(y) > 0:
            groups.setdefault((tuple(usable), first), []).append(i)
    for (usable, first), members in groups.items():
        members.sort(key=lambda i: len(series[i]))          # equal lengths together
        for k in range(0, len(members), SERIES_AT_ONCE):
            some = members[k:k + SERIES_AT_ONCE]
            for i, found in zip(some, _fit_group([np.asarray(series[i], dtype=float) for i in some], usable, first, horizon, season, refit)):
                out[i] = found
    return [fit_ar(y, horizon, season) if f is None else f for y, f in zip(series, out)]


def _fit_group(series: list[np.ndarray], usable: tuple, first: int, horizon: int, season: int, refit: bool = True):
    logs = np.array([bool((y > 0).all()) for y in series])
    length = max(len(y) for y in series)
    n = np.array([len(y) - first for y in series])
    u = np.empty((len(series), length))
    for i, y in enumerate(series):
        u[i, length - len(y):] = np.log(y) if logs[i] else y
        u[i, :length - len(y)] = u[i, length - len(y)]
    known = np.arange(first, length) >= length - n[:, None]         # the targets of each series
    lag = lambda k: u[:, first - k:length - k]
    low = np.array([x[-m - first:].min() for x, m in zip(u, n)])
    high = np.array([x[-m - first:].max() for x, m in zip(u, n)])
    spread = high - low
    centre = (lag(1) * known).sum(1) / n
    yearly_lag, yearly_step = any(c[2] for c in usable), any(c[3] for c in usable)
    columns = {0: np.ones(known.shape), 1: lag(1) - centre[:, None], 6: lag(0) - lag(1)}
    if first > 1:
        columns[2] = lag(1) - lag(2)
    if first > 2:
        columns[3] = lag(2) - lag(3)
    if yearly_lag:
        columns[4] = lag(1) - lag(season)
    if yearly_step:
        columns[5] = lag(1) - lag(season + 1)
        columns[7] = lag(0) - lag(season) - columns[5]
    place = {name: k for k, name in enumerate(columns)}
    table = np.stack(list(columns.values()), axis=1) * known[:, None, :]
    products = table @ table.transpose(0, 2, 1)
    best, second, chosen = np.full(len(series), np.inf), np.full(len(series), np.inf), np.zeros(len(series), int)
    doubt, answers = np.zeros(len(series), bool), np.zeros((len(series), 6))
    floor = (1e-9 * spread) ** 2
    for j, c in enumerate(usable):
        x, y = [place[k] for k in _SHARED[c]], place[7 if c[3] else 6]
        a, b, yy = products[:, x][:, :, x], products[:, x, y], products[:, y, y]
        size = np.sqrt(np.einsum("ijj->ij", a))
        flat = (size <= 0).any(1) | (yy <= 0)
        size[flat] = 1.0
        a = a / size[:, :, None] / size[:, None, :]
        a[flat] = np.eye(len(x))
        unsure = flat | (np.linalg.eigvalsh(a)[:, 0] < 1e-7)
        a[unsure] = np.eye(len(x))
        beta = np.linalg.solve(a, (b / size)[:, :, None])[:, :, 0]
        rest = yy - (beta * (b / size)).sum(1)
        doubt |= unsure | (rest < 1e-7 * yy)
        k = len(x) + 1
        aicc = n * np.log(np.maximum(np.maximum(rest, 0.0) / n, np.maximum(floor, 1e-300))) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        better = aicc < best
        second = np.where(better, best, np.minimum(second, aicc))
        best, chosen = np.where(better, aicc, best), np.where(better, j, chosen)
        filled = np.zeros((len(series), 6))
        filled[:, _SHARED[c]] = beta / size
        answers[better] = filled[better]
    doubt |= second - best < 1e-4
    if refit:
        out = []
        for i, y in enumerate(series):
            c, own = usable[chosen[i]], u[i, length - len(y):]
            out.append(None if doubt[i] else _carried_on(y, own, logs[i], c, *_fit(own, *c, season, first)[1:], horizon, season))
        return out
    path = u[:, max(0, length - season - 2):]
    yearly = np.array([bool(c[3]) for c in usable])[chosen]
    for _ in range(horizon):
        d1, d2 = path[:, -1] - path[:, -2], path[:, -2] - path[:, -3]
        old = path[:, -season] if yearly_lag or yearly_step else path[:, -1]
        z = path[:, -1] - path[:, -season - 1] if yearly_step else np.zeros(len(path))
        terms = np.stack([np.ones(len(path)), path[:, -1] - centre, d1, d2, path[:, -1] - old, z], axis=1)
        step = (answers * terms).sum(1)
        path = np.concatenate([path, np.where(yearly, old + z + step, path[:, -1] + step)[:, None]], axis=1)
    out = []
    for i, y in enumerate(series):
        if doubt[i] or not np.isfinite(path[i]).all():
            out.append(None)
            continue
        f, (p, d, s, ds) = path[i, -horizon:], usable[chosen[i]]
        f = np.clip(np.exp(np.clip(f, low[i], high[i])), y.min(), y.max()) if logs[i] else f
        out.append((f, f"AR({p}) d={d}" + (f" s={season}" if s else "") + (f" D={season}" if ds else "")))
    return out


def ar_forecasts(panel: DataFrame, keys: list[str], y: str, step: str, horizon: int,
                 season: int, t: str = "t") -> DataFrame:
    """AICc-selected autoregressive forecast for every series."""
    key_fields = [f for f in panel.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [
        T.StructField("h", T.IntegerType()), T.StructField("t_last", T.DateType()),
        T.StructField("f_ar", T.DoubleType()), T.StructField("model", T.StringType())])

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        vals = pdf[y].to_numpy(dtype=float)
        vals = vals[~np.isnan(vals)]
        if len(vals) == 0:
            return pd.DataFrame(columns=schema.fieldNames())
        f, model = fit_ar(vals, horizon, season)
        out = pd.DataFrame({"h": np.arange(1, horizon + 1, dtype="int32"), "f_ar": f, "model": model})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["t_last"] = pdf[t].iloc[-1]
        return out[schema.fieldNames()]

    ship_package(panel.sparkSession)
    res = panel.select(*keys, t, y).groupBy(*keys).applyInPandas(per_series, schema)
    return res.withColumn("t_forecast", _horizon_date(F.col("t_last"), F.col("h"), step)).drop("t_last")


def _per_series(obs: DataFrame, keys: list[str], y: str, idx) -> DataFrame:
    """One row per series: its known observations as two arrays by ``idx``.  A series is bounded by the calendar."""
    whole = F.col(y).isNotNull() & F.col("_i").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    one = (obs.withColumn("_i", idx).groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.when(whole, F.struct(F.col("_i").alias("i"), F.col(y).alias("v"))))).alias("_o")))
    return one.select(*keys, F.col("_o.i").alias("_at"), F.col("_o.v").alias("_values"))


SERIES_HELD = 128       # whose dense values a task holds at a time


def _arrow_rows(df: DataFrame, keys: list[str], fit, fields: list[T.StructField]) -> DataFrame:
    """``fit([(places, values), ...])`` -> rows of ``fields`` for each row of ``_per_series``; ``SERIES_HELD`` series at a time."""
    schema = T.StructType([f for f in df.schema.fields if f.name in keys] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            owner, columns = [], [[] for _ in fields]
            places, found = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("_at", "_values"))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in batch.column("_at")])])
            for r in range(0, batch.num_rows, SERIES_HELD):
                some = range(r, min(r + SERIES_HELD, batch.num_rows))
                for i, rows in zip(some, fit([(places[ends[i]:ends[i + 1]], found[ends[i]:ends[i + 1]]) for i in some])):
                    for row in rows:
                        owner.append(i)
                        for c, v in zip(columns, row):
                            c.append(v)
            own = batch.select(keys).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keys):]))], schema=arrow)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def dense_values(at: np.ndarray, values: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The gap-filled series over lo..hi from its observations, bit for bit as ``filled_panel`` has it."""
    gaps = np.diff(at).astype(float)
    out = np.repeat(values.astype(float), np.diff(np.concatenate([[lo], at[1:], [hi + 1]])))
    if len(at) > 1:
        a, b = at[0] - lo, at[-1] - lo
        steps = np.diff(at)
        since = (np.arange(at[0], at[-1]) - np.repeat(at[:-1], steps)).astype(float)
        out[a:b] = np.where(since > 0, out[a:b] + np.repeat(np.diff(values), steps) * since / np.repeat(gaps, steps), out[a:b])
    return out


def observed_ar_forecasts(obs: DataFrame, keys: list[str], y: str, step: str, horizon: int, season: int, span: tuple, t: str = "t") -> DataFrame:
    """``ar_forecasts`` of the gap-filled panel over ``span`` (first and last period) from the observations: every series is
    one row, filled and fitted in its task; no panel is shuffled or sorted."""
    rows = _per_series(obs, keys, y, C.period_index(t, step))
    if span[0] is None:
        span = (dt.date(1970, 1, 1),) * 2     # no observations: no rows
    lo, hi = obs.sparkSession.range(1).select(*[C.period_index(F.lit(d).cast("date"), step) for d in span]).first()

    def fit(series):
        some = [i for i, (at, _) in enumerate(series) if len(at)]
        out = [[] for _ in series]
        for i, (f, model) in zip(some, fit_ar_many([dense_values(*series[i], lo, hi) for i in some], horizon, season)):
            out[i] = [(h + 1, float(v), model) for h, v in enumerate(f)]
        return out

    out = _arrow_rows(rows, keys, fit, [T.StructField("h", T.IntegerType()), T.StructField("f_ar", T.DoubleType()), T.StructField("model", T.StringType())])
    kinds = ["h", "f_ar", "model"]
    return out.select(*keys, *kinds, _horizon_date(F.lit(span[1]).cast("date"), F.col("h"), step).alias("t_forecast"))


def dense_forecasts(obs: DataFrame, keys: list[str], y: str, step: str, horizon: int, season: int, span: tuple, t: str = "t") -> DataFrame:
    """``baseline_forecasts`` of the gap-filled panel over ``span``: every series is one row, filled in its task, and its values are
    added one by one in order of time, as the panel's rows would be.  No panel row is made.
    A series without a known value has n = 0 and null forecasts."""
    rows = _per_series(obs, keys, y, C.period_index(t, step))
    if span[0] is None:
        span = (dt.date(1970, 1, 1),) * 2     # no observations: no rows
    lo, hi = obs.sparkSession.range(1).select(*[C.period_index(F.lit(d).cast("date"), step) for d in span]).first()
    places = [hi - season + 1 + k for k in _season_places(horizon, season)]

    def fit(series):
        some = [i for i, (at, _) in enumerate(series) if len(at)]
        out = [[(0, None, None, None, None, None, [None] * len(places))] for _ in series]
        if not some:
            return out
        v = np.stack([dense_values(*series[i], lo, hi) for i in some])
        n, rel = v.shape[1], v - v[:, :1]
        total = v.cumsum(axis=1)[:, -1]
        a, b = rel[:, :-1], rel[:, 1:]
        pairs = n - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            sa, sb = a.sum(1), b.sum(1)
            var = (a * a).sum(1) - sa * sa / pairs
            slope = ((a * b).sum(1) - sa * sb / pairs) / var
            intercept = sb / pairs + v[:, 0] - slope * (sa / pairs + v[:, 0])
        for r, i in enumerate(some):
            fitted = pairs > 0 and var[r] != 0
            out[i] = [(n, float(v[r, -1]), float(v[r, 0]), float(total[r]), float(slope[r]) if fitted else None, float(intercept[r]) if fitted else None,
                       [float(v[r, p - lo]) if p >= lo else None for p in places])]
        return out

    double = T.DoubleType()
    stats = _arrow_rows(rows, keys, fit, [T.StructField("n", T.LongType()), *[T.StructField(c, double) for c in ("last", "first", "_total", "ar_slope", "ar_intercept")],
                                          T.StructField("seasonal", T.ArrayType(double))])
    stats = stats.withColumns({"mean": F.try_divide(F.round("_total", 8), "n"), "t_last": F.lit(span[1]).cast("date")})
    return _forecasts(stats, keys, step, horizon, season)


# ----------------------------------------------------------------------------- rolling-origin evaluation

BASELINES = ["last", "mean", "drift", "snaive"]


def backtest_targets(obs: DataFrame, keys: list[str], y: str, idx: str, horizon: int, season: int, origins: int) -> DataFrame:
    """One row per evaluated observation, the last ``origins`` of every series: what each closed-form method
    says from the observations at least ``horizon`` periods older (F6, F7).  Nothing later is seen."""
    order = Window.partitionBy(*keys).orderBy(idx)
    known = order.rangeBetween(Window.unboundedPreceding, -horizon)
    year = order.rangeBetween(Window.unboundedPreceding, -max(season, horizon))
    d = obs.select(
        *keys, idx, y, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(idx))).alias("back"),
        F.last(y).over(known).alias("f_last"), F.first(y).over(known).alias("_first"), F.count(y).over(known).alias("_n"),
        F.sum(y).over(known).alias("_sum"), F.max(idx).over(known).alias("_at"), F.min(idx).over(known).alias("_from"), F.last(y).over(year).alias("_season"))
    d = d.filter((F.col("back") <= origins) & (F.col("_n") > 0))
    slope = F.try_divide(F.col("f_last") - F.col("_first"), F.col("_at") - F.col("_from"))
    return d.select(*keys, idx, y, "f_last", (F.round("_sum", 8) / F.col("_n")).alias("f_mean"),
                    (F.col("f_last") + (F.col(idx) - F.col("_at")) * F.coalesce(slope, F.lit(0.0))).alias("f_drift"),
                    F.coalesce("_season", "f_last").alias("f_snaive"))


def backtest_baselines(obs: DataFrame, keys: list[str], y: str, idx: str, horizon: int, season: int, origins: int) -> DataFrame:
    """Mean absolute error per series and method."""
    d = backtest_targets(obs, keys, y, idx, horizon, season, origins)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_targets"),
                                *[(F.round(F.sum(F.abs(F.col(y) - F.col(f"f_{m}"))), 4) / F.count(F.lit(1))).alias(f"mae_{m}") for m in BASELINES])


def backtest_ar(obs: DataFrame, keys: list[str], y: str, idx: str, horizon: int, season: int, origins: int) -> DataFrame:
    """Mean absolute error of the AR model per series at the same targets, refitted at every origin on
    what is known there (gaps between known observations interpolated, the last one carried on)."""
    def fit(series):
        dense, targets = [], []
        for r, (at, values) in enumerate(series):
            for i in range(max(0, len(at) - origins), len(at)):
                known = at <= at[i] - horizon
                if known.any():
                    dense.append(np.interp(np.arange(at[0], at[i] - horizon + 1), at[known], values[known]))
                    targets.append((r, values[i]))
        errors = [[] for _ in series]
        for (r, seen), (f, _) in zip(targets, fit_ar_many(dense, horizon, season, refit=False)):
            errors[r].append(abs(seen - f[horizon - 1]))
        return [[(len(e), float(np.mean(e)) if e else None)] for e in errors]

    rows = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(y).cast("double").alias("v")))).alias("_o"))
    return _arrow_rows(rows.select(*keys, F.col("_o.i").alias("_at"), F.col("_o.v").alias("_values")), keys, fit,
                       [T.StructField("n_ar", T.LongType()), T.StructField("mae_ar", T.DoubleType())])
