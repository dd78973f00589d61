"""Price series: period medians, dense panels, gap filling.

A panel is a DataFrame with unique (series keys, t) and no missing period.  Each
series is bounded by the calendar length, so the per-series windows below never
create a hot partition, however many series there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.functions import columns as C
from pricewise.session import materialize


def period_median(daily: DataFrame, keys: list[str], step: str, value: str = "price_",
                  t: str = "date_id", out: str = "price_median") -> DataFrame:
    """Median of a daily value per series and period (F1; A14 for the daily case).
    A period holds at most 31 daily values, so the exact percentile buffer is bounded."""
    return (daily.groupBy(*keys, C.period_start(t, step).alias("t"))
            .agg(F.percentile(value, 0.5).alias(out)))


def bounds(obs: DataFrame, t: str = "t"):
    """First and last observed period: two scalars from one aggregate job."""
    row = obs.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    return row["lo"], row["hi"]


def calendar(obs: DataFrame, step: str, t: str = "t", span=None) -> DataFrame:
    """Every period between the first and last observed one, with its labels."""
    lo, hi = span or bounds(obs, t)
    periods = obs.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(lo), F.lit(hi), C.step_interval(step))).alias("t"))
    return periods.select(
        "t", C.period_index("t", step).alias("idx"),
        C.iso_week("t").alias("iso_week"), C.iso_year("t").alias("iso_year"),
        C.simple_week("t").alias("simple_week"), F.year("t").alias("year"))


def dense_panel(obs: DataFrame, keys: list[str], step: str, value: str, t: str = "t") -> DataFrame:
    """Observed series x every calendar period, observed value or null (J7 + J8 + J9)."""
    return filled_panel(obs, keys, step, value, "_filled", t).drop("_filled")


def stretches(obs: DataFrame, keys: list[str], step: str, value: str, t: str, span: tuple) -> DataFrame:
    """One row per known observation with the periods it stands for, ``_from`` to ``_to``: up to the next
    known one (``_nt``, ``_nv``; ``_pt``, ``_pv``: the one before), the first one from the start of ``span`` and the last one to its end.  A series
    without a known value has one row for the whole span.  Equal periods of a series (none after
    ``period_median``) each keep their own row.  A series is bounded by the calendar."""
    lo, hi = (F.lit(d).cast("date") for d in span)
    whole = F.col(t).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()         # a null key joins no observation
    # The spread over the keys is kept as asked (AQE would coalesce the few observations, and every row becomes a
    # stretch of the calendar); the panel and whatever is grouped by series stay in these partitions.
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = obs.select(*keys, t, F.when(whole, F.col(value)).alias("_v")).repartition(parts, *keys)
    w = Window.partitionBy(*keys).orderBy(F.col("_v").isNull(), F.col(t))
    rows = known.select("*", F.row_number().over(w).alias("_n"), F.lag(t).over(w).alias("_pt"), F.lag("_v").over(w).alias("_pv"), F.lead(t).over(w).alias("_nt"), F.lead("_v").over(w).alias("_nv"))
    back = {"day": lambda c: F.date_sub(c, 1), "week": lambda c: F.date_sub(c, 7), "month": lambda c: F.add_months(c, -1)}[step]
    rows = rows.filter(F.col("_v").isNotNull() | (F.col("_n") == 1))
    return rows.select(
        *keys, F.when(F.col("_v").isNotNull(), F.col(t)).alias("_t"), "_v", "_pt", "_pv", F.when(F.col("_nv").isNotNull(), F.col("_nt")).alias("_nt"), "_nv",
        F.when(F.col("_n") == 1, lo).otherwise(F.col(t)).alias("_from"),
        F.when(F.col("_nv").isNull(), hi).otherwise(F.greatest(F.col(t), back(F.col("_nt")))).alias("_to"))


def filled_panel(obs: DataFrame, keys: list[str], step: str, value: str, out: str, t: str = "t", lagged: str | None = None) -> DataFrame:
    """``fill_gaps(dense_panel(obs))`` without a shuffle, join or sort of the panel.

    Only observations are shuffled: each expands into its stretch (``stretches``) with ``explode(sequence(...))``
    and carries the two values that the stretch lies between, so its rows are filled where they are
    made, and labelled from the small calendar.  The rows of a series stay in one partition, so an aggregate
    by series needs no exchange.  The observations are written once to the shared checkpoint folder: the
    bounds and the stretches read that copy.  ``lagged`` names a column for the filled value one period before.
    """
    obs = materialize(obs.select(*keys, t, value), "panel-obs")
    return filled_over(obs, keys, step, value, out, bounds(obs, t), t, lagged)


def filled_over(obs: DataFrame, keys: list[str], step: str, value: str, out: str, span: tuple, t: str = "t", lagged: str | None = None) -> DataFrame:
    """``filled_panel`` of observations that are already written, over their bounds ``span``."""
    rows = stretches(obs, keys, step, value, t, span)
    grid = rows.withColumn("_at", F.explode(F.sequence("_from", "_to", C.step_interval(step))))
    cal = calendar(obs, step, t, span).withColumnRenamed("t", "_at")
    p = grid.join(cal, "_at", "left")
    i, ni = C.period_index("_t", step), C.period_index("_nt", step)

    def line(v, nv, at, frm, to):
        return v + (nv - v) * (at - frm).cast("double") / (to - frm).cast("double")

    inner = F.col("_nv").isNotNull() & (F.col("_at") > F.col("_t"))
    interp = line(F.col("_v"), F.col("_nv"), F.col("idx"), i, ni)
    more = []
    if lagged:
        k, pi = F.col("idx") - 1, C.period_index("_pt", step)
        earlier = F.col("_at") == F.col("_t")           # then the value before is on the stretch before
        more = [F.when(F.col("_at") == F.lit(span[0]).cast("date"), F.lit(None).cast("double"))
                .when(earlier & F.col("_pv").isNotNull() & (k > pi), line(F.col("_pv"), F.col("_v"), k, pi, i))
                .when(earlier & F.col("_pv").isNotNull(), F.col("_pv"))
                .when(F.col("_nv").isNotNull() & (k > i), line(F.col("_v"), F.col("_nv"), k, i, ni))
                .otherwise(F.col("_v")).alias(lagged)]
    return p.select(F.col("_at").alias(t), *keys, F.when(F.col("_at") == F.col("_t"), F.col("_v")).alias(value),
                    "idx", "iso_week", "iso_year", "simple_week", "year", F.when(inner, interp).otherwise(F.col("_v")).alias(out), *more)


def fill_gaps(panel: DataFrame, keys: list[str], value: str, out: str,
              idx: str = "idx", t: str = "t") -> DataFrame:
    """Linear interpolation of inner gaps by position, then carry the last value
    forward and the first value backward (W2, W3, W4; ordering W7).

    Both directions are running frames (unbounded preceding .. current row): the
    next observed value is the last one seen when the series is walked backwards.
    A ``current row .. unbounded following`` frame would be recomputed for every
    row, quadratic in the series length.  The two orders share one partitioning,
    so the second costs a sort inside each partition, not a shuffle.
    """
    running = (Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(F.col(t).asc()).rowsBetween(*running)
    after = Window.partitionBy(*keys).orderBy(F.col(t).desc()).rowsBetween(*running)
    seen_idx = F.when(F.col(value).isNotNull(), F.col(idx))
    p = panel.select(
        "*",
        F.last(value, ignorenulls=True).over(before).alias("_pv"),
        F.last(seen_idx, ignorenulls=True).over(before).alias("_pi"),
        F.last(value, ignorenulls=True).over(after).alias("_nv"),
        F.last(seen_idx, ignorenulls=True).over(after).alias("_ni"),
    )
    frac = (F.col(idx) - F.col("_pi")).cast("double")
    span = (F.col("_ni") - F.col("_pi")).cast("double")
    interp = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * frac / span
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
              .when(F.col("_pv").isNotNull() & F.col("_nv").isNotNull(), interp)
              .when(F.col("_pv").isNotNull(), F.col("_pv"))
              .otherwise(F.col("_nv")))
    return p.withColumn(out, filled).drop("_pv", "_pi", "_nv", "_ni")


def series_order(obs: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Position of each observation inside its series."""
    return obs.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(t)))


def long_observations(obs: DataFrame, keys: list[str], min_rows: int = 5) -> DataFrame:
    """The observations of series with more than ``min_rows`` of them (F5, applied before any
    panel or forecast).  A series is bounded by the calendar."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return obs.withColumn("_n", n).filter(F.col("_n") > min_rows).drop("_n")


def long_series(obs: DataFrame, keys: list[str], min_rows: int = 5) -> DataFrame:
    """Series with more than ``min_rows`` rows."""
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs")).filter(F.col("n_obs") > min_rows)
