"""Data-quality profile (A17-A20, P18) and the series contract check."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pricewise.functions import columns as C

#: Rank error (1 / accuracy) of the sketches that bracket a quantile.  They hold a bounded number of
#: values; what they return only says where to look.
BRACKET_ACCURACY = 1000
#: Distinct values of a bracket that are put in order at once.
ORDERED = 20_000


def write_profiled(tables: dict[str, DataFrame], write) -> DataFrame:
    """Writes every table with ``write(df, name)`` and returns (table_name, column_name, n_rows, n_null), counted
    by an observation while the rows are written: no pass of its own (A17)."""
    rows = []
    for name, df in tables.items():
        seen = Observation(f"profile-{name}")
        write(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]), name)
        counts = seen.get
        rows += [(name, c, counts["n_rows"], counts[f"null_{c}"]) for c in df.columns]
    # one row a column
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, n_rows long, n_null long")


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls in every column, one pass, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def select_ranks(rows: DataFrame, column: str, ranks: list[int], n: int) -> dict:
    """The values of the given 1-based ranks among the ``n`` non-null values of a column, exactly.

    Every rank is bracketed by a coarse sketch; one pass counts what lies below, on and between the
    brackets' edges, and only a bracket with few distinct values is put in order.  Others are
    bracketed again among their own rows, without the edges, so that heavy values never come back.
    No task receives the column, whatever its size.
    """
    col, eps = F.col(column), 3.0 / BRACKET_ACCURACY
    near = {r: (max(0.0, r / n - eps), min(1.0, r / n + eps)) for r in ranks}
    probs = sorted({p for pair in near.values() for p in pair})
    edges = dict(zip(probs, rows.agg(F.percentile_approx(column, probs, BRACKET_ACCURACY).alias("q")).first()["q"]))
    of = {r: (edges[a], edges[b]) for r, (a, b) in near.items()}
    brackets = sorted(set(of.values()))
    sums = []
    for i, (lo, hi) in enumerate(brackets):
        between = (col > F.lit(lo)) & (col < F.lit(hi))
        sums += [F.count_if(col < F.lit(lo)).alias(f"below{i}"), F.count_if(col == F.lit(lo)).alias(f"lo{i}"), F.count_if(between).alias(f"mid{i}"),
                 F.count_if((col == F.lit(hi)) & F.lit(lo != hi)).alias(f"hi{i}"), F.approx_count_distinct(F.when(between, col)).alias(f"kinds{i}")]
    c = rows.agg(*sums).first()
    found = {}
    for i, (lo, hi) in enumerate(brackets):
        below = c[f"below{i}"]
        middle = below + c[f"lo{i}"]
        top = middle + c[f"mid{i}"]
        end = top + c[f"hi{i}"]
        mine = [r for r in ranks if of[r] == (lo, hi)]
        found |= {r: lo for r in mine if below < r <= middle} | {r: hi for r in mine if top < r <= end}
        between = rows.filter((col > F.lit(lo)) & (col < F.lit(hi)))
        wanted = sorted(r for r in mine if middle < r <= top)
        if wanted and c[f"kinds{i}"] <= ORDERED:
            at = middle
            for value, k in between.groupBy(column).count().orderBy(column).collect():     # about ORDERED rows at most
                found |= {r: value for r in wanted if at < r <= at + k}
                at += k
            wanted = []
        # ranks between the edges of a wide bracket, and those the sketch's error put outside
        for part, start, size, some in ((between, middle, top - middle, wanted), (rows.filter(col < F.lit(lo)), 0, below, [r for r in mine if r <= below]),
                                        (rows.filter(col > F.lit(hi)), end, n - end, [r for r in mine if r > end])):
            if some:
                inner = select_ranks(part, column, [r - start for r in some], size)
                found |= {r: inner[r - start] for r in some}
    return found


def rank_of(p: float, n: int) -> int:
    """1-based rank of the p-quantile that is a value of the column (SQL's discrete quantile)."""
    return max(1, n - math.floor(n - n * p))


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list:
    """Discrete quantiles of a column's non-null values; nulls for an empty column."""
    rows = df.select(column).filter(F.col(column).isNotNull())
    n = rows.count()
    if not n:
        return [None] * len(probs)
    ranks = [rank_of(p, n) for p in probs]
    found = select_ranks(rows, column, sorted(set(ranks)), n)
    return [found[r] for r in ranks]


def quantile_profile(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """p_low, p_high, min and max of a column."""
    kind = df.schema[column].dataType
    q_low, q_high = exact_quantiles(df, column, [low, high])
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max")).select(
        F.lit(q_low).cast(kind).alias("q_low"), F.lit(q_high).cast(kind).alias("q_high"), "min", "max")


def count_outside(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows below p_low or above p_high."""
    lo, hi = exact_quantiles(df, column, [low, high])
    return df.agg(F.count_if((F.col(column) < F.lit(lo)) | (F.col(column) > F.lit(hi))).alias("n_outside"))


def extreme_rows(df: DataFrame, column: str, p: float = 0.9999, keep=None) -> DataFrame:
    """Rows above the p-quantile."""
    out = df.filter(F.col(column) > F.lit(exact_quantiles(df, column, [p])[0]))
    return out.select(*keep) if keep else out


def calculation_errors(tx: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Rows whose recorded units x price differ from sales by more than ``tolerance``."""
    dif = F.abs(F.col("quantity") * F.col("price") - F.col("total_sales"))
    return (tx.filter(F.col("quantity").isNotNull() & (dif > tolerance))
            .select("transaction_id", "quantity", "price", "total_sales", dif.alias("dif")))


def irregular_series(panel: DataFrame, keys, t: str, step: str, span: tuple) -> DataFrame:
    """Series that do not have every period from their first to their last exactly once (F4): the only ones
    that ``duplicate_keys`` and ``irregular_steps`` can find anything in.

    The periods seen are kept as bits, 62 to a word, so a series is one fixed row of a hash aggregate however long:
    the panel is neither sorted nor kept.  ``span`` holds the first and the last period that occur (all in it)."""
    lo, hi = (C.period_index(F.lit(d).cast("date"), step) for d in span)
    size = panel.sparkSession.range(1).select((hi - lo).alias("n")).first()["n"]
    place = C.period_index(t, step) - lo
    words = range(0 if size is None else size // 62 + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 62).cast("int"))
    seen = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(place) - F.min(place) + 1).alias("_length"),
        *[F.bit_or(F.when(F.floor(place / 62) == k, bit)).alias(f"_w{k}") for k in words])
    periods = sum((F.coalesce(F.bit_count(f"_w{k}"), F.lit(0)) for k in words), F.lit(0))
    regular = (F.col("_n") == F.col("_length")) & (periods == F.col("_length"))
    return seen.filter(~F.coalesce(regular, F.lit(False))).select(*keys)


def duplicate_keys(panel: DataFrame, keys, t: str) -> DataFrame:
    """(series, t) pairs present more than once (F4: uniqueness)."""
    return (panel.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def irregular_steps(panel: DataFrame, keys, t: str, step: str) -> DataFrame:
    """Consecutive observations of a series more than one period apart (F4: regularity)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(t)
    idx = C.period_index(t, step)
    gap = F.lead(idx).over(w) - idx
    return (panel.select(*keys, t, gap.alias("gap")).filter(F.col("gap") != 1))
