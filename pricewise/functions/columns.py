"""Column-level helpers: safe arithmetic, retail formulas, dates, composite keys.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- arithmetic (P4-P8, P16, P19, X12-X15) ---------------------------------

def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def margin(total_sales="total_sales", price="price", costos="costos") -> Column:
    """Unit margin: sales minus implied units times unit cost."""
    return col(total_sales) - safe_div(total_sales, price) * col(costos)


def ganancia_as_coded(price="price", costos="costos", total_sales="total_sales") -> Column:
    """(price - cost) * sales, as the original pipeline codes it: scaled by sales, not units (P5)."""
    return (col(price) - col(costos)) * col(total_sales)


def profit(total_sales="total_sales", quantity="quantity", costos="costos") -> Column:
    """Reported profit: sales - units * unit cost."""
    return col(total_sales) - col(quantity) * col(costos)


def quantity_from_sales(total_sales="total_sales", price="price", rounded: bool = False) -> Column:
    """Units implied by sales / price; optionally rounded half-up."""
    q = safe_div(total_sales, price)
    return F.round(q) if rounded else q


def impute_quantity(quantity="quantity", total_sales="total_sales", price="price") -> Column:
    """Keep the recorded quantity, fill a missing one from sales / price (P7 rule)."""
    return F.coalesce(col(quantity), F.round(safe_div(total_sales, price)))


def stable_mean(c, scale: int = 8) -> Column:
    """Mean from a sum rounded at 10^-scale: the same value under any partitioning
    (a plain double sum changes in its last bits with the order of addition)."""
    return F.try_divide(F.round(F.sum(col(c)), scale), F.count(col(c)))


def markup(price="price", costos="costos") -> Column:
    """(price - cost) / cost."""
    return safe_div(col(price) - col(costos), costos)


def zero_or_round_even(c) -> Column:
    """0 when missing, else rounded half-to-even."""
    return F.coalesce(F.bround(col(c)), F.lit(0.0))


def valid_flag(total_sales="total_sales", quantity="quantity", price="price") -> Column:
    """1 when sales equal units * price after rounding, else 0."""
    return F.when(F.round(col(total_sales) - col(quantity) * col(price)) == 0, 1).otherwise(0)


# --- dates (X1-X8) ---------------------------------------------------------

def parse_date(c) -> Column:
    """Text or timestamp to date; bad text gives null instead of an error."""
    return F.try_to_date(col(c).cast("string")) if isinstance(c, str) else col(c).cast("date")


def simple_week(d) -> Column:
    """Week counted from Jan 1: (day-of-year - 1) div 7 + 1."""
    return (F.floor((F.dayofyear(col(d)) - 1) / 7) + 1).cast("int")


def iso_week(d) -> Column:
    return F.weekofyear(col(d))


def iso_year(d) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d))


def week_start(d) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", col(d)).cast("date")


def month_start(d) -> Column:
    return F.trunc(col(d), "MM")


def period_start(d, step: str) -> Column:
    return {"day": col(d).cast("date"), "week": week_start(d), "month": month_start(d)}[step]


def period_index(d, step: str) -> Column:
    """Integer position of a period: consecutive periods differ by 1."""
    if step == "day":
        return F.unix_date(col(d))
    if step == "week":
        return F.floor((F.unix_date(col(d)) + 3) / 7).cast("int")   # 1970-01-01 is a Thursday
    if step == "month":
        return (F.year(col(d)) * 12 + F.month(col(d)) - 1).cast("int")
    raise ValueError(step)


def step_interval(step: str) -> Column:
    return F.expr({"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[step])


# --- composite keys and hashing (P17, X9-X11, S8, M9, M10) -----------------

def format_key(store="store_id", subgroup="subgroup", day="date_id") -> Column:
    return F.concat_ws("_", col(store), col(subgroup), F.date_format(col(day), "yyyy-MM-dd"))


def split_key(key="store_subgroup_date_id") -> list[Column]:
    """STORE_SUBGROUP_DATE -> three columns; date parsed once."""
    k = col(key)
    return [
        F.split_part(k, F.lit("_"), F.lit(1)).alias("store_id"),
        F.split_part(k, F.lit("_"), F.lit(2)).alias("subgroup"),
        F.try_to_date(F.split_part(k, F.lit("_"), F.lit(3))).alias("date_id"),
    ]


def hash_bucket(key, n: int) -> Column:
    """Stable bucket 0..n-1 from the md5 of a key (same value on every engine and rerun)."""
    return F.pmod(F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint"),
                  F.lit(n))
