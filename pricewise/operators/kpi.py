"""Report KPIs, ranking and bins.

Global orderings never go through a single-partition window:
* top-k with ties takes the k-th value from a distributed top-k (TakeOrderedAndProject)
  as a scalar subquery, then filters;
* exact row numbers / ntile / interpolated quantiles use a range repartition and
  per-partition offsets (a table with one row per partition).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewise.functions import columns as C
from pricewise.session import materialize

_LOCAL_BITS = 33   # monotonically_increasing_id = partition index << 33 | row index in partition


def top_k_with_ties(df: DataFrame, by: str, k: int) -> DataFrame:
    """Rows whose ``by`` value ranks in the top k, ties kept (= rank() <= k)."""
    kth = df.select(by).dropna().orderBy(F.desc(by)).limit(k).agg(F.min(by)).scalar()
    return df.filter(F.col(by) >= kth)


def top_k(df: DataFrame, by: str, k: int, tiebreak: list[str]) -> DataFrame:
    """First k rows by ``by`` descending, no ties kept (T3).  Plans as a distributed top-k."""
    return df.orderBy(F.desc(by), *tiebreak).limit(k)


def global_row_number(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number over a total order, without a single-partition window.

    Range-partition on the order, sort inside each partition, number rows locally,
    then add the running count of earlier partitions (one row per partition).
    Rows tied on every ``order`` column are interchangeable; give enough columns
    to make the order total when that matters.  ``partitions`` defaults to the
    session's shuffle width, so range slices grow with the cluster, not the data.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({
        "_pid": F.shiftright("_mid", _LOCAL_BITS),
        "_local": F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    }).drop("_mid")
    # Written once: the counts, the numbering join and every later consumer read the
    # same rows, and a recomputation after a lost executor cannot renumber ties.
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_offset"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    # offsets has one row per partition: a proven bound, so broadcasting it is safe.
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumns({
        "row_number": F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_local") + 1,
        "n_rows": F.col("_total"),
    }).drop("_pid", "_local", "_offset", "_total")


class RankRanges:
    """Where given ranks of a total order fall, found without sorting the table.

    A sketch of the first order column brackets ``fractions`` of the rows; a second pass counts (and sums up, with
    ``more`` aggregates) the rows inside and between the brackets.  Rows between brackets belong to one side of every
    rank by their value alone.  Only the rows inside are written and numbered: those near a rank, and
    values so common that one covers a bracket.
    """

    def __init__(self, df: DataFrame, order: list[str], fractions: list[float], ranks_of, more: list[Column] = (), accuracy: int = 2000):
        self.df, self.order, self.by = df, order, F.col(order[0])
        self.brackets, self.below, self.inside, self.between = [], [], [], []
        slack = 3.0 / accuracy
        while True:
            probs = sorted({min(1.0, max(0.0, f + d)) for f in fractions for d in (-slack, slack)})
            first = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(order[0], probs, accuracy).alias("q")).first()
            self.n = first["n"]
            if not self.n:
                return
            edges = dict(zip(probs, first["q"]))
            brackets: list[list] = []
            for lo, hi in sorted((edges[max(0.0, f - slack)], edges[min(1.0, f + slack)]) for f in fractions):
                if brackets and lo <= brackets[-1][1]:
                    brackets[-1][1] = max(hi, brackets[-1][1])
                else:
                    brackets.append([lo, hi])
            part = F.lit(0)
            for i, (lo, hi) in enumerate(brackets):
                part = F.when(self.by > F.lit(hi), 2 * i + 2).when(self.by >= F.lit(lo), 2 * i + 1).otherwise(part)
            # 2 k + 1 rows
            parts = {r["part"]: r for r in df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), *more).collect()}
            sizes = [parts[i]["n"] if i in parts else 0 for i in range(2 * len(brackets) + 1)]
            self.brackets, self.inside = brackets, sizes[1::2]
            self.below = [sum(sizes[: 2 * i + 1]) for i in range(len(brackets))]
            #: (rows before at least, aggregates) of every run of rows between brackets
            self.between = [(sum(sizes[:i]), parts[i]) for i in range(0, len(sizes), 2) if i in parts]
            ranks = [r for r in ranks_of(self.n) if 1 <= r <= self.n]
            if all(any(b < r <= b + k for b, k in zip(self.below, self.inside)) for r in ranks) or slack >= 1:
                return
            slack *= 4      # few rows, or the sketch was off

    def _within(self):
        out = F.lit(False)
        for lo, hi in self.brackets:
            out = out | self.by.between(F.lit(lo), F.lit(hi))
        return out

    def outside(self) -> DataFrame:
        """Rows in no bracket, with ``before``: how many rows lie in or below the brackets under them, at least."""
        before = F.lit(0)
        for (lo, hi), b, k in zip(self.brackets, self.below, self.inside):
            before = F.when(self.by > F.lit(hi), F.lit(b + k)).otherwise(before)
        return self.df.filter(~self._within()).withColumn("before", before.cast("long"))

    def numbered(self) -> DataFrame:
        """Rows in a bracket, with their row_number in the whole order."""
        rows = global_row_number(materialize(self.df.filter(self._within()), "near-ranks"), self.order).drop("n_rows")
        skipped, seen = F.lit(0), 0
        for b, k in zip(self.below, self.inside):
            skipped = F.when(F.col("row_number") > seen, F.lit(b - seen)).otherwise(skipped)
            seen += k
        return rows.withColumn("row_number", F.col("row_number") + skipped)


def bin_ends(n: int, k: int) -> list[int]:
    """Last row number of each NTILE(k) bin but the last."""
    q, r = divmod(n, k)
    return [i * q + min(i, r) for i in range(1, k)]


def _bin_of(number, ends: list[int]) -> Column:
    return sum((F.when(number > end, 1).otherwise(0) for end in ends), F.lit(1)).cast("int")


def ntile(df: DataFrame, order: list[str], k: int, name: str = "bin") -> DataFrame:
    """Quantile bin of every row (W5): rows away from the bins' ends by value, the others by number."""
    near = RankRanges(df, order, [i / k for i in range(1, k)], lambda n: [r + d for r in bin_ends(n, k) for d in (0, 1)])
    ends = bin_ends(near.n, k)
    out = near.outside().withColumn(name, _bin_of(F.col("before") + 1, ends)).drop("before")
    if not near.brackets:
        return out
    return out.unionByName(near.numbered().withColumn(name, _bin_of(F.col("row_number"), ends)).drop("row_number"))


def df_of_runs(like: DataFrame, runs: list[tuple]) -> DataFrame:
    """The aggregates of runs of rows, with their bin: at most one row a run."""
    names = like.columns[1:]
    return like.sparkSession.createDataFrame([(bin_, *[r[c] for c in names]) for bin_, r in runs], like.schema)


def markup_bins(tx: DataFrame, k: int = 5) -> DataFrame:
    """Profit and units per markup quantile bin with each bin's limits.

    Limits are the (i/k)-quantiles of markup (linear interpolation); bins are NTILE(k).
    Rows without a markup (no cost) are left out, as the original leaves them unbinned.
    The fact is neither sorted nor written: it is aggregated per range, and only rows near a bin's end are numbered.
    """
    base = tx.select(C.markup().alias("markup"), "profit", "quantity_filled", "transaction_id",
                     "sku", "store_id", "sale_date").filter(F.col("markup").isNotNull())
    order = ["markup", "profit", "quantity_filled", "transaction_id", "sku", "store_id", "sale_date"]

    def needed(n):
        places = [(n - 1) * i / k + 1 for i in range(1, k)]
        return [r + d for r in bin_ends(n, k) for d in (0, 1)] + [math.floor(h) + d for h in places for d in (0, 1)]

    sums = [F.sum("profit").alias("total_profit"), F.sum("quantity_filled").alias("total_quantity"), F.min("markup").alias("lo"), F.max("markup").alias("hi")]
    near = RankRanges(base, order, [i / k for i in range(1, k)], needed, sums)
    if not near.n:
        return base.select(F.lit(1).alias("bin"), F.col("profit").alias("total_profit"), F.col("quantity_filled").alias("total_quantity"),
                           F.col("markup").alias("lower_limit"), F.col("markup").alias("upper_limit")).limit(0)
    ends = bin_ends(near.n, k)
    numbered = materialize(near.numbered().select("markup", "profit", "quantity_filled", "row_number"), "near-bin-ends")
    close = numbered.withColumn("bin", _bin_of(F.col("row_number"), ends)).groupBy("bin").agg(*sums)
    far = df_of_runs(close, [(1 + sum(before >= end for end in ends), r) for before, r in near.between])
    totals = close.unionByName(far).groupBy("bin").agg(F.sum("total_profit").alias("total_profit"), F.sum("total_quantity").alias("total_quantity"),
                                                       F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    places = {i: (near.n - 1) * i / k + 1 for i in range(1, k)}
    wanted = sorted({math.floor(h) + d for h in places.values() for d in (0, 1) if math.floor(h) + d <= near.n})
    at = {r["row_number"]: r["markup"] for r in numbered.filter(F.col("row_number").isin(wanted)).collect()}    # two rows a limit
    limits = {}
    for i, h in places.items():
        lo = math.floor(h)
        limits[i] = at[lo] if h == lo else at[lo] + (h - lo) * (at[lo + 1] - at[lo])
    lower, upper = F.min("lo").over(Window.partitionBy(F.lit(0))), F.max("hi").over(Window.partitionBy(F.lit(0)))     # over k rows
    for i, value in limits.items():
        lower = F.when(F.col("bin") == i + 1, F.lit(value)).otherwise(lower)
        upper = F.when(F.col("bin") == i, F.lit(value)).otherwise(upper)
    return totals.select("bin", "total_profit", "total_quantity", lower.alias("lower_limit"), upper.alias("upper_limit"))


def rollup_tree(df: DataFrame, parent: str, child: str, measure: str, root: str = "Total") -> DataFrame:
    """Leaf, parent and root totals in one grouping-sets pass, as (label, parent, value, level)."""
    r = df.rollup(parent, child).agg(F.sum(measure).alias("value"), F.grouping_id().alias("level"))
    return r.select(
        F.when(F.col("level") == 0, F.col(child)).when(F.col("level") == 1, F.col(parent))
        .otherwise(F.lit(root)).alias("label"),
        F.when(F.col("level") == 0, F.col(parent)).when(F.col("level") == 1, F.lit(root))
        .otherwise(F.lit("")).alias("parent"),
        "value", "level")


def share_of_total(totals: DataFrame, flag: Column, measure: str) -> DataFrame:
    """Percent of the grand total inside / outside a chosen set (A22).  ``totals`` is
    already aggregated (one row per member), so the whole-table window is over a few rows."""
    by_flag = totals.groupBy(flag.alias("in_set")).agg(F.sum(measure).alias("total"))
    return by_flag.withColumn("pct", 100 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0))))


def product_kpis(tx: DataFrame) -> DataFrame:
    """Units, profit and mean price per product."""
    return tx.groupBy("product_name", "category").agg(
        F.sum("quantity_filled").alias("quantity"),
        F.sum("profit").alias("profit"),
        C.stable_mean("price").alias("price_mean"))


def group_totals_on_rows(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Each row with its group's totals repeated.

    Not ``sum() over (partition by key)``: that puts a whole group in one task, and
    one key may hold a large share of the rows.  The totals are a partial + final
    aggregate (map-side combine), joined back on the key.  AQE sees the totals'
    measured shuffle size and broadcasts them when small; otherwise it stays a
    shuffle join whose hot partitions AQE's skew-join handling splits.  (A count
    to prove the bound up front would compute the aggregate twice.)
    """
    totals = df.groupBy(key).agg(*[F.sum(m).alias(f"{m}_group") for m in measures])
    return df.join(totals, key, "left")
