"""Demand models with Spark MLlib.

Feature handling is RFormula (strings one-hot encoded, unseen levels kept), so a
model trained on history scores new ids without failing.  Splits and folds come
from a hash of the row key, so they are the same on every recomputation (a
random column would change when a lost partition is recomputed).
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline as MLPipeline
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GBTRegressionModel, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.functions.columns import hash_bucket
from pricewise.operators import trees as sparse
from pricewise.operators.trees import fit_forest, pack
from pricewise.session import materialize, ship_package

# The reference model's features and settings (fixed values).
DEMAND_FEATURES = ["price_", "subgroup", "store_type", "region", "store_id", "mes", "dia", "anio",
                   "category", "group_name", "brand"]
# Units models: SKU and store are as many as the business has, so they enter as means of the
# label (one column), not as one column each.
UNITS_LOW = ["category", "group_name", "brand", "region"]
ITEM = ["store_id", "sku"]
SMOOTHING = 10.0
# MLlib's tree learners keep every row as an array of all its columns, one-hot ones too: cells (of 4 bytes) a partition.
TREE_CELLS = 10_000_000


def formula(label: str, features: list[str]) -> str:
    """Feature list -> R-style formula (M2)."""
    return f"{label} ~ {' + '.join(features)}"


def featurizer(label: str, features: list[str]) -> RFormula:
    """One-hot strings, pass numerics, keep unseen levels (M1)."""
    return RFormula(formula=formula(label, features), featuresCol="features", labelCol="label",
                    handleInvalid="keep")


def random_forest(label: str, features: list[str], num_trees: int = 20, min_instances: int = 9,
                  max_depth: int = 5, max_bins: int = 40, seed: int = 250) -> MLPipeline:
    """Random-forest regressor, as configured in the original (M3)."""
    rf = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins,
                               minInstancesPerNode=min_instances, subsamplingRate=0.8,
                               featureSubsetStrategy="onethird", seed=seed)
    return MLPipeline(stages=[featurizer(label, features), rf])


def boosted_trees(label: str, features: list[str], max_iter: int = 20, step_size: float = 0.1,
                  subsample: float = 1.0, seed: int = 300) -> MLPipeline:
    """Gradient-boosted trees (M4 demand: 20 x 0.1; M5 units: 9 x 0.5, subsample 0.8)."""
    gbt = sparse.SparseBoosted(maxIter=max_iter, stepSize=step_size, subsamplingRate=subsample, seed=seed)
    return MLPipeline(stages=[featurizer(label, features), gbt])


def dealt(rows: DataFrame, cells: int = TREE_CELLS) -> DataFrame:
    """Vectors for a tree learner, dealt out evenly if they have more than ``cells`` rows x columns: as the files are
    split, a partition has as many rows as fit 128 MB of parquet, and a task reads back all their arrays at every step."""
    size = rows.count() * rows.schema["features"].metadata["ml_attr"]["num_attrs"]
    if size <= cells:
        return rows
    return rows.select("features", "label").repartition(max(math.ceil(size / cells), rows.sparkSession.sparkContext.defaultParallelism))


def fit_trees(trees: MLPipeline, train: DataFrame) -> PipelineModel:
    """Fits a featurizer and its tree learner, which gets the vectors in partitions of bounded size (``dealt``; the
    sparse learners deal out their rows themselves)."""
    features, learner = trees.getStages()
    fitted = features.fit(train)
    rows = fitted.transform(train)
    return PipelineModel([fitted, learner.fit(rows if isinstance(learner, sparse.SparseBoosted) else dealt(rows))])


def poisson_glm(label: str, features: list[str], offset: str | None = None) -> MLPipeline:
    """Poisson regression with log link (M6); ``offset`` is a column added to the linear part."""
    glm = GeneralizedLinearRegression(family="poisson", link="log", maxIter=25, regParam=1e-6)
    if offset:
        glm = glm.setOffsetCol(offset)
    return MLPipeline(stages=[featurizer(label, features), glm])


class UnitsEncoder:
    """Store, SKU and item (store x SKU) as smoothed mean units.

    ``train`` gives the training rows out-of-fold means: a row sees the labels of the other folds only, so
    its own label never stands in its features.  Calling the encoder gives any other rows the means of all folds."""

    def __init__(self, train: DataFrame, label: str = "quantity", fold: str = "fold", smoothing: float = SMOOTHING,
                 means: list[str] | None = None):
        """``means``: those of ``UNITS_MEANS`` that are wanted, all if not given."""
        self.label, self.fold, self.smoothing = label, fold, smoothing
        self.means = means or UNITS_MEANS
        # one row a fold: a handful
        folds = train.groupBy(fold).agg(F.sum(label).alias("s"), F.count(label).alias("n")).collect()
        s, n = sum(r["s"] or 0.0 for r in folds), sum(r["n"] for r in folds)
        self.overall = s / n if n else 0.0
        self.others = {r[fold]: (s - (r["s"] or 0.0)) / (n - r["n"]) if n > r["n"] else self.overall for r in folds}
        self.sums = {}
        for out, keys in (("store_units", ["store_id"]), ("sku_units", ["sku"]), ("item_units", ITEM)):
            if out in self.means:
                # The items are nearly as many as the rows: their sums are not written, and only made where they are joined.
                by = keys if keys == ITEM else [*keys, fold]
                sums = train.groupBy(*by).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
                self.sums[out] = (keys, sums if keys == ITEM else materialize(sums, out))

    def _mean(self, prior):
        return (F.coalesce("_s", F.lit(0.0)) + prior * self.smoothing) / (F.coalesce("_n", F.lit(0)) + self.smoothing)

    def _logs(self, df: DataFrame) -> DataFrame:
        if "item_units" not in self.means:
            return df
        return df.withColumn("log_item_units", F.ln(F.greatest("item_units", F.lit(1e-6))))

    def __call__(self, df: DataFrame) -> DataFrame:
        for out, (keys, sums) in self.sums.items():
            total = sums.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
            df = df.join(total, keys, "left").withColumn(out, self._mean(F.lit(self.overall))).drop("_s", "_n")
        return self._logs(df)

    def train(self, df: DataFrame) -> DataFrame:
        """The training rows with the means of the folds that are not theirs.  The means of items come from windows (an item's
        rows are bounded by the calendar): one shuffle by item, no table of sums."""
        prior = F.lit(self.overall)
        for fold, value in self.others.items():
            prior = F.when(F.col(self.fold) == F.lit(fold), F.lit(value)).otherwise(prior)
        for out, (keys, sums) in self.sums.items():
            if keys == ITEM:
                known = F.lit(True)
                for k in keys:
                    known = known & F.col(k).isNotNull()         # a null key has no sums
                item, own = Window.partitionBy(*keys), Window.partitionBy(*keys, self.fold)
                left = lambda f: F.when(known, f(self.label).over(item) - f(self.label).over(own))
                df = df.withColumns({"_s": left(F.sum), "_n": left(F.count)}).withColumn(out, self._mean(prior)).drop("_s", "_n")
                continue
            total = sums.groupBy(*keys).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
            other = sums.join(total, keys).select(*keys, self.fold, (F.col("_ts") - F.col("_s")).alias("_s"), (F.col("_tn") - F.col("_n")).alias("_n"))
            df = df.join(other, [*keys, self.fold], "left").withColumn(out, self._mean(prior)).drop("_s", "_n")
        return self._logs(df)


UNITS_MEANS = ["store_units", "sku_units", "item_units"]


def predict(model, df: DataFrame) -> DataFrame:
    """Score a table (M7)."""
    return model.transform(df)


def predict_points(fitted: PipelineModel, items: DataFrame, price: str = "price", points: str = "price_sim") -> DataFrame:
    """``predict`` at every price of the array ``points``, as the array ``prediction`` in the item's row (M7).

    The item's other features are made once; only the price changes from point to point."""
    featurize, learner = fitted.stages
    rows = featurize.transform(items.withColumn(price, F.get(points, F.lit(0))))
    at = next(a["idx"] for a in rows.schema["features"].metadata["ml_attr"]["attrs"]["numeric"] if a["name"] == price)
    ship_package(items.sparkSession)
    if isinstance(learner, GBTRegressionModel):
        score = sparse.points_scorer(sparse.nodes_of(learner), list(learner.treeWeights), at)
        return rows.withColumn("prediction", F.arrow_udf(score, "array<double>")("features", points)).drop("features", price)
    score = sparse.log_linear_scorer(learner.coefficients.toArray(), learner.intercept, at)
    offset = F.col(learner.getOffsetCol()) if learner.isSet(learner.offsetCol) else F.lit(0.0)
    return rows.withColumn("prediction", F.arrow_udf(score, "array<double>")("features", points, offset)).drop("features", price)


def r2(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """R squared of predictions (M8)."""
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName="r2").evaluate(pred)


def r2_frame(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """R squared as a one-row DataFrame: 1 - SSE / SST (M8, SQL form)."""
    mean = pred.agg(F.avg(label)).scalar()
    return pred.agg((1 - F.sum((F.col(label) - F.col(prediction)) ** 2)
                     / F.sum((F.col(label) - mean) ** 2)).alias("r2"))


def split_flag(key, train_pct: int = 85) -> F.Column:
    """Train / test by hash bucket of the key (M9)."""
    return F.when(hash_bucket(key, 100) < train_pct, "train").otherwise("test")


def fold_id(key, k: int = 4) -> F.Column:
    """Fold 1..k by hash bucket of the key."""
    return (hash_bucket(key, k) + 1).cast("int")


def vectors(df: DataFrame, label: str, features: list[str], keep: list[str], fit_on: DataFrame | None = None):
    """(fitted featurizer, ``keep`` + features + label written once) for all models of one job (M1)."""
    fitted = featurizer(label, features).fit(df if fit_on is None else fit_on)
    return fitted, materialize(fitted.transform(df).select(*keep, "features", "label"), "vectors")


def forest(num_trees: int, min_instances: int, seed: int = 250) -> sparse.SparseForest:
    """The reference's forest on written vectors (M3)."""
    return sparse.SparseForest(numTrees=num_trees, maxDepth=5, maxBins=40, minInstancesPerNode=min_instances, subsamplingRate=0.8,
                              featureSubsetStrategy="onethird", seed=seed, maxMemoryInMB=512, cacheNodeIds=False)


def demand_gbt(max_iter: int = 20, step_size: float = 0.1, seed: int = 300) -> sparse.SparseBoosted:
    """The reference's boosted trees on written vectors (M4)."""
    return sparse.SparseBoosted(maxIter=max_iter, stepSize=step_size, seed=seed, maxMemoryInMB=512)


def cross_validate(data: DataFrame, grid: list[dict], fold_col: str = "fold", k: int = 4, parallelism: int = 2) -> DataFrame:
    """k-fold CV of a random forest over a parameter grid on written vectors; mean R^2 per point.

    ``CrossValidator`` needs a 0-based integer fold column.
    """
    rf = forest(20, 9)
    maps = [{rf.numTrees: g["num_trees"], rf.minInstancesPerNode: g["min_instances"]} for g in grid]
    cv = CrossValidator(estimator=rf, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="r2"),
                        foldCol="_fold", numFolds=k, parallelism=parallelism, collectSubModels=False)
    fitted = cv.fit(data.withColumn("_fold", (F.col(fold_col) - 1).cast("int")))
    rows = [(int(m[rf.numTrees]), int(m[rf.minInstancesPerNode]), float(s), float(sd))
            for m, s, sd in zip(maps, fitted.avgMetrics, fitted.stdMetrics)]
    return data.sparkSession.createDataFrame(rows, "num_trees int, min_instances int, r2_mean double, r2_sd double")


def r2_of(df: DataFrame, predictions: dict[str, object], label: str = "label") -> dict[str, float]:
    """R squared of several prediction columns in one pass over the rows."""
    mean = df.agg(F.avg(label)).scalar()
    d = df.withColumn("_mean", mean)
    sums = d.agg(F.sum((F.col(label) - F.col("_mean")) ** 2).alias("_sst"), *[F.sum((F.col(label) - c) ** 2).alias(n) for n, c in predictions.items()]).first()
    return {n: 1.0 - sums[n] / sums["_sst"] for n in predictions}


def search_forest(train: DataFrame, validation: DataFrame, trees: tuple[int, ...] = (70, 148, 225),
                  min_instances: tuple[int, ...] = (5, 6, 7, 8, 9, 10), keep: tuple[int, ...] = (6, 3, 1),
                  least_gain: float = 1e-4, seed: int = 91) -> list[dict]:
    """Successive halving over tree counts (M12): every leaf size starts with the fewest trees, the best
    ones grow to the next count, and the search stops when the best does not gain ``least_gain``.

    A forest's prediction is the mean of its trees', so a candidate grows by a forest of the missing
    trees only, with a seed of its own; nothing already trained is trained again.  Points are scored
    by R squared on ``validation``, all candidates of a rung in one pass.  Both tables hold written vectors.
    """
    packed = pack(train, forest(1, 1, seed))         # once for all candidates
    alive = {m: [] for m in min_instances[: keep[0]]}      # leaf size -> [(trees, model)]
    points, best = [], None
    for rung, count in enumerate(trees):
        for m, parts in alive.items():
            missing = count - sum(n for n, _ in parts)
            parts.append((missing, fit_forest(forest(missing, m, seed + 1000 * rung + m), packed)))
        scored, columns = validation, {}
        for m, parts in alive.items():
            names = []
            for i, (n, fitted) in enumerate(parts):
                names.append((n, f"_p{m}_{i}"))
                scored = fitted.copy({fitted.predictionCol: names[-1][1]}).transform(scored)
            columns[str(m)] = sum((F.col(c) * n for n, c in names[1:]), F.col(names[0][1]) * names[0][0]) / count
        r2s = r2_of(scored, columns)
        order = sorted(alive, key=lambda m: (-r2s[str(m)], m))
        last = best
        best = max([(r2s[str(m)], -count, -m) for m in alive] + ([best] if best else []))
        going = rung + 1 < len(trees) and (last is None or best[0] - last[0] >= least_gain)
        survivors = order[: keep[rung + 1]] if going else []
        points += [{"rung": rung, "num_trees": count, "min_instances": m, "r2": r2s[str(m)], "grown": m in survivors} for m in order]
        alive = {m: alive[m] for m in survivors}
        if not alive:
            break
    for p in points:
        p["chosen"] = (p["r2"], -p["num_trees"], -p["min_instances"]) == best
    return points
