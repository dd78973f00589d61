"""Target-encoded units models, the cross-validation grid, scans and joins as planned."""

import random

import pytest
from pyspark.sql import functions as F

from pricewise.operators import model
from tests.conftest import SF_SMALL


def _items(spark, n=600):
    rng = random.Random(1)
    data = []
    for i in range(n):
        store, sku = f"S{i % 5}", f"P{i % 40}"
        price = rng.uniform(1, 5)
        units = (i % 40 + 1) * 2.0 / price + rng.uniform(0, 0.2)
        data.append((store, sku, f"c{i % 3}", "g", "b", "r", price, units))
    return spark.createDataFrame(data, "store_id string, sku string, category string, group_name string, brand string, region string, price double, quantity double")


def test_means_are_smoothed_and_leave_the_own_fold_out(spark):
    rows = [("S", "a", 1, 10.0), ("S", "a", 2, 4.0)] + [("S", "b", 1 + i % 2, 2.0) for i in range(90)]
    df = spark.createDataFrame(rows, "store_id string, sku string, fold int, quantity double")
    encoder = model.UnitsEncoder(df)
    got = {r.sku: r.sku_units for r in encoder(df).collect()}
    prior = 194 / 92
    assert got["a"] == pytest.approx((14 + 10 * prior) / 12) and got["b"] == pytest.approx((180 + 10 * prior) / 100)
    own = {(r.sku, r.fold): r.sku_units for r in encoder.train(df).collect()}
    first, second = 100 / 46, 94 / 46
    assert own["a", 1] == pytest.approx((4 + 10 * second) / 11) and own["a", 2] == pytest.approx((10 + 10 * first) / 11)
    # another label of the row changes nothing in its own features
    other = df.withColumn("quantity", F.when((F.col("sku") == "a") & (F.col("fold") == 1), 1e6).otherwise(F.col("quantity")))
    again = {(r.sku, r.fold): r.sku_units for r in model.UnitsEncoder(other).train(other).collect()}
    assert again["a", 1] == own["a", 1] and again["a", 2] != own["a", 2]


def test_units_models_explain_a_known_signal_with_any_number_of_skus(spark):
    items = _items(spark).withColumn("fold", F.pmod(F.xxhash64("price"), F.lit(4)))
    encoder = model.UnitsEncoder(items)
    data = encoder.train(items)
    gbt = model.boosted_trees("quantity", ["price", *model.UNITS_MEANS, *model.UNITS_LOW], max_iter=9, step_size=0.5, subsample=0.8).fit(data)
    assert model.r2(model.predict(gbt, data), "quantity") > 0.7
    glm = model.poisson_glm("quantity", ["price", "category"], offset="log_item_units").fit(data)
    assert model.r2(model.predict(glm, data), "quantity") > 0.7
    new = encoder(items.limit(1).withColumn("sku", F.lit("unseen")))
    assert new.filter("item_units IS NULL").count() == 0 and model.predict(gbt, new).count() == 1


def test_cross_validation_runs_the_points_it_is_given(spark):
    data = _items(spark, 120).withColumn("fold", (F.crc32("sku") % 2 + 1).cast("int"))
    grid = [{"num_trees": 2, "min_instances": 5}, {"num_trees": 3, "min_instances": 9}]
    _, data = model.vectors(data, "quantity", ["price", "category"], ["fold"])
    got = model.cross_validate(data, grid, k=2)
    assert sorted((r.num_trees, r.min_instances) for r in got.collect()) == [(2, 5), (3, 9)]


def test_scans_read_only_their_columns_and_joins_carry_no_hint(spark):
    from pricewise.plans.registry import QUERIES
    plan = QUERIES["s3_parquet_scan_pruned"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan.split("Relation")[0] and "Repartition" not in plan
    plan = QUERIES["a1_daily_demand"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_search_halves_grows_and_names_the_best(spark):
    _, data = model.vectors(_items(spark), "quantity", ["price", "category"], ["sku"])
    train, held = data.filter("sku < 'P3'"), data.filter("sku >= 'P3'")
    points = model.search_forest(train, held, trees=(2, 4, 8), min_instances=(1, 2, 50), keep=(3, 2, 1), least_gain=-9.0)
    assert [(p["rung"], p["num_trees"]) for p in points] == [(0, 2)] * 3 + [(1, 4)] * 2 + [(2, 8)]
    assert sum(p["chosen"] for p in points) == 1 and max(points, key=lambda p: p["r2"])["chosen"]
    assert {p["min_instances"] for p in points if p["rung"] == 1} == {p["min_instances"] for p in points if p["rung"] == 0 and p["grown"]}
    short = model.search_forest(train, held, trees=(2, 4, 8), min_instances=(1, 2, 50), keep=(3, 2, 1), least_gain=9.0)
    assert max(p["rung"] for p in short) == 1       # no gain: no third rung
    again = model.search_forest(train, held, trees=(2,), min_instances=(1, 2, 50), keep=(3,))
    assert [p["r2"] for p in again] == pytest.approx([p["r2"] for p in points[:3]])


def test_strategies_share_the_written_vectors(spark):
    """One row a strategy, and the fact tables are not read again once the history is written."""
    from pricewise.plans import q_model
    from pricewise.plans.registry import Pipeline
    history, holdout = q_model._strategy_frame(Pipeline(spark, SF_SMALL))
    for df in (history, holdout):
        assert "lineitem" not in " ".join(df.inputFiles())
    rows = q_model.compare_strategies(history, holdout, trees=5, instances=9)
    assert [r[0] for r in rows] == ["random_forest_weekly_price", "random_forest_daily_price", "boosted_trees_weekly_price"]
    assert len({r[1] for r in rows}) == 1 and all(r[3] >= r[4] > 0 for r in rows)


def test_trees_get_partitions_of_bounded_size(spark):
    """Rows of one big partition are dealt out by rows x columns; few rows stay as they are; the model is the same."""
    data = _items(spark).coalesce(1)
    trees = model.boosted_trees("quantity", ["price", "category"], max_iter=2)
    rows = trees.getStages()[0].fit(data).transform(data).select("features", "label")
    columns = rows.first()["features"].size
    held = model.dealt(rows, cells=100 * columns).rdd.glom().map(len).collect()
    assert sum(held) == 600 and max(held) <= 150 and len(held) >= 6
    assert model.dealt(rows).rdd.getNumPartitions() == 1
    got = model.predict(model.fit_trees(trees, data), data).select("sku", "price", "prediction").collect()
    assert got == model.predict(trees.fit(data), data).select("sku", "price", "prediction").collect()
