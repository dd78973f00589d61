"""Queries for the price optimiser (M13-M15, W1, T4), MLlib models (M1-M12, M17) and
the demand-forecast assembly (J12-J15, P16, P20, U1, M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewise.functions import columns as C
from pricewise.operators import assemble, demand, kpi, model, optimise, panel
from pricewise.plans import q_series
from pricewise.plans.oracle import with_fixtures as W
from pricewise.plans.registry import Pipeline, register
from pricewise.session import materialize
from pricewise.sources.fixtures import HORIZON_DAYS, PROXY_DONOR, PROXY_TARGET

ITEM_ATTRS = ["store_id", "sku", "category", "group_name", "brand", "region"]
OPT_KEEP = ITEM_ATTRS + ["price_sim", "prediction", "profit"]

# ----------------------------------------------------------------------------- optimiser

OPT_SQL = """
with curve as (select category, round(regr_slope(ln(quantity), ln(price)), 10) as elasticity,
                      round(regr_intercept(ln(quantity), ln(price)), 10) as log_scale
               from item_day where quantity > 0 and price > 0 group by category),
grid as (select r.*, s.step, r.min_price + s.step * (r.max_price - r.min_price) / 24 as price_sim
         from item_range r, (select unnest(range(0, 25)) as step) s),
scored as (select g.*, exp(c.log_scale + c.elasticity * ln(g.price_sim)) as prediction
           from grid g left join curve c on g.category = c.category),
prof as (select *, (price_sim - costos) * prediction as profit from scored),
best as (select *, rank() over (partition by store_id, sku order by profit desc) as r from prof),
opt as (select distinct store_id, sku, category, group_name, brand, region, price_sim,
               round(prediction, 8) as prediction, round(profit, 4) as profit from best where r = 1)"""


def _optimal(spark, sf):
    p = Pipeline(spark, sf)
    curve = optimise.log_linear_demand(p.item_day_written)
    best = optimise.optimal_prices_closed_form(p.item_range_written, curve).select(*OPT_KEEP)
    return best.withColumns({"prediction": F.round("prediction", 8), "profit": F.round("profit", 4)})


@register("m13_price_grid", W("""
select store_id, sku, count(*) as n_points, min(price_sim) as lo, max(price_sim) as hi
from (select r.*, r.min_price + s.step * (r.max_price - r.min_price) / 24 as price_sim
      from item_range r, (select unnest(range(0, 25)) as step) s) group by store_id, sku"""))
def m13(spark, sf):
    grid = optimise.price_grid(Pipeline(spark, sf).item_range)
    return grid.groupBy("store_id", "sku").agg(F.count(F.lit(1)).alias("n_points"),
                                               F.min("price_sim").alias("lo"), F.max("price_sim").alias("hi"))


@register("m14_demand_curve", W("""
select category, round(regr_slope(ln(quantity), ln(price)), 10) as elasticity,
       round(regr_intercept(ln(quantity), ln(price)), 10) as log_scale
from item_day where quantity > 0 and price > 0 group by category"""))
def m14(spark, sf):
    return optimise.log_linear_demand(Pipeline(spark, sf).item_day)


@register("m15_w1_optimal_price", W(OPT_SQL + " select * from opt"))
def m15(spark, sf):
    return _optimal(spark, sf)


@register("t4_top1000_optimal_prices", W(OPT_SQL + """
select store_id, sku, category, group_name, brand, region, price_sim from
(select *, rank() over (order by price_sim desc) as rr from opt) where rr <= 1000"""))
def t4(spark, sf):
    return kpi.top_k_with_ties(_optimal(spark, sf), "price_sim", 1000).select(*ITEM_ATTRS, "price_sim")


def _units_items(p: Pipeline):
    """Item days with units as doubles and the fold of their row."""
    key = F.concat_ws("|", "store_id", "sku", F.col("sale_date").cast("string"))
    return p.item_day_written.withColumns({"quantity": F.col("quantity").cast("double"), "fold": model.fold_id(key, 5)})


def _training(encoder, items):
    """The training rows' columns that a model reads."""
    made = [*encoder.means, *(["log_item_units"] if "item_units" in encoder.means else [])]
    return encoder.train(items.select("store_id", "sku", "fold", "quantity", "price", *model.UNITS_LOW)).select("quantity", "price", *model.UNITS_LOW, *made)


def _units_model_optimum(spark, sf, fit, means=model.UNITS_MEANS):
    """The price grid scored by a units model, best row of every item.  The item's ``means`` and features are made once, the
    grid is an array in the item's row, and the ranges are spread by item, so no step makes or moves the grid's rows."""
    p = Pipeline(spark, sf)
    items = _units_items(p)
    encoder = model.UnitsEncoder(items, means=means)
    fitted = fit(materialize(_training(encoder, items), "units-train"))
    columns = p.item_range_written.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = encoder(p.item_range_written).repartition(parts, *optimise.ITEM)
    grid = optimise.price_points(ranges)
    return p, optimise.best_of_points(model.predict_points(fitted, grid), columns, OPT_KEEP)


def _fit_glm(train):
    return model.poisson_glm("quantity", ["price", *model.UNITS_LOW], offset="log_item_units").fit(train)


def _fit_units_gbt(train):
    trees = model.boosted_trees("quantity", ["price", *model.UNITS_MEANS, *model.UNITS_LOW], max_iter=9,
                                step_size=0.5, subsample=0.8)
    return model.fit_trees(trees, train)


@register("m6_poisson_glm_optimal_price")
def m6(spark, sf):
    """Poisson GLM of units (offset: the item's smoothed mean units) scores the grid."""
    return _units_model_optimum(spark, sf, _fit_glm, ["item_units"])[1]


@register("m5_gbt_units_optimal_price")
def m5(spark, sf):
    """Boosted trees (9 x 0.5, subsample 0.8) of units score the grid."""
    return _units_model_optimum(spark, sf, _fit_units_gbt)[1]


OPTIMUM_CHECK_SQL = W("select count(*) as n_items, 0 as n_outside from item_range")


def _optimum_check(spark, sf, fit, means=model.UNITS_MEANS):
    """Every item once, its price inside its own range."""
    p, best = _units_model_optimum(spark, sf, fit, means)
    ranges = p.item_range_written.select("store_id", "sku", "min_price", "max_price")
    one = best.groupBy("store_id", "sku").agg(F.count(F.lit(1)).alias("n"), F.min("price_sim").alias("lo"), F.max("price_sim").alias("hi"))
    j = one.join(ranges, ["store_id", "sku"], "full")
    return j.agg(F.count_if(F.col("n") >= 1).alias("n_items"),
                 F.count_if((F.col("lo") < F.col("min_price") - 1e-9) | (F.col("hi") > F.col("max_price") + 1e-9)
                            | F.col("min_price").isNull() | F.col("n").isNull()).cast("int").alias("n_outside"))


@register("m6_optimum_covers_items_in_range", OPTIMUM_CHECK_SQL)
def m6_check(spark, sf):
    return _optimum_check(spark, sf, _fit_glm, ["item_units"])


@register("m5_optimum_covers_items_in_range", OPTIMUM_CHECK_SQL)
def m5_check(spark, sf):
    return _optimum_check(spark, sf, _fit_units_gbt)


@register("m5_m6_units_holdout", W("""
select m.model, true as beats_mean from (select unnest(['boosted_trees', 'poisson']) as model) m order by 1"""))
def m56_holdout(spark, sf):
    """Both units models, fitted on four folds with out-of-fold means, explain more of the fifth than its mean."""
    items = _units_items(Pipeline(spark, sf))
    train, held = items.filter("fold <= 4"), items.filter("fold = 5")
    encoder = model.UnitsEncoder(train)
    rows, scored = materialize(_training(encoder, train), "units-train"), materialize(encoder(held).select("quantity", "price", *model.UNITS_LOW, *encoder.means, "log_item_units"), "units-held")
    out = [(name, bool(model.r2_of(model.predict(fit(rows), scored), {"r2": F.col("prediction")}, "quantity")["r2"] > 0))
           for name, fit in (("boosted_trees", _fit_units_gbt), ("poisson", _fit_glm))]
    return spark.createDataFrame(out, "model string, beats_mean boolean")


# ----------------------------------------------------------------------------- demand models

SPLIT_SQL = "case when ('0x' || substr(md5(store_subgroup_date_id), 1, 8))::bigint % 100 < 85 then 'train' else 'test' end"
FOLD_SQL = "cast(('0x' || substr(md5(store_subgroup_date_id), 1, 8))::bigint % 4 + 1 as int)"


def _with_split(p: Pipeline, daily=None):
    return (p.daily_written if daily is None else daily).withColumns({"split": model.split_flag("store_subgroup_date_id"),
                                        "fold": model.fold_id("store_subgroup_date_id")})


@register("m9_train_test_split", W(f"select store_subgroup_date_id, {SPLIT_SQL} as split from daily"))
def m9(spark, sf):
    p = Pipeline(spark, sf)
    return _with_split(p, p.daily).select("store_subgroup_date_id", "split")


@register("m10_fold_ids", W(f"select store_subgroup_date_id, {FOLD_SQL} as fold from daily"))
def m10(spark, sf):
    p = Pipeline(spark, sf)
    return _with_split(p, p.daily).select("store_subgroup_date_id", "fold")


@register("m8_r2_subgroup_mean_baseline", W(f"""
with d as (select *, {SPLIT_SQL} as split from daily),
m as (select subgroup, round(sum(total_sales_), 8) / count(*) as prediction from d where split = 'train' group by subgroup),
t as (select d.total_sales_ as y, m.prediction from d join m on d.subgroup = m.subgroup where split = 'test')
select round(1 - sum((y - prediction) * (y - prediction)) / sum((y - (select avg(y) from t)) * (y - (select avg(y) from t))), 6)
       as r2 from t"""))
def m8(spark, sf):
    d = _with_split(Pipeline(spark, sf))
    means = d.filter(F.col("split") == "train").groupBy("subgroup").agg(
        C.stable_mean("total_sales_").alias("prediction"))
    test = d.filter(F.col("split") == "test").join(means, "subgroup").select(
        F.col("total_sales_").alias("y"), "prediction")
    mean = test.agg(F.avg("y")).scalar()
    err = F.col("y") - F.col("prediction")
    dev = F.col("y") - mean
    return test.agg(F.round(1 - F.sum(err * err) / F.sum(dev * dev), 6).alias("r2"))


class DemandVectors:
    """The daily table's vectors, featurized and written once for every model of a query (M1)."""

    def __init__(self, p: Pipeline):
        self.daily = _with_split(p)
        keep = ["store_subgroup_date_id", "total_sales_", "split", "fold"]
        self.featurizer, self.all = model.vectors(self.daily, "total_sales_", model.DEMAND_FEATURES, keep, self.daily.filter("split = 'train'"))
        self.train, self.test = self.all.filter("split = 'train'"), self.all.filter("split = 'test'")


def _fit_eval(spark, sf, estimator):
    v = DemandVectors(Pipeline(spark, sf))
    fitted = estimator.fit(v.train)
    return fitted, model.predict(fitted, v.test)


@register("m1_m3_m7_random_forest_demand")
def m3(spark, sf):
    """RFormula + random forest on the train split, predictions on the test split (rows-only)."""
    _, pred = _fit_eval(spark, sf, model.forest(20, 9))
    return pred.select("store_subgroup_date_id", "total_sales_", "prediction")


@register("m2_m4_gbt_demand")
def m4(spark, sf):
    """Gradient-boosted trees (20 x 0.1, seed 300) from a feature list (rows-only)."""
    _, pred = _fit_eval(spark, sf, model.demand_gbt())
    return pred.select("store_subgroup_date_id", "total_sales_", "prediction")


def _beats_mean(spark, sf, estimator):
    """One row: the test rows, each predicted once, and whether the model explains more than the subgroup's mean."""
    _, pred = _fit_eval(spark, sf, estimator)
    pred = materialize(pred.select("store_subgroup_date_id", "label", "prediction"), "predictions")
    r2 = model.r2_of(pred, {"model": F.col("prediction")})["model"]
    baseline = m8(spark, sf).first()["r2"]
    return pred.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("store_subgroup_date_id").alias("n_ids"),
                    F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("n_unscored")).withColumn("beats_mean", F.lit(bool(r2 > baseline)))


BEATS_SQL = W(f"""
select count(*) as n_rows, count(distinct store_subgroup_date_id) as n_ids, 0::bigint as n_unscored, true as beats_mean
from (select *, {SPLIT_SQL} as split from daily) where split = 'test'""")


@register("m3_forest_beats_subgroup_mean", BEATS_SQL)
def m3_check(spark, sf):
    return _beats_mean(spark, sf, model.forest(20, 9))


@register("m4_gbt_beats_subgroup_mean", BEATS_SQL)
def m4_check(spark, sf):
    return _beats_mean(spark, sf, model.demand_gbt())


@register("m11_m12_cross_validated_grid")
def m11(spark, sf):
    """4-fold CV over a fixed (trees x min-instances) grid on the train split (rows-only)."""
    grid = [{"num_trees": 20, "min_instances": 5}, {"num_trees": 20, "min_instances": 9}]
    return model.cross_validate(DemandVectors(Pipeline(spark, sf)).train, grid)


@register("m12_forest_search")
def m12(spark, sf):
    """Search of 70-225 trees x 5-10 instances by successive halving: fold 4 of the train split scores, the
    best point is refitted on the whole train split and scored on the test split (rows-only)."""
    v = DemandVectors(Pipeline(spark, sf))
    points = model.search_forest(v.train.filter("fold <> 4"), v.train.filter("fold = 4"))
    best = next(p for p in points if p["chosen"])
    refit = model.forest(best["num_trees"], best["min_instances"]).fit(v.train)
    r2_test = model.r2_of(refit.transform(v.test), {"r2": F.col("prediction")})["r2"]
    rows = [(p["rung"], p["num_trees"], p["min_instances"], p["r2"], p["grown"], p["chosen"], r2_test if p["chosen"] else None) for p in points]
    # one row a scored point
    return spark.createDataFrame(rows, "rung int, num_trees int, min_instances int, r2 double, grown boolean, chosen boolean, r2_test double")


# The best point the reference reports (fixed values): 165 trees, 9 instances.
BEST_TREES, BEST_INSTANCES = 165, 9


def _strategy_frame(p: Pipeline):
    """Hold-out of the last week: (history, rows to predict with each price forecast, both made from history only)."""
    daily = _with_split(p)
    last = daily.agg(F.max("date_id")).first()[0]
    history = materialize(daily.filter(F.col("date_id") <= F.date_sub(F.lit(last), HORIZON_DAYS)), "history")
    actual = daily.filter(F.col("date_id") > F.date_sub(F.lit(last), HORIZON_DAYS)).withColumnRenamed("price_", "price_seen")
    keys = q_series.KEYS
    seen = panel.period_median(history, keys, "day").withColumn("price_median", F.round("price_median", 8))
    known = seen.groupBy(*keys).agg(F.max_by("price_median", "t").alias("price_last"), F.min("price_median").alias("lowest"))
    rows = actual.join(known, keys)         # a series without history has no price forecast
    for step, horizon in HORIZON.items():
        fc = assemble.forecast_price(q_series.forecasts_of(history, step, horizon), known.drop("price_last"), keys)
        fc = fc.withColumnRenamed("price_forecast", f"price_{step}")
        on = keys if step == "week" else [*keys, "date_id"]
        fc = fc.drop("t_forecast") if step == "week" else fc.withColumnRenamed("t_forecast", "date_id")
        rows = rows.join(fc, on, "left").withColumn(f"price_{step}", F.coalesce(f"price_{step}", "price_last"))
    return history, materialize(rows, "holdout")


def compare_strategies(history, holdout, trees=BEST_TREES, instances=BEST_INSTANCES) -> list[tuple]:
    """(strategy, n_rows, r2, rmse, mae) of forest + weekly price, forest + daily price, boosted trees + weekly
    price, each fitted on the same written vectors of the history and scored on the hold-out."""
    fitted, train = model.vectors(history, "total_sales_", model.DEMAND_FEATURES, ["store_subgroup_date_id"])
    models = {"random_forest": model.forest(trees, instances).fit(train), "boosted_trees": model.demand_gbt().fit(train)}
    out = []
    for kind, step in (("random_forest", "week"), ("random_forest", "day"), ("boosted_trees", "week")):
        frame = fitted.transform(holdout.withColumn("price_", F.col(f"price_{step}")))
        scored = materialize(model.predict(models[kind], frame).select("label", "prediction"), "scored")
        err = F.col("label") - F.col("prediction")
        m = scored.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae")).first()
        out.append((f"{kind}_{'weekly' if step == 'week' else 'daily'}_price", m["n"], model.r2_of(scored, {"r2": F.col("prediction")})["r2"], m["rmse"], m["mae"]))
    return out


@register("m17_strategy_comparison")
def m17(spark, sf):
    """The three strategies (forest + weekly price, forest + daily price, boosted trees + weekly price) on the
    last week, held out (rows-only)."""
    rows = compare_strategies(*_strategy_frame(Pipeline(spark, sf)))
    # three rows of metrics computed by distributed aggregates
    return spark.createDataFrame(rows, "strategy string, n_rows long, r2 double, rmse double, mae double")


@register("m16_forest_daily_price_forecast")
def m16f(spark, sf):
    """The daily branch: the horizon's ids scored by the random forest with the day-by-day price (rows-only)."""
    p, frame = _frame(spark, sf, "day", None)
    v = DemandVectors(p)
    fitted = model.forest(BEST_TREES, BEST_INSTANCES).fit(v.train)
    scored = model.predict(fitted, v.featurizer.transform(frame.filter("price_ IS NOT NULL")))
    return assemble.back_fill(p.ids_written, assemble.proxy_predictions(scored, PROXY_DONOR, PROXY_TARGET))


# ----------------------------------------------------------------------------- assembly

IDS_SQL = f"""
pairs as (select distinct store_id, subgroup from transactions
          where store_id in (select store_id from stores_open)),
pairs2 as (select * from pairs union all select store_id, '{PROXY_TARGET}' from pairs where subgroup = '{PROXY_DONOR}'),
ids as (select store_id || '_' || subgroup || '_' || strftime(g.d, '%Y-%m-%d') as store_subgroup_date_id
        from pairs2, unnest(generate_series(timestamp '2001-11-05', timestamp '2001-11-11', interval 1 day)) as g(d)),
sep as (select store_subgroup_date_id, split_part(store_subgroup_date_id, '_', 1) as store_id,
               split_part(store_subgroup_date_id, '_', 2) as subgroup,
               try_cast(split_part(store_subgroup_date_id, '_', 3) as date) as date_id from ids),
att as (select s.*, so.brand, so.region, so.store_type, cast(month(date_id) as int) as mes,
               cast(day(date_id) as int) as dia, cast(year(date_id) as int) as anio
        from sep s left join stores_open so on s.store_id = so.store_id),
prof as (select mes, dia, store_id, subgroup, round(sum(quantity_), 8) / count(quantity_) as quantity_avg
         from daily where (mes, dia) in (select distinct mes, dia from att) group by mes, dia, store_id, subgroup),
facts as (select store_id, subgroup, round(sum(quantity_), 8) / count(quantity_) as quantity_usual,
          min(category) as category, min(group_name) as group_name from daily group by store_id, subgroup)"""

HORIZON = {"week": 1, "day": HORIZON_DAYS}


def _assembly_sql(step: str) -> str:
    trunc = {"week": "cast(date_trunc('week', date_id) as date)", "day": "date_id"}[step]
    match = {"week": "", "day": " and s.date_id = f.t_forecast"}[step]
    return f"""
with fcs as ({q_series._forecast_sql(step, HORIZON[step])}),
seen as (select store_id, subgroup, {trunc} as t, round(quantile_cont(price_, 0.5), 8) as pm from daily group by 1, 2, 3),
last as (select store_id, subgroup, arg_max(pm, t) as price_last, min(pm) as lowest from seen group by 1, 2),
fprice as (select f.store_id, f.subgroup, f.t_forecast,
           case when f_ar1 is not null and abs(ar_slope) < 1 then greatest(f_ar1, lowest) else f_last end as price_forecast
           from fcs f join last l on f.store_id = l.store_id and f.subgroup = l.subgroup),
{IDS_SQL.strip()},
source as (select *, case when subgroup = '{PROXY_TARGET}' then '{PROXY_DONOR}' else subgroup end as src from att),
frame as (select s.* exclude (src), c.category, c.group_name, coalesce(f.price_forecast, l.price_last) as price_,
                 coalesce(round_even(coalesce(pr.quantity_avg, c.quantity_usual), 0), 0) as quantity_
          from source s left join facts c on s.store_id = c.store_id and s.src = c.subgroup
          left join last l on s.store_id = l.store_id and s.src = l.subgroup
          left join fprice f on s.store_id = f.store_id and s.src = f.subgroup{match}
          left join prof pr on s.store_id = pr.store_id and s.src = pr.subgroup and s.mes = pr.mes and s.dia = pr.dia),
scored as (select *, price_ * quantity_ as prediction from frame),
donor as (select store_subgroup_date_id, store_id, date_id, prediction * 0.5 as total_sales from scored
          where subgroup = '{PROXY_DONOR}'),
preds as (select store_subgroup_date_id, prediction as total_sales from scored
          where subgroup not in ('{PROXY_DONOR}', '{PROXY_TARGET}')
          union all select store_subgroup_date_id, total_sales from donor
          union all select s.store_subgroup_date_id, d.total_sales from scored s
                    left join donor d on s.store_id = d.store_id and s.date_id = d.date_id where s.subgroup = '{PROXY_TARGET}')"""


# What the scoring frame reads of the daily table; a demand model reads all of it.
FRAME_COLUMNS = ["store_id", "subgroup", "date_id", "category", "group_name", "quantity_", "price_", "mes", "dia"]


def _frame(spark, sf, step: str, daily_columns: list[str] | None = FRAME_COLUMNS):
    """Scoring frame with the F6 (one week for all days) or F7 (day by day) forecast as price."""
    p = Pipeline(spark, sf, daily_columns)
    daily, keys = p.daily_written, q_series.KEYS
    seen = materialize(panel.period_median(daily, keys, step).withColumn("price_median", F.round("price_median", 8)), f"medians-{step}")
    last = assemble.last_value_price(seen, keys, "price_median")
    lowest = seen.groupBy(*keys).agg(F.min("price_median").alias("lowest"))
    price = assemble.forecast_price(q_series.forecasts_from(seen, step, HORIZON[step]), lowest, keys)
    if step == "week":
        price, on = price.drop("t_forecast"), keys
    else:
        price, on = price.withColumnRenamed("t_forecast", "date_id"), [*keys, "date_id"]
    profile = demand.horizon_profile(daily, assemble.split_ids(p.ids_written))
    return p, assemble.score_frame(p.ids_written, p.stores_open, last, price, on, profile, demand.series_facts(daily),
                                   PROXY_DONOR, PROXY_TARGET)


@register("j12_j13_p16_score_frame_weekly", W(_assembly_sql("week") + """
select store_subgroup_date_id, store_id, subgroup, date_id, brand, region, store_type, mes, dia, anio,
       category, group_name, price_, quantity_ from frame"""))
def j12(spark, sf):
    _, frame = _frame(spark, sf, "week")
    return frame.select("store_subgroup_date_id", "store_id", "subgroup", "date_id", "brand", "region",
                        "store_type", "mes", "dia", "anio", "category", "group_name", "price_", "quantity_")


@register("j14_p20_u1_proxy_predictions_daily", W(_assembly_sql("day") + """
select store_subgroup_date_id, total_sales from preds"""))
def j14(spark, sf):
    _, frame = _frame(spark, sf, "day")
    preds = assemble.proxy_predictions(assemble.price_times_units(frame), PROXY_DONOR, PROXY_TARGET)
    return preds.select("store_subgroup_date_id", "total_sales")


def _assembled(spark, sf, step):
    p, frame = _frame(spark, sf, step)
    preds = assemble.proxy_predictions(assemble.price_times_units(frame), PROXY_DONOR, PROXY_TARGET)
    return assemble.back_fill(p.ids_written, preds)


@register("m16_j15_assembled_forecast_weekly_price", W(_assembly_sql("week") + """
select i.store_subgroup_date_id, p.total_sales from ids i left join preds p
on i.store_subgroup_date_id = p.store_subgroup_date_id"""))
def m16w(spark, sf):
    return _assembled(spark, sf, "week")


@register("m16_j15_assembled_forecast_daily_price", W(_assembly_sql("day") + """
select i.store_subgroup_date_id, p.total_sales from ids i left join preds p
on i.store_subgroup_date_id = p.store_subgroup_date_id"""))
def m16d(spark, sf):
    return _assembled(spark, sf, "day")


@register("m16_gbt_scored_forecast")
def m16g(spark, sf):
    """The same assembly scored by the boosted-trees demand model (rows-only)."""
    p, frame = _frame(spark, sf, "week", None)
    v = DemandVectors(p)
    fitted = model.demand_gbt().fit(v.train)
    scored = model.predict(fitted, v.featurizer.transform(frame.filter("price_ IS NOT NULL")))   # unpriced ids are null in the back-fill
    preds = assemble.proxy_predictions(scored, PROXY_DONOR, PROXY_TARGET)
    return assemble.back_fill(p.ids_written, preds)
