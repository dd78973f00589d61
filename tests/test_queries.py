"""Every registered query against its DuckDB oracle on the smallest data set
(rows-only for the queries SQL cannot express), plus the driver entry point."""

import os
import sys

import pytest

from tests.conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
import check_oracle as CO  # noqa: E402

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _series(horizon):
    def check(rows):
        keys = {(r["store_id"], r["subgroup"], r["h"]) for r in rows}
        assert len(keys) == len(rows) == horizon * len({k[:2] for k in keys})
        assert all(r["f_ar"] > 0 for r in rows)
    return check


def _scored_ids(rows):
    assert len({r["store_subgroup_date_id"] for r in rows}) == len(rows)
    assert sum(r["total_sales"] is not None for r in rows) > 0.9 * len(rows)


def _predictions(rows):
    assert len({r["store_subgroup_date_id"] for r in rows}) == len(rows) and all(r["prediction"] is not None for r in rows)


def _optimum(rows):
    assert all(r["profit"] == r["profit"] and r["price_sim"] > 0 for r in rows)


def _search(rows):
    assert len(rows) >= 9 and sum(r["chosen"] for r in rows) == 1
    best = next(r for r in rows if r["chosen"])
    assert best["r2"] == max(r["r2"] for r in rows) and best["r2_test"] is not None
    assert all(70 <= r["num_trees"] <= 225 and 5 <= r["min_instances"] <= 10 for r in rows)


def _strategies(rows):
    assert [r["strategy"] for r in rows] == ["random_forest_weekly_price", "random_forest_daily_price", "boosted_trees_weekly_price"]
    assert len({r["n_rows"] for r in rows}) == 1 and all(r["rmse"] >= r["mae"] > 0 for r in rows)


def _grid(rows):
    assert {(r["num_trees"], r["min_instances"]) for r in rows} == {(20, 5), (20, 9)} and all(0 < r["r2_mean"] < 1 for r in rows)


# What holds for the results that SQL cannot express.
HOLDS = {"f6b_weekly_ar_forecast": _series(1), "f7b_daily_ar_forecast": _series(7), "m16_gbt_scored_forecast": _scored_ids, "m16_forest_daily_price_forecast": _scored_ids,
         "m1_m3_m7_random_forest_demand": _predictions, "m2_m4_gbt_demand": _predictions, "m5_gbt_units_optimal_price": _optimum, "m6_poisson_glm_optimal_price": _optimum,
         "m12_forest_search": _search, "m17_strategy_comparison": _strategies, "m11_m12_cross_validated_grid": _grid,
         "s8_sample_bernoulli": lambda rows: None}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in CO.TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    yield con
    con.close()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(CO.norm(x) for x in r) for r in sdf.collect()]
    if name not in ORACLE:
        assert srows
        if name in HOLDS:
            HOLDS[name]([dict(zip(sdf.columns, r)) for r in srows])
        return
    rel = duck.sql(ORACLE[name])
    dcols = rel.columns
    drows = [tuple(CO.norm(x) for x in r) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    si = [sdf.columns.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    S = sorted((tuple(r[i] for i in si) for r in srows), key=CO.key)
    D = sorted((tuple(r[i] for i in di) for r in drows), key=CO.key)
    assert len(S) == len(D)
    assert all(all(CO.close(a, b) for a, b in zip(x, y)) for x, y in zip(S, D))


def test_every_retail_result_without_sql_is_checked():
    assert {n for n in QUERIES if n not in ORACLE and not n.startswith("op") and n != "pipeline"} == set(HOLDS)


def test_forecasts_run_from_another_folder(tmp_path):
    """Executors import the shipped package, not the folder that the driver was started in."""
    import subprocess
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from pricewise.plans import QUERIES\n"
            "from pricewise.session import build_session\n"
            "spark = build_session(master='local[2]', shuffle_partitions=4)\n"
            f"print('rows', QUERIES['f6b_weekly_ar_forecast'](spark, {SF_SMALL!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
