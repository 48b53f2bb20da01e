"""Built portfolios, stored results, optimality of the solvers, the pooled test between forecasts, and no look-ahead."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.constants import RiskProfile
from panelforge.operators import alloc, forecast, frames, results, rolling, stage, tailrisk, walk


def days(n, start=dt.date(2015, 1, 1)):
    return [start + dt.timedelta(k) for k in range(n)]


def test_minimum_variance_meets_its_optimality_conditions():
    rng = np.random.default_rng(5)
    for caps, sectors in (((0.0, 1.0), np.zeros((0, 8))), ((0.0, 0.2), np.zeros((0, 8))), ((0.05, 0.3), np.repeat(np.eye(4), 2, 1))):
        cov = np.cov(rng.normal(size=(300, 8)).T * rng.uniform(0.5, 3, (8, 1)))
        project = alloc.projector(8, *caps, sectors, 0.35)
        w, good = alloc.min_variance_weights(cov, project)
        slope = 2 * cov @ w
        assert good and np.allclose(project(w - slope), w, atol=1e-3)  # a fixed point of the projected step
        for _ in range(200):  # no feasible point is better
            x = project(rng.normal(size=8))
            assert w @ cov @ w <= x @ cov @ x + 1e-9


def test_best_ratio_beats_random_portfolios():
    rng = np.random.default_rng(6)
    cov, mean = np.cov(rng.normal(size=(200, 6)).T), rng.uniform(0, 1, 6)
    project = alloc.projector(6, 0.0, 0.5, np.zeros((0, 6)), 1.0)
    w, good = alloc.max_sharpe_weights(cov, mean, 0.1, project)
    ratio = lambda x: (x @ mean - 0.1) / math.sqrt(x @ cov @ x)
    assert good and w.sum() == pytest.approx(1) and w.max() <= 0.5 + 1e-6
    assert all(ratio(w) >= ratio(project(3 * rng.normal(size=6))) - 1e-6 for _ in range(500))


def test_a_failed_solver_gives_equal_weights(spark):
    rows = [(dt.date(2020, 1, 1), f"T{k}", d, random.Random(k * 100 + i).gauss(0, 0.01)) for k in range(4) for i, d in enumerate(days(60))]
    train = spark.createDataFrame(rows, "as_of date, ticker string, date date, ret double")
    chosen = train.select("as_of", "ticker").distinct()
    cov = spark.createDataFrame([(dt.date(2020, 1, 1), f"T{a}", f"T{b}", float("nan")) for a in range(4) for b in range(4)], "as_of date, a string, b string, value double")
    got = alloc.optimised("max_sharpe", chosen, train, alloc.Constraints(max_weight=0.5), cov=cov).collect()
    assert len(got) == 4 and all(r["weight"] == pytest.approx(0.25) for r in got)


def test_pooled_test_matches_one_ordered_array(spark):
    rng = np.random.default_rng(8)
    rows = [(d, f"T{k}", float(a), float(a * math.exp(0.2 * e)), float(a * math.exp(0.3 * f))) for d in days(150) for k in range(3) for a, e, f in [(rng.uniform(0.1, 0.4), rng.normal(), rng.normal())]]
    frame = spark.createDataFrame(rows, "date date, ticker string, actual double, x double, y double").repartition(7)
    a, x, y = (np.array([r[k] for r in sorted(rows)]) for k in (2, 3, 4))
    for loss, cost in (("qlike", lambda p: a**2 / p**2 - np.log(a**2 / p**2) - 1), ("mse", lambda p: (a - p) ** 2)):
        d = cost(x) - cost(y)
        e, n = d - d.mean(), len(d)
        var = e @ e / n + sum(2 * (1 - k / 22) * (e[k:] @ e[:-k]) / n for k in range(1, 22))
        stat = d.mean() / math.sqrt(max(var / n, 1e-18))
        row = forecast.diebold_mariano(frame, "x", "y", loss).first()
        assert row["stat"] == pytest.approx(stat) and row["n"] == n and row["p"] == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)))
    assert forecast.diebold_mariano(frame.limit(20), "x", "y").first()["stat"] is None
    table = forecast.dm_table(frame, "x", ["y", "actual"]).collect()
    assert [(r["comparison"], r["loss"]) for r in table] == [("x vs y", "QLIKE"), ("x vs y", "MSE"), ("x vs actual", "QLIKE"), ("x vs actual", "MSE")]


def test_coverage_without_days_is_unknown(spark):
    none = spark.createDataFrame([("a", days(1)[0], None, 0.1)], "name string, date date, ret double, var double")
    assert tailrisk.evaluate(none, 0.95).count() == 0
    one = spark.createDataFrame([("a", days(1)[0], 0.0, 0.1)], "name string, date date, ret double, var double")
    row = tailrisk.with_p_values(tailrisk.evaluate(one, 0.95)).first()
    assert row["independence_lr"] is None and row["cc_p"] is None and row["verdict"] is None


def test_results_are_written_read_and_rendered(spark):
    table = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, sharpe double")
    for kind in ("parquet", "csv", "json"):
        path = stage.stage_path(spark, f"test-{kind}")
        assert results.read_result(spark, path, kind) is None
        results.write_result(table, path, kind)
        results.write_result(table, path, kind)
        assert {r["name"]: r["sharpe"] for r in results.read_result(spark, path, kind).collect()} == {"a": 0.5, "b": None}
    with pytest.raises(ValueError):
        results.write_result(table, path, "xml")
    csv = stage.stage_path(spark, "test-render")
    results.write_result(table.coalesce(1), csv, "csv")
    text = results.render_document(spark, "x <!-- T --> <!-- U -->", {"T": csv, "U": csv + "-none", "V": csv}, ratios=["sharpe"])
    assert text == "x | name | sharpe |\n| --- | --- |\n| a | 0.50 |\n| b | — | <!-- U -->"


def test_portfolio_in_money(spark):
    w = spark.createDataFrame([("a", 0.6), ("b", 0.4), ("c", 0.0)], "ticker string, weight double")
    m = spark.createDataFrame([("a", 0.1, 1.0, 0.2, 1.1), ("b", 0.2, 2.0, 0.3, 0.9)], "ticker string, mean_return double, sharpe double, volatility double, beta double")
    s = spark.createDataFrame([("a", "S")], "ticker string, sector string")
    got = {r["ticker"]: r for r in results.allocation_table(w, m, s, 1000.0).collect()}
    assert set(got) == {"a", "b"} and got["a"]["amount"] == 600 and got["b"]["sector"] == frames.MISSING
    cov = spark.createDataFrame([("a", "a", 0.04), ("a", "b", 0.01), ("b", "a", 0.01), ("b", "b", 0.09)], "a string, b string, value double")
    row = results.portfolio_estimates(w, m, cov).first()
    vol = math.sqrt(0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09)
    assert (row["holdings"], row["est_return"], row["est_vol"], row["est_sharpe"]) == (2, pytest.approx(0.14), pytest.approx(vol), pytest.approx((0.14 - 0.065) / vol))
    series = spark.createDataFrame([(d, x) for d, x in zip(days(100), np.linspace(-0.05, 0.05, 100).tolist(), strict=True)], "date date, ret double")
    r = np.linspace(-0.05, 0.05, 100)
    row = results.money_at_risk(series, 1000.0).first()
    assert row["var_95"] == pytest.approx(-np.quantile(r, 0.05) * 1000) and row["cvar_95"] == pytest.approx(-r[r <= np.quantile(r, 0.05)].mean() * 1000)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(12)
    rows = []
    for k in range(3):
        price = 100.0
        for d in days(420):
            price *= math.exp(rng.gauss(0.0003, 0.012))
            rows.append((d, f"T{k}", price, price * 1.01, price * 0.99, price, 1000 + rng.randrange(100)))
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long").cache()


def test_features_do_not_look_ahead(spark, bars):
    cut = days(420)[330]
    mkt = bars.groupBy("date").agg(F.avg("close").alias("close"))
    late = F.col("date") > F.lit(cut)
    changed = bars.select("date", "ticker", *(F.when(late, F.col(c) * 3).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), "volume")
    market = mkt.select("date", F.when(late, F.col("close") * 2).otherwise(F.col("close")).alias("close"))
    names = [c for c in rolling.feature_columns(rolling.feature_panel(bars, mkt, month_ends=False))]
    pick = lambda p: {(r["date"], r["ticker"]): tuple(None if r[c] is None else round(r[c], 9) for c in names) for r in p.where(F.col("date") <= F.lit(cut)).collect()}
    keep = lambda b, m: pick(rolling.feature_panel(b, m, month_ends=False).drop("fwd_vol_21").withColumn("fwd_vol_21", F.lit(None).cast("double")))
    one, other = keep(bars, mkt), keep(changed, market)
    both = set(one) & set(other)
    assert len(both) > 300 and all(one[k] == other[k] for k in both)


def test_weights_do_not_look_ahead(spark):
    rng = random.Random(14)
    rows = [(f"T{k}", d, rng.gauss(0.0004 * k, 0.01)) for d in days(400) for k in range(5)]
    market = spark.createDataFrame([(d, rng.gauss(0.0003, 0.01)) for d in days(400)], "date date, ret double")
    sectors = spark.createDataFrame([(f"T{k}", "S") for k in range(5)], "ticker string, sector string")
    config = walk.BacktestConfig("score_based", RiskProfile("t", 0.5, 2, {"sharpe": 1.0}), train_months=6, hold_months=2, min_obs=100)
    cut = days(400)[300]
    other = [(t, d, -5 * r if d > cut else r) for t, d, r in rows]
    got = []
    for x in (rows, other):
        w = walk.run_backtest(spark.createDataFrame(x, "ticker string, date date, ret double"), market, sectors, config).weights
        got.append({(r["as_of"], r["ticker"]): round(r["weight"], 9) for r in w.collect()})
    before = {k: v for k, v in got[0].items() if k[0] <= cut}
    assert before and before == {k: v for k, v in got[1].items() if k[0] <= cut} and got[0] != got[1]
