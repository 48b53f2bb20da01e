"""Reference operators on small panels: closed forms, invariants and no look-ahead."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import alloc, forecast, legacy, matrix, panel, perf, rolling, select, signif, tailrisk, walk


def days(n, start=dt.date(2015, 1, 1)):
    return [start + dt.timedelta(k) for k in range(n)]


@pytest.fixture(scope="module")
def returns(spark):
    rng = random.Random(7)
    rows = [(f"T{k}", d, rng.gauss(0.0004 * k, 0.01 + 0.001 * k)) for d in days(400) for k in range(6)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double").cache()


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(d, rng.gauss(0.0003, 0.01)) for d in days(400)], "date date, ret double").cache()


def test_forward_fill_stops_after_five(spark):
    cal = spark.createDataFrame([(d,) for d in days(12)], "date date")
    px = spark.createDataFrame([("A", days(12)[0], 1.0), ("A", days(12)[9], 2.0)], "ticker string, date date, close double")
    got = [r["close"] for r in panel.densify(px, cal, ["close"]).orderBy("date").collect()]
    assert got == [1.0] * 6 + [None] * 3 + [2.0] * 3


def test_quality_statuses(spark):
    cal = spark.createDataFrame([(d,) for d in days(40)], "date date")
    rows = [("GOOD", d, 100.0 + i) for i, d in enumerate(days(40))] + [("SHORT", d, 1.0 + i) for i, d in enumerate(days(40)) if i > 35]
    rows += [("GAPPY", d, 1.0 + i) for i, d in enumerate(days(40)) if i % 2 == 0] + [("STALE", d, 5.0) for d in days(40)]
    px = spark.createDataFrame(rows, "ticker string, date date, close double")
    asked = spark.createDataFrame([("GOOD",), ("LOST",)], "ticker string")
    got = {r["ticker"]: r["status"] for r in panel.quality_report(px, cal, asked, min_history=15).collect()}
    assert got == {"GOOD": "ok", "SHORT": "short_history", "GAPPY": "gappy", "STALE": "stale", "LOST": "download_failed"}


def test_returns_and_clipping(spark):
    px = spark.createDataFrame([("A", d, c) for d, c in zip(days(3), (100.0, 110.0, 99.0), strict=True)], "ticker string, date date, close double")
    got = [r["ret"] for r in panel.to_returns(px).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.1, -0.1])
    tail = spark.createDataFrame([(-0.9,), (None,), (0.9,)], "ret double")
    assert [r["ret"] for r in panel.winsorise(tail).collect()] == [-0.5, None, 0.5]


def test_ewma_with_gaps(spark):
    x = [0.01, None, None, 0.02, None, -0.03]
    df = spark.createDataFrame([("A", d, v) for d, v in zip(days(6), x, strict=True)], "ticker string, date date, ret double")
    got = [r["ewma"] for r in rolling.ewma_vol(df, annualise=False).orderBy("date").collect()]
    s = 0.01**2
    s2 = (0.94**3 * s + 0.06 * 0.02**2) / (0.94**3 + 0.06)
    s3 = (0.94**2 * s2 + 0.06 * 0.03**2) / (0.94**2 + 0.06)
    assert got == pytest.approx([math.sqrt(v) for v in (s, s, s, s2, s2, s3)])


def test_known_beta_and_no_look_ahead(returns, market):
    both = market.select(F.lit("X").alias("ticker"), "date", F.col("ret").alias("mkt"), (F.col("ret") * 1.4).alias("ret"))
    last = both.withColumn("b", rolling.beta("ret", "mkt", 252)).orderBy(F.desc("date")).first()
    assert last["b"] == pytest.approx(1.4)
    shocked = returns.withColumn("ret", F.when(F.col("date") > days(400)[300], F.col("ret") * 5).otherwise(F.col("ret")))
    old, new = (r.withColumn("v", rolling.realised_vol()).where(F.col("date") <= days(400)[300]).orderBy("ticker", "date").select("v").collect() for r in (returns, shocked))
    assert old == new


def test_drawdown_and_flat_stream(spark):
    s = spark.createDataFrame([("a", days(2)[0], 1.0), ("a", days(2)[1], -0.5)] + [("flat", d, 0.001) for d in days(252)], "name string, date date, ret double")
    got = {r["name"]: r for r in perf.tearsheet(s).collect()}
    assert got["a"]["max_drawdown"] == pytest.approx(-0.5)
    assert got["flat"]["sharpe"] is None and got["flat"]["cagr"] == pytest.approx(1.001**252 - 1)


def test_var_properties(returns):
    s = returns.withColumnRenamed("ticker", "name")
    for r in tailrisk.var_summary(s).collect():
        assert r["cvar"] >= r["historical"] > 0 and abs(r["monte_carlo"] - r["historical"]) < 0.1 * r["historical"]


def test_kupiec(spark):
    got = spark.range(1).select(*(tailrisk.kupiec(F.lit(1000), F.lit(x), 0.05).alias(f"x{x}") for x in (50, 150, 0))).first()
    assert abs(got["x50"]) < 1e-9 and got["x150"] > 11 and got["x0"] > 11


def test_matrices(returns):
    wide = returns.toPandas().pivot(index="date", columns="ticker", values="ret")
    _, cov = matrix.dense(matrix.sample_cov(returns).toPandas())
    assert np.allclose(cov, wide.cov().to_numpy())
    _, lw = matrix.dense(matrix.ledoit_wolf_cov(returns).toPandas())
    x = wide.to_numpy() - wide.to_numpy().mean(0)
    s, n, p = x.T @ x / len(x), len(x), x.shape[1]
    mu, d2 = np.trace(s) / p, ((s - np.trace(s) / p * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / p)
    assert np.allclose(lw, (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p))
    assert np.linalg.eigvalsh(matrix.psd(np.array([[1.0, 2.0], [2.0, 1.0]]))).min() > 0


def test_caps(spark):
    df = spark.createDataFrame([("a", k, w) for k, w in zip("wxyz", (0.7, 0.2, 0.05, 0.05), strict=True)], "as_of string, ticker string, raw double")
    got = {r["ticker"]: r["weight"] for r in alloc.apply_caps(df, 0.3).collect()}
    assert max(got.values()) <= 0.3 + 1e-9 and sum(got.values()) == pytest.approx(1) and got["w"] == got["x"] == pytest.approx(0.3)


def test_optimisers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * np.array([1, 1, 2, 2, 3, 3]) * 0.01
    cov = np.cov(x.T)
    free, none = alloc.projector(6, 0.0, 1.0, np.zeros((0, 6)), 1.0), np.zeros((0, 6))
    w, good = alloc.min_variance_weights(cov, free)
    assert good and w.sum() == pytest.approx(1) and w @ cov @ w <= np.full(6, 1 / 6) @ cov @ np.full(6, 1 / 6)
    exact = np.linalg.solve(cov, np.ones(6))
    assert np.allclose(w, exact / exact.sum(), atol=1e-4) or (exact < 0).any()
    w, good = alloc.risk_parity_weights(cov, alloc.projector(6, 1e-4, 1.0, none, 1.0))
    share = w * (cov @ w) / (w @ cov @ w)
    assert good and np.ptp(share) < 0.01
    w, good = alloc.min_variance_weights(cov, alloc.projector(6, 0.0, 0.3, np.array([[1.0, 1, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 0, 0, 1, 1]]), 0.35))
    assert good and w.max() <= 0.3 + 1e-6 and w[:2].sum() <= 0.35 + 1e-6


def test_backtest(spark, returns, market):
    sectors = spark.createDataFrame([(f"T{k}", f"S{k % 2}") for k in range(6)], "ticker string, sector string")
    from panelforge.constants import RiskProfile

    profile = RiskProfile("t", 0.4, 2, {"sharpe": 1.0})
    config = walk.BacktestConfig("equal_weight", profile, train_months=6, hold_months=1, min_obs=100)
    out = walk.run_backtest(returns, market, sectors, config)
    w = out.weights.groupBy("as_of").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in w)
    first = out.costs.orderBy("as_of").first()
    assert first["traded"] == pytest.approx(1) and first["cost"] == pytest.approx(0.0015)
    assert out.daily.agg(F.min("date")).first()[0] > min(r["as_of"] for r in w)
    with pytest.raises(ValueError):
        walk.run_backtest(returns, market, sectors, walk.BacktestConfig("equal_weight", profile, train_months=36))


def test_zscore_of_constant(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0)], "as_of string, x double")
    assert [r[0] for r in df.select(select.zscore("x")).collect()] == [0.0, 0.0]


def test_bootstrap_of_identical_streams(returns):
    s = returns.where("ticker = 'T1'").select(F.col("ticker").alias("name"), "date", "ret", F.col("ret").alias("bench"))
    r = signif.bootstrap_sharpe_difference(s, n_boot=50).first()
    assert r["sharpe_diff"] == 0 and r["ci_low"] <= 0 <= r["ci_high"]
    at = signif.bootstrap_indices(100, 10, np.random.default_rng(1))
    assert len(at) == 100 and at.min() >= 0 and at.max() < 100


def test_booster_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    x[::7, 1] = np.nan
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.1 * rng.normal(size=2000)
    model = forecast.Booster(rounds=60).fit(x[:1500], y[:1500])
    assert np.mean((model.predict(x[1500:]) - y[1500:]) ** 2) < 0.1


def test_legacy_signs(returns):
    s = returns.withColumnRenamed("ticker", "name")
    row = s.groupBy("name").agg(legacy.signed_var().alias("v"), tailrisk.parametric().alias("p")).first()
    assert row["v"] == pytest.approx(-row["p"])


def test_entry_without_training_data_package(monkeypatch):
    import importlib
    import sys

    saved = {k: v for k, v in sys.modules.items() if k.startswith(("panelforge.llm", "corpus_pipeline"))}
    for k in saved:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "panelforge.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
