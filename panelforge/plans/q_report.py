"""Queries of significance (T), forecasts (F), reporting (O) and the first variant (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import daily_rate
from ..operators import forecast, frames, legacy, matrix, panel, perf, rolling, signif, tailrisk
from ..operators.panel import r6
from ..operators.stage import staged
from ..sources import bridge as B
from . import q_panel, q_risk, q_rolling, q_walk
from .registry import query

RF = f"{daily_rate()!r}::double"


def _pairs(spark, d):
    return q_risk.streams(spark, d).join(B.mkt(spark, d).select("date", F.col("ret").alias("bench")), "date")


@query("T1_T2_bootstrap_sharpe")
def _(spark, d):
    return signif.bootstrap_sharpe_difference(_pairs(spark, d))


def _psr(limit: str) -> str:
    m = lambda k: f"(sum(pow(ret - mu, {k})) / count(*))"
    sr = f"((avg(ret) - {RF}) / stddev_samp(ret))"
    g3, g4 = f"({m(3)} / pow({m(2)}, 1.5))", f"({m(4)} / pow({m(2)}, 2))"
    return f"({sr} - {limit}) * sqrt(count(*) - 1) / sqrt(greatest(1 - {g3} * {sr} + ({g4} - 1) / 4 * {sr} * {sr}, 1e-12))"


_MU = ", mu0 AS (SELECT ticker AS name, ret, avg(ret) OVER (PARTITION BY ticker) AS mu FROM rets)"


@query("T3_T4_sharpe_z", f"{_MU} SELECT name, round({_psr('0')}, 6) AS psr_z, round({_psr(f'{signif.best_of_noise(25)!r}::double / sqrt(count(*) - 1)')}, 6) AS dsr_z FROM mu0 GROUP BY name")
def _(spark, d):
    return q_risk.streams(spark, d).groupBy("name").agg(r6(signif.psr_statistic()).alias("psr_z"), r6(signif.dsr_statistic(25)).alias("dsr_z"))


def _hac(rows: str, lags: int, out: str) -> str:
    lagged = ", ".join(f"lag(e, {k}) OVER (PARTITION BY name ORDER BY date, ticker) AS e{k}" for k in range(1, lags + 1))
    total = " + ".join(["sum(e * e)", *(f"2 * {1 - k / (lags + 1)!r}::double * coalesce(sum(e * e{k}), 0)" for k in range(1, lags + 1))])
    return f", {out}0 AS (SELECT *, x - avg(x) OVER (PARTITION BY name) AS e FROM ({rows})), {out}1 AS (SELECT name, x, e, {lagged} FROM {out}0), {out} AS (SELECT name, avg(x) / sqrt(greatest(({total}) / count(*) / count(*), 1e-18)) AS t, count(*) AS n FROM {out}1 GROUP BY name)"


@query("T5_newey_west", _hac("SELECT ticker AS name, ticker, date, rets.ret - mkt.ret AS x FROM rets JOIN mkt USING (date)", 5, "nw") + " SELECT name, round(t, 6) AS t_stat FROM nw")
def _(spark, d):
    active = _pairs(spark, d).select("name", "date", (F.col("ret") - F.col("bench")).alias("ret"))
    return signif.newey_west(active).select("name", r6("t_stat").alias("t_stat"))


@query("T6_significance_table")
def _(spark, d):
    return signif.significance_table(q_risk.streams(spark, d), B.mkt(spark, d))


@query("T7_head_to_head")
def _(spark, d):
    """The best strategy by Sharpe ratio against equal weights, net of costs."""
    out = None
    for name in q_walk.RAW:
        one = q_walk.run(spark, d, name).daily.select(F.lit(name).alias("name"), "date", F.col("net").alias("ret"))
        out = one if out is None else out.unionByName(one)
    return signif.head_to_head(staged(out, "strategies"), "equal_weight")


# Forecasts: features of the dense panel at all dates serve as predictions.
def _preds(spark, d):
    return q_rolling.features(spark, d).select("date", "ticker", F.col("fwd_vol_21").alias("actual"), "rv_21", "rv_63", "ewma_94", "rv_252")


_PRED = q_rolling._PANEL + ", preds AS (SELECT date, ticker, fwd_vol_21 AS actual, rv_21, rv_63, ewma_94, rv_252 FROM features)"
_STACK = ", st AS (SELECT date, ticker, actual, model, pred FROM preds UNPIVOT (pred FOR model IN (rv_21, rv_63, ewma_94, rv_252)) WHERE actual > 0 AND pred > 0)"
_SCORES = "sqrt(avg(pow(actual - pred, 2))) AS rmse, avg(abs(actual - pred)) AS mae, avg(actual * actual / greatest(pred * pred, 1e-10) - ln(actual * actual / greatest(pred * pred, 1e-10)) - 1) AS qlike, 1 - sum(pow(actual - pred, 2)) / nullif(var_pop(actual) * count(*), 0) AS r2, count(*) AS n"
_MODELS = ["rv_21", "rv_63", "ewma_94", "rv_252"]
_FOUR = ("rmse", "mae", "qlike", "r2")


@query("F1_F2_F3_scores", f"{_PRED}{_STACK}, s AS (SELECT model, {_SCORES} FROM st GROUP BY model) SELECT model, n, {', '.join(f'round({c}, 6) AS {c}' for c in _FOUR)} FROM s")
def _(spark, d):
    t = forecast.stacked(_preds(spark, d), _MODELS).groupBy("model").agg(*(c.alias(k) for k, c in forecast.scores().items()))
    return t.select("model", "n", *(r6(c).alias(c) for c in _FOUR))


@query("F4_hybrid_baseline", f"{_PRED} SELECT date, ticker, round(0.5 * rv_21 + 0.5 * coalesce(rv_252, rv_21), 6) AS hybrid FROM preds")
def _(spark, d):
    return _preds(spark, d).select("date", "ticker", r6(forecast.hybrid()).alias("hybrid"))


@query("F5_garch")
def _(spark, d):
    points = B.mkt(spark, d).groupBy(F.year("date"), F.floor(F.month("date") / 6.5)).agg(F.max("date").alias("date")).select("date")
    return forecast.garch_forecasts(B.crets(spark, d), points)


_NAMES = [c for c in q_rolling.FEATURES if c != "fwd_vol_21"]


@query("F6_boosted_walk_forward")
def _(spark, d):
    return forecast.walk_forward_predict(q_rolling.features(spark, d), _NAMES, start_year=1999, min_train=200)


@query("O5f_feature_gains")
def _(spark, d):
    _, gains = forecast.walk_forward(q_rolling.features(spark, d), _NAMES, start_year=1999, min_train=200)
    return frames.top_features(forecast.mean_gains(gains))


@query("F4_baselines", f"{_PRED} SELECT date, ticker, round(rv_21, 6) AS random_walk, round(ewma_94, 6) AS ewma, round(0.5 * rv_21 + 0.5 * coalesce(rv_252, rv_63), 6) AS hybrid FROM preds")
def _(spark, d):
    return _preds(spark, d).select("date", "ticker", *(r6(c).alias(k) for k, c in forecast.baselines().items()))


@query("F7_evaluation", f"{_PRED}{_STACK}, s AS (SELECT model, {_SCORES} FROM st GROUP BY model), b AS (SELECT rmse AS r0, qlike AS q0 FROM s WHERE model = 'ewma_94') SELECT model, n, {', '.join(f'round({c}, 6) AS {c}' for c in _FOUR)}, round((rmse / r0 - 1) * 100, 6) AS rmse_vs_reference, round((qlike / q0 - 1) * 100, 6) AS qlike_vs_reference FROM s, b")
def _(spark, d):
    t = forecast.evaluate_predictions(_preds(spark, d), _MODELS)
    return t.select("model", "n", *(r6(c).alias(c) for c in (*_FOUR, "rmse_vs_reference", "qlike_vs_reference")))


_DM = "SELECT 1 AS name, ticker, date, actual * actual / (rv_21 * rv_21) - ln(actual * actual / (rv_21 * rv_21)) - (actual * actual / (ewma_94 * ewma_94) - ln(actual * actual / (ewma_94 * ewma_94))) AS x FROM preds"


@query("F8_diebold_mariano", _PRED + _hac(_DM, 21, "dm") + " SELECT round(t, 6) AS stat, n FROM dm")
def _(spark, d):
    return forecast.diebold_mariano(_preds(spark, d), "rv_21", "ewma_94").select(r6("stat").alias("stat"), "n")


@query("F9_forecasts_wide", _PRED + "SELECT date, " + ", ".join(f"""round(max(CASE WHEN ticker = '{b}' THEN ewma_94 END), 6) AS "{b}" """ for b in q_panel.BRANDS) + " FROM preds GROUP BY date")
def _(spark, d):
    wide = forecast.forecasts_to_wide(_preds(spark, d), q_panel.BRANDS, "ewma_94")
    return wide.select("date", *(F.round(F.col(f"`{b}`"), 6).alias(b) for b in q_panel.BRANDS))


@query("F10_yearly_scores", f"{_PRED}{_STACK}, s AS (SELECT year(date) AS year, model, {_SCORES} FROM st GROUP BY 1, 2) SELECT year, model, n, {', '.join(f'round({c}, 6) AS {c}' for c in _FOUR)} FROM s")
def _(spark, d):
    return forecast.yearly_scores(_preds(spark, d), _MODELS).select("year", "model", "n", *(r6(c).alias(c) for c in _FOUR))


def _dm_sql(other: str, loss: str) -> str:
    cost = lambda c: f"actual * actual / ({c} * {c}) - ln(actual * actual / ({c} * {c}))" if loss == "qlike" else f"pow(actual - {c}, 2)"
    return f"SELECT '{other} {loss}' AS name, ticker, date, {cost('rv_21')} - ({cost(other)}) AS x FROM preds"


_DMS = [(o, k) for o in ("ewma_94", "rv_63", "rv_252") for k in ("qlike", "mse")]


@query("F11_dm_table", _PRED + _hac(" UNION ALL ".join(f"SELECT * FROM ({_dm_sql(*x)}) WHERE x IS NOT NULL" for x in _DMS), 21, "dm") + " SELECT 'rv_21 vs ' || split_part(name, ' ', 1) AS comparison, upper(split_part(name, ' ', 2)) AS loss, round(t, 5) AS stat, n, CASE WHEN abs(t) <= 1.959963984540054::double THEN 'no significant difference' WHEN t < 0 THEN 'first better' ELSE 'second better' END AS verdict FROM dm")
def _(spark, d):
    preds = staged(_preds(spark, d), "preds")
    return forecast.dm_table(preds, "rv_21", ["ewma_94", "rv_63", "rv_252"]).select("comparison", "loss", F.round("stat", 5).alias("stat"), "n", "verdict")


@query("F11_verdicts", "SELECT * FROM (VALUES (1.5, 0.2, 'no significant difference'), (-3.0, 0.01, 'first better'), (3.0, 0.01, 'second better')) t(stat0, p0, verdict)".replace("stat0, p0", "stat, p").replace("SELECT *", "SELECT stat::double AS stat, p::double AS p, verdict"))
def _(spark, d):
    t = spark.createDataFrame([(1.5, 0.2), (-3.0, 0.01), (3.0, 0.01)], "stat double, p double")
    return t.withColumn("verdict", forecast.verdict(F.col("stat"), F.col("p")))


# Reporting.
_W = {"first": ("1995-03-01", "1995-06-30"), "late": ("2000-01-01", "2001-12-31"), "none": ("1980-01-01", "1980-12-31")}


@query("O1_format_table", q_risk.SHEET + "SELECT name, CASE WHEN cagr IS NULL THEN '—' ELSE printf('%.1f%%', round(cagr, 6) * 100) END AS cagr, CASE WHEN sharpe IS NULL THEN '—' ELSE printf('%.2f', round(sharpe, 6)) END AS sharpe FROM sheet")
def _(spark, d):
    t = q_risk.sheet(spark, d).select("name", r6("cagr").alias("cagr"), r6("sharpe").alias("sharpe"))
    return frames.format_table(t, ["cagr"], ["sharpe"])


@query("O2_comparison", q_risk.SHEET + "SELECT name, round(sharpe, 6) AS sharpe, round(hit_rate / 2, 6) AS turnover FROM sheet JOIN hr USING (name)")
def _(spark, d):
    t = q_risk.sheet(spark, d)
    return frames.comparison_table(t.select("name", r6("sharpe").alias("sharpe")), t.select("name", r6(F.col("hit_rate") / 2).alias("turnover")))


_STRESS = ", w(\"window\", a, b) AS (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in _W.items()) + ")"


@query("O3_stress_test", _STRESS + ' SELECT t.name, w."window", round((SELECT product(1 + r.ret) - 1 FROM rets r WHERE r.ticker = t.name AND r.date BETWEEN w.a AND w.b), 6) AS total FROM (SELECT DISTINCT ticker AS name FROM rets) t, w')
def _(spark, d):
    return frames.stress_test(q_risk.streams(spark, d), _W).select("name", "window", r6("total").alias("total"))


@query("O4_sector_exposure", ", wx AS (SELECT last_day(date) AS as_of, ticker, abs(sum(ret)) AS weight FROM rets GROUP BY 1, 2), sx AS (SELECT as_of, sector, sum(weight) AS weight FROM wx JOIN sector USING (ticker) GROUP BY 1, 2), rx AS (SELECT sector, row_number() OVER (ORDER BY sum(weight) DESC, sector) AS r FROM sx GROUP BY 1) SELECT as_of, CASE WHEN r <= 3 THEN sector ELSE 'Other' END AS sector, round(sum(weight), 6) AS weight FROM sx JOIN rx USING (sector) GROUP BY 1, 2")
def _(spark, d):
    w = B.rets(spark, d).groupBy(F.last_day("date").alias("as_of"), "ticker").agg(F.abs(F.sum("ret")).alias("weight"))
    return frames.sector_exposure(w, B.sector(spark, d), top=3).select("as_of", "sector", r6("weight").alias("weight"))


@query("O5a_equity_curves", q_risk.SHEET + "SELECT name, date, round(curve, 6) AS value FROM c1")
def _(spark, d):
    return perf.drawdowns(q_risk.streams(spark, d)).select("name", "date", r6("curve").alias("value"))


@query("O5e_scatter", _PRED + "SELECT round(quantile_cont(actual, 0.99::double), 6) AS axis_limit, round(corr(actual, ewma_94), 6) AS corr, count(*) AS n FROM preds")
def _(spark, d):
    return frames.scatter(_preds(spark, d), "ewma_94").select(r6("axis_limit").alias("axis_limit"), r6("corr").alias("corr"), "n")


@query("O5f_top_features", q_risk.SHEET + ", t AS (SELECT name AS feature, annual_vol AS importance FROM sheet ORDER BY annual_vol DESC, name LIMIT 15) SELECT feature, round(importance, 6) AS importance, round(importance / max(importance) OVER (), 6) AS share FROM t")
def _(spark, d):
    t = q_risk.sheet(spark, d).select(F.col("name").alias("feature"), F.col("annual_vol").alias("importance"))
    return frames.top_features(t).select("feature", r6("importance").alias("importance"), r6("share").alias("share"))


@query("O5g_scores_by_year_wide", f"{_PRED}{_STACK} SELECT year(date) AS year, " + ", ".join(f"round(sqrt(avg(CASE WHEN model = '{m}' THEN pow(actual - pred, 2) END)), 6) AS {m}" for m in _MODELS) + " FROM st GROUP BY 1")
def _(spark, d):
    t = forecast.yearly_scores(_preds(spark, d), _MODELS)
    wide = t.groupBy("year").pivot("model", _MODELS).agg(F.first("rmse"))
    return wide.select("year", *(r6(m).alias(m) for m in _MODELS))


@query("O8_universe_summary", "SELECT sector, count(*) AS tickers FROM sector GROUP BY 1")
def _(spark, d):
    return B.sector(spark, d).groupBy("sector").agg(F.count("*").alias("tickers"))


@query("O8_correlation_summary", ", c AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0) AS v FROM crets x JOIN crets y USING (date) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL AND x.ticker <> y.ticker GROUP BY 1, 2) SELECT round(avg(v), 6) AS mean_corr, round(max(v), 6) AS max_corr FROM c")
def _(spark, d):
    c = matrix.correlation(B.crets(spark, d)).where("a <> b")
    return c.agg(r6(F.avg("value")).alias("mean_corr"), r6(F.max("value")).alias("max_corr"))


# First variant.
_N1 = q_panel._MONTHLY + ", mf AS (SELECT ticker, month_end, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS close FROM monthly), mr AS (SELECT * FROM (SELECT ticker, month_end, close / lag(close) OVER (PARTITION BY ticker ORDER BY month_end) - 1 AS ret FROM mf) WHERE ret IS NOT NULL)"


def _mr(spark, d):
    return legacy.monthly_returns(panel.to_monthly(B.px(spark, d)))


@query("N1_monthly_returns", f"{_N1} SELECT ticker, month_end, round(ret, 6) AS ret FROM mr")
def _(spark, d):
    return _mr(spark, d).select("ticker", "month_end", r6("ret").alias("ret"))


@query("N2_signed_var", f"SELECT ticker AS name, round(avg(ret) + {tailrisk.z_of(0.95)!r}::double * stddev_samp(ret), 6) AS var FROM rets GROUP BY 1")
def _(spark, d):
    return q_risk.streams(spark, d).groupBy("name").agg(r6(legacy.signed_var()).alias("var"))


_N3 = ", c AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0) AS v FROM crets x JOIN crets y USING (date) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL AND x.ticker < y.ticker GROUP BY 1, 2), sh AS (SELECT ticker, avg(ret) / stddev_samp(ret) AS s FROM rets GROUP BY 1)"


@query("N3_drop_correlated", f"{_N3} SELECT ticker, round(s, 6) AS sharpe FROM sh WHERE ticker NOT IN (SELECT CASE WHEN p.s >= q.s THEN b ELSE a END FROM c JOIN sh p ON p.ticker = a JOIN sh q ON q.ticker = b WHERE v > 0.04)")
def _(spark, d):
    s = B.rets(spark, d).groupBy("ticker").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
    return legacy.drop_correlated(matrix.correlation(B.crets(spark, d)), s, 0.04).select("ticker", r6("sharpe").alias("sharpe"))


@query("N4_minmax_weights", q_risk.SHEET + ", sc AS (SELECT name, (coalesce((sharpe - min(sharpe) OVER ()) / nullif(max(sharpe) OVER () - min(sharpe) OVER (), 0), 0) + coalesce(1 - (annual_vol - min(annual_vol) OVER ()) / nullif(max(annual_vol) OVER () - min(annual_vol) OVER (), 0), 0)) / 2 AS s FROM sheet) SELECT name, round(s, 6) AS score, round(s / sum(s) OVER (), 6) AS weight FROM sc")
def _(spark, d):
    t = q_risk.sheet(spark, d).select("name", "sharpe", "annual_vol")
    return legacy.minmax_weights(t, {"sharpe": True, "annual_vol": False}).select("name", r6("score").alias("score"), r6("weight").alias("weight"))


@query("N5_date_split", "SELECT CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'eval' ELSE 'test' END AS part, count(*) AS n FROM rets GROUP BY 1")
def _(spark, d):
    return legacy.split_by_date(B.rets(spark, d), "1998-12-31", "1999-12-31").groupBy("part").agg(F.count("*").alias("n"))


_N6 = f"""{_N1}, ao AS (SELECT DISTINCT month_end AS as_of FROM mr)
, wn AS (SELECT as_of, ticker, ret FROM ao JOIN mr ON month_end < as_of AND month_end > cast(as_of - interval 37 month as date))
, ws AS (SELECT as_of, ticker, count(ret) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS s, stddev_samp(ret) AS v FROM wn GROUP BY 1, 2)
, fu AS (SELECT as_of FROM ws GROUP BY 1 HAVING count(*) FILTER (n >= 36) = (SELECT count(DISTINCT ticker) FROM mr))
, sc AS (SELECT as_of, ticker, (coalesce((s - min(s) OVER g) / nullif(max(s) OVER g - min(s) OVER g, 0), 0) + coalesce(1 - (v - min(v) OVER g) / nullif(max(v) OVER g - min(v) OVER g, 0), 0)) / 2 AS score FROM ws JOIN fu USING (as_of) WINDOW g AS (PARTITION BY as_of))
, wt AS (SELECT as_of, ticker, score / nullif(sum(score) OVER (PARTITION BY as_of), 0) AS weight FROM sc)
"""


@query("N6_monthly_walk", f"{_N6} SELECT as_of AS month_end, round(sum(weight * ret), 6) AS ret FROM wt JOIN mr ON mr.month_end = as_of AND mr.ticker = wt.ticker GROUP BY 1")
def _(spark, d):
    return legacy.monthly_walk(_mr(spark, d)).select("month_end", r6("ret").alias("ret"))


@query("N7_renormalised", ", s AS (SELECT ticker, abs(avg(ret)) AS w FROM rets GROUP BY 1), k AS (SELECT * FROM s WHERE ticker <= 'Brand#2') SELECT ticker, round(w / sum(w) OVER (), 6) AS weight FROM k")
def _(spark, d):
    w = B.rets(spark, d).groupBy("ticker").agg(F.abs(F.avg("ret")).alias("weight"))
    return legacy.renormalised(w, w.where("ticker <= 'Brand#2'")).select("ticker", r6("weight").alias("weight"))


# The interactive allocation: one date, from the same parts as the walk-forward engine.
@query("O6_build_portfolio", q_walk._weights_sql("score_based") + "SELECT ticker, round(weight, 6) AS weight FROM wt WHERE as_of = (SELECT max(as_of) FROM wt) AND weight > 0")
def _(spark, d):
    from ..operators import alloc, walk

    _, _, sectors, _, train = q_walk.base(spark, d)
    w = alloc.score_based(walk.choose(train, sectors, q_walk.CONFIG), train, alloc.Constraints(max_weight=q_walk.CAP))
    last = w.agg(F.max("as_of").alias("as_of"))
    return w.join(F.broadcast(last), "as_of", "left_semi").where("weight > 0").select("ticker", r6("weight").alias("weight"))


@query("O5b_drawdown_chart", q_risk.SHEET + "SELECT name, date, round(dd, 6) AS dd FROM c1")
def _(spark, d):
    return perf.drawdowns(q_risk.streams(spark, d)).select("name", "date", r6("dd").alias("dd"))


@query("O5c_rolling_sharpe", f"SELECT ticker AS name, date, round(CASE WHEN count(ret) {q_rolling.w(252)} = 252 THEN (avg(ret) {q_rolling.w(252)} - {RF}) / stddev_samp(ret) {q_rolling.w(252)} * sqrt(252::double) END, 6) AS sharpe FROM rets")
def _(spark, d):
    return B.rets(spark, d).select(F.col("ticker").alias("name"), "date", r6(rolling.rolling_sharpe()).alias("sharpe"))
