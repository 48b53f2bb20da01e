"""Queries of built portfolios (O7), report frames and stored results (A, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alloc, frames, matrix, panel, results, select, tailrisk, walk
from ..operators.panel import r6
from ..operators.stage import staged, stage_path
from ..sources import bridge as B
from . import q_matrix, q_panel, q_risk, q_walk
from .registry import query

CAPITAL = 1_000_000.0

_LAST = q_walk._weights_sql("score_based") + ", lastw AS (SELECT ticker, weight FROM wt WHERE as_of = (SELECT max(as_of) FROM wt) AND weight > 0), lastm AS (SELECT * FROM met WHERE as_of = (SELECT max(as_of) FROM wt)), lastr AS (SELECT w.ticker, w.date, w.ret FROM win w JOIN lastw USING (ticker) WHERE as_of = (SELECT max(as_of) FROM wt))"


def _portfolio(spark, d):
    """Weights, metrics and training returns of the last rebalance."""
    _, _, sectors, _, train = q_walk.base(spark, d)
    chosen = walk.choose(train, sectors, q_walk.CONFIG)
    last = F.broadcast(chosen.agg(F.max("as_of").alias("as_of")))
    train = train.join(last, "as_of", "left_semi")
    w = alloc.score_based(chosen.join(last, "as_of", "left_semi"), train, alloc.Constraints(max_weight=q_walk.CAP)).where("weight > 0")
    return staged(w.select("ticker", "weight"), "last-weights"), select.window_metrics(train), train, sectors


@query("O7_allocation_table", f"{_LAST} SELECT w.ticker, round(weight, 6) AS weight, round(weight * {CAPITAL}, 3) AS amount, coalesce(x.sector, '—') AS sector, round(m.sharpe, 6) AS sharpe, round(m.volatility, 6) AS volatility, round(m.beta, 6) AS beta FROM lastw w LEFT JOIN sector x USING (ticker) LEFT JOIN lastm m ON m.ticker = w.ticker")
def _(spark, d):
    w, metrics, _, sectors = _portfolio(spark, d)
    t = results.allocation_table(w, metrics, sectors, CAPITAL)
    return t.select("ticker", r6("weight").alias("weight"), F.round("amount", 3).alias("amount"), "sector", *(r6(c).alias(c) for c in ("sharpe", "volatility", "beta")))


_RHO = q_matrix._LW_RHO.replace("FROM crets", "FROM lastr")


@query("O7_portfolio_estimates", f"{_LAST}{_RHO}, est AS (SELECT sqrt(sum(p.weight * q.weight * ((1 - rho) * s + CASE WHEN a = b THEN rho * mu ELSE 0 END) * 252)) AS v FROM pop, rho, lastw p, lastw q WHERE p.ticker = a AND q.ticker = b), ret AS (SELECT count(*) AS holdings, sum(weight * mean_return) AS r FROM lastw LEFT JOIN lastm USING (ticker)) SELECT holdings, round(r, 6) AS est_return, round(v, 6) AS est_vol, round((r - 0.065::double) / v, 6) AS est_sharpe FROM ret, est")
def _(spark, d):
    w, metrics, train, _ = _portfolio(spark, d)
    cov = matrix.ledoit_wolf_cov(train.join(w.select("ticker"), "ticker", "left_semi").select("ticker", "date", "ret"))
    t = results.portfolio_estimates(w, metrics, cov.withColumn("value", F.col("value") * 252))
    return t.select("holdings", *(r6(c).alias(c) for c in ("est_return", "est_vol", "est_sharpe")))


@query("O7_money_at_risk", f"{_LAST}, ser AS (SELECT date, sum(weight * coalesce(ret, 0)) AS r FROM lastr JOIN lastw USING (ticker) GROUP BY 1), q AS (SELECT quantile_cont(r, {1 - 0.95!r}::double) AS a, quantile_cont(r, {1 - 0.99!r}::double) AS b FROM ser) SELECT round(-max(a) * {CAPITAL}, 2) AS var_95, round(-max(b) * {CAPITAL}, 2) AS var_99, round(-avg(r) FILTER (r <= a) * {CAPITAL}, 2) AS cvar_95 FROM ser, q")
def _(spark, d):
    w, _, train, _ = _portfolio(spark, d)
    t = results.money_at_risk(results.portfolio_series(train, w), CAPITAL)
    return t.select(*(F.round(c, 2).alias(c) for c in t.columns))


@query("O5i_mean_turnover", q_walk._engine_sql("score_based") + "SELECT 'score_based' AS name, round(avg(traded / 2), 6) AS turnover FROM cost")
def _(spark, d):
    costs = q_walk.run(spark, d, "score_based").costs.withColumn("name", F.lit("score_based"))
    return frames.mean_turnover(costs).select("name", r6("turnover").alias("turnover"))


@query("O5j_heat_map", "SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0), 6) AS value FROM crets x JOIN crets y USING (date) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL AND x.ticker IN (SELECT DISTINCT ticker FROM crets ORDER BY ticker LIMIT 12) AND y.ticker IN (SELECT DISTINCT ticker FROM crets ORDER BY ticker LIMIT 12) GROUP BY 1, 2")
def _(spark, d):
    return frames.heat_map(B.crets(spark, d), most=12).select("a", "b", r6("value").alias("value"))


_NAMED = {"first half (1995)": ("1995-03-01", "1995-06-30"), "late (2000-01)": ("2000-01-01", "2001-12-31")}


@query("O5k_stress_frame", ", w(\"window\", a, b) AS (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in _NAMED.items()) + ") SELECT replace(w.\"window\", ' (', chr(10) || '(') AS \"window\", " + ", ".join(f"(SELECT round(product(1 + r.ret) - 1, 6) FROM rets r WHERE r.ticker = '{t}' AND r.date BETWEEN w.a AND w.b) AS \"{t}\"" for t in q_panel.BRANDS) + " FROM w")
def _(spark, d):
    t = frames.stress_frame(frames.stress_test(q_risk.streams(spark, d), _NAMED), q_panel.BRANDS)
    return t.select("window", *(F.round(F.col(f"`{b}`"), 6).alias(b) for b in q_panel.BRANDS))


@query("O2_comparison_order", q_risk.SHEET + "SELECT name, round(annual_vol, 6) AS annual_vol, round(sharpe, 6) AS sharpe, round(beta, 6) AS beta, round(hit_rate, 6) AS hit_rate, n FROM sheet JOIN hr USING (name)")
def _(spark, d):
    t = frames.comparison_table(q_risk.sheet(spark, d).select("n", "hit_rate", "beta", "sharpe", "annual_vol", "name"))
    return t.select("name", *(r6(c).alias(c) for c in t.columns if c not in ("name", "n")), "n")


@query("O8_sector_medians", q_risk.SHEET + "SELECT sector, round(median(annual_return), 6) AS median_return, round(median(annual_vol), 6) AS median_vol FROM sheet JOIN sector ON ticker = name GROUP BY 1")
def _(spark, d):
    t = q_risk.sheet(spark, d).join(B.sector(spark, d).withColumnRenamed("ticker", "name"), "name")
    return t.groupBy("sector").agg(*(r6(F.median(c)).alias(k) for c, k in (("annual_return", "median_return"), ("annual_vol", "median_vol"))))


@query("O8_risk_return_scatter", q_risk.SHEET + "SELECT name, round(annual_vol, 6) AS risk, round(annual_return, 6) AS ret, sector FROM sheet LEFT JOIN sector ON ticker = name")
def _(spark, d):
    t = q_risk.sheet(spark, d).join(B.sector(spark, d).withColumnRenamed("ticker", "name"), "name", "left")
    return t.select("name", r6("annual_vol").alias("risk"), r6("annual_return").alias("ret"), "sector")


def _stored(kind: str) -> None:
    @query(f"A6_O9_{kind}_round_trip", q_risk.SHEET + "SELECT name, n, round(sharpe, 6) AS sharpe FROM sheet")
    def _(spark, d):
        path = stage_path(spark, f"result-{kind}")
        results.write_result(q_risk.sheet(spark, d).select("name", "n", r6("sharpe").alias("sharpe")), path, kind)
        return results.read_result(spark, path, kind).select("name", F.col("n").cast("long").alias("n"), F.col("sharpe").cast("double").alias("sharpe"))


for _kind in ("parquet", "csv", "json"):
    _stored(_kind)


@query("A1_read_or_build", "SELECT ticker, date, open, close, volume::bigint AS volume FROM bars")
def _(spark, d):
    path = stage_path(spark, "bars")
    for _ in range(2):  # the second reads what the first has written
        rows = panel.read_or_build(spark, path, lambda s: B.bars(s, d))
    return rows.select("ticker", "date", "open", "close", F.col("volume").cast("long").alias("volume"))


@query("O10_rendered_lines", q_risk.SHEET + ", t AS (SELECT name, printf('%.2f', round(sharpe, 6)) AS s FROM sheet) SELECT '| ' || name || ' | ' || s || ' |' AS line FROM t")
def _(spark, d):
    path = stage_path(spark, "sheet")
    results.write_result(q_risk.sheet(spark, d).select("name", r6("sharpe").alias("sharpe")), path, "csv")
    text = results.render_document(spark, "# Report\n<!-- SHEET -->\n<!-- LOST -->", {"SHEET": path, "LOST": f"{path}-lost"}, ratios=["sharpe"])
    lines = [x for x in text.splitlines() if x.startswith("| Brand")]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("V12_joint_verdict", "".join(q_risk._forecast(c, m, f"f{i}") for i, (m, c) in enumerate(q_risk._FOUR)) + ", v AS (" + " UNION ALL ".join(f"SELECT name, '{m} {c:.0%}' AS model, {q_risk._tests(c)} FROM f{i}t" for i, (m, c) in enumerate(q_risk._FOUR)) + ") SELECT name, model, round(exp(-(kupiec_lr + independence_lr) / 2), 5) AS cc_p, CASE WHEN exp(-(kupiec_lr + independence_lr) / 2) > 0.05 THEN 'PASS' ELSE 'REJECT' END AS verdict FROM v")
def _(spark, d):
    return tailrisk.with_p_values(q_risk._rounded(tailrisk.backtest_table(q_risk.streams(spark, d)))).select("name", "model", F.round("cc_p", 5).alias("cc_p"), "verdict")


@query("V6_with_simulation")
def _(spark, d):
    return tailrisk.var_summary(q_risk.streams(spark, d))



