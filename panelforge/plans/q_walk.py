"""Queries of scoring and selection (S), allocation (P) and the walk-forward engine (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PROFILES, daily_rate
from ..operators import alloc, panel, select, walk
from ..operators.panel import r6
from ..sources import bridge as B
from .registry import query

RF = f"{daily_rate()!r}::double"
Y = "sqrt(252::double)"
CONFIG = walk.BacktestConfig(n_select=15, per_sector=4)
CAP, LEAST = CONFIG.profile.max_weight, CONFIG.profile.min_positions

# SQL: rebalances, windows, metrics.
REB = """, ends AS (SELECT min(date) AS first, max(date) AS last FROM mkt)
, bins AS (SELECT max(m.date) AS as_of FROM mkt m, ends GROUP BY ceil(((year(m.date) * 12 + month(m.date)) - (year(first) * 12 + month(first))) / 3.0))
, reb AS (SELECT as_of, coalesce(lead(as_of) OVER (ORDER BY as_of), last) AS next_date FROM bins, ends WHERE as_of >= cast(first + interval 36 month as date) AND as_of < last)
"""
TRAIN = f"""{REB}, win0 AS (SELECT r.as_of, c.ticker, c.date, c.ret FROM reb r JOIN crets c ON c.date > cast(r.as_of - interval 36 month as date) AND c.date <= r.as_of)
, cov0 AS (SELECT as_of, ticker FROM win0 GROUP BY 1, 2 HAVING count(ret) >= floor(0.9 * count(*)))
, enough AS (SELECT as_of FROM cov0 GROUP BY 1 HAVING count(*) >= {LEAST})
, win AS (SELECT w.as_of, w.ticker, w.date, w.ret, m.ret AS mkt FROM win0 w JOIN cov0 USING (as_of, ticker) JOIN enough USING (as_of) LEFT JOIN mkt m ON m.date = w.date)
"""
MET = f"""{TRAIN}, cv AS (SELECT *, product(1 + coalesce(ret, 0)) OVER o AS curve, row_number() OVER (PARTITION BY as_of, ticker ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY as_of, ticker) AS n FROM win WINDOW o AS (PARTITION BY as_of, ticker ORDER BY date ROWS UNBOUNDED PRECEDING))
, cd AS (SELECT *, curve / max(curve) OVER (PARTITION BY as_of, ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, least(252, n) AS mw FROM cv)
, met AS (SELECT as_of, ticker, avg(ret) * 252 AS mean_return, stddev_samp(ret) * {Y} AS volatility, (avg(ret) - {RF}) / nullif(stddev_samp(ret), 0) * {Y} AS sharpe,
  (avg(ret) - {RF}) * 252 / nullif(sqrt(avg(pow(CASE WHEN ret < 0 THEN ret ELSE 0 END, 2))) * {Y}, 0) AS sortino,
  covar_samp(ret, mkt) / nullif(var_samp(mkt), 0) AS beta, (avg(ret) * 252 - 0.065::double) / nullif(covar_samp(ret, mkt) / nullif(var_samp(mkt), 0), 0) AS treynor,
  min(dd) AS max_dd, -quantile_cont(ret, {1 - 0.95!r}::double) AS var_95, -quantile_cont(ret, {1 - 0.99!r}::double) AS var_99,
  max(CASE WHEN k = n - 1 - least(21, mw // 4) THEN curve END) / max(CASE WHEN k = greatest(0, n - mw) THEN curve END) - 1 AS momentum, count(ret) AS n_obs
  FROM cd GROUP BY 1, 2 HAVING count(ret) >= 200)
"""


def _z(c: str) -> str:
    return f"(CASE WHEN coalesce(stddev_samp({c}) OVER p, 0) = 0 THEN 0 WHEN {c} IS NOT NULL THEN greatest(-3, least(3, ({c} - avg({c}) OVER p) / stddev_samp({c}) OVER p)) END)"


def _score(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"({w!r}::double) * {_z(c)}" for c, w in weights.items()) + f") / {sum(map(abs, weights.values()))!r}::double"


SCORE = f"{MET}, sc AS (SELECT *, {_score(CONFIG.profile.weights)} AS score FROM met WINDOW p AS (PARTITION BY as_of))"
GREEDY = f"""{SCORE}, rk AS (SELECT as_of, ticker, score, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS place FROM sc WHERE score IS NOT NULL)
, cr AS (SELECT x.as_of, x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0) AS c FROM win x JOIN win y ON y.as_of = x.as_of AND y.date = x.date AND x.ticker <> y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2, 3)
, bl AS (SELECT p.as_of, p.place, p.ticker, p.score, coalesce(list(c.b) FILTER (c.b IS NOT NULL AND (c.c IS NULL OR abs(c.c) >= {{threshold}})), []) AS blockers FROM rk p LEFT JOIN cr c ON c.as_of = p.as_of AND c.a = p.ticker GROUP BY 1, 2, 3, 4)
, gr AS (SELECT as_of, place, [ticker] AS kept FROM bl WHERE place = 1
  UNION ALL SELECT b.as_of, b.place, CASE WHEN list_has_any(g.kept, b.blockers) THEN g.kept ELSE list_append(g.kept, b.ticker) END FROM gr g JOIN bl b ON b.as_of = g.as_of AND b.place = g.place + 1)
, kept AS (SELECT as_of, unnest(arg_max(kept, place)) AS ticker FROM gr GROUP BY as_of)
"""
CHOSEN = (
    GREEDY.format(threshold="0.85")
    + f""", s1 AS (SELECT k.as_of, k.ticker, s.score, s.mean_return, row_number() OVER (PARTITION BY k.as_of, coalesce(x.sector, 'UNKNOWN') ORDER BY s.score DESC, k.ticker) AS r FROM kept k JOIN sc s ON s.as_of = k.as_of AND s.ticker = k.ticker LEFT JOIN sector x ON x.ticker = k.ticker)
, s2 AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS q FROM s1 WHERE r <= 4)
, s3 AS (SELECT as_of, ticker, score, mean_return FROM s2 WHERE q <= 15), ok AS (SELECT as_of FROM s3 GROUP BY 1 HAVING count(*) >= {LEAST})
, chosen AS (SELECT s3.* FROM s3 JOIN ok USING (as_of) UNION ALL SELECT as_of, ticker, score, mean_return FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS q FROM sc WHERE score IS NOT NULL) WHERE q <= 15 AND as_of NOT IN (SELECT as_of FROM ok))
"""
)


def _caps(source: str, out: str, cap: float = CAP) -> str:
    return f""", {out}0 AS (SELECT *, count(*) OVER g AS n, sum(raw) OVER g AS total FROM {source} WINDOW g AS (PARTITION BY as_of))
, {out}1 AS (SELECT *, CASE WHEN total > 0 THEN raw / total ELSE 1.0 / n END AS w, greatest({cap}::double, 1.0::double / n) AS cap FROM {out}0)
, {out}2 AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY w DESC, ticker) - 1 AS k, sum(w) OVER (PARTITION BY as_of ORDER BY w DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM {out}1)
, {out}3 AS (SELECT *, min(CASE WHEN (1 - k * cap) / tail * w <= cap + 1e-12 THEN k END) OVER (PARTITION BY as_of) AS cut FROM {out}2)
, {out} AS (SELECT as_of, ticker, CASE WHEN cut IS NULL OR k < cut THEN cap ELSE w * max(CASE WHEN k = cut THEN (1 - k * cap) / tail END) OVER (PARTITION BY as_of) END AS weight FROM {out}3)
"""


RAW = {
    "equal_weight": ", raws AS (SELECT as_of, ticker, 1.0::double AS raw FROM chosen)",
    "inverse_vol": ", raws AS (SELECT c.as_of, c.ticker, coalesce(1 / nullif(v.s, 0), 0) AS raw FROM chosen c LEFT JOIN (SELECT as_of, ticker, stddev_samp(ret) AS s FROM win GROUP BY 1, 2) v USING (as_of, ticker))",
    "score_based": ", raws AS (SELECT as_of, ticker, exp(greatest(-10, least(10, CASE WHEN stddev_samp(score) OVER g > 0 THEN (score - avg(score) OVER g) / stddev_samp(score) OVER g ELSE 0 END))) AS raw FROM chosen WINDOW g AS (PARTITION BY as_of))",
}


def _weights_sql(name: str) -> str:
    return CHOSEN + RAW[name] + _caps("raws", "wt")


def _engine_sql(name: str) -> str:
    return (
        _weights_sql(name)
        + """, hv AS (SELECT w.as_of, w.ticker, c.date, w.weight, w.weight * product(1 + coalesce(c.ret, 0)) OVER (PARTITION BY w.as_of, w.ticker ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS value FROM wt w JOIN reb r USING (as_of) JOIN crets c ON c.ticker = w.ticker AND c.date > r.as_of AND c.date <= r.next_date)
, tot AS (SELECT as_of, date, sum(value) AS total, sum(weight) AS start FROM hv GROUP BY 1, 2)
, per AS (SELECT as_of, date, total / coalesce(lag(total) OVER (PARTITION BY as_of ORDER BY date), start) - 1 AS ret, row_number() OVER (PARTITION BY as_of ORDER BY date) AS k FROM tot)
, lastv AS (SELECT as_of, ticker, arg_max(value, date) AS v FROM hv GROUP BY 1, 2), dr AS (SELECT as_of, ticker, v / sum(v) OVER (PARTITION BY as_of) AS drifted FROM lastv)
, done AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nxt FROM (SELECT DISTINCT as_of FROM wt)), prior AS (SELECT nxt AS as_of, ticker, drifted FROM dr JOIN done USING (as_of) WHERE nxt IS NOT NULL)
, cost AS (SELECT as_of, sum(abs(coalesce(weight, 0) - coalesce(drifted, 0))) AS traded, count(weight) AS holdings FROM wt FULL JOIN prior USING (as_of, ticker) GROUP BY 1)
, daily AS (SELECT date, ret - CASE WHEN k = 1 THEN traded * 15 / 10000 ELSE 0 END AS net, ret AS gross FROM per JOIN cost USING (as_of))
"""
    )


def base(spark, d):
    """returns, market, sectors, dates, train."""
    returns, market = B.crets(spark, d), B.mkt(spark, d)
    dates = walk.rebalance_dates(market)
    train = walk.enough_names(walk.training_windows(returns, market, dates), LEAST)
    return returns, market, B.sector(spark, d), dates, train


@query("B1_rebalance_dates", REB + "SELECT * FROM reb")
def _(spark, d):
    return walk.rebalance_dates(B.mkt(spark, d))


@query("B2_training_windows", TRAIN + "SELECT as_of, ticker, count(*) AS n_days, count(ret) AS n_obs, min(date) AS first_date, max(date) AS last_date FROM win GROUP BY 1, 2")
def _(spark, d):
    return base(spark, d)[4].groupBy("as_of", "ticker").agg(F.count("*").alias("n_days"), F.count("ret").alias("n_obs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("B3_enough_names", TRAIN + "SELECT as_of, count(DISTINCT ticker) AS names FROM win GROUP BY 1")
def _(spark, d):
    return base(spark, d)[4].groupBy("as_of").agg(F.countDistinct("ticker").alias("names"))


@query("S1_window_metrics", MET + f"SELECT as_of, ticker, n_obs, {', '.join(f'round({m}, 6) AS {m}' for m in select.METRICS)} FROM met")
def _(spark, d):
    return select.window_metrics(base(spark, d)[4]).select("as_of", "ticker", "n_obs", *(r6(m).alias(m) for m in select.METRICS))


@query("S2_zscore", MET + f"SELECT as_of, ticker, round({_z('sharpe')}, 6) AS z FROM met WINDOW p AS (PARTITION BY as_of)")
def _(spark, d):
    return select.window_metrics(base(spark, d)[4]).select("as_of", "ticker", r6(select.zscore("sharpe")).alias("z"))


def _scored(name: str) -> None:
    @query(f"S3_S4_score_{name}", MET + f"SELECT as_of, ticker, round({_score(PROFILES[name].weights)}, 6) AS score FROM met WINDOW p AS (PARTITION BY as_of)")
    def _(spark, d):
        return select.rank_stocks(base(spark, d)[4], PROFILES[name].weights).select("as_of", "ticker", r6("score").alias("score"))


for _name in PROFILES:
    _scored(_name)


@query("S7_correlation_filter", GREEDY.format(threshold="0.05") + "SELECT as_of, ticker FROM kept")
def _(spark, d):
    train = base(spark, d)[4]
    return select.correlation_filter(select.rank_stocks(train, CONFIG.profile.weights), train, 0.05).select("as_of", "ticker")


@query("S8_S9_candidates", CHOSEN + "SELECT as_of, ticker, round(score, 6) AS score FROM chosen")
def _(spark, d):
    _, _, sectors, _, train = base(spark, d)
    return walk.choose(train, sectors, CONFIG).select("as_of", "ticker", r6("score").alias("score"))


_CAPS_IN = ", raws AS (SELECT as_of, ticker, greatest(volatility * volatility * volatility, 0) AS raw FROM met)"


@query("S5_S6_apply_caps", MET + _CAPS_IN + _caps("raws", "wt", 0.05) + "SELECT as_of, ticker, round(weight, 6) AS weight FROM wt")
def _(spark, d):
    m = select.window_metrics(base(spark, d)[4]).select("as_of", "ticker", F.pow("volatility", 3).alias("raw"))
    return alloc.apply_caps(m, 0.05).select("as_of", "ticker", r6("weight").alias("weight"))


@query("P7_clean", MET + ", c AS (SELECT as_of, ticker, CASE WHEN sharpe >= 1e-6 THEN sharpe ELSE 0 END AS k FROM met) SELECT as_of, ticker, round(CASE WHEN sum(k) OVER g > 0 THEN k / sum(k) OVER g ELSE 1.0 / count(*) OVER g END, 6) AS weight FROM c WINDOW g AS (PARTITION BY as_of)")
def _(spark, d):
    m = select.window_metrics(base(spark, d)[4]).select("as_of", "ticker", F.col("sharpe").alias("weight"))
    return alloc.clean(m).select("as_of", "ticker", r6("weight").alias("weight"))


def _closed(key: str, name: str) -> None:
    @query(f"{key}_{name}", _weights_sql(name) + "SELECT as_of, ticker, round(weight, 6) AS weight FROM wt")
    def _(spark, d):
        _, _, sectors, _, train = base(spark, d)
        chosen = walk.choose(train, sectors, CONFIG)
        return alloc.ALLOCATORS[name](chosen, train, alloc.Constraints(max_weight=CAP)).select("as_of", "ticker", r6("weight").alias("weight"))


for _key, _name in (("P1", "equal_weight"), ("P2", "inverse_vol"), ("P6", "score_based")):
    _closed(_key, _name)


def _solved(key: str, name: str) -> None:
    @query(f"{key}_{name}")
    def _(spark, d):
        _, _, sectors, _, train = base(spark, d)
        chosen = walk.choose(train, sectors, CONFIG)
        rows = {r["ticker"]: r["sector"] for r in sectors.collect()}
        return alloc.ALLOCATORS[name](chosen, train, alloc.Constraints(max_weight=CAP, sectors=rows))


for _key, _name in (("P3", "min_variance"), ("P4", "risk_parity"), ("P5", "max_sharpe")):
    _solved(_key, _name)


@query("P10_allocators", "SELECT name FROM (VALUES ('equal_weight'), ('inverse_vol'), ('min_variance'), ('risk_parity'), ('max_sharpe'), ('score_based')) t(name)")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in alloc.ALLOCATORS], "name string")


def run(spark, d, name: str, **kw) -> walk.BacktestResult:
    from dataclasses import replace

    return walk.run_backtest(B.crets(spark, d), B.mkt(spark, d), B.sector(spark, d), replace(CONFIG, allocator=name, **kw))


def _backtest(name: str, sql: bool) -> None:
    @query(f"B7_backtest_{name}", _engine_sql(name) + "SELECT date, round(net, 6) AS net, round(gross, 6) AS gross FROM daily" if sql else None)
    def _(spark, d):
        return run(spark, d, name).daily.select("date", r6("net").alias("net"), r6("gross").alias("gross"))


for _name in alloc.ALLOCATORS:
    _backtest(_name, _name in RAW)


@query("B4_drifted_weights", _engine_sql("equal_weight") + "SELECT as_of, ticker, round(drifted, 6) AS drifted FROM dr")
def _(spark, d):
    returns, market, sectors, dates, train = base(spark, d)
    w = alloc.equal_weight(walk.choose(train, sectors, CONFIG), train, alloc.Constraints(max_weight=CAP))
    return walk.drifted_weights(walk.holding_values(w.select("as_of", "ticker", "weight"), returns, dates)).select("as_of", "ticker", r6("drifted").alias("drifted"))


@query("B5_costs", _engine_sql("score_based") + "SELECT as_of, round(traded, 6) AS traded, round(traded / 2, 6) AS turnover, round(traded * 15 / 10000, 6) AS cost, holdings FROM cost")
def _(spark, d):
    c = run(spark, d, "score_based").costs
    return c.select("as_of", *(r6(x).alias(x) for x in ("traded", "turnover", "cost")), "holdings")


@query("B8_as_of_lookup", REB + ", f AS (SELECT ticker, date, ret FROM rets WHERE day(date) <= 3) SELECT r.as_of, f.ticker, round(arg_max(f.ret, f.date), 6) AS ret FROM reb r JOIN f ON f.date <= r.as_of GROUP BY 1, 2")
def _(spark, d):
    market = B.mkt(spark, d)
    facts = B.rets(spark, d).where("day(date) <= 3")
    return walk.as_of_values(facts, market, walk.rebalance_dates(market), "ret").select("as_of", "ticker", r6("ret").alias("ret"))


@query("B9_cost_drag", _engine_sql("equal_weight") + "SELECT round(pow(product(1 + gross), 252.0::double / count(*)) - pow(product(1 + net), 252.0::double / count(*)), 6) AS cost_drag FROM daily")
def _(spark, d):
    return run(spark, d, "equal_weight").total_cost_drag().select(r6("cost_drag").alias("cost_drag"))


@query("B9_equity_curve", _engine_sql("equal_weight") + "SELECT date, round(product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS value FROM daily")
def _(spark, d):
    return run(spark, d, "equal_weight").equity_curve().select("date", r6("value").alias("value"))


@query("B10_buy_and_hold", _engine_sql("equal_weight") + "SELECT d.date, round(coalesce(m.ret, 0), 6) AS ret FROM daily d LEFT JOIN mkt m ON m.date = d.date")
def _(spark, d):
    return walk.buy_and_hold(B.mkt(spark, d), run(spark, d, "equal_weight").daily).select("date", r6("ret").alias("ret"))


@query("B11_common_window", ", s AS (SELECT ticker AS name, date, ret FROM crets WHERE ret IS NOT NULL) SELECT name, date, round(ret, 6) AS ret FROM s WHERE date IN (SELECT date FROM s GROUP BY date HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM s))")
def _(spark, d):
    s = B.crets(spark, d).where("ret IS NOT NULL").withColumnRenamed("ticker", "name")
    return panel.common_dates(s).select("name", "date", r6("ret").alias("ret"))


def _variant(key: str, name: str, forecasts: bool = False, **kw) -> None:
    @query(f"B7_{key}")
    def _(spark, d):
        from dataclasses import replace

        from . import q_rolling

        vols = q_rolling.features(spark, d).select("date", "ticker", F.col("ewma_94").alias("vol")) if forecasts else None
        result = walk.run_backtest(B.crets(spark, d), B.mkt(spark, d), B.sector(spark, d), replace(CONFIG, allocator=name, **kw), vols)
        return result.daily.select("date", r6("net").alias("net"), r6("gross").alias("gross"))


_variant("min_variance_sample", "min_variance", cov_estimator="sample")
_variant("min_variance_forecast", "min_variance", forecasts=True)
_variant("risk_parity_forecast", "risk_parity", forecasts=True)
for _name in PROFILES:
    _variant(f"profile_{_name}", "score_based", profile=PROFILES[_name])
