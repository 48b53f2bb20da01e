"""Queries of stream metrics (M) and tail risk (V). Streams are the brands' returns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..constants import RISK_FREE_ANNUAL, daily_rate
from ..operators import perf, tailrisk
from ..operators.panel import r6
from ..sources import bridge as B
from .registry import query

RF = f"{daily_rate()!r}::double"
Y = "sqrt(252::double)"


def streams(spark, d):
    return B.rets(spark, d).select(F.col("ticker").alias("name"), "date", "ret")


def sheet(spark, d):
    return perf.tearsheet(streams(spark, d), B.mkt(spark, d))


OWN = {
    "cagr": "CASE WHEN count(ret) >= 2 AND product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0::double / count(ret)) - 1 END",
    "annual_return": "avg(ret) * 252",
    "annual_vol": f"stddev_samp(ret) * {Y}",
    "sharpe": f"avg(ret - {RF}) / stddev_samp(ret) * {Y}",
    "sortino": f"avg(ret - {RF}) / sqrt(avg(pow(least(ret - {RF}, 0), 2))) * {Y}",
    "max_drawdown": "min(dd)",
    "calmar": "(pow(product(1 + ret), 252.0::double / count(ret)) - 1) / abs(min(dd))",
    "ulcer": "sqrt(avg(dd * dd))",
    "skew": "skewness(ret)",
    "kurtosis": "kurtosis(ret)",
    "beta": "covar_samp(ret, mkt) / nullif(var_samp(mkt), 0)",
    "alpha": f"(avg(ret) - {RF} - covar_samp(ret, mkt) / nullif(var_samp(mkt), 0) * (avg(mkt) - {RF})) * 252",
    "treynor": f"(avg(ret) * 252 - {RISK_FREE_ANNUAL}::double) / nullif(covar_samp(ret, mkt) / nullif(var_samp(mkt), 0), 0)",
    "information_ratio": f"avg(ret - mkt) / nullif(stddev_samp(ret - mkt), 0) * {Y}",
}
SHEET = (
    ", c0 AS (SELECT r.ticker AS name, r.date, r.ret, m.ret AS mkt, product(1 + r.ret) OVER (PARTITION BY r.ticker ORDER BY r.date ROWS UNBOUNDED PRECEDING) AS curve FROM rets r JOIN mkt m ON m.date = r.date)"
    ", c1 AS (SELECT *, curve / max(curve) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c0)"
    ", mo AS (SELECT name, date_trunc('month', date) AS m, product(1 + ret) - 1 AS r, product(1 + mkt) - 1 AS b FROM c1 GROUP BY 1, 2)"
    ", hr AS (SELECT name, sum(CASE WHEN r > b THEN 1.0::double ELSE 0 END) / (datediff('month', min(m), max(m)) + 1) AS hit_rate FROM mo GROUP BY name)"
    f", sheet AS (SELECT c1.name, count(ret) AS n, {', '.join(f'{v} AS {k}' for k, v in OWN.items())} FROM c1 GROUP BY c1.name)"
)
METRICS = [*OWN, "hit_rate"]

query("M16_tearsheet", f"{SHEET} SELECT name, n, {', '.join(f'round({c}, 6) AS {c}' for c in METRICS)} FROM sheet JOIN hr USING (name)")(lambda spark, d: sheet(spark, d).select("name", "n", *(r6(c).alias(c) for c in METRICS)))


def _metric(key: str, column: str) -> None:
    @query(f"{key}_{column}", f"{SHEET} SELECT name, round({column}, 6) AS {column} FROM sheet JOIN hr USING (name)")
    def _(spark, d):
        return sheet(spark, d).select("name", r6(column).alias(column))


for _key, _name in {
    "M2": "cagr", "M3": "annual_return", "M4": "annual_vol", "M5": "sharpe", "M6": "sortino", "M7": "max_drawdown", "M9": "calmar", "M10": "beta",
    "M11": "alpha", "M12": "treynor", "M13": "information_ratio", "M14": "hit_rate", "M15": "ulcer",
}.items():
    _metric(_key, _name)


@query("M1_daily_rate", f"SELECT round(pow(1 + {RISK_FREE_ANNUAL}::double, 1.0::double / 252) - 1, 12) AS daily_rate")
def _(spark, d):
    return spark.range(1).select(F.round(F.lit(daily_rate()), 12).alias("daily_rate"))


@query("M8_drawdown_series", f"{SHEET} SELECT name, date, round(dd, 6) AS dd FROM c1")
def _(spark, d):
    return perf.drawdowns(streams(spark, d)).select("name", "date", r6("dd").alias("dd"))


def _sums(c: float) -> dict[str, str]:
    z, q = tailrisk.z_of(c), 1 - c
    m = "avg(ret)"
    mom = lambda k: f"(sum(pow(ret - mu, {k})) / count(*))"
    s, k = f"({mom(3)} / pow({mom(2)}, 1.5))", f"({mom(4)} / pow({mom(2)}, 2) - 3)"
    cf = f"({z!r}::double + ({z * z - 1!r}::double) * {s} / 6 + ({z**3 - 3 * z!r}::double) * {k} / 24 - ({2 * z**3 - 5 * z!r}::double) * {s} * {s} / 36)"
    return {
        "parametric": f"-({m} + {z!r}::double * stddev_samp(ret))",
        "historical": f"-quantile_cont(ret, {q!r}::double)",
        "cornish_fisher": f"-({m} + {cf} * stddev_samp(ret))",
        "cvar": "-avg(CASE WHEN ret <= cut THEN ret END)",
    }


def _base(c: float) -> str:
    return f", q{c * 100:.0f} AS (SELECT ticker AS name, quantile_cont(ret, {1 - c!r}::double) AS cut, avg(ret) AS mu FROM rets GROUP BY 1), s{c * 100:.0f} AS (SELECT r.ticker AS name, r.ret, q.cut, q.mu FROM rets r JOIN q{c * 100:.0f} q ON q.name = r.ticker)"


def _estimate(key: str, column: str, make) -> None:
    @query(f"{key}_{column}", f"{_base(0.95)} SELECT name, round({_sums(0.95)[column]}, 6) AS {column} FROM s95 GROUP BY name")
    def _(spark, d):
        return make(streams(spark, d)).select("name", r6(column).alias(column))


_estimate("V1", "parametric", lambda s: s.groupBy("name").agg(tailrisk.parametric().alias("parametric")))
_estimate("V2", "historical", lambda s: s.groupBy("name").agg(tailrisk.historical().alias("historical")))
_estimate("V3", "cornish_fisher", lambda s: s.groupBy("name").agg(tailrisk.cornish_fisher().alias("cornish_fisher")))
_estimate("V5", "cvar", tailrisk.conditional)

_COLS = ("parametric", "historical", "cornish_fisher", "cvar")


@query("V6_var_summary", _base(0.95) + _base(0.99) + " UNION ALL ".join(f" SELECT name, '{c:.0%}' AS confidence, {', '.join(f'round({v}, 6) AS {k}' for k, v in _sums(c).items())} FROM s{c * 100:.0f} GROUP BY name" for c in (0.95, 0.99)))
def _(spark, d):
    return tailrisk.var_summary(streams(spark, d), simulate=False).select("name", "confidence", *(r6(c).alias(c) for c in _COLS))


@query("V4_monte_carlo")
def _(spark, d):
    return tailrisk.monte_carlo(streams(spark, d), horizon=5)


@query("V7_var_in_money", f"{_base(0.95)} SELECT name, round({_sums(0.95)['historical']} * 1000, 3) AS amount FROM s95 GROUP BY name")
def _(spark, d):
    return streams(spark, d).groupBy("name").agg(F.round(tailrisk.in_money(tailrisk.historical(), 1000.0), 3).alias("amount"))


@query("V8_annualised_var", f"{_base(0.95)} SELECT name, round({_sums(0.95)['historical']} * {Y}, 6) AS annual_var FROM s95 GROUP BY name")
def _(spark, d):
    return streams(spark, d).groupBy("name").agg(r6(tailrisk.annualised(tailrisk.historical())).alias("annual_var"))


def _forecast(c: float, method: str, out: str) -> str:
    w = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    value = f"-quantile_cont(ret, {1 - c!r}::double) {w}" if method == "historical" else f"-(avg(ret) {w} + {tailrisk.z_of(c)!r}::double * stddev_samp(ret) {w})"
    tests = f"""{out}b AS (SELECT *, lag(b) OVER (PARTITION BY name ORDER BY date) AS prev FROM (SELECT *, CASE WHEN round(ret, 10) < round(-var, 10) THEN 1 ELSE 0 END AS b FROM {out}))
, {out}t AS (SELECT name, count(*)::double AS n, sum(b)::double AS x, count(*) FILTER (prev = 0 AND b = 0)::double AS n00, count(*) FILTER (prev = 0 AND b = 1)::double AS n01, count(*) FILTER (prev = 1 AND b = 0)::double AS n10, count(*) FILTER (prev = 1 AND b = 1)::double AS n11 FROM {out}b GROUP BY name)"""
    return f", {out} AS (SELECT name, date, ret, var FROM (SELECT ticker AS name, date, ret, {value} AS var, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM rets) WHERE k > 252), {tests}"


def _ll(stay: str, go: str, p: str) -> str:
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN {stay} * ln(1 - {p}) + {go} * ln({p}) ELSE 0 END)"


def _tests(c: float) -> str:
    p = 1 - c
    alt = "(CASE WHEN x < n THEN (n - x) * ln(1 - x / n) ELSE 0 END + CASE WHEN x > 0 THEN x * ln(x / n) ELSE 0 END)"
    pi, p01, p11 = "((n01 + n11) / (n00 + n01 + n10 + n11))", "(n01 / nullif(n00 + n01, 0))", "(n11 / nullif(n10 + n11, 0))"
    ind = f"CASE WHEN n00 + n01 = 0 OR n10 + n11 = 0 OR n01 + n11 = 0 THEN 0 ELSE greatest(0, -2 * ({_ll('(n00 + n10)', '(n01 + n11)', pi)} - {_ll('n00', 'n01', p01)} - {_ll('n10', 'n11', p11)})) END"
    kup = f"-2 * ((n - x) * ({math.log(1 - p)!r}::double) + x * ({math.log(p)!r}::double) - {alt})"
    return f"n::bigint AS n_obs, x::bigint AS n_breaches, round(n * {p!r}::double, 6) AS expected, round(x / n, 6) AS breach_rate, round({kup}, 6) AS kupiec_lr, round(({ind})::double, 6) AS independence_lr"


def _rounded(t):
    return t.select(*(c for c in t.columns if c in ("name", "model", "n_obs", "n_breaches")), *(r6(c).alias(c) for c in ("expected", "breach_rate", "kupiec_lr", "independence_lr")))


@query("V9_V10_V11_coverage", f"{_forecast(0.95, 'parametric', 'f')} SELECT name, {_tests(0.95)} FROM ft")
def _(spark, d):
    return _rounded(tailrisk.evaluate(tailrisk.rolling_forecasts(streams(spark, d), 252, 0.95, "parametric"), 0.95))


@query("V12_verdicts")
def _(spark, d):
    return tailrisk.with_p_values(tailrisk.backtest_table(streams(spark, d)))


@query("V13_rolling_historical", f"{_forecast(0.95, 'historical', 'f')} SELECT name, date, round(var, 6) AS var FROM f")
def _(spark, d):
    return tailrisk.rolling_forecasts(streams(spark, d)).select("name", "date", r6("var").alias("var"))


_FOUR = [("historical", 0.95), ("historical", 0.99), ("parametric", 0.95), ("parametric", 0.99)]


@query("V14_backtest_table", "".join(_forecast(c, m, f"f{i}") for i, (m, c) in enumerate(_FOUR)) + " UNION ALL ".join(f" SELECT name, '{m} {c:.0%}' AS model, {_tests(c)} FROM f{i}t" for i, (m, c) in enumerate(_FOUR)))
def _(spark, d):
    return _rounded(tailrisk.backtest_table(streams(spark, d)))


@query("V15_breach_series", f"{_forecast(0.95, 'historical', 'f')} SELECT name, date, round(ret, 6) AS ret, round(var, 6) AS var, b = 1 AS breach FROM fb")
def _(spark, d):
    return tailrisk.breach_series(streams(spark, d)).select("name", "date", r6("ret").alias("ret"), r6("var").alias("var"), "breach")
