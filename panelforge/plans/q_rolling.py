"""Queries of rolling features (W)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..constants import daily_rate
from ..operators import panel as P
from ..operators import rolling as R
from ..sources import bridge as B
from .registry import query

Y = "sqrt(252::double)"
RF = f"{daily_rate()!r}::double"


def w(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ALL = "OVER (PARTITION BY ticker ORDER BY date)"


def roll(agg: str, x: str, n: int, least: int) -> str:
    return f"(CASE WHEN count({x}) {w(n)} >= {least} THEN {agg}({x}) {w(n)} END)"


def chg(x: str, n: int) -> str:
    return f"({x} / nullif(lag({x}, {n}) {ALL}, 0) - 1)"


def betas(n: int, least: int) -> str:
    pair = f"count(CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN 1 END) {w(n)}"
    return f"((CASE WHEN {pair} >= {least} THEN covar_samp(ret, m) {w(n)} END) / nullif(CASE WHEN count(m) {w(n)} >= {least} THEN var_samp(m) {w(n)} END, 0))"


CM = ", cm AS (SELECT c.ticker, c.date, c.close, c.ret, m.ret AS m FROM crets c JOIN mkt m USING (date))"
DB = (
    ", dgrid AS (SELECT t.ticker, c.date, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT date FROM mkt) c LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = c.date), db AS (SELECT ticker, date, "
    + ", ".join(f"last_value({c} IGNORE NULLS) {w(6)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
    + " FROM dgrid)"
)


def _cm(spark, d):
    return B.crets(spark, d).join(B.mkt(spark, d).select("date", F.col("ret").alias("m")), "date")


def _db(spark, d):
    return P.densify(B.bars(spark, d), B.mkt(spark, d), ["open", "high", "low", "close", "volume"])


def _one(name: str, base, cte: str, source: str, column, sql: str) -> None:
    """A query of one feature: (ticker, date, value) rounded."""

    @query(name, f"{cte} SELECT ticker, date, round({sql}, 6) AS value FROM {source}")
    def _(spark, d):
        return base(spark, d).select("ticker", "date", P.r6(column()).alias("value"))


LN2 = f"{math.log(2)!r}::double"
PARK = f"sqrt({roll('avg', 'pow(ln(high / low), 2)', 21, 10)} / (4 * {LN2})) * {Y}"
GK = f"sqrt(greatest(0, {roll('avg', f'0.5 * pow(ln(high / low), 2) - (2 * {LN2} - 1) * pow(ln(close / open), 2)', 21, 10)})) * {Y}"
GK = f"CASE WHEN count(close) {w(21)} >= 10 THEN {GK} END"
RS = f"CASE WHEN count(close) {w(21)} >= 10 THEN sqrt(greatest(0, {roll('avg', 'ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)', 21, 10)})) * {Y} END"
DOWN = f"CASE WHEN count(*) {w(252)} >= 126 THEN sqrt(avg(pow(CASE WHEN ret < 0 THEN ret ELSE 0 END, 2)) {w(252)}) * {Y} END"
FWD = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"

_one("W1_realised_vol", B.crets, "", "crets", lambda: R.realised_vol(), f"{roll('stddev_samp', 'ret', 21, 10)} * {Y}")
_one("W3_parkinson", _db, DB, "db", lambda: R.parkinson(), PARK)
_one("W4_garman_klass", _db, DB, "db", lambda: R.garman_klass(), GK)
_one("W5_rogers_satchell", _db, DB, "db", lambda: R.rogers_satchell(), RS)
_one("W6_downside_deviation", B.crets, "", "crets", lambda: R.downside_deviation(), DOWN)
_one("W7_forward_vol", B.crets, "", "crets", lambda: R.forward_vol(), f"CASE WHEN count(ret) {FWD} = 21 THEN stddev_samp(ret) {FWD} END * {Y}")
_one("W8_rolling_beta", _cm, CM, "cm", lambda: R.beta("ret", "m"), betas(252, 126))
_one("W9_rolling_alpha", _cm, CM, "cm", lambda: R.alpha(R.beta("ret", "m"), "ret", "m"), f"({roll('avg', 'ret', 252, 126)} - {RF} - {betas(252, 126)} * ({roll('avg', 'm', 252, 126)} - {RF})) * 252")
_M, _R = "(CASE WHEN m < 0 THEN m END)", "(CASE WHEN m < 0 THEN ret END)"
_one("W10_downside_beta", _cm, CM, "cm", lambda: R.downside_beta("ret", "m"), f"CASE WHEN row_number() {ALL} >= 252 AND count({_M}) {w(252)} >= 20 THEN covar_samp({_R}, {_M}) {w(252)} / nullif(var_samp({_M}) {w(252)}, 0) END")
_one("W11_momentum", B.panel, "", "panel", lambda: R.momentum(), f"lag(close, 21) {ALL} / nullif(lag(close, 252) {ALL}, 0) - 1")
_one("W13_liquidity", _db, DB, "db", lambda: R.liquidity() / 1e6, roll("avg", "volume * close", 63, 31) + " / 1e6")
_one("W17_return_21", B.panel, "", "panel", lambda: R.change("close", 21), chg("close", 21))
_one("W18_abs_return_5", B.crets, "", "crets", lambda: R.over(F.avg, F.abs("ret"), 5, 3), roll("avg", "abs(ret)", 5, 3))
_one("W18_downside_share", B.crets, "", "crets", lambda: R.downside_share("ret", 21, 10), f"CASE WHEN count(*) {w(21)} >= 10 THEN avg(CASE WHEN ret < 0 THEN 1.0::double ELSE 0 END) {w(21)} END")
_one("W19_drawdown_state", B.panel, "", "panel", lambda: R.drawdown(), f"close / {roll('max', 'close', 252, 60)} - 1")
_one("W22_beta_120", _cm, CM, "cm", lambda: R.beta("ret", "m", 252, 120), betas(252, 120))
_one("W26_rolling_sharpe", B.crets, "", "crets", lambda: R.rolling_sharpe(), f"CASE WHEN count(ret) {w(252)} = 252 AND stddev_samp(ret) {w(252)} >= 1e-10 THEN (avg(ret) {w(252)} - {RF}) / stddev_samp(ret) {w(252)} * {Y} END")
_one("W28_equity_curve", B.crets, "", "crets", lambda: R.equity_curve(), f"product(1 + coalesce(ret, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)")

_EW = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
EWMA = f"sqrt(pow(0.94::double, k) * sum(CASE WHEN k = 0 THEN ret * ret ELSE 0.06::double * pow(0.94::double, -k) * ret * ret END) OVER {_EW}) * {Y}"
_K = ", kk AS (SELECT *, count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS k FROM rets)"


@query("W2_ewma_vol", f"{_K} SELECT ticker, date, round({EWMA}, 6) AS value FROM kk")
def _(spark, d):
    return R.ewma_vol(B.rets(spark, d)).select("ticker", "date", P.r6("ewma").alias("value"))


@query("W2_ewma_prefix", f"{_K} SELECT ticker, date, round({EWMA}, 6) AS value FROM kk")
def _(spark, d):
    return R.ewma_vol_dense(B.rets(spark, d)).select("ticker", "date", P.r6("ewma").alias("value"))


@query("W12_max_drawdown", f", dd AS (SELECT ticker, date, close / {roll('max', 'close', 252, 126)} - 1 AS x FROM panel) SELECT ticker, date, round({roll('min', 'x', 252, 126)}, 6) AS value FROM dd")
def _(spark, d):
    return R.max_drawdown(B.panel(spark, d)).select("ticker", "date", P.r6("max_dd").alias("value"))


_VOLS = ", v AS (SELECT ticker, date, " + ", ".join(f"{roll('stddev_samp', 'ret', n, max(5, n // 2))} * {Y} AS rv_{n}" for n in (5, 21, 63, 252)) + " FROM crets)"


@query("W14_16_vol_shape", f"{_VOLS} SELECT ticker, date, round({roll('stddev_samp', 'rv_21', 63, 30)}, 6) AS vol_of_vol, round(rv_5 / nullif(rv_63, 0), 6) AS ratio_5_63, round(rv_21 / nullif(rv_252, 0), 6) AS ratio_21_252, round(rv_21 - lag(rv_21, 21) {ALL}, 6) AS trend FROM v")
def _(spark, d):
    v = B.crets(spark, d).select("ticker", "date", *(R.realised_vol("ret", n).alias(f"rv_{n}") for n in (5, 21, 63, 252)))
    zero = F.lit(0.0)
    return v.select(
        "ticker",
        "date",
        P.r6(R.over(F.stddev_samp, "rv_21", 63, 30)).alias("vol_of_vol"),
        P.r6(F.col("rv_5") / F.nullif(F.col("rv_63"), zero)).alias("ratio_5_63"),
        P.r6(F.col("rv_21") / F.nullif(F.col("rv_252"), zero)).alias("ratio_21_252"),
        P.r6(F.col("rv_21") - F.lag("rv_21", 21).over(R.ordered())).alias("trend"),
    )


@query("W20_turnover", f"{DB}, lt AS (SELECT ticker, date, ln(nullif(volume * close, 0)) AS x FROM db) SELECT ticker, date, round(x, 6) AS log_turnover, round(({roll('avg', 'x', 21, 10)} - {roll('avg', 'x', 252, 60)}) / nullif({roll('stddev_samp', 'x', 252, 60)}, 0), 6) AS turnover_z FROM lt")
def _(spark, d):
    x = _db(spark, d).withColumn("x", F.ln(F.nullif(F.col("volume") * F.col("close"), F.lit(0.0))))
    z = (R.over(F.avg, "x", 21, 10) - R.over(F.avg, "x", 252, 60)) / F.nullif(R.over(F.stddev_samp, "x", 252, 60), F.lit(0.0))
    return x.select("ticker", "date", P.r6("x").alias("log_turnover"), P.r6(z).alias("turnover_z"))


_MS = f", ms0 AS (SELECT 'm' AS ticker, date, close, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM mkt_px), ms AS (SELECT date, {roll('stddev_samp', 'ret', 21, 10)} * {Y} AS mkt_rv_21, {roll('stddev_samp', 'ret', 63, 30)} * {Y} AS mkt_rv_63, {chg('close', 21)} AS mkt_ret_21, ret AS m, close AS vix, close - lag(close, 21) {ALL} AS vix_chg_21 FROM ms0)"


@query("W21_market_state", f"{_MS} SELECT date, round(mkt_rv_21, 6) AS mkt_rv_21, round(mkt_rv_63, 6) AS mkt_rv_63, round(mkt_ret_21, 6) AS mkt_ret_21, round(vix, 6) AS vix, round(vix_chg_21, 6) AS vix_chg_21 FROM ms")
def _(spark, d):
    m = B.mkt_px(spark, d)
    return R.market_state(m, m).select("date", *(P.r6(c).alias(c) for c in ("mkt_rv_21", "mkt_rv_63", "mkt_ret_21", "vix", "vix_chg_21")))


@query("W23_month_ends", "SELECT ticker, date, close FROM panel WHERE date IN (SELECT max(date) FROM mkt GROUP BY date_trunc('month', date))")
def _(spark, d):
    return P.month_end_rows(B.panel(spark, d), B.mkt(spark, d).select("date"))


def _fb(spark, d):
    return B.px(spark, d).join(B.bars(spark, d).drop("close"), ["ticker", "date"]).select("ticker", "date", "open", "high", "low", "close", "volume")


_DOWN63 = f"CASE WHEN count(*) {w(63)} >= 31 THEN sqrt(avg(pow(CASE WHEN ret < 0 THEN ret ELSE 0 END, 2)) {w(63)}) * {Y} END"
_ONE = {f"rv_{n}": f"{roll('stddev_samp', 'ret', n, max(5, n // 2))} * {Y}" for n in (5, 10, 21, 63, 126, 252)} | {
    "parkinson_21": PARK,
    "gk_21": GK,
    "rs_21": RS,
    "downside_63": _DOWN63,
    "ret_21": chg("close", 21),
    "ret_63": chg("close", 63),
    "abs_ret_5": roll("avg", "abs(ret)", 5, 3),
    "downside_frac_21": f"CASE WHEN count(*) {w(21)} >= 10 THEN avg(CASE WHEN ret < 0 THEN 1.0::double ELSE 0 END) {w(21)} END",
    "drawdown_252": f"close / {roll('max', 'close', 252, 60)} - 1",
    "log_turnover": "ln(nullif(volume * close, 0))",
    "beta_252": betas(252, 120),
    "fwd_vol_21": f"CASE WHEN count(ret) {FWD} = 21 THEN stddev_samp(ret) {FWD} END * {Y}",
    "ewma_94": EWMA.replace("CASE WHEN k = 0", "CASE WHEN ret IS NULL THEN 0 WHEN k = 0"),
}
_TWO = {
    "vol_of_vol": roll("stddev_samp", "rv_21", 63, 30),
    "vol_ratio_5_63": "rv_5 / nullif(rv_63, 0)",
    "vol_ratio_21_252": "rv_21 / nullif(rv_252, 0)",
    "vol_trend": f"rv_21 - lag(rv_21, 21) {ALL}",
    "neg_ret_21": "CASE WHEN ret_21 IS NOT NULL THEN least(ret_21, 0) END",
    "turnover_z": f"({roll('avg', 'log_turnover', 21, 10)} - {roll('avg', 'log_turnover', 252, 60)}) / nullif({roll('stddev_samp', 'log_turnover', 252, 60)}, 0)",
}
_MKT = ("mkt_rv_21", "mkt_rv_63", "mkt_ret_21", "vix", "vix_chg_21")
_PANEL = (
    f"{_MS}, fb AS (SELECT p.ticker, p.date, b.open, b.high, b.low, p.close, b.volume, p.close / lag(p.close) OVER (PARTITION BY p.ticker ORDER BY p.date) - 1 AS ret FROM px p JOIN bars b ON b.ticker = p.ticker AND b.date = p.date)"
    f", fk AS (SELECT fb.*, ms.* EXCLUDE (date), greatest(count(ret) OVER (PARTITION BY ticker ORDER BY fb.date ROWS UNBOUNDED PRECEDING) - 1, 0) AS k FROM fb LEFT JOIN ms ON ms.date = fb.date)"
    f", f1 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _ONE.items())} FROM fk), f2 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _TWO.items())} FROM f1)"
    f", features AS (SELECT ticker, date, {', '.join([*_MKT, *_ONE, *_TWO])} FROM f2 WHERE fwd_vol_21 > 0 AND rv_21 IS NOT NULL AND rv_63 IS NOT NULL AND ewma_94 IS NOT NULL AND date IN (SELECT max(date) FROM mkt GROUP BY date_trunc('month', date)))"
)
FEATURES = [*_MKT, *_ONE, *_TWO]


def features(spark, d):
    m = B.mkt_px(spark, d)
    return R.feature_panel(_fb(spark, d), m, m)


@query("W24_feature_panel", f"{_PANEL} SELECT ticker, date, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM features")
def _(spark, d):
    return features(spark, d).select("ticker", "date", *(P.r6(c).alias(c) for c in FEATURES))


@query("W25_feature_columns", "SELECT name FROM (VALUES " + ", ".join(f"('{c}')" for c in FEATURES if c != "fwd_vol_21") + ") t(name)")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in R.feature_columns(features(spark, d))], "name string")


@query("W27_horizon_stats", f", c AS (SELECT ticker, date, product(1 + coalesce(ret, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM crets), t AS (SELECT ticker, v / nullif(lag(v, 252) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS x FROM c) SELECT ticker AS name, count(x) AS n, round(min(x), 6) AS lowest, round(median(x), 6) AS middle, round(max(x), 6) AS highest FROM t GROUP BY 1")
def _(spark, d):
    s = R.horizon_stats(B.crets(spark, d).withColumnRenamed("ticker", "name"))
    return s.select("name", "n", *(P.r6(c).alias(c) for c in ("lowest", "middle", "highest")))
