"""Queries of covariance estimators (C) over the brands' clean returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix
from ..operators.panel import r6
from ..sources import bridge as B
from .registry import query

#: Annualised, so that six decimals tell values apart.
LW = ", lw0 AS (SELECT ticker, date, ret FROM crets WHERE ret IS NOT NULL), lw AS (SELECT ticker, date, ret FROM lw0 WHERE date IN (SELECT date FROM lw0 GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM lw0)))"
POP = (
    LW
    + ", np AS (SELECT count(DISTINCT date)::double AS n, count(DISTINCT ticker)::double AS p FROM lw), pop AS (SELECT x.ticker AS a, y.ticker AS b, covar_pop(x.ret, y.ret) AS s FROM lw x JOIN lw y USING (date) GROUP BY 1, 2)"
)
_SHRUNK = " SELECT a, b, round(((1 - rho) * s + CASE WHEN a = b THEN rho * mu ELSE 0 END) * 252, 6) + 0.0::double AS value FROM pop, rho"


def _out(df):
    return df.select("a", "b", r6(F.col("value") * 252).alias("value"))


@query("C1_sample_cov", "SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret) * 252, 6) AS value FROM crets x JOIN crets y USING (date) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return _out(matrix.sample_cov(B.crets(spark, d)))


_LW_RHO = f"""{POP}, cen AS (SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM lw), nrm AS (SELECT sum(q * q) AS q2 FROM (SELECT date, sum(x * x) AS q FROM cen GROUP BY date))
, st AS (SELECT sum(CASE WHEN a = b THEN s END) / max(p) AS mu, sum(s * s) AS ss, max(n) AS n, max(p) AS p FROM pop, np)
, de AS (SELECT mu, (ss - p * mu * mu) / p AS delta, (q2 / n - ss) / (n * p) AS b0 FROM st, nrm), rho AS (SELECT mu, CASE WHEN least(delta, b0) <= 0 THEN 0 ELSE least(delta, b0) / delta END AS rho FROM de)
"""


@query("C2_ledoit_wolf", _LW_RHO + _SHRUNK)
def _(spark, d):
    return _out(matrix.ledoit_wolf_cov(B.crets(spark, d)))


def _oas(num: str, den: str) -> str:
    return f"{POP}, st AS (SELECT sum(CASE WHEN a = b THEN s END) AS tr, sum(s * s) AS ss, max(n) AS n, max(p) AS p FROM pop, np), rho AS (SELECT tr / p AS mu, least(1, ({num}) / ({den})) AS rho FROM st) {_SHRUNK}"


@query("C3_oas", _oas("ss / (p * p) + tr * tr / (p * p)", "(n + 1) * (ss / (p * p) - tr * tr / (p * p * p))"))
def _(spark, d):
    return _out(matrix.oas_cov(B.crets(spark, d)))


@query("C3_oas_paper", _oas("(1 - 2 / p) * ss + tr * tr", "(n + 1 - 2 / p) * (ss - tr * tr / p)"))
def _(spark, d):
    return _out(matrix.oas_cov(B.crets(spark, d), keep_small_terms=True))


_CC = f"{LW}, sc AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS v, stddev_samp(x.ret) AS sa, stddev_samp(y.ret) AS sb FROM lw x JOIN lw y USING (date) GROUP BY 1, 2)"


@query("C4_constant_correlation", f"{_CC} SELECT a, b, round(252 * CASE WHEN a = b THEN v ELSE (SELECT avg(v / (sa * sb)) FROM sc WHERE a <> b) * sa * sb END, 6) AS value FROM sc")
def _(spark, d):
    return _out(matrix.constant_correlation_cov(B.crets(spark, d)))


@query("C5_ewma_cov", f"{LW}, wd AS (SELECT date, pow(0.94::double, row_number() OVER (ORDER BY date DESC) - 1) AS w FROM (SELECT DISTINCT date FROM lw)), wc AS (SELECT ticker, date, w, ret - sum(w * ret) OVER (PARTITION BY ticker) / sum(w) OVER (PARTITION BY ticker) AS x FROM lw JOIN wd USING (date)) SELECT p.ticker AS a, q.ticker AS b, round(sum(p.w * p.x * q.x) / sum(p.w) * 252, 6) AS value FROM wc p JOIN wc q USING (date) GROUP BY 1, 2")
def _(spark, d):
    return _out(matrix.ewma_cov(B.crets(spark, d)))


@query("C6_condition_number")
def _(spark, d):
    out = None
    for name, f in matrix.ESTIMATORS.items():
        one = matrix.condition_number(f(B.crets(spark, d))).withColumn("estimator", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


#: A covariance without negative eigenvalues is its own nearest one.
@query("C7_nearest_psd", LW + " SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret) * 252, 6) AS value FROM lw x JOIN lw y USING (date) GROUP BY 1, 2")
def _(spark, d):
    whole = matrix.listwise(B.crets(spark, d))
    return _out(matrix.nearest_psd(matrix.sample_cov(whole)))


_VOL = ", fv AS (SELECT ticker, stddev_samp(ret) * sqrt(252::double) * 1.1 AS vol FROM crets WHERE ticker <> 'Brand#3' GROUP BY 1), ow AS (SELECT ticker, stddev_samp(ret) * sqrt(252::double) AS own FROM crets GROUP BY 1), vv AS (SELECT ticker, greatest(coalesce(vol, own), 1e-4) AS v FROM ow LEFT JOIN fv USING (ticker))"


@query("C8_cov_from_vols", f"{_LW_RHO}, sh AS (SELECT a, b, (1 - rho) * s + CASE WHEN a = b THEN rho * mu ELSE 0 END AS c FROM pop, rho), sd AS (SELECT a AS t, sqrt(c) AS sd FROM sh WHERE a = b) {_VOL} SELECT a, b, round(CASE WHEN a = b THEN 1 ELSE c / (x.sd * y.sd) END * p.v * q.v, 6) AS value FROM sh JOIN sd x ON x.t = a JOIN sd y ON y.t = b JOIN vv p ON p.ticker = a JOIN vv q ON q.ticker = b")
def _(spark, d):
    r = B.crets(spark, d)
    vols = r.where("ticker <> 'Brand#3'").groupBy("ticker").agg((F.stddev_samp("ret") * F.sqrt(F.lit(252.0)) * 1.1).alias("vol"))
    return matrix.cov_from_vols(r, vols).select("a", "b", r6("value").alias("value"))


@query("C9_estimators", "SELECT name FROM (VALUES ('sample'), ('ledoit_wolf'), ('oas'), ('constant_corr'), ('ewma')) t(name)")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in matrix.ESTIMATORS], "name string")


@query("C10_correlation", "SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0), 6) AS value FROM crets x JOIN crets y USING (date) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return matrix.correlation(B.crets(spark, d)).select("a", "b", r6("value").alias("value"))
