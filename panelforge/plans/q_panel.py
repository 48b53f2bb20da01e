"""Queries of sources and panel preparation (A, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..sources import bridge as B
from .registry import query

BRANDS = [f"Brand#{k}" for k in range(1, 26)]
_CELLS = ", ".join(f"""max(CASE WHEN ticker = '{b}' THEN close END) AS "{b}" """ for b in BRANDS)


@query("A1_read_bars", "SELECT ticker, date, open, high, low, close, cast(volume as bigint) AS volume FROM bars")
def _(spark, d):
    return B.bars(spark, d).select("ticker", "date", "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"))


@query("A3_normalise_long", "SELECT ticker, date, field, value FROM (SELECT ticker, date, open, high, low, close, volume FROM bars) UNPIVOT (value FOR field IN (open, high, low, close, volume))")
def _(spark, d):
    return P.to_long(B.bars(spark, d), ["open", "high", "low", "close", "volume"])


@query("A4_to_wide", f"SELECT date, {_CELLS} FROM px GROUP BY date")
def _(spark, d):
    return P.to_wide(B.px(spark, d), "close", BRANDS)


@query("A5_one_series", "SELECT date, close FROM px WHERE ticker = 'Brand#11'")
def _(spark, d):
    return P.one_series(B.px(spark, d), "Brand#11")


@query("A7_universe", "SELECT ticker || '.NS' AS ticker, sector FROM sector")
def _(spark, d):
    return B.sector(spark, d).select(F.concat("ticker", F.lit(".NS")).alias("ticker"), "sector")


@query("A7_sector_map", "SELECT t.ticker, coalesce(s.sector, 'UNKNOWN') AS sector FROM (SELECT DISTINCT ticker FROM px UNION SELECT 'GHOST') t LEFT JOIN sector s USING (ticker)")
def _(spark, d):
    ghost = spark.createDataFrame([("GHOST",)], "ticker string")
    return P.with_sector(B.px(spark, d).select("ticker").distinct().union(ghost), B.sector(spark, d))


@query("A8_close_only", "SELECT date, close FROM bars")
def _(spark, d):
    return B.bars(spark, d).select("date", "close")


_REPORT = """, moves AS (
  SELECT ticker, date, close, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS day FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY date)
), stats AS (
  SELECT ticker, count(close) AS n_obs, min(date) FILTER (close IS NOT NULL) AS first_date, max(date) FILTER (close IS NOT NULL) AS last_date,
    max(day) FILTER (close IS NOT NULL) - min(day) FILTER (close IS NOT NULL) + 1 AS span,
    avg(CASE WHEN ret = 0 THEN 1.0::double ELSE 0 END) FILTER (ret IS NOT NULL) AS stale, count(*) FILTER (abs(ret) > 0.5) AS n_extreme
  FROM moves GROUP BY ticker
), rated AS (
  SELECT *, CASE WHEN n_obs > 0 THEN 1 - n_obs::double / span ELSE 1 END AS missing, coalesce(stale, 0) AS still FROM stats
), report AS (
  SELECT ticker, n_obs, first_date, last_date, round(missing, 4) AS missing_frac, round(still, 4) AS stale_frac, n_extreme,
    CASE WHEN n_obs = 0 THEN 'no_data' WHEN n_obs < 500 THEN 'short_history' WHEN missing > 0.05 THEN 'gappy' WHEN still > 0.2 THEN 'stale' ELSE 'ok' END AS status
  FROM rated
  UNION ALL SELECT 'MISSING', 0, NULL, NULL, 1.0, 0.0, 0, 'download_failed'
)
"""


def _report(spark, d, **kw):
    asked = B.px(spark, d).select("ticker").union(spark.createDataFrame([("MISSING",)], "ticker string"))
    return P.quality_report(B.px(spark, d), B.mkt(spark, d), asked, **kw)


@query("D1_quality_report", _REPORT + "SELECT * FROM report")
def _(spark, d):
    return _report(spark, d)


@query("D2_status_counts", _REPORT + "SELECT status, count(*) AS n FROM report GROUP BY status")
def _(spark, d):
    return _report(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("D3_failed_downloads", _REPORT + "SELECT * FROM report WHERE status = 'download_failed'")
def _(spark, d):
    return _report(spark, d).where("status = 'download_failed'")


@query("D4_report_order", _REPORT + "SELECT cast(row_number() OVER (ORDER BY status, ticker) as bigint) AS place, ticker, status FROM report")
def _(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("status", "ticker")).cast("long")
    return P.sorted_report(_report(spark, d)).select(place.alias("place"), "ticker", "status")


@query("D5_clean_prices", "SELECT p.ticker, p.date, p.close FROM panel p JOIN (SELECT ticker FROM px GROUP BY ticker HAVING count(*) >= 500) USING (ticker)")
def _(spark, d):
    return P.clean_prices(B.px(spark, d), B.mkt(spark, d), _report(spark, d, max_missing=1.0))


@query("D6_simple_returns", "SELECT ticker, date, round(ret, 6) AS ret FROM crets")
def _(spark, d):
    return B.crets(spark, d).select("ticker", "date", P.r6("ret").alias("ret"))


@query("D6_log_returns", "SELECT ticker, date, round(ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)), 6) AS ret FROM panel")
def _(spark, d):
    return P.to_returns(B.panel(spark, d), log_returns=True).select("ticker", "date", P.r6("ret").alias("ret"))


_MONTHLY = """, months AS (
  SELECT last_day(m) AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', min(date))::timestamp, date_trunc('month', max(date))::timestamp, interval 1 month)) AS m FROM px)
), monthly AS (
  SELECT t.ticker, m.month_end, x.close FROM (SELECT DISTINCT ticker FROM px) t CROSS JOIN months m
  LEFT JOIN (SELECT ticker, last_day(date) AS month_end, arg_max(close, date) AS close FROM px GROUP BY 1, 2) x ON x.ticker = t.ticker AND x.month_end = m.month_end
)
"""


@query("D7_monthly", _MONTHLY + "SELECT ticker, month_end, close FROM monthly")
def _(spark, d):
    return P.to_monthly(B.px(spark, d))


@query("D8_winsorise", "SELECT ticker, date, round(CASE WHEN ret IS NOT NULL THEN greatest(-0.03, least(0.03, ret)) END, 6) AS ret FROM crets")
def _(spark, d):
    return P.winsorise(B.crets(spark, d), 0.03).select("ticker", "date", P.r6("ret").alias("ret"))


_FILL = "last_value({0} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {0}"


@query("D9_field_panels", ", g AS (SELECT t.ticker, c.date, b.open, b.high, b.low, b.volume FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT date FROM mkt) c LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = c.date) SELECT ticker, date, " + ", ".join(_FILL.format(c) for c in ("open", "high", "low", "volume")) + " FROM g")
def _(spark, d):
    return P.densify(B.bars(spark, d), B.mkt(spark, d), ["open", "high", "low", "volume"])


_YEAR = ", yr AS (SELECT * FROM crets WHERE date > DATE '1996-01-01' AND date <= DATE '1996-12-31')"


@query("D10_coverage", _YEAR + " SELECT ticker, date, round(ret, 6) AS ret FROM yr WHERE ticker IN (SELECT ticker FROM yr GROUP BY ticker HAVING count(ret) >= floor(0.9 * (SELECT count(DISTINCT date) FROM yr)))")
def _(spark, d):
    return P.covered(P.between_dates(B.crets(spark, d), "1996-01-01", "1996-12-31", open_start=True)).select("ticker", "date", P.r6("ret").alias("ret"))


@query("D11_date_slice", "SELECT ticker, date, close FROM px WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def _(spark, d):
    return P.between_dates(B.px(spark, d), "1995-01-01", "1995-06-30")


def _two(spark, d):
    r = B.rets(spark, d)
    return r.where("ticker = 'Brand#11'"), r.where("ticker = 'Brand#23'")


_TWO = ", a AS (SELECT date, ret FROM rets WHERE ticker = 'Brand#11'), b AS (SELECT date, ret FROM rets WHERE ticker = 'Brand#23')"


@query("D12_inner_align", _TWO + " SELECT date, round(a.ret, 6) AS x, round(b.ret, 6) AS y FROM a JOIN b USING (date)")
def _(spark, d):
    return P.aligned(*_two(spark, d)).select("date", P.r6("x").alias("x"), P.r6("y").alias("y"))


@query("D12_outer_align", _TWO + " SELECT date, round(coalesce(a.ret, 0), 6) AS x, round(coalesce(b.ret, 0), 6) AS y FROM a FULL JOIN b USING (date)")
def _(spark, d):
    return P.unioned(*_two(spark, d)).select("date", P.r6("x").alias("x"), P.r6("y").alias("y"))


@query("D12_common_dates", ", s AS (SELECT * FROM rets WHERE ticker IN ('Brand#11', 'Brand#23', 'Brand#5')) SELECT ticker AS name, date, round(ret, 6) AS ret FROM s WHERE date IN (SELECT date FROM s GROUP BY date HAVING count(DISTINCT ticker) = 3)")
def _(spark, d):
    s = B.rets(spark, d).where("ticker IN ('Brand#11', 'Brand#23', 'Brand#5')").withColumnRenamed("ticker", "name")
    return P.common_dates(s).select("name", "date", P.r6("ret").alias("ret"))


@query("D13_market_columns", "SELECT p.ticker, p.date, p.close, round(m.ret, 6) AS mkt_ret FROM px p LEFT JOIN mkt m USING (date)")
def _(spark, d):
    market = B.mkt(spark, d).select("date", P.r6("ret").alias("mkt_ret"))
    return P.with_market(B.px(spark, d), market)
