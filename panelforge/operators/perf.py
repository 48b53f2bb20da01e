"""Performance metrics of return streams (name, date, ret): a window stage for curves, then one aggregation by stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RISK_FREE_ANNUAL, TRADING_DAYS, daily_rate

YEAR = math.sqrt(TRADING_DAYS)
TINY = 1e-10


def safe(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def drawdowns(streams: DataFrame) -> DataFrame:
    """``curve`` and ``dd`` (fall below the highest curve so far) beside each return; the capital at the start is no peak."""
    w = Window.partitionBy("name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = streams.withColumn("curve", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    return curve.withColumn("dd", F.col("curve") / F.max("curve").over(w) - 1)


def unbiased_skew(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def unbiased_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def own_metrics(rf_annual: float = RISK_FREE_ANNUAL) -> dict[str, Column]:
    """Aggregates over (ret, dd) of one stream."""
    rf = daily_rate(rf_annual)
    n, growth, sd = F.count("ret"), F.product(1 + F.col("ret")), F.stddev_samp("ret")
    excess = F.avg(F.col("ret") - rf)
    below = F.sqrt(F.avg(F.pow(F.least(F.col("ret") - rf, F.lit(0.0)), 2)))
    cagr = F.when((n >= 2) & (growth > 0), F.pow(growth, TRADING_DAYS / n) - 1)
    return {
        "cagr": cagr,
        "annual_return": F.avg("ret") * TRADING_DAYS,
        "annual_vol": sd * YEAR,
        "sharpe": F.when(sd >= TINY, excess / sd * YEAR),
        "sortino": F.when(below >= TINY, excess / below * YEAR),
        "max_drawdown": F.min("dd"),
        "calmar": F.when(F.min("dd") != 0, cagr / F.abs(F.min("dd"))),
        "ulcer": F.sqrt(F.avg(F.pow("dd", 2))),
        "skew": F.when(sd >= TINY, unbiased_skew("ret")),
        "kurtosis": F.when(sd >= TINY, unbiased_kurtosis("ret")),
    }


def market_metrics(rf_annual: float = RISK_FREE_ANNUAL) -> dict[str, Column]:
    """Aggregates over (ret, mkt) of one stream, on the dates that both have."""
    rf = daily_rate(rf_annual)
    r, m = (F.when(F.col("ret").isNotNull() & F.col("mkt").isNotNull(), F.col(c)) for c in ("ret", "mkt"))
    beta = F.when(F.count(r) >= 20, safe(F.covar_samp(r, m), F.var_samp(m)))
    active = r - m
    return {
        "beta": beta,
        "alpha": (F.avg(r) - rf - beta * (F.avg(m) - rf)) * TRADING_DAYS,
        "treynor": safe(F.avg("ret") * TRADING_DAYS - rf_annual, beta),
        "information_ratio": safe(F.avg(active), F.stddev_samp(active)) * YEAR,
    }


def hit_rate(streams: DataFrame, market: DataFrame) -> DataFrame:
    """Share of months in which a stream beats the market; a month without returns between others compounds to 0."""
    both = streams.join(market.select("date", F.col("ret").alias("mkt")), "date").dropna(subset=["ret", "mkt"])
    month = F.trunc("date", "month")
    monthly = both.groupBy("name", month.alias("m")).agg((F.product(1 + F.col("ret")) - 1).alias("r"), (F.product(1 + F.col("mkt")) - 1).alias("b"))
    span = monthly.groupBy("name").agg((F.months_between(F.max("m"), F.min("m")) + 1).alias("months"), F.sum((F.col("r") > F.col("b")).cast("double")).alias("won"))
    return span.select("name", (F.col("won") / F.round("months")).alias("hit_rate"))


def tearsheet(streams: DataFrame, market: DataFrame | None = None, rf_annual: float = RISK_FREE_ANNUAL) -> DataFrame:
    """A row for each stream: its own metrics and, given market returns (date, ret), those against the market."""
    rows = drawdowns(streams.select("name", "date", "ret").where("ret IS NOT NULL"))
    metrics = own_metrics(rf_annual)
    if market is None:
        return rows.groupBy("name").agg(F.count("ret").alias("n"), *(c.alias(k) for k, c in metrics.items()))
    rows = rows.join(market.select("date", F.col("ret").alias("mkt")), "date", "left")
    metrics |= market_metrics(rf_annual)
    sheet = rows.groupBy("name").agg(F.count("ret").alias("n"), *(c.alias(k) for k, c in metrics.items()))
    return sheet.join(hit_rate(streams, market), "name", "left")
