"""Rolling features as window columns over a dense panel.

Every function returns a Column over ``Window.partitionBy(ticker).orderBy(date)`` ROWS frames, so that all features of one
level share a sort. A value is NULL until its frame holds ``min_rows`` non-null inputs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EWMA_LAMBDA, HORIZON, TRADING_DAYS, daily_rate

YEAR = math.sqrt(TRADING_DAYS)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(n: int, ticker: str = "ticker", date: str = "date"):
    return Window.partitionBy(ticker).orderBy(date).rowsBetween(-(n - 1), 0)


def ordered(ticker: str = "ticker", date: str = "date"):
    return Window.partitionBy(ticker).orderBy(date)


def over(agg, x: Column | str, n: int, min_rows: int) -> Column:
    """``agg(x)`` over the last ``n`` rows once ``min_rows`` of them have a value."""
    w, x = trailing(n), _col(x)
    return F.when(F.count(x).over(w) >= min_rows, agg(x).over(w))


def _least(n: int) -> int:
    return max(5, n // 2)


def realised_vol(ret: str = "ret", n: int = 21, annualise: bool = True, min_rows: int | None = None) -> Column:
    return over(F.stddev_samp, ret, n, min_rows or _least(n)) * (YEAR if annualise else 1.0)


def parkinson(high: str = "high", low: str = "low", n: int = 21) -> Column:
    """Range-based volatility from ln(high / low)."""
    term = F.pow(F.ln(_ratio(high, low)), 2)
    return F.sqrt(over(F.avg, term, n, _least(n)) / (4 * math.log(2))) * YEAR


def garman_klass(o: str = "open", h: str = "high", l: str = "low", c: str = "close", n: int = 21) -> Column:  # noqa: E741
    term = 0.5 * F.pow(F.ln(_ratio(h, l)), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(_ratio(c, o)), 2)
    return _root(over(F.avg, term, n, _least(n)))


def rogers_satchell(o: str = "open", h: str = "high", l: str = "low", c: str = "close", n: int = 21) -> Column:  # noqa: E741
    term = F.ln(_ratio(h, c)) * F.ln(_ratio(h, o)) + F.ln(_ratio(l, c)) * F.ln(_ratio(l, o))
    return _root(over(F.avg, term, n, _least(n)))


def _ratio(a: str, b: str) -> Column:
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / F.col(b))


def _root(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), x))) * YEAR


def downside_deviation(ret: str = "ret", n: int = 252, floor: float = 0.0) -> Column:
    """Root mean square of returns below ``floor``; every other row, missing ones too, counts as 0."""
    w = trailing(n)
    below = F.coalesce(F.when(F.col(ret) < floor, F.col(ret)), F.lit(0.0))
    return F.when(F.count(F.lit(1)).over(w) >= n // 2, F.sqrt(F.avg(F.pow(below, 2)).over(w))) * YEAR


def forward_vol(ret: str = "ret", horizon: int = HORIZON) -> Column:
    """Volatility of the next ``horizon`` rows; NULL where they aren't all there."""
    w = ordered().rowsBetween(1, horizon)
    return F.when(F.count(ret).over(w) == horizon, F.stddev_samp(ret).over(w)) * YEAR


def beta(ret: str = "ret", market: str = "mkt", n: int = 252, min_rows: int | None = None) -> Column:
    """Covariance over rows where both are present, over the variance of all market rows in the frame."""
    w, least = trailing(n), min_rows or n // 2
    both = F.when(F.col(ret).isNotNull() & F.col(market).isNotNull(), F.lit(1))
    cov = F.when(F.count(both).over(w) >= least, F.covar_samp(ret, market).over(w))
    var = F.when(F.count(market).over(w) >= least, F.var_samp(market).over(w))
    return cov / F.nullif(var, F.lit(0.0))


def alpha(beta_: Column | str, ret: str = "ret", market: str = "mkt", n: int = 252, rf_daily: float | None = None) -> Column:
    rf = daily_rate() if rf_daily is None else rf_daily
    mine, theirs = over(F.avg, ret, n, n // 2), over(F.avg, market, n, n // 2)
    return (mine - rf - _col(beta_) * (theirs - rf)) * TRADING_DAYS


def downside_beta(ret: str = "ret", market: str = "mkt", n: int = 252, threshold: float = 0.0, least: int = 20) -> Column:
    """Beta over the market's down days of a full window with at least ``least`` of them."""
    w = trailing(n)
    down = F.col(market) < threshold
    m, r = F.when(down, F.col(market)), F.when(down, F.col(ret))
    value = F.covar_samp(r, m).over(w) / F.nullif(F.var_samp(m).over(w), F.lit(0.0))
    return F.when((F.row_number().over(ordered()) >= n) & (F.count(m).over(w) >= least), value)


def momentum(price: str = "close", lookback: int = 252, skip: int = 21) -> Column:
    w = ordered()
    return F.lag(price, skip).over(w) / F.nullif(F.lag(price, lookback).over(w), F.lit(0.0)) - 1


def change(price: str = "close", n: int = 21) -> Column:
    return F.col(price) / F.nullif(F.lag(price, n).over(ordered()), F.lit(0.0)) - 1


def drawdown(price: str = "close", n: int = 252, min_rows: int = 60) -> Column:
    return F.col(price) / over(F.max, price, n, min_rows) - 1


def max_drawdown(df: DataFrame, price: str = "close", n: int = 252, name: str = "max_dd") -> DataFrame:
    """Deepest fall below the rolling high, over the rolling window: two window levels."""
    return df.withColumn("__dd", drawdown(price, n, n // 2)).withColumn(name, over(F.min, "__dd", n, n // 2)).drop("__dd")


def liquidity(volume: str = "volume", price: str = "close", n: int = 63) -> Column:
    return over(F.avg, F.col(volume) * F.col(price), n, n // 2)


def equity_curve(ret: str = "ret", key: str = "ticker", date: str = "date") -> Column:
    """Growth of 1; a missing return leaves it as it is."""
    return F.product(1 + F.coalesce(ret, F.lit(0.0))).over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))


def rolling_sharpe(ret: str = "ret", n: int = TRADING_DAYS, rf_annual: float | None = None) -> Column:
    """Annualised Sharpe ratio of full windows."""
    w = trailing(n)
    rf = daily_rate() if rf_annual is None else daily_rate(rf_annual)
    sd = F.stddev_samp(ret).over(w)
    return F.when((F.count(ret).over(w) == n) & (sd >= 1e-10), (F.avg(ret).over(w) - rf) / sd * YEAR)


def ewma_vol(df: DataFrame, ret: str = "ret", lam: float = EWMA_LAMBDA, name: str = "ewma", annualise: bool = True) -> DataFrame:
    """Exponentially weighted volatility of each ticker, gaps included; ``name`` is added to the rows.

    Squares are folded in date order: the old state weighs ``lam`` to the number of rows since the last value, renormalised
    with the new one; rows without a return carry the state on. The recursion has no closed form across gaps, so one
    grouped-map task folds one ticker's rows.
    """
    from pyspark.sql import types as T

    scale = YEAR if annualise else 1.0

    def fold(rows):
        rows = rows.sort_values("date")
        out, state, gap = [], None, 0
        for r in rows[ret].to_numpy(dtype=float):
            gap += 1
            if r == r:
                old = lam**gap
                state = r * r if state is None else (old * state + (1 - lam) * r * r) / (old + 1 - lam)
                gap = 0
            out.append(None if state is None else math.sqrt(state) * scale)
        return rows.assign(**{name: out})

    return df.groupBy("ticker").applyInPandas(fold, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def ewma_vol_dense(df: DataFrame, ret: str = "ret", lam: float = EWMA_LAMBDA, name: str = "ewma") -> DataFrame:
    """The same for series without gaps, as a prefix sum: for up to about 10,000 rows a ticker."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(ret) * F.col(ret)
    rows = df.withColumn("__k", F.count(ret).over(w) - 1)
    total = F.sum(F.when(F.col("__k") == 0, x).otherwise((1 - lam) * F.pow(F.lit(lam), -F.col("__k")) * x)).over(w)
    return rows.withColumn(name, F.sqrt(F.pow(F.lit(lam), F.col("__k")) * total) * YEAR).drop("__k")


def market_state(market: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    """By date: the market's volatility over 21 and 63 rows, its 21-row return and, if given, VIX and its 21-row change."""
    m = market.withColumn("ticker", F.lit("market"))
    fill = ordered().rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("close", F.last("close", ignorenulls=True).over(fill))
    m = m.withColumn("ret", change("close", 1))
    columns = ["date", realised_vol("ret", 21, min_rows=10).alias("mkt_rv_21"), realised_vol("ret", 63, min_rows=30).alias("mkt_rv_63"), change("close", 21).alias("mkt_ret_21"), F.col("ret").alias("mkt")]
    if vix is not None:
        m = m.join(vix.select("date", F.col("close").alias("vix_raw")), "date", "left").withColumn("vix", F.last("vix_raw", ignorenulls=True).over(fill))
        columns += [F.col("vix"), (F.col("vix") - F.lag("vix", 21).over(ordered())).alias("vix_chg_21")]
    return m.select(*columns)


def feature_panel(bars: DataFrame, market: DataFrame, vix: DataFrame | None = None, month_ends: bool = True) -> DataFrame:
    """Forecasting features and the target ``fwd_vol_21`` of dense bars (ticker, date, open..volume), at month ends.

    Rows need the target (above 0), rv_21, rv_63 and ewma_94. One sort by ticker serves all trailing features; those of
    features are a second level over the same sort.
    """
    base = bars.withColumn("ret", change("close", 1))
    base = ewma_vol(base, name="ewma_94").join(market_state(market, vix), "date", "left")
    turnover = F.nullif(F.col("volume") * F.col("close"), F.lit(0.0))
    one = base.select(
        "*",
        *(realised_vol("ret", n).alias(f"rv_{n}") for n in (5, 10, 21, 63, 126, 252)),
        parkinson().alias("parkinson_21"),
        garman_klass().alias("gk_21"),
        rogers_satchell().alias("rs_21"),
        downside_deviation("ret", 63).alias("downside_63"),
        change("close", 21).alias("ret_21"),
        change("close", 63).alias("ret_63"),
        over(F.avg, F.abs("ret"), 5, 3).alias("abs_ret_5"),
        downside_share("ret", 21, 10).alias("downside_frac_21"),
        drawdown("close", 252, 60).alias("drawdown_252"),
        F.when(turnover > 0, F.ln(turnover)).alias("log_turnover"),
        beta("ret", "mkt", 252, 120).alias("beta_252"),
        forward_vol("ret").alias("fwd_vol_21"),
    )
    zero = F.lit(0.0)
    two = one.select(
        "*",
        over(F.stddev_samp, "rv_21", 63, 30).alias("vol_of_vol"),
        (F.col("rv_5") / F.nullif("rv_63", zero)).alias("vol_ratio_5_63"),
        (F.col("rv_21") / F.nullif("rv_252", zero)).alias("vol_ratio_21_252"),
        (F.col("rv_21") - F.lag("rv_21", 21).over(ordered())).alias("vol_trend"),
        F.when(F.col("ret_21").isNotNull(), F.least("ret_21", zero)).alias("neg_ret_21"),
        ((over(F.avg, "log_turnover", 21, 10) - over(F.avg, "log_turnover", 252, 60)) / F.nullif(over(F.stddev_samp, "log_turnover", 252, 60), zero)).alias("turnover_z"),
    )
    good = two.where("fwd_vol_21 > 0 AND rv_21 IS NOT NULL AND rv_63 IS NOT NULL AND ewma_94 IS NOT NULL")
    if month_ends:
        from .panel import month_end_rows

        good = month_end_rows(good, market.select("date"))
    return good.drop("open", "high", "low", "close", "volume", "ret", "mkt")


def downside_share(ret: str, n: int, min_rows: int) -> Column:
    """Share of rows with a negative return; a missing one counts as not negative."""
    w = trailing(n)
    down = F.coalesce((F.col(ret) < 0).cast("double"), F.lit(0.0))
    return F.when(F.count(F.lit(1)).over(w) >= min_rows, F.avg(down).over(w))


def feature_columns(panel: DataFrame, target: str = "fwd_vol_21") -> list[str]:
    return [c for c in panel.columns if c not in ("date", "ticker", target)]


def horizon_stats(streams: DataFrame, years: int = 1) -> DataFrame:
    """Distribution of rolling ``years``-year total returns of each stream (name, date, ret)."""
    w = Window.partitionBy("name").orderBy("date")
    curve = streams.withColumn("curve", equity_curve("ret", "name"))
    total = F.col("curve") / F.nullif(F.lag("curve", TRADING_DAYS * years).over(w), F.lit(0.0)) - 1
    return curve.withColumn("total", total).groupBy("name").agg(F.count("total").alias("n"), F.min("total").alias("lowest"), F.median("total").alias("middle"), F.max("total").alias("highest"))
