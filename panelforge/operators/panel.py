"""Panel preparation: reading, reshaping, auditing, densifying and returns of (ticker, date) tables.

Rolling operators count rows, so a panel has one row for each ticker and calendar date before they run. Missing values are
NULL; NaN never enters (``no_nan`` on the way in).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EXTREME_RETURN, FFILL_LIMIT, MAX_MISSING_FRAC, MAX_STALE_FRAC, MIN_HISTORY_DAYS

#: Long price bars.
BARS = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")] + [T.StructField("volume", T.LongType())])

#: A calendar with more dates isn't broadcast when a panel is densified.
BROADCAST_DATES = 100_000


def by_ticker(ticker: str = "ticker", date: str = "date") -> Window:
    return Window.partitionBy(ticker).orderBy(date)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))


def read_or_build(spark: SparkSession, path: str, build, schema: T.StructType | None = None) -> DataFrame:
    """The Parquet table at ``path``; if there is none, ``build(spark)`` is written there first. Empty results raise."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        made = build(spark)
        if made.isEmpty():
            raise ValueError(f"nothing to write to {path}")
        made.write.parquet(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def to_long(wide: DataFrame, fields: Sequence[str], ids: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """``ids, field, value`` of the non-null values of several columns, field names in lower case."""
    return wide.unpivot(list(ids), list(fields), "field", "value").where("value IS NOT NULL").withColumn("field", F.lower("field"))


def drop_empty(bars: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows with at least one of ``fields``; dates without time zone."""
    return bars.dropna("all", subset=list(fields)).withColumn("date", F.to_date("date"))


def to_wide(long: DataFrame, field: str, tickers: Sequence[str]) -> DataFrame:
    """One column for each of ``tickers``; two rows for one cell raise."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two rows for one ticker and date"))).otherwise(F.first(field))
    return long.where(F.col("ticker").isin(list(tickers))).groupBy("date").pivot("ticker", list(tickers)).agg(cell)


def one_series(long: DataFrame, ticker: str, field: str = "close") -> DataFrame:
    """``date, close`` of one ticker."""
    return long.where(F.col("ticker") == ticker).select("date", F.col(field).alias("close"))


def _grid(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    dates = calendar.select("date").distinct()
    dates = F.broadcast(dates) if dates.limit(BROADCAST_DATES + 1).count() <= BROADCAST_DATES else dates
    return prices.select("ticker").distinct().crossJoin(dates)


def densify(prices: DataFrame, calendar: DataFrame, fields: Sequence[str], limit: int = FFILL_LIMIT) -> DataFrame:
    """A row for each ticker and calendar date; ``fields`` filled forward over at most ``limit`` rows."""
    full = _grid(prices, calendar).join(prices.select("ticker", "date", *fields), ["ticker", "date"], "left")
    w = by_ticker().rowsBetween(-limit, 0)
    return full.select("ticker", "date", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in fields))


def quality_report(prices: DataFrame, calendar: DataFrame, requested: DataFrame | None = None, min_history: int = MIN_HISTORY_DAYS, max_missing: float = MAX_MISSING_FRAC, max_stale: float = MAX_STALE_FRAC, extreme: float = EXTREME_RETURN) -> DataFrame:
    """A row for each ticker: observations, first and last date, shares missing and stale, extreme moves, status.

    The missing share counts calendar dates between the ticker's first and last observation. Status is the first that
    holds of no_data, short_history, gappy, stale, ok. Tickers of ``requested`` without any row are download_failed.
    """
    full = _grid(prices, calendar).join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left")
    step = F.col("close") / F.nullif(F.lag("close").over(by_ticker()), F.lit(0.0)) - 1
    moves = full.withColumn("ret", step).withColumn("day", F.row_number().over(by_ticker()))
    seen = F.col("close").isNotNull()
    stats = moves.groupBy("ticker").agg(
        F.count("close").alias("n_obs"),
        F.min(F.when(seen, F.col("date"))).alias("first_date"),
        F.max(F.when(seen, F.col("date"))).alias("last_date"),
        (F.max(F.when(seen, F.col("day"))) - F.min(F.when(seen, F.col("day"))) + 1).alias("span"),
        F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") == 0).cast("double"))).alias("stale"),
        F.count_if(F.abs("ret") > extreme).alias("n_extreme"),
    )
    missing = F.when(F.col("n_obs") > 0, 1 - F.col("n_obs") / F.col("span")).otherwise(1.0)
    stale = F.coalesce("stale", F.lit(0.0))
    status = F.when(F.col("n_obs") == 0, "no_data").when(F.col("n_obs") < min_history, "short_history").when(missing > max_missing, "gappy").when(stale > max_stale, "stale").otherwise("ok")
    report = stats.select("ticker", "n_obs", "first_date", "last_date", F.round(missing, 4).alias("missing_frac"), F.round(stale, 4).alias("stale_frac"), "n_extreme", status.alias("status"))
    if requested is None:
        return report
    lost = requested.select("ticker").distinct().join(report, "ticker", "left_anti")
    lost = lost.select("ticker", F.lit(0).cast("long").alias("n_obs"), F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"), F.lit(1.0).alias("missing_frac"), F.lit(0.0).alias("stale_frac"), F.lit(0).cast("long").alias("n_extreme"), F.lit("download_failed").alias("status"))
    return report.unionByName(lost)


def sorted_report(report: DataFrame) -> DataFrame:
    return report.orderBy("status", "ticker")


def clean_prices(prices: DataFrame, calendar: DataFrame, report: DataFrame, limit: int = FFILL_LIMIT) -> DataFrame:
    """The ok tickers on the calendar, short gaps filled forward."""
    good = prices.join(report.where("status = 'ok'").select("ticker"), "ticker", "left_semi")
    return densify(good, calendar, ["close"], limit)


def to_returns(prices: DataFrame, log_returns: bool = False, value: str = "close") -> DataFrame:
    """``ret`` beside the prices: NULL if either price is, and never bridged over missing rows."""
    ratio = F.col(value) / F.nullif(F.lag(value).over(by_ticker()), F.lit(0.0))
    step = F.when(ratio > 0, F.ln(ratio)) if log_returns else ratio - 1
    return prices.withColumn("ret", step)


def to_monthly(prices: DataFrame) -> DataFrame:
    """``ticker, month_end, close``: the last price of each month; months without one stay as NULL."""
    last = prices.groupBy("ticker", F.last_day("date").alias("month_end")).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"))
    span = prices.agg(F.trunc(F.min("date"), "month").alias("lo"), F.trunc(F.max("date"), "month").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("month_end"))
    grid = prices.select("ticker").distinct().crossJoin(F.broadcast(months))
    return grid.join(last, ["ticker", "month_end"], "left")


def winsorise(df: DataFrame, limit: float = EXTREME_RETURN, value: str = "ret") -> DataFrame:
    """Values clipped to plus or minus ``limit``; NULL stays NULL."""
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(value))))
    return df.withColumn(value, clipped)


def covered(window: DataFrame, share: float = 0.9, group: Sequence[str] = ()) -> DataFrame:
    """Rows of the tickers with returns on at least ``share`` of the window's dates (rounded down)."""
    days = window.groupBy(*group).agg(F.countDistinct("date").alias("days")) if group else window.agg(F.countDistinct("date").alias("days"))
    seen = window.groupBy(*group, "ticker").agg(F.count("ret").alias("seen"))
    both = seen.join(F.broadcast(days), list(group)) if group else seen.crossJoin(F.broadcast(days))
    good = both.where(F.col("seen") >= F.floor(F.col("days") * share)).select(*group, "ticker")
    return window.join(good, [*group, "ticker"], "left_semi")


def between_dates(df: DataFrame, first, last, open_start: bool = False) -> DataFrame:
    """Rows from ``first`` (or after it) to ``last``, both inclusive."""
    low = F.col("date") > F.lit(first).cast("date") if open_start else F.col("date") >= F.lit(first).cast("date")
    return df.where(low & (F.col("date") <= F.lit(last).cast("date")))


def aligned(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``date, x, y`` on the dates that two series (date, ret) share, where neither is NULL."""
    a, b = left.select("date", F.col("ret").alias(names[0])), right.select("date", F.col("ret").alias(names[1]))
    return a.join(b, "date").dropna()


def unioned(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("x", "y"), fill: float = 0.0) -> DataFrame:
    """The same over all dates of either, with ``fill`` where one is missing."""
    a, b = left.select("date", F.col("ret").alias(names[0])), right.select("date", F.col("ret").alias(names[1]))
    return a.join(b, "date", "full").select("date", *(F.coalesce(n, F.lit(fill)).alias(n) for n in names))


def common_dates(streams: DataFrame) -> DataFrame:
    """Rows (name, date, ...) of the dates that every stream has."""
    total = streams.agg(F.countDistinct("name").alias("total"))
    full = streams.groupBy("date").agg(F.countDistinct("name").alias("n")).crossJoin(F.broadcast(total)).where("n = total").select("date")
    return streams.join(full, "date", "left_semi")


def with_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Market columns (by date) beside every ticker's rows."""
    return panel.join(market, "date", "left")


def month_end_rows(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows on the last calendar date of each month."""
    last = calendar.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")
    return panel.join(F.broadcast(last), "date", "left_semi")


def universe(spark: SparkSession, members: Sequence[tuple[str, str]], suffix: str = "") -> DataFrame:
    """``ticker, sector`` of (name, sector) pairs given by the caller, with an exchange suffix."""
    rows = [(f"{name}{suffix}", sector) for name, sector in members]
    return spark.createDataFrame(rows, "ticker string, sector string")


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Unknown tickers get the sector UNKNOWN."""
    return df.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))


def r6(column: Column | str) -> Column:
    """Rounded for comparison across engines."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
