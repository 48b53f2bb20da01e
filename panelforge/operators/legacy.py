"""The notebook's first variant: monthly returns, min-max scores and a monthly walk without costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .perf import safe
from .tailrisk import z_of


def monthly_returns(monthly: DataFrame) -> DataFrame:
    """``ticker, month_end, ret`` of month-end prices, filled forward; months without a return go."""
    w = Window.partitionBy("ticker").orderBy("month_end")
    rows = monthly.withColumn("close", F.last("close", ignorenulls=True).over(w))
    return rows.withColumn("ret", safe(F.col("close"), F.lag("close").over(w)) - 1).where("ret IS NOT NULL").select("ticker", "month_end", "ret")


def signed_var(confidence: float = 0.95, ret: str = "ret") -> Column:
    """VaR in the opposite sign: a negative number is a loss."""
    return F.avg(ret) + F.lit(z_of(confidence)) * F.stddev_samp(ret)


def drop_correlated(pairs: DataFrame, sharpe: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Tickers (ticker, sharpe) without the worse one of any pair (a, b, value) above the threshold; not greedy."""
    s = lambda side: sharpe.select(F.col("ticker").alias(side), F.col("sharpe").alias(f"s{side}"))
    near = pairs.where((F.col("a") < F.col("b")) & (F.col("value") > threshold)).join(s("a"), "a").join(s("b"), "b")
    worse = near.select(F.when(F.col("sa") >= F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("ticker")).distinct()
    return sharpe.join(worse, "ticker", "left_anti")


def minmax_weights(metrics: DataFrame, columns: dict[str, bool], group: Sequence[str] = ()) -> DataFrame:
    """``score``: mean of min-max scaled metrics (False: less is better); ``weight``: its share."""
    w = Window.partitionBy(*(group or [F.lit(1)]))

    def scaled(c: str, more: bool) -> Column:
        x = safe(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
        return F.coalesce(x if more else 1 - x, F.lit(0.0))

    score = sum((scaled(c, more) for c, more in columns.items()), F.lit(0.0)) / len(columns)
    rows = metrics.withColumn("score", score)
    return rows.withColumn("weight", safe(F.col("score"), F.sum("score").over(w)))


def split_by_date(rows: DataFrame, train_end: str, eval_end: str) -> DataFrame:
    part = F.when(F.col("date") <= F.lit(train_end).cast("date"), "train").when(F.col("date") <= F.lit(eval_end).cast("date"), "eval").otherwise("test")
    return rows.withColumn("part", part)


def monthly_walk(monthly: DataFrame, months: int = 36) -> DataFrame:
    """``month_end, ret``: each month the mean-over-deviation weights of the ``months`` before it; a month is skipped if any
    ticker lacks a return in its window."""
    ends = monthly.select(F.col("month_end").alias("as_of")).distinct()
    number = lambda c: F.year(c) * 12 + F.month(c)
    reach = ends.select("as_of", F.explode(F.sequence(number("as_of") - months - 1, number("as_of"))).alias("number"))
    near = (F.col("month_end") < F.col("as_of")) & (F.col("month_end") > F.add_months("as_of", -months - 1))
    rows = monthly.withColumn("number", number("month_end")).join(F.broadcast(reach), "number").where(near).drop("number")
    stats = rows.groupBy("as_of", "ticker").agg(F.count("ret").alias("n"), safe(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.stddev_samp("ret").alias("vol"))
    names = monthly.select("ticker").distinct().count()
    full = stats.groupBy("as_of").agg(F.count_if(F.col("n") >= months).alias("full")).where(F.col("full") == names)
    weights = minmax_weights(stats.join(full.select("as_of"), "as_of", "left_semi"), {"sharpe": True, "vol": False}, ["as_of"])
    held = weights.join(monthly.select(F.col("month_end").alias("as_of"), "ticker", "ret"), ["as_of", "ticker"])
    return held.groupBy(F.col("as_of").alias("month_end")).agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def renormalised(weights: DataFrame, available: DataFrame) -> DataFrame:
    """Weights of the tickers that are there, scaled to 1."""
    rows = weights.join(available.select("ticker").distinct(), "ticker", "left_semi")
    return rows.withColumn("weight", safe(F.col("weight"), F.sum("weight").over(Window.partitionBy(F.lit(1)))))
