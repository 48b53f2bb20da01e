"""Significance of return streams: stationary bootstrap, Sharpe-ratio probabilities, HAC t-statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RISK_FREE_ANNUAL, SEED, TRADING_DAYS, daily_rate
from .perf import safe

EULER = 0.5772156649015329


def bootstrap_indices(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Politis-Romano indices: a block goes on with probability 1 - 1 / mean_block and wraps at the end."""
    restart = rng.random(n) < 1.0 / mean_block
    restart[0] = True
    begin = np.flatnonzero(restart)
    starts = rng.integers(0, n, len(begin))
    block = np.cumsum(restart) - 1
    return (starts[block] + np.arange(n) - begin[block]) % n


def _sharpe(x: np.ndarray, rf: float) -> np.ndarray:
    sd = x.std(axis=-1, ddof=1)
    return np.where(sd > 1e-10, (x.mean(axis=-1) - rf) / np.where(sd > 1e-10, sd, 1) * math.sqrt(TRADING_DAYS), np.nan)


def bootstrap_sharpe_difference(pairs: DataFrame, n_boot: int = 2000, mean_block: int = 21, seed: int = SEED, rf_annual: float = RISK_FREE_ANNUAL, tasks: int = 8) -> DataFrame:
    """``name, sharpe_diff, ci_low, ci_high, p_value`` of streams (name, date, ret) against ``bench`` on the same rows.

    Both sides are drawn with the same indices. Draws of a stream are spread over ``tasks`` groups with spawned seeds, each
    given the stream (one value a day); a draw's difference is all that comes together again. Under 60 rows: NULL.
    """
    rf = daily_rate(rf_annual)
    rows = pairs.select("name", "date", "ret", "bench").dropna()
    spread = rows.crossJoin(F.broadcast(rows.sparkSession.range(tasks).withColumnRenamed("id", "task")))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        s, b, task = rows["ret"].to_numpy(), rows["bench"].to_numpy(), int(rows["task"].iloc[0])
        if len(s) < 60:
            return pd.DataFrame({"name": [], "diff": [], "observed": []})
        rng = np.random.default_rng(np.random.SeedSequence(seed).spawn(tasks)[task])
        mine = n_boot // tasks + (task < n_boot % tasks)
        at = np.stack([bootstrap_indices(len(s), mean_block, rng) for _ in range(mine)])
        observed = float(_sharpe(s, rf) - _sharpe(b, rf))
        return pd.DataFrame({"name": rows["name"].iloc[0], "diff": _sharpe(s[at], rf) - _sharpe(b[at], rf), "observed": observed})

    draws = spread.groupBy("name", "task").applyInPandas(draw, "name string, diff double, observed double")
    mean = draws.groupBy("name").agg(F.avg("diff").alias("centre"))
    out = draws.join(F.broadcast(mean), "name").groupBy("name").agg(
        F.first("observed").alias("sharpe_diff"),
        F.percentile("diff", 0.025).alias("ci_low"),
        F.percentile("diff", 0.975).alias("ci_high"),
        F.avg((F.abs(F.col("diff") - F.col("centre")) >= F.abs("observed")).cast("double")).alias("p_value"),
    )
    return pairs.select("name").distinct().join(out, "name", "left")


def psr_statistic(threshold: float | Column = 0.0, ret: str = "ret", rf_annual: float = RISK_FREE_ANNUAL) -> Column:
    """z of the probabilistic Sharpe ratio against a daily threshold: population skewness and kurtosis; NULL under 30 rows."""
    n = F.count(ret)
    sr = safe(F.avg(ret) - daily_rate(rf_annual), F.stddev_samp(ret))
    g3, g4 = F.skewness(ret), F.kurtosis(ret) + 3
    spread = F.greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, F.lit(1e-12))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(n >= 30, (sr - limit) * F.sqrt(n - 1.0) / F.sqrt(spread))


def best_of_noise(n_trials: int) -> float:
    """Expected largest of ``n_trials`` standard normal draws."""
    if n_trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e))


def dsr_statistic(n_trials: int, ret: str = "ret", rf_annual: float = RISK_FREE_ANNUAL) -> Column:
    """The same against the best Sharpe ratio that ``n_trials`` streams of noise would show; NULL for a constant stream."""
    limit = F.lit(best_of_noise(n_trials)) / F.sqrt(F.greatest(F.count(ret) - 1.0, F.lit(1.0)))
    return F.when(F.stddev_samp(ret) != 0, psr_statistic(limit, ret, rf_annual))


def normal_cdf(z: str) -> Column:
    """Spark has no error function; the table it is applied to has a row for each stream."""

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v != v else 0.5 * math.erfc(-v / math.sqrt(2)))

    return cdf(z)


def newey_west(active: DataFrame, lags: int = 5) -> DataFrame:
    """``name, t_stat``: mean of ``ret`` over its HAC standard error with Bartlett weights; NULL under 30 rows."""
    w = Window.partitionBy("name").orderBy("date")
    rows = active.where("ret IS NOT NULL").withColumn("e", F.col("ret") - F.avg("ret").over(Window.partitionBy("name")))
    rows = rows.select("name", "ret", "e", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)))
    sums = rows.groupBy("name").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.sum(F.col("e") * F.col("e")).alias("g0"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, lags + 1)))
    total = F.col("g0")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}")
    var = F.greatest(total / F.col("n"), F.lit(1e-18)) / F.col("n")
    return sums.select("name", F.when(F.col("n") >= 30, F.col("m") / F.sqrt(var)).alias("t_stat"))


def significance_table(streams: DataFrame, market: DataFrame, n_boot: int = 2000) -> DataFrame:
    """One row for each stream: bootstrap interval, active t-statistic and p, probabilistic and deflated Sharpe ratios."""
    pairs = streams.join(market.select("date", F.col("ret").alias("bench")), "date").dropna(subset=["ret", "bench"])
    trials = streams.select("name").distinct().count()
    z = streams.groupBy("name").agg(psr_statistic().alias("psr_z"), dsr_statistic(trials).alias("dsr_z"))
    t = newey_west(pairs.select("name", "date", (F.col("ret") - F.col("bench")).alias("ret")))
    out = bootstrap_sharpe_difference(pairs, n_boot).join(t, "name", "left").join(z, "name", "left")
    out = out.withColumn("abs_t", F.abs("t_stat"))
    out = out.withColumn("active_p", 2 * (1 - normal_cdf("abs_t"))).withColumn("psr", normal_cdf("psr_z")).withColumn("dsr", normal_cdf("dsr_z"))
    return out.withColumn("significant_5pct", F.col("ci_low") > 0).drop("abs_t", "psr_z", "dsr_z")


def head_to_head(streams: DataFrame, against: str, n_boot: int = 2000, rf_annual: float = RISK_FREE_ANNUAL) -> DataFrame:
    """The bootstrap of the stream (name, date, ret) with the best Sharpe ratio against the stream ``against``, on their
    common dates; ``against`` itself doesn't compete."""
    sharpe = safe(F.avg("ret") - daily_rate(rf_annual), F.stddev_samp("ret"))
    best = streams.where(F.col("name") != against).groupBy("name").agg(sharpe.alias("s")).orderBy(F.desc_nulls_last("s"), "name").limit(1).select("name")
    other = streams.where(F.col("name") == against).select("date", F.col("ret").alias("bench"))
    return bootstrap_sharpe_difference(streams.join(F.broadcast(best), "name").join(other, "date"), n_boot)
