"""Cross-sectional scoring and selection, for all rebalance dates (``as_of``) at once.

A training window is a table (as_of, ticker, date, ret, mkt) with a row for each ticker and date of the window.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RISK_FREE_ANNUAL, TRADING_DAYS, daily_rate
from . import matrix
from .panel import with_sector
from .perf import safe
from .stage import staged

YEAR = math.sqrt(TRADING_DAYS)
METRICS = ("mean_return", "volatility", "sharpe", "sortino", "beta", "treynor", "max_dd", "var_95", "var_99", "momentum")


def window_metrics(train: DataFrame, rf_annual: float = RISK_FREE_ANNUAL, min_obs: int = 200) -> DataFrame:
    """``as_of, ticker``, the metrics and ``n_obs`` of tickers with ``min_obs`` returns in the window.

    The curve treats missing returns as 0, and so does the downside's mean; momentum skips the window's last month.
    """
    rf = daily_rate(rf_annual)
    order = Window.partitionBy("as_of", "ticker").orderBy("date")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = train.withColumn("curve", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(run))
    rows = rows.withColumn("dd", F.col("curve") / F.max("curve").over(run) - 1).withColumn("k", F.row_number().over(order) - 1)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("as_of", "ticker")))
    span = F.least(F.lit(TRADING_DAYS), F.col("n"))
    skip = F.least(F.lit(21), F.floor(span / 4))
    last = F.max(F.when(F.col("k") == F.col("n") - 1 - skip, F.col("curve")))
    first = F.max(F.when(F.col("k") == F.greatest(F.lit(0), F.col("n") - span), F.col("curve")))
    seen, sd = F.count("ret"), F.stddev_samp("ret")
    excess = F.avg("ret") - rf
    beta = safe(F.covar_samp("ret", "mkt"), F.var_samp("mkt"))
    down = F.sqrt(F.avg(F.pow(F.coalesce(F.when(F.col("ret") < 0, F.col("ret")), F.lit(0.0)), 2))) * YEAR
    var = lambda q: F.when(seen > 30, -F.percentile("ret", q))
    out = rows.groupBy("as_of", "ticker").agg(
        (F.avg("ret") * TRADING_DAYS).alias("mean_return"),
        (sd * YEAR).alias("volatility"),
        (safe(excess, sd) * YEAR).alias("sharpe"),
        safe(excess * TRADING_DAYS, down).alias("sortino"),
        beta.alias("beta"),
        safe(F.avg("ret") * TRADING_DAYS - rf_annual, beta).alias("treynor"),
        F.min("dd").alias("max_dd"),
        var(1 - 0.95).alias("var_95"),
        var(1 - 0.99).alias("var_99"),
        (safe(last, first) - 1).alias("momentum"),
        seen.alias("n_obs"),
    )
    return out.where(F.col("n_obs") >= min_obs)


def zscore(column: str, clip: float = 3.0, group: str = "as_of") -> Column:
    """Standard score within the group, clipped; 0 for all where the group doesn't vary."""
    w = Window.partitionBy(group)
    sd = F.stddev_samp(column).over(w)
    z = (F.col(column) - F.avg(column).over(w)) / F.nullif(sd, F.lit(0.0))
    clipped = F.when(F.col(column).isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise(clipped)


def composite_score(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``score``: the weighted sum of z-scores over the sum of absolute weights; unknown metrics are skipped."""
    known = {k: v for k, v in weights.items() if k in metrics.columns}
    if not known:
        return metrics.withColumn("score", F.lit(0.0))
    total = sum((zscore(k) * v for k, v in known.items()), F.lit(0.0))
    return metrics.withColumn("score", total / sum(abs(v) for v in known.values()))


def rank_stocks(train: DataFrame, weights: dict[str, float], rf_annual: float = RISK_FREE_ANNUAL, min_obs: int = 200) -> DataFrame:
    return composite_score(window_metrics(train, rf_annual, min_obs), weights)


def by_score() -> Window:
    return Window.partitionBy("as_of").orderBy(F.desc("score"), "ticker")


def correlation_filter(scores: DataFrame, train: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``scores`` without names too correlated with a better one that is kept.

    Walks down the ranking: a name stays if its absolute correlation with every kept name is below the threshold; an
    undefined one fails. Pairs that fail are found in Spark; the walk over the few names of one as_of is a grouped map.
    """
    ranked = scores.where("score IS NOT NULL").withColumn("place", F.row_number().over(by_score()))
    rows = train.join(ranked.select("as_of", "ticker"), ["as_of", "ticker"], "left_semi")
    corr = matrix.correlation(rows, ["as_of"], once=True)
    spot = ranked.select("as_of", F.col("ticker").alias("t"), "place")
    near = corr.where(F.col("value").isNull() | (F.abs("value") >= threshold))
    near = near.join(spot.select("as_of", F.col("t").alias("a"), F.col("place").alias("pa")), ["as_of", "a"]).join(spot.select("as_of", F.col("t").alias("b"), F.col("place").alias("pb")), ["as_of", "b"])
    later, earlier = F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("pa") > F.col("pb"), F.col("b")).otherwise(F.col("a"))
    blocked = near.groupBy("as_of", later.alias("ticker")).agg(F.collect_set(earlier).alias("blockers"))
    given = ranked.select("as_of", "ticker", "place").join(blocked, ["as_of", "ticker"], "left")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept: set[str] = set()
        for r in rows.sort_values("place").itertuples():
            if r.blockers is None or not kept.intersection(r.blockers):
                kept.add(r.ticker)
        return rows[rows["ticker"].isin(kept)][["as_of", "ticker"]]

    kept = given.groupBy("as_of").applyInPandas(walk, given.select("as_of", "ticker").schema)
    kept = staged(kept, "kept")
    return scores.join(kept, ["as_of", "ticker"], "left_semi")


def select_candidates(scores: DataFrame, train: DataFrame, sectors: DataFrame, n_select: int = 25, threshold: float = 0.85, per_sector: int = 5, min_positions: int = 1) -> DataFrame:
    """``as_of, ticker, score`` of the names to hold.

    Correlation filter, then the first ``per_sector`` of each sector, then the first ``n_select``; if that leaves fewer than
    ``min_positions`` names, the best ``n_select`` by score alone.
    """
    good = with_sector(correlation_filter(scores, train, threshold), sectors)
    in_sector = Window.partitionBy("as_of", "sector").orderBy(F.desc("score"), "ticker")
    good = good.withColumn("s", F.row_number().over(in_sector)).where(F.col("s") <= per_sector)
    good = good.withColumn("r", F.row_number().over(by_score())).where(F.col("r") <= n_select).select("as_of", "ticker", "score")
    enough = good.groupBy("as_of").agg(F.count("*").alias("c")).where(F.col("c") >= min_positions).select("as_of")
    plain = scores.where("score IS NOT NULL").withColumn("r", F.row_number().over(by_score())).where(F.col("r") <= n_select).select("as_of", "ticker", "score")
    return good.join(enough, "as_of", "left_semi").unionByName(plain.join(enough, "as_of", "left_anti"))
