"""Value at risk, expected shortfall, coverage tests and rolling forecasts of return streams (name, date, ret).

A positive VaR is a loss. Quantiles are exact, with linear interpolation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED, TRADING_DAYS

CONFIDENCES = (0.95, 0.99)


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - confidence)


def label(confidence: float) -> str:
    return f"{confidence:.0%}"


def parametric(confidence: float = 0.95, horizon: int = 1, ret: str = "ret") -> Column:
    return -(F.avg(ret) + F.lit(z_of(confidence)) * F.stddev_samp(ret)) * math.sqrt(horizon)


def historical(confidence: float = 0.95, horizon: int = 1, ret: str = "ret") -> Column:
    return -F.percentile(ret, 1 - confidence) * math.sqrt(horizon)


def cornish_fisher(confidence: float = 0.95, horizon: int = 1, ret: str = "ret") -> Column:
    """The normal quantile corrected for population skewness and excess kurtosis."""
    z, s, k = z_of(confidence), F.skewness(ret), F.kurtosis(ret)
    turned = F.lit(z) + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    return -(F.avg(ret) + turned * F.stddev_samp(ret)) * math.sqrt(horizon)


def conditional(streams: DataFrame, confidence: float = 0.95, horizon: int = 1) -> DataFrame:
    """``name, cvar``: the mean of returns at or below the quantile."""
    cut = streams.groupBy("name").agg(F.percentile("ret", 1 - confidence).alias("cut"))
    tail = streams.join(F.broadcast(cut), "name").where("ret <= cut")
    return tail.groupBy("name").agg((-F.avg("ret") * math.sqrt(horizon)).alias("cvar"))


def monte_carlo(streams: DataFrame, confidence: float = 0.95, horizon: int = 1, n_sims: int = 50_000, bootstrap: bool = True, seed: int = SEED) -> DataFrame:
    """``name, monte_carlo``: quantile of compounded ``horizon``-day paths, resampled or normal.

    One grouped-map task simulates one stream, whose length is the calendar's.
    """

    def simulate(rows):
        import numpy as np

        r = rows.sort_values("date")["ret"].dropna().to_numpy()
        rng = np.random.default_rng(seed)
        if not len(r):
            value = None
        else:
            paths = rng.choice(r, size=(n_sims, horizon), replace=True) if bootstrap else rng.normal(r.mean(), r.std(ddof=1), (n_sims, horizon))
            value = float(-np.quantile(np.prod(1 + paths, axis=1) - 1, 1 - confidence))
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "monte_carlo": [value]})

    return streams.select("name", "date", "ret").groupBy("name").applyInPandas(simulate, "name string, monte_carlo double")


def var_summary(streams: DataFrame, confidences: Sequence[float] = CONFIDENCES, simulate: bool = True) -> DataFrame:
    """A row for each stream and confidence: every estimate beside the others."""
    streams = streams.where("ret IS NOT NULL")
    out = None
    for c in confidences:
        one = streams.groupBy("name").agg(parametric(c).alias("parametric"), historical(c).alias("historical"), cornish_fisher(c).alias("cornish_fisher"))
        one = one.join(conditional(streams, c), "name").withColumn("confidence", F.lit(label(c)))
        if simulate:
            one = one.join(monte_carlo(streams, c), "name")
        out = one if out is None else out.unionByName(one)
    return out


def in_money(var: Column, capital: float) -> Column:
    return var * capital


def annualised(var: Column) -> Column:
    return var * math.sqrt(TRADING_DAYS)


def _xlogy(x: Column, y: Column) -> Column:
    """x * ln(y), 0 where y is not a positive probability."""
    return F.when(y > 0, x * F.ln(F.when(y > 0, y))).otherwise(0.0)


def kupiec(n: Column, x: Column, p: Column | float) -> Column:
    """Likelihood ratio of ``x`` breaches in ``n`` days against probability ``p``; NULL without days."""
    n, x, p = n.cast("double"), x.cast("double"), F.lit(p)
    share = x / F.nullif(n, F.lit(0.0))
    null = (n - x) * F.ln(1 - p) + x * F.ln(p)
    alt = _xlogy(n - x, 1 - share) + _xlogy(x, share)
    return F.when(n > 0, -2 * (null - alt))


def independence(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Likelihood ratio of first-order dependence; 0 where a state never occurs, NULL without a pair of days."""
    n00, n01, n10, n11 = (c.cast("double") for c in (n00, n01, n10, n11))
    p01, p11 = n01 / F.nullif(n00 + n01, F.lit(0.0)), n11 / F.nullif(n10 + n11, F.lit(0.0))
    pi = (n01 + n11) / F.nullif(n00 + n01 + n10 + n11, F.lit(0.0))

    def ll(stay: Column, go: Column, p: Column) -> Column:
        good = (p > 0) & (p < 1)
        return F.when(good, stay * F.ln(F.when(good, 1 - p)) + go * F.ln(F.when(good, p))).otherwise(0.0)

    ratio = -2 * (ll(n00 + n10, n01 + n11, pi) - ll(n00, n01, p01) - ll(n10, n11, p11))
    flat = (n00 + n01 == 0) | (n10 + n11 == 0) | (n01 + n11 == 0)
    return F.when(n00 + n01 + n10 + n11 == 0, None).when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), ratio))


def _counts(b: str, prev: str) -> Column:
    """Days, breaches and steps between the states of a flag and that of the day before."""
    step = lambda i, j: F.count_if((F.col(prev) == i) & (F.col(b) == j))
    return F.struct(F.count(b).alias("n_obs"), F.sum(b).alias("n_breaches"), *(step(i, j).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))


def _coverage(c: Column, p: Column | float) -> list[Column]:
    """The statistics of such counts against the probability ``p`` of a breach."""
    n, x = c["n_obs"], c["n_breaches"]
    return [
        n.alias("n_obs"),
        x.alias("n_breaches"),
        (n * p).alias("expected"),
        (x / F.nullif(n, F.lit(0))).alias("breach_rate"),
        kupiec(n, x, p).alias("kupiec_lr"),
        independence(*(c[f"n{i}{j}"] for i in (0, 1) for j in (0, 1))).alias("independence_lr"),
    ]


def _breached(var: Column) -> Column:
    return (F.round("ret", 10) < F.round(-var, 10)).cast("int")


def evaluate(rows: DataFrame, confidence: float) -> DataFrame:
    """Coverage statistics of forecasts (name, date, ret, var): counts, rate and likelihood ratios."""
    w = Window.partitionBy("name").orderBy("date")
    b = rows.where("ret IS NOT NULL AND var IS NOT NULL").withColumn("b", _breached(F.col("var"))).withColumn("prev", F.lag("b").over(w))
    return b.groupBy("name").agg(_counts("b", "prev").alias("c")).select("name", *_coverage(F.col("c"), 1 - confidence))


def with_p_values(table: DataFrame, level: float = 0.05) -> DataFrame:
    """p-values of the likelihood ratios and the verdict, on the small table of results.

    Spark has no error function: the survival of chi-squared with one degree is erfc(sqrt(x / 2)) in an Arrow function;
    with two degrees it is exp(-x / 2).
    """

    @F.pandas_udf("double")
    def chi2(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)))

    joint = F.exp(-(F.col("kupiec_lr") + F.col("independence_lr")) / 2)
    out = table.withColumn("kupiec_p", chi2("kupiec_lr")).withColumn("christoffersen_p", chi2("independence_lr")).withColumn("cc_p", joint)
    return out.withColumn("verdict", F.when(F.col("cc_p") > level, "PASS").when(F.col("cc_p").isNotNull(), "REJECT"))


def rolling_forecasts(streams: DataFrame, window: int = TRADING_DAYS, confidence: float = 0.95, method: str = "historical") -> DataFrame:
    """``var`` for each row from the ``window`` rows before it; the first ``window`` rows have none and go."""
    order = Window.partitionBy("name").orderBy("date")
    w = order.rowsBetween(-window, -1)
    if method == "historical":
        value = -F.percentile("ret", 1 - confidence).over(w)
    elif method == "parametric":
        value = -(F.avg("ret").over(w) + F.lit(z_of(confidence)) * F.stddev_samp("ret").over(w))
    else:
        raise ValueError(f"unknown method {method!r}")
    rows = streams.where("ret IS NOT NULL").withColumn("var", value).withColumn("__row", F.row_number().over(order))
    return rows.where(F.col("__row") > window).drop("__row")


def backtest_table(streams: DataFrame, window: int = TRADING_DAYS, confidences: Sequence[float] = CONFIDENCES) -> DataFrame:
    """Two methods at each confidence, evaluated: ``name, model`` and the statistics.

    All forecasts come from one frame of one window and their flags from one order of the same rows, so a stream is
    shuffled and sorted once.
    """
    order = Window.partitionBy("name").orderBy("date")
    w = order.rowsBetween(-window, -1)
    before = {"cuts": F.percentile("ret", F.array(*(F.lit(1 - c) for c in confidences))), "mean": F.avg("ret"), "sd": F.stddev_samp("ret")}
    known = streams.where("ret IS NOT NULL").select("name", "date", "ret", F.row_number().over(order).alias("k"), *(x.over(w).alias(c) for c, x in before.items()))
    known = known.where(F.col("k") > window)
    var = {}
    for i, c in enumerate(confidences):
        var[f"historical {label(c)}"] = (c, -F.col("cuts")[i])
        var[f"parametric {label(c)}"] = (c, -(F.col("mean") + F.lit(z_of(c)) * F.col("sd")))
    flags = known.select("name", "date", *(_breached(x).alias(f"b{i}") for i, (_, x) in enumerate(var.values())))
    flags = flags.select("*", *(F.lag(f"b{i}").over(order).alias(f"p{i}") for i in range(len(var))))
    counts = flags.groupBy("name").agg(*(_counts(f"b{i}", f"p{i}").alias(f"c{i}") for i in range(len(var))))
    each = F.inline(F.array(*(F.struct(F.lit(model).alias("model"), F.lit(1 - c).alias("p"), F.col(f"c{i}").alias("c")) for i, (model, (c, _)) in enumerate(var.items()))))
    return counts.select("name", each).where("c.n_obs > 0").select("name", *_coverage(F.col("c"), F.col("p")), "model")


def breach_series(streams: DataFrame, window: int = TRADING_DAYS, confidence: float = 0.95) -> DataFrame:
    """Chart data: return, VaR line and whether it is breached."""
    rows = rolling_forecasts(streams, window, confidence)
    return rows.withColumn("breach", F.round("ret", 10) < F.round(-F.col("var"), 10))
