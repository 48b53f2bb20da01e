"""Covariance and correlation as pair tables (as_of, a, b, value), both orders and the diagonal included.

Pairs come from a self-join on (as_of, date), so a task holds the pairs of a few dates; aggregates are partial before the
shuffle. Solvers get dense arrays of the few names of one ``as_of`` in a grouped-map task. ``listwise`` estimators first
keep the dates on which every ticker of the group has a return.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EWMA_LAMBDA, TRADING_DAYS
from .perf import safe


def listwise(returns: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows of the dates on which all tickers of the group have a return; tickers without any are left out."""
    rows = returns.where("ret IS NOT NULL")
    names = rows.groupBy(*group).agg(F.countDistinct("ticker").alias("names"))
    full = rows.groupBy(*group, "date").agg(F.count("ret").alias("seen"))
    full = full.join(F.broadcast(names), list(group)) if group else full.crossJoin(F.broadcast(names))
    return rows.join(full.where("seen = names").select(*group, "date"), [*group, "date"], "left_semi")


def paired(returns: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``a, x, b, y``: each date's returns of every ordered pair of tickers."""
    keys = [*group, "date"]
    left = returns.select(*keys, F.col("ticker").alias("a"), F.col("ret").alias("x"))
    right = returns.select(*keys, F.col("ticker").alias("b"), F.col("ret").alias("y"))
    return left.join(right, keys)


def sample_cov(returns: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete sample covariance."""
    rows = paired(returns.where("ret IS NOT NULL"), group)
    return rows.groupBy(*group, "a", "b").agg(F.covar_samp("x", "y").alias("value"))


def correlation(returns: DataFrame, group: Sequence[str] = (), once: bool = False) -> DataFrame:
    """Pairwise-complete correlation; NULL where a side is constant. ``once``: only pairs with a before b."""
    rows = paired(returns.where("ret IS NOT NULL"), group)
    rows = rows.where("a < b") if once else rows
    return rows.groupBy(*group, "a", "b").agg(safe(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("value"))


def _moments(returns: DataFrame, group: Sequence[str]) -> DataFrame:
    """Population covariance pairs of listwise rows, with n (dates) and p (names) of the group."""
    rows = listwise(returns, group)
    size = rows.groupBy(*group).agg(F.countDistinct("date").cast("double").alias("n"), F.countDistinct("ticker").cast("double").alias("p"))
    pairs = paired(rows, group).groupBy(*group, "a", "b").agg(F.covar_pop("x", "y").alias("s"))
    return pairs.join(F.broadcast(size), list(group)) if group else pairs.crossJoin(F.broadcast(size))


def _shrunk(pairs: DataFrame, rho: DataFrame, group: Sequence[str]) -> DataFrame:
    """(1 - rho) S + rho mu I."""
    both = pairs.join(F.broadcast(rho), list(group)) if group else pairs.crossJoin(F.broadcast(rho))
    own = F.when(F.col("a") == F.col("b"), F.col("rho") * F.col("mu")).otherwise(0.0)
    return both.select(*group, "a", "b", ((1 - F.col("rho")) * F.col("s") + own).alias("value"))


def ledoit_wolf_cov(returns: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Shrinkage to a scaled identity with the intensity of Ledoit and Wolf (2004), on population moments.

    The mean squared error of the sample needs, besides S, only each date's squared norm of demeaned returns.
    """
    pairs = _moments(returns, group)
    rows = listwise(returns, group)
    w = Window.partitionBy(*group, "ticker")
    centred = rows.withColumn("x", F.col("ret") - F.avg("ret").over(w))
    norms = centred.groupBy(*group, "date").agg(F.sum(F.col("x") * F.col("x")).alias("q")).groupBy(*group).agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    trace = F.sum(F.when(F.col("a") == F.col("b"), F.col("s")))
    stats = pairs.groupBy(*group).agg((trace / F.first("p")).alias("mu"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.first("n").alias("n"), F.first("p").alias("p"))
    stats = stats.join(norms, list(group)) if group else stats.crossJoin(norms)
    delta = (F.col("ss") - F.col("p") * F.col("mu") * F.col("mu")) / F.col("p")
    beta = F.least(delta, (F.col("q2") / F.col("n") - F.col("ss")) / (F.col("n") * F.col("p")))
    rho = F.when(beta <= 0, F.lit(0.0)).otherwise(F.coalesce(safe(beta, delta), F.lit(0.0)))
    return _shrunk(pairs, stats.select(*group, "mu", rho.alias("rho")), group)


def oas_cov(returns: DataFrame, group: Sequence[str] = (), keep_small_terms: bool = False) -> DataFrame:
    """Oracle-approximating shrinkage (Chen et al. 2010); ``keep_small_terms`` keeps the paper's 2 / p terms."""
    pairs = _moments(returns, group)
    trace = F.sum(F.when(F.col("a") == F.col("b"), F.col("s")))
    stats = pairs.groupBy(*group).agg(trace.alias("tr"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.first("n").alias("n"), F.first("p").alias("p"))
    n, p, tr, ss = (F.col(c) for c in ("n", "p", "tr", "ss"))
    if keep_small_terms:
        num, den = (1 - 2 / p) * ss + tr * tr, (n + 1 - 2 / p) * (ss - tr * tr / p)
    else:
        phi, mu = ss / (p * p), tr / p
        num, den = phi + mu * mu, (n + 1) * (phi - mu * mu / p)
    rho = F.when(den == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), safe(num, den)))
    return _shrunk(pairs, stats.select(*group, (tr / p).alias("mu"), rho.alias("rho")), group)


def constant_correlation_cov(returns: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Every pair gets the mean correlation; variances are the sample's."""
    pairs = sample_cov(listwise(returns, group), group)
    sd = pairs.where("a = b").select(*group, F.col("a").alias("t"), F.sqrt("value").alias("sd"))
    both = pairs.join(sd.select(*group, F.col("t").alias("a"), F.col("sd").alias("sa")), [*group, "a"]).join(sd.select(*group, F.col("t").alias("b"), F.col("sd").alias("sb")), [*group, "b"])
    mean = both.where("a <> b").groupBy(*group).agg(F.avg(safe(F.col("value"), F.col("sa") * F.col("sb"))).alias("r"))
    out = both.join(F.broadcast(mean), list(group), "left") if group else both.crossJoin(F.broadcast(mean))
    return out.select(*group, "a", "b", F.when(F.col("a") == F.col("b"), F.col("value")).otherwise(F.coalesce("r", F.lit(0.0)) * F.col("sa") * F.col("sb")).alias("value"))


def ewma_cov(returns: DataFrame, lam: float = EWMA_LAMBDA, group: Sequence[str] = ()) -> DataFrame:
    """Exponentially weighted covariance of listwise rows, about the weighted mean."""
    rows = listwise(returns, group)
    days = rows.select(*group, "date").distinct()
    age = F.row_number().over(Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc("date"))) - 1
    days = days.withColumn("w", F.pow(F.lit(lam), age))
    rows = rows.join(F.broadcast(days), [*group, "date"])
    mean = F.sum(F.col("w") * F.col("ret")) / F.sum("w")
    centre = rows.groupBy(*group, "ticker").agg(mean.alias("m"))
    rows = rows.join(centre, [*group, "ticker"]).withColumn("ret", F.col("ret") - F.col("m"))
    weights = rows.select(*group, "date", "w").distinct()
    pairs = paired(rows, group).join(F.broadcast(weights), [*group, "date"])
    return pairs.groupBy(*group, "a", "b").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / F.sum("w")).alias("value"))


#: Estimators by name.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {"sample": sample_cov, "ledoit_wolf": ledoit_wolf_cov, "oas": oas_cov, "constant_corr": constant_correlation_cov, "ewma": ewma_cov}


def dense(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order and the matrix of one group's pairs."""
    square = pairs.pivot(index="a", columns="b", values="value").sort_index().sort_index(axis=1)
    return list(square.index), square.to_numpy(dtype=float)


def condition(matrix: np.ndarray) -> float:
    """Largest over smallest positive eigenvalue; infinite without one."""
    values = np.linalg.eigvalsh((matrix + matrix.T) / 2)
    values = values[values > 0]
    return float(values.max() / values.min()) if len(values) else math.inf


def psd(matrix: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Symmetric, with eigenvalues raised to ``least``."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    out = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    return (out + out.T) / 2


def condition_number(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    rows = pairs if group else pairs.withColumn("__g", F.lit(1))
    keys = list(group) or ["__g"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*rows[keys].iloc[0], condition(dense(rows)[1])]], columns=[*keys, "condition"])

    out = rows.groupBy(*keys).applyInPandas(one, f"{kinds}, condition double")
    return out if group else out.drop("__g")


def nearest_psd(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    rows = pairs if group else pairs.withColumn("__g", F.lit(1))
    keys = list(group) or ["__g"]
    rows = rows.select(*keys, "a", "b", "value")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names, matrix = dense(rows)
        fixed = pd.DataFrame(psd(matrix), index=names, columns=names).rename_axis("a").reset_index().melt("a", var_name="b", value_name="value")
        for k in keys:
            fixed[k] = rows[k].iloc[0]
        return fixed[[*keys, "a", "b", "value"]]

    out = rows.groupBy(*keys).applyInPandas(one, rows.schema)
    return out if group else out.drop("__g")


def cov_from_vols(returns: DataFrame, vols: DataFrame, shrink: bool = True, group: Sequence[str] = ()) -> DataFrame:
    """Correlations of the (shrunk) covariance scaled by forecast daily volatilities (ticker, vol; annual).

    A missing forecast falls back to the ticker's own volatility; both are at least 1e-4. Feed it to ``nearest_psd``.
    """
    base = (ledoit_wolf_cov if shrink else sample_cov)(returns, group)
    own = returns.groupBy(*group, "ticker").agg((F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias("own"))
    shared = [*[g for g in group if g in vols.columns], "ticker"]
    scale = own.join(vols, shared, "left").select(*group, "ticker", F.greatest(F.coalesce("vol", "own"), F.lit(1e-4)).alias("v"))
    sd = base.where("a = b").select(*group, F.col("a").alias("ticker"), F.sqrt("value").alias("sd"))
    side: Callable[[str], DataFrame] = lambda s: scale.join(sd, [*group, "ticker"]).select(*group, F.col("ticker").alias(s), F.col("v").alias(f"v{s}"), F.col("sd").alias(f"sd{s}"))
    both = base.join(side("a"), [*group, "a"]).join(side("b"), [*group, "b"])
    corr: Column = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.coalesce(safe(F.col("value"), F.col("sda") * F.col("sdb")), F.lit(0.0)))
    return both.select(*group, "a", "b", (corr * F.col("va") * F.col("vb")).alias("value"))
