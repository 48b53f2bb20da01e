"""Allocation: weights of the chosen names of each (strategy, as_of).

Closed forms are window expressions. The three optimisers get one group's few names as numpy arrays and run spectral
projected gradients over box, sum and sector constraints; a run that doesn't converge gives equal weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RISK_FREE_ANNUAL, TRADING_DAYS
from . import matrix


@dataclass(frozen=True)
class Constraints:
    """Bounds of single weights and of sectors; the cap is relaxed where it can't add up to 1."""

    min_weight: float = 0.0
    max_weight: float = 0.15
    max_sector: float = 0.35
    sectors: dict[str, str] = field(default_factory=dict)

    def cap(self, n: int) -> float:
        return max(self.max_weight, 1.0 / n) if n else self.max_weight

    def feasible(self, n: int) -> bool:
        return n * self.max_weight >= 1.0

    def bounds(self, n: int) -> list[tuple[float, float]]:
        return [(self.min_weight, self.cap(n))] * n

    def sector_matrix(self, names: Sequence[str]) -> np.ndarray:
        """A row of 0 and 1 for each sector with more names than its limit could hold."""
        owner = [self.sectors.get(n, "UNKNOWN") for n in names]
        return np.array([[float(o == s) for o in owner] for s in sorted(set(owner))]) if self.sectors else np.zeros((0, len(names)))


def effective_cap(max_weight: float, group: Sequence[str]) -> Column:
    return F.greatest(F.lit(max_weight), 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*group)))


def apply_caps(df: DataFrame, max_weight: float, raw: str = "raw", group: Sequence[str] = ("as_of",)) -> DataFrame:
    """``weight``: ``raw`` (negative as 0) scaled to sum to 1 with no weight above the cap; the excess of capped names goes to
    the others in proportion.

    In falling order, the first ``k`` names are capped, for the smallest ``k`` at which the others, scaled to fill the rest,
    stay within the cap: one sort, a running sum from below, one minimum. All zero gives equal weights.
    """
    whole = Window.partitionBy(*group)
    down = Window.partitionBy(*group).orderBy(F.desc("__w"), "ticker")
    rows = df.withColumn("__w", F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__sum", F.sum("__w").over(whole))
    rows = rows.withColumn("__w", F.when(F.col("__sum") > 0, F.col("__w") / F.nullif("__sum", F.lit(0.0))).otherwise(1.0 / F.col("__n")))
    rows = rows.withColumn("__cap", F.greatest(F.lit(max_weight), 1.0 / F.col("__n"))).withColumn("__k", F.row_number().over(down) - 1)
    tail = F.sum("__w").over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__scale", (1.0 - F.col("__k") * F.col("__cap")) / F.nullif(tail, F.lit(0.0)))
    fits = F.when(F.col("__scale") * F.col("__w") <= F.col("__cap") + 1e-12, F.struct("__k", "__scale"))
    rows = rows.withColumn("__best", F.min(fits).over(whole))
    capped = F.col("__best").isNull() | (F.col("__k") < F.col("__best.__k"))
    rows = rows.withColumn("weight", F.when(capped, F.col("__cap")).otherwise(F.col("__w") * F.col("__best.__scale")))
    return rows.drop("__w", "__n", "__sum", "__cap", "__k", "__scale", "__best")


def clean(df: DataFrame, group: Sequence[str] = ("as_of",), dust: float = 1e-6) -> DataFrame:
    """Weights without negatives and dust, scaled to 1; all zero gives equal weights."""
    w = Window.partitionBy(*group)
    kept = F.when(F.col("weight") >= dust, F.col("weight")).otherwise(0.0)
    total, n = F.sum(kept).over(w), F.count(F.lit(1)).over(w)
    return df.withColumn("weight", F.when(total > 0, kept / F.nullif(total, F.lit(0.0))).otherwise(1.0 / n))


def equal_weight(chosen: DataFrame, train: DataFrame, cons: Constraints) -> DataFrame:
    return apply_caps(chosen.withColumn("raw", F.lit(1.0)), cons.max_weight).drop("raw")


def inverse_vol(chosen: DataFrame, train: DataFrame, cons: Constraints) -> DataFrame:
    vol = train.groupBy("as_of", "ticker").agg(F.stddev_samp("ret").alias("__vol"))
    rows = chosen.join(vol, ["as_of", "ticker"], "left").withColumn("raw", F.coalesce(1.0 / F.nullif("__vol", F.lit(0.0)), F.lit(0.0)))
    return apply_caps(rows, cons.max_weight).drop("raw", "__vol")


def score_based(chosen: DataFrame, train: DataFrame, cons: Constraints, temperature: float = 1.0) -> DataFrame:
    """Softmax of standardised scores; missing scores take the mean."""
    w = Window.partitionBy("as_of")
    rows = chosen.withColumn("__s", F.coalesce("score", F.avg("score").over(w), F.lit(0.0)))
    sd = F.stddev_samp("__s").over(w)
    z = F.when(sd > 0, (F.col("__s") - F.avg("__s").over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)
    soft = F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z / max(temperature, 1e-6))))
    return apply_caps(rows.withColumn("raw", soft), cons.max_weight).drop("raw", "__s")


# Optimisers on the arrays of one group.


def projector(n: int, low: float, high: float, sectors: np.ndarray, limit: float) -> Callable[[np.ndarray], np.ndarray]:
    """Nearest point with weights in [low, high] that sum to 1 and no sector above ``limit``.

    Sectors are disjoint, so the point is the clipped input less one shift for the sum and, in a sector that would exceed
    its limit, a further one; both are found by bisection. Limits that can't add up to 1 are left out.
    """
    groups = [np.flatnonzero(s) for s in sectors] if len(sectors) and sum(min(limit, s.sum() * high) for s in sectors) >= 1 else []

    def to_sum(v: np.ndarray, total: float) -> np.ndarray:
        a, b = v.min() - high, v.max() - low
        for _ in range(50):
            mid = (a + b) / 2
            a, b = (mid, b) if np.clip(v - mid, low, high).sum() > total else (a, mid)
        return np.clip(v - (a + b) / 2, low, high)

    def shifted(v: np.ndarray, by: float) -> np.ndarray:
        x = np.clip(v - by, low, high)
        for g in groups:
            if x[g].sum() > limit:
                x[g] = to_sum(v[g], max(limit, low * len(g)))
        return x

    def project(v: np.ndarray) -> np.ndarray:
        a, b = v.min() - high, v.max() - low
        for _ in range(50):
            mid = (a + b) / 2
            a, b = (mid, b) if shifted(v, mid).sum() > 1 else (a, mid)
        return shifted(v, (a + b) / 2)

    return project


def descend(value: Callable, slope: Callable, project: Callable, start: np.ndarray, steps: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, bool]:
    """Spectral projected gradient with a line search over the last ten values."""
    x, g, size = project(start), None, 1.0
    g, recent = slope(x), [value(x)]
    for _ in range(steps):
        move = project(x - size * g) - x
        if np.abs(move).max() < tol:
            return x, True
        t, down = 1.0, float(g @ move)
        while value(x + t * move) > max(recent[-10:]) + 1e-4 * t * down and t > 1e-10:
            t /= 2
        new = x + t * move
        fresh = slope(new)
        s, y = new - x, fresh - g
        size = float(np.clip(s @ s / (s @ y), 1e-8, 1e8)) if s @ y > 0 else 1e4
        x, g = new, fresh
        recent.append(value(x))
    return x, np.abs(project(x - g) - x).max() < 1e-4


def min_variance_weights(cov: np.ndarray, project: Callable) -> tuple[np.ndarray, bool]:
    scale = max(float(np.trace(cov)) / len(cov), 1e-18)
    s = cov / scale
    return descend(lambda w: float(w @ s @ w), lambda w: 2 * s @ w, project, np.full(len(s), 1 / len(s)))


def risk_parity_weights(cov: np.ndarray, project: Callable) -> tuple[np.ndarray, bool]:
    """Least squares of risk shares against equal ones, from the uncapped solution of the log-barrier form."""
    n = len(cov)
    s = cov / max(float(np.trace(cov)) / n, 1e-18)
    x = 1 / np.sqrt(np.diag(s))
    for _ in range(500):
        for i in range(n):
            rest = s[i] @ x - s[i, i] * x[i]
            x[i] = (-rest + math.sqrt(rest * rest + 4 * s[i, i] / n)) / (2 * s[i, i])

    def shares(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        m = s @ w
        total = float(w @ m)
        return w * m / total, m, total

    def value(w: np.ndarray) -> float:
        return n * float(np.square(shares(w)[0] - 1 / n).sum())

    def slope(w: np.ndarray) -> np.ndarray:
        r, m, total = shares(w)
        e = 2 * n * (r - 1 / n)
        return (e * m + s @ (e * w)) / total - 2 * m * float(e @ r) / total

    return descend(value, slope, project, x / x.sum())


def max_sharpe_weights(cov: np.ndarray, mean: np.ndarray, rf: float, project: Callable) -> tuple[np.ndarray, bool]:
    """Best ratio of excess mean to volatility, from several starts."""
    mean = np.nan_to_num(mean)
    n = len(mean)

    def value(w: np.ndarray) -> float:
        return -float((w @ mean - rf) / math.sqrt(max(w @ cov @ w, 1e-18)))

    def slope(w: np.ndarray) -> np.ndarray:
        v = max(float(w @ cov @ w), 1e-18)
        return -(mean / math.sqrt(v) - (w @ mean - rf) * (cov @ w) / v**1.5)

    starts = [np.full(n, 1 / n), project(mean - mean.mean()), project(10 * (mean - mean.mean()))]
    runs = [descend(value, slope, project, x) for x in starts]
    return min(runs, key=lambda r: value(r[0]))


def _tidy(w: np.ndarray) -> np.ndarray:
    w = np.where(w < 1e-6, 0.0, w)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def optimised(kind: str, chosen: DataFrame, train: DataFrame, cons: Constraints, cov: DataFrame | None = None, rf: float = RISK_FREE_ANNUAL) -> DataFrame:
    """``as_of, ticker, weight, converged`` by an optimiser; ``cov`` defaults to the shrunk covariance of the window.

    ``max_sharpe`` reads expected annual returns from ``mean_return`` of ``chosen``.
    """
    rows = train.join(chosen.select("as_of", "ticker"), ["as_of", "ticker"], "left_semi")
    pairs = cov if cov is not None else matrix.ledoit_wolf_cov(rows, ["as_of"])
    mean = chosen.select("as_of", F.col("ticker").alias("a"), (F.col("mean_return") if "mean_return" in chosen.columns else F.lit(None).cast("double")).alias("mean"))
    given = pairs.select("as_of", "a", "b", "value").join(mean, ["as_of", "a"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, s = matrix.dense(rows)
        n = len(names)
        s = matrix.psd(np.nan_to_num(s)) * TRADING_DAYS
        mu = rows.drop_duplicates("a").set_index("a")["mean"].reindex(names).to_numpy(dtype=float)
        low = max(cons.min_weight, 1e-4) if kind == "risk_parity" else cons.min_weight
        project = projector(n, low, cons.cap(n), cons.sector_matrix(names), cons.max_sector)
        try:
            w, good = {"min_variance": lambda: min_variance_weights(s, project), "risk_parity": lambda: risk_parity_weights(s, project), "max_sharpe": lambda: max_sharpe_weights(s, mu, rf, project)}[kind]()
        except np.linalg.LinAlgError:
            w, good = np.full(n, 1 / n), False
        w = _tidy(w) if good else np.full(n, 1 / n)
        return pd.DataFrame({"as_of": rows["as_of"].iloc[0], "ticker": names, "weight": w, "converged": good})

    return given.groupBy("as_of").applyInPandas(solve, "as_of date, ticker string, weight double, converged boolean")


#: Allocators by name: (chosen, train, constraints) -> as_of, ticker, weight.
ALLOCATORS: dict[str, Callable[..., DataFrame]] = {
    "equal_weight": equal_weight,
    "inverse_vol": inverse_vol,
    "min_variance": lambda *a, **k: optimised("min_variance", *a, **k),
    "risk_parity": lambda *a, **k: optimised("risk_parity", *a, **k),
    "max_sharpe": lambda *a, **k: optimised("max_sharpe", *a, **k),
    "score_based": score_based,
}
