"""Volatility forecasts: scores, baselines, tests between models, boosted trees and GARCH."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HORIZON, SEED, TRADING_DAYS
from .signif import normal_cdf
from .stage import staged


def qlike_loss(actual: str, pred: str, floor: float = 1e-10) -> Column:
    ratio = F.col(actual) * F.col(actual) / F.greatest(F.col(pred) * F.col(pred), F.lit(floor))
    return ratio - F.ln(ratio) - 1


def scores(actual: str = "actual", pred: str = "pred") -> dict[str, Column]:
    """Aggregates: rmse, mae, qlike and r2 (NULL if the actual values don't vary)."""
    err = F.col(actual) - F.col(pred)
    total = F.var_pop(actual) * F.count(actual)
    return {"rmse": F.sqrt(F.avg(err * err)), "mae": F.avg(F.abs(err)), "qlike": F.avg(qlike_loss(actual, pred)), "r2": F.when(total > 0, 1 - F.sum(err * err) / F.nullif(total, F.lit(0.0))), "n": F.count(pred)}


def stacked(preds: DataFrame, models: Sequence[str], keep: Sequence[str] = ("date", "ticker", "actual")) -> DataFrame:
    """A row for each prediction and model (``model, pred``), finite and positive on both sides."""
    long = preds.unpivot(list(keep), list(models), "model", "pred")
    return long.where("actual > 0 AND pred > 0 AND NOT isnan(actual) AND NOT isnan(pred) AND pred < double('infinity')")


def evaluate_predictions(preds: DataFrame, models: Sequence[str], garch: DataFrame | None = None, reference: str = "ewma_94") -> DataFrame:
    """Scores by model and their change against ``reference`` in percent; with GARCH, only rows that have its forecast."""
    rows = preds
    if garch is not None:
        rows, models = preds.join(garch.select("date", "ticker", "garch"), ["date", "ticker"], "left").where("garch IS NOT NULL"), [*models, "garch"]
    table = stacked(rows, models).groupBy("model").agg(*(c.alias(k) for k, c in scores().items()))
    base = table.where(F.col("model") == reference).select(F.col("rmse").alias("r0"), F.col("qlike").alias("q0"))
    out = table.crossJoin(F.broadcast(base))
    pct = lambda c, b: (F.col(c) / F.nullif(F.col(b), F.lit(0.0)) - 1) * 100
    return out.select("model", "rmse", "mae", "qlike", "r2", "n", pct("rmse", "r0").alias("rmse_vs_reference"), pct("qlike", "q0").alias("qlike_vs_reference"))


def yearly_scores(preds: DataFrame, models: Sequence[str]) -> DataFrame:
    rows = stacked(preds.withColumn("year", F.year("date").cast("long")), models, ("date", "ticker", "year", "actual"))
    return rows.groupBy("year", "model").agg(*(c.alias(k) for k, c in scores().items()))


def hybrid(short: str = "rv_21", long: str = "rv_252") -> Column:
    """Mean of short and long volatility, the short one standing in for a missing long one."""
    return 0.5 * F.col(short) + 0.5 * F.coalesce(long, short)


def baselines() -> dict[str, Column]:
    """Random walk, EWMA and the mean of short and long volatility, the quarter's standing in for a missing year's."""
    return {"random_walk": F.col("rv_21"), "ewma": F.col("ewma_94"), "hybrid": 0.5 * F.col("rv_21") + 0.5 * F.coalesce("rv_252", "rv_63")}


def _carried(rows: DataFrame, lags: int) -> DataFrame:
    """Rows in buckets of months, each with the ``lags`` rows before its first (``own`` false), wherever those stand.

    Only a few rows a bucket are put in one order, so no task orders the whole table.
    """
    rows = rows.withColumn("bucket", F.year("date") * 12 + F.month("date"))
    back = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("date"), F.desc("ticker")))
    tails = rows.withColumn("back", back).where(F.col("back") <= lags)
    entry = F.struct("date", "ticker", "e")
    ends = tails.groupBy("bucket").agg(F.array_sort(F.collect_list(entry)).alias("tail"))
    above = Window.orderBy("bucket").rowsBetween(-lags, -1)
    earlier = ends.select("bucket", F.flatten(F.collect_list("tail").over(above)).alias("earlier"))
    carried = earlier.select("bucket", F.explode(F.slice(F.reverse("earlier"), 1, lags)).alias("x")).select("bucket", "x.*", F.lit(False).alias("own"))
    return rows.select("bucket", "date", "ticker", "e", F.lit(True).alias("own")).unionByName(carried)


def diebold_mariano(rows: DataFrame, a: str, b: str, loss: str = "qlike", lags: int = HORIZON, actual: str = "actual") -> DataFrame:
    """``stat, p, n`` of the loss difference of two forecasts, with a HAC error over rows in order of (date, ticker).

    ``p`` is two-sided and normal; both are NULL under 30 rows. The rows are in one order, as the test is defined, but are
    lagged in buckets of months that carry the rows before them.
    """

    def cost(c: str) -> Column:
        p = F.greatest(F.col(c), F.lit(1e-8))
        ratio = F.col(actual) * F.col(actual) / (p * p)
        return ratio - F.when(ratio > 0, F.ln(ratio)) - 1 if loss == "qlike" else F.pow(F.col(actual) - p, 2)

    d = rows.select("date", "ticker", (cost(a) - cost(b)).alias("d")).where("d IS NOT NULL AND NOT isnan(d) AND abs(d) < double('infinity')")
    mean = d.agg(F.avg("d").alias("m"))
    e = d.crossJoin(F.broadcast(mean)).select("date", "ticker", (F.col("d") - F.col("m")).alias("e"))  # one row
    w = Window.partitionBy("bucket").orderBy("date", "ticker")
    lagged = _carried(e, lags).select("e", "own", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1))).where("own")
    sums = lagged.agg(F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"), *(F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)))
    total = F.col("g0")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}")
    error = F.sqrt(F.greatest(total / F.col("n") / F.col("n"), F.lit(1e-18)))
    out = sums.crossJoin(mean).select(F.when(F.col("n") >= 30, F.col("m") / error).alias("stat"), "n")  # one row each
    return out.withColumn("size", F.abs("stat")).select("stat", (2 * (1 - normal_cdf("size"))).alias("p"), "n")


def dm_table(preds: DataFrame, model: str, contenders: Sequence[str]) -> DataFrame:
    """``comparison, loss, stat, p, n, verdict`` of a model against each contender under both losses, on rows that have all
    of actual value, model and contender."""
    out = None
    for other in contenders:
        rows = preds.dropna(subset=["actual", model, other])
        for loss in ("qlike", "mse"):
            one = diebold_mariano(rows, model, other, loss).select(F.lit(f"{model} vs {other}").alias("comparison"), F.lit(loss.upper()).alias("loss"), "stat", "p", "n")
            out = one if out is None else out.unionByName(one)
    return out.withColumn("verdict", verdict(F.col("stat"), F.col("p")))


def verdict(stat: Column, p: Column, level: float = 0.05) -> Column:
    return F.when(p.isNull() | (p >= level), "no significant difference").when(stat < 0, "first better").otherwise("second better")


class Booster:
    """Least-squares gradient boosting of shallow trees over quantile bins; missing values have a bin of their own.

    Each round draws a share of the rows and of the features. ``l2`` is added to a node's rows where its value and gain are
    worked out. ``gain`` adds up what each feature's splits gain.
    """

    def __init__(self, rounds: int = 400, depth: int = 5, rate: float = 0.05, least: int = 100, bins: int = 48, share: float = 0.8, l2: float = 1.0, seed: int = SEED):
        self.rounds, self.depth, self.rate, self.least, self.bins, self.share, self.l2 = rounds, depth, rate, least, bins, share, l2
        self.rng = np.random.default_rng(seed)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.stack([np.searchsorted(c, x[:, j], "right") + 1 for j, c in enumerate(self.cuts)], 1)
        return np.where(np.isnan(x), 0, out)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        q = np.linspace(0, 1, self.bins)[1:-1]
        self.cuts = [np.unique(np.quantile(c[~np.isnan(c)], q)) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        z = self._binned(x)
        self.base, self.trees, self.gain = float(y.mean()), [], np.zeros(x.shape[1])
        pred = np.full(len(y), self.base)
        for _ in range(self.rounds):
            some = np.flatnonzero(self.rng.random(len(y)) < self.share)
            used = np.sort(self.rng.permutation(x.shape[1])[: max(1, round(self.share * x.shape[1]))])
            flat = z[:, used] + np.arange(len(used)) * (self.bins + 1)
            tree: list = []
            self._grow(flat, used, y - pred, some if len(some) else np.arange(len(y)), self.depth, tree)
            self.trees.append(tree)
            pred += self.rate * self._values(tree, z)
        return self

    def _grow(self, flat: np.ndarray, used: np.ndarray, r: np.ndarray, rows: np.ndarray, depth: int, tree: list) -> None:
        total, n = r[rows].sum(), len(rows)
        gain = np.zeros(1)
        if depth and n >= 2 * self.least:
            here, width = flat[rows].ravel(), self.bins + 1
            many = np.bincount(here, minlength=len(used) * width).reshape(len(used), width).cumsum(1)[:, :-1]
            sums = np.bincount(here, np.repeat(r[rows], len(used)), minlength=len(used) * width).reshape(len(used), width).cumsum(1)[:, :-1]
            good = (many >= self.least) & (n - many >= self.least)
            gain = np.where(good, sums**2 / (many + self.l2) + (total - sums) ** 2 / (n - many + self.l2) - total**2 / (n + self.l2), 0.0)
        if gain.max() <= 1e-12:
            tree.append(float(total / (n + self.l2)))
            return
        j, cut = divmod(int(gain.argmax()), gain.shape[1])
        self.gain[used[j]] += float(gain.max())
        at = len(tree)
        tree.append(None)
        left = flat[rows, j] - j * (self.bins + 1) <= cut
        self._grow(flat, used, r, rows[left], depth - 1, tree)
        right = len(tree)
        self._grow(flat, used, r, rows[~left], depth - 1, tree)
        tree[at] = (int(used[j]), cut, at + 1, right)

    def _values(self, tree: list, z: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(z)), [(0, np.arange(len(z)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(tree[node], float):
                out[rows] = tree[node]
            else:
                j, cut, a, b = tree[node]
                go = z[rows, j] <= cut
                stack += [(a, rows[go]), (b, rows[~go])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        z, out = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._values(tree, z)
        return out


def walk_forward(panel: DataFrame, features: Sequence[str], target: str = "fwd_vol_21", start_year: int = 2018, min_train: int = 3000, keep: Sequence[str] = ("rv_21", "ewma_94", "rv_252"), embargo_days: int = 0, log_target: bool = True) -> tuple[DataFrame, DataFrame]:
    """(predictions, gains) of expanding yearly folds: each year from models that saw only earlier years' rows.

    Gains are ``feature, fold_year, gain``. A fold is one grouped-map task over the rows up to its year; folds run in
    parallel, and their rows are written once for both results. With ``embargo_days`` rows that many days before the year
    don't train either, as the target reaches a horizon past its date. Raises ValueError if no fold has ``min_train`` rows.
    """
    rows = panel.select("date", "ticker", target, *features).where(F.col(target).isNotNull())
    years = rows.select(F.year("date").alias("fold_year")).distinct().where(F.col("fold_year") >= start_year)
    folds = rows.join(F.broadcast(years), F.year("date") <= F.col("fold_year"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["date", "ticker"])
        fold = int(part["fold_year"].iloc[0])
        day = pd.to_datetime(part["date"])
        x, y = part[list(features)].to_numpy(dtype=float), part[target].to_numpy(dtype=float)
        test = (day.dt.year == fold).to_numpy()
        train = ~test & (day < pd.Timestamp(fold, 1, 1) - pd.Timedelta(days=embargo_days)).to_numpy()
        out = part[test][["date", "ticker", target, *keep]].rename(columns={target: "actual"})
        if train.sum() < min_train or not test.any():
            return out.iloc[:0].assign(boosted=0.0, fold_year=fold, feature="")
        model = Booster().fit(x[train], np.log(y[train]) if log_target else y[train])
        pred = model.predict(x[test])
        out = out.assign(boosted=np.exp(pred) if log_target else pred, fold_year=fold, feature=None)
        return pd.concat([out, pd.DataFrame({"feature": list(features), "boosted": model.gain, "fold_year": fold})])

    schema = "date date, ticker string, actual double, " + ", ".join(f"{k} double" for k in keep) + ", boosted double, fold_year int, feature string"
    made = staged(folds.groupBy("fold_year").applyInPandas(fit, schema), "folds")
    if made.isEmpty():
        raise ValueError("no fold has enough rows to train on")
    return made.where("feature IS NULL").drop("feature"), made.where("feature IS NOT NULL").select("feature", "fold_year", F.col("boosted").alias("gain"))


def walk_forward_predict(panel: DataFrame, features: Sequence[str], **options) -> DataFrame:
    """The predictions of ``walk_forward``."""
    return walk_forward(panel, features, **options)[0]


def mean_gains(gains: DataFrame) -> DataFrame:
    """``feature, importance``: each feature's mean gain over the folds."""
    return gains.groupBy("feature").agg(F.avg("gain").alias("importance"))


def _garch_loss(theta: np.ndarray, r: np.ndarray) -> float:
    mu, omega, alpha, beta, nu = theta[0], math.exp(theta[1]), *_shares(theta[2:4]), 2.05 + math.exp(min(theta[4], 6.0))
    e2 = (r - mu) ** 2
    h = np.empty(len(r))
    h[0] = last = e2.mean()
    for t in range(1, len(r)):
        last = omega + alpha * e2[t - 1] + beta * last
        h[t] = last
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return -float((const - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e2 / h / (nu - 2))).sum())


def _shares(x: np.ndarray) -> tuple[float, float]:
    a, b = np.exp(np.clip(x, -20, 20))
    return a / (1 + a + b), b / (1 + a + b)


def nelder_mead(f, start: np.ndarray, steps: int = 600) -> np.ndarray:
    """The least point found; ValueError if the simplex hasn't shrunk together within ``steps``."""
    simplex = [start, *(start + 0.4 * np.eye(len(start))[i] for i in range(len(start)))]
    values = [f(x) for x in simplex]
    for _ in range(steps):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-5:
            return simplex[0]
        centre = np.mean(simplex[:-1], axis=0)
        tries = [centre + k * (centre - simplex[-1]) for k in (1.0, 2.0, -0.5)]
        first = f(tries[0])
        point, value = tries[0], first
        if first < values[0]:
            far = f(tries[1])
            point, value = (tries[1], far) if far < first else (point, first)
        elif first >= values[-2]:
            near = f(tries[2])
            point, value = (tries[2], near) if near < min(first, values[-1]) else (None, math.inf)
        if point is None:
            simplex = [simplex[0], *((simplex[0] + x) / 2 for x in simplex[1:])]
            values = [values[0], *(f(x) for x in simplex[1:])]
        else:
            simplex[-1], values[-1] = point, value
    raise ValueError("not converged")


def garch_forecasts(returns: DataFrame, points: DataFrame, horizon: int = HORIZON, window: int = 750, least: int = 250, refit_every: int = 3) -> DataFrame:
    """``date, ticker, garch``: annual volatility expected over ``horizon`` days from a GARCH(1,1) with t errors.

    At each point the last ``window`` returns up to it; parameters are fitted at every ``refit_every``-th point and kept
    between. One grouped-map task serves one ticker; a fit that fails gives no forecast and is tried again at the next point.
    """
    sample = [r["date"] for r in points.select("date").distinct().orderBy("date").collect()]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["ret"]).sort_values("date")
        day, r = rows["date"].to_numpy(), rows["ret"].to_numpy() * 100
        out, theta, age = [], None, 0
        for point in sample:
            x = r[: int(np.searchsorted(day, point, "right"))][-window:]
            if len(x) < least or x.std() == 0:
                continue
            try:
                if theta is None or age % refit_every == 0:
                    theta, age = nelder_mead(lambda t, x=x: _garch_loss(t, x), np.array([x.mean(), math.log(0.05 * x.var()), 0.5, 3.0, 1.8])), 0
                age += 1
                mu, omega, (alpha, beta) = theta[0], math.exp(theta[1]), _shares(theta[2:4])
                h, path = float(((x - mu) ** 2).mean()), []
                for e in x - mu:
                    h = omega + alpha * e * e + beta * h
                for _ in range(horizon):
                    path.append(h)
                    h = omega + (alpha + beta) * h
                value = math.sqrt(sum(path) / horizon) / 100 * math.sqrt(TRADING_DAYS)
                if math.isfinite(value):
                    out.append((point, rows["ticker"].iloc[0], value))
            except (OverflowError, FloatingPointError, ValueError):
                theta = None
        return pd.DataFrame(out, columns=["date", "ticker", "garch"])

    return returns.select("ticker", "date", "ret").groupBy("ticker").applyInPandas(fit, "date date, ticker string, garch double")


def forecasts_to_wide(preds: DataFrame, tickers: Sequence[str], value: str = "boosted") -> DataFrame:
    return preds.groupBy("date").pivot("ticker", list(tickers)).agg(F.first(value))
