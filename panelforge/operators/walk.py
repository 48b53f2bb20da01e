"""Walk-forward engine: one plan over all rebalance dates, as weights never depend on drifted holdings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COST_BPS, HOLD_MONTHS, PROFILES, TRADING_DAYS, TRAIN_MONTHS, RiskProfile
from . import matrix, select
from .alloc import ALLOCATORS, Constraints
from .panel import covered
from .stage import staged


@dataclass(frozen=True)
class BacktestConfig:
    allocator: str = "score_based"
    profile: RiskProfile = PROFILES["balanced"]
    train_months: int = TRAIN_MONTHS
    hold_months: int = HOLD_MONTHS
    cost_bps: float = COST_BPS
    n_select: int = 25
    corr_threshold: float = 0.85
    per_sector: int = 5
    min_obs: int = 200
    coverage: float = 0.9
    cov_estimator: str = "ledoit_wolf"


@dataclass
class BacktestResult:
    """``daily`` (date, net, gross), ``weights`` (as_of, ticker, weight), ``costs`` (as_of, traded, turnover, cost, holdings)."""

    daily: DataFrame
    weights: DataFrame
    costs: DataFrame

    def equity_curve(self, gross: bool = False) -> DataFrame:
        w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return self.daily.select("date", F.product(1 + F.col("gross" if gross else "net")).over(w).alias("value"))

    def total_cost_drag(self) -> DataFrame:
        """Annual growth before costs less that after costs."""
        grown = lambda c: F.pow(F.product(1 + F.col(c)), TRADING_DAYS / F.count(F.lit(1))) - 1
        return self.daily.agg((grown("gross") - grown("net")).alias("cost_drag"))


def months(c: str) -> Column:
    """The number of a date's month."""
    return F.year(c) * 12 + F.month(c)


def rebalance_dates(calendar: DataFrame, train_months: int = TRAIN_MONTHS, hold_months: int = HOLD_MONTHS) -> DataFrame:
    """``as_of, next_date``: the last date of each bin of months that leaves room to train and to hold.

    Bins are counted from the calendar's first month, which is a bin of its own. ``next_date`` ends the holding period: the
    next rebalance, or the calendar's end.
    """
    ends = calendar.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    rows = calendar.select("date").distinct().crossJoin(F.broadcast(ends))
    bins = rows.groupBy("first", "last", F.ceil((months("date") - months("first")) / hold_months).alias("bin")).agg(F.max("date").alias("as_of"))
    good = bins.where((F.col("as_of") >= F.add_months("first", train_months)) & (F.col("as_of") < F.col("last")))
    after = F.lead("as_of").over(Window.partitionBy("last").orderBy("as_of"))
    return good.select("as_of", F.coalesce(after, "last").alias("next_date"))


def training_windows(returns: DataFrame, market: DataFrame, dates: DataFrame, train_months: int = TRAIN_MONTHS, coverage: float = 0.9) -> DataFrame:
    """``as_of, ticker, date, ret, mkt``: the months before each rebalance (its own day included), well-covered tickers only.

    A return meets, by the number of its month, only the rebalances whose window reaches into it.
    """
    near = (F.col("date") > F.add_months("as_of", -train_months)) & (F.col("date") <= F.col("as_of"))
    reach = dates.select("as_of", F.explode(F.sequence(months("as_of") - train_months, months("as_of"))).alias("month"))
    rows = returns.select("ticker", "date", "ret", months("date").alias("month")).join(F.broadcast(reach), "month").where(near).drop("month")
    rows = covered(rows, coverage, ["as_of"])
    return rows.join(market.select("date", F.col("ret").alias("mkt")), "date", "left")


def enough_names(train: DataFrame, least: int) -> DataFrame:
    """Windows with at least ``least`` tickers; the other rebalances are skipped. Metrics, correlations and allocators all
    read the windows, so they are kept."""
    train = staged(train, "train")
    good = train.groupBy("as_of").agg(F.countDistinct("ticker").alias("c")).where(F.col("c") >= least)
    return train.join(good.select("as_of"), "as_of", "left_semi")


def choose(train: DataFrame, sectors: DataFrame, config: BacktestConfig) -> DataFrame:
    """``as_of, ticker, score, mean_return`` of the names to hold: shared by all allocators."""
    scores = staged(select.rank_stocks(train, config.profile.weights, min_obs=config.min_obs), "scores")
    chosen = select.select_candidates(scores, train, sectors, config.n_select, config.corr_threshold, config.per_sector, config.profile.min_positions)
    return staged(chosen.join(scores.select("as_of", "ticker", "mean_return"), ["as_of", "ticker"]), "chosen")


def holding_values(weights: DataFrame, returns: DataFrame, dates: DataFrame) -> DataFrame:
    """``as_of, ticker, date, weight, value`` of each holding over its period; a missing return leaves the value.

    Periods don't overlap, so a date has one rebalance at most and holdings join on (rebalance, ticker).
    """
    days = dates.select("as_of", F.explode(F.sequence(F.date_add("as_of", 1), F.col("next_date"))).alias("date"))
    rows = returns.select("ticker", "date", "ret").join(F.broadcast(days), "date").join(weights.select("as_of", "ticker", "weight"), ["as_of", "ticker"])
    w = Window.partitionBy("as_of", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("as_of", "ticker", "date", "weight", (F.col("weight") * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)).alias("value"))


def period_returns(values: DataFrame) -> DataFrame:
    """``as_of, date, ret``: daily returns of the drifting portfolio."""
    total = values.groupBy("as_of", "date").agg(F.sum("value").alias("total"), F.sum("weight").alias("start"))
    before = F.coalesce(F.lag("total").over(Window.partitionBy("as_of").orderBy("date")), "start")
    return total.select("as_of", "date", (F.col("total") / F.nullif(before, F.lit(0.0)) - 1).alias("ret"))


def drifted_weights(values: DataFrame) -> DataFrame:
    """``as_of, ticker, drifted``: weights at the end of the holding period."""
    last = values.groupBy("as_of", "ticker").agg(F.max_by("value", "date").alias("value"))
    return last.select("as_of", "ticker", (F.col("value") / F.nullif(F.sum("value").over(Window.partitionBy("as_of")), F.lit(0.0))).alias("drifted"))


def trading_costs(weights: DataFrame, drifted: DataFrame, cost_bps: float = COST_BPS) -> DataFrame:
    """``as_of, traded, turnover, cost, holdings``: against the drifted weights of the rebalance before; the first buys all."""
    done = weights.select("as_of").distinct()
    after = done.withColumn("then", F.lead("as_of").over(Window.orderBy("as_of")))
    prior = drifted.join(after, "as_of").where("then IS NOT NULL").select(F.col("then").alias("as_of"), "ticker", "drifted")
    both = weights.select("as_of", "ticker", "weight").join(prior, ["as_of", "ticker"], "full")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))
    sums = both.groupBy("as_of").agg(F.sum(change).alias("traded"), F.count("weight").alias("holdings"))
    return sums.select("as_of", "traded", (F.col("traded") / 2).alias("turnover"), (F.col("traded") * cost_bps / 10_000).alias("cost"), "holdings")


def book_costs(periods: DataFrame, costs: DataFrame) -> DataFrame:
    """``date, net, gross``: costs come off the first day of a holding period; of equal dates the first period's stays."""
    first = F.row_number().over(Window.partitionBy("as_of").orderBy("date"))
    rows = periods.withColumn("k", first).join(F.broadcast(costs.select("as_of", "cost")), "as_of")
    rows = rows.select("as_of", "date", F.col("ret").alias("gross"), (F.col("ret") - F.when(F.col("k") == 1, F.col("cost")).otherwise(0.0)).alias("net"))
    rows = rows.withColumn("d", F.row_number().over(Window.partitionBy("date").orderBy("as_of"))).where("d = 1")
    return rows.select("date", "net", "gross")


def as_of_values(facts: DataFrame, calendar: DataFrame, dates: DataFrame, value: str = "vol") -> DataFrame:
    """``as_of, ticker, value``: each ticker's last ``value`` on a calendar date up to the rebalance.

    A fact goes to the first rebalance from its date on, where the last one stays; those few carry on to the rebalances
    before the ticker's next.
    """
    ends = dates.select("as_of", F.row_number().over(Window.orderBy("as_of")).alias("k"))
    days = calendar.select("date").distinct().join(F.broadcast(ends), F.col("date") <= F.col("as_of")).groupBy("date").agg(F.min("k").alias("k"))
    known = facts.where(F.col(value).isNotNull()).join(days, "date").groupBy("ticker", "k").agg(F.max_by(value, "date").alias(value))
    after = F.lead("k").over(Window.partitionBy("ticker").orderBy("k"))
    until = F.coalesce(after - 1, F.lit(ends.count()))
    carried = known.withColumn("until", until).select("ticker", value, F.explode(F.sequence("k", "until")).alias("k"))
    return carried.join(F.broadcast(ends), "k").select("as_of", "ticker", value)


def run_backtest(returns: DataFrame, market: DataFrame, sectors: DataFrame, config: BacktestConfig | None = None, vol_forecasts: DataFrame | None = None) -> BacktestResult:
    """Backtest of one configuration over (ticker, date, ret), market (date, ret) and sectors (ticker, sector).

    Raises ValueError if no rebalance leaves room to train.
    """
    config = config or BacktestConfig()
    dates = rebalance_dates(market, config.train_months, config.hold_months)
    dates = staged(dates, "dates")
    if dates.isEmpty():
        raise ValueError("no rebalance dates: the sample is shorter than the training window")
    train = enough_names(training_windows(returns, market, dates, config.train_months, config.coverage), config.profile.min_positions)
    chosen = choose(train, sectors, config)
    rows = {r["ticker"]: r["sector"] for r in sectors.collect()}
    cons = Constraints(max_weight=config.profile.max_weight, sectors=rows)
    sub = train.join(chosen.select("as_of", "ticker"), ["as_of", "ticker"], "left_semi")
    extra = {}
    if config.allocator in ("min_variance", "risk_parity", "max_sharpe"):
        if vol_forecasts is not None:
            vols = as_of_values(vol_forecasts, market, dates)
            extra["cov"] = matrix.cov_from_vols(sub, vols, group=["as_of"])
        else:
            extra["cov"] = matrix.ESTIMATORS[config.cov_estimator](sub, group=["as_of"])
    weights = staged(ALLOCATORS[config.allocator](chosen, sub, cons, **extra).where("weight > 0").select("as_of", "ticker", "weight"), "weights")
    values = staged(holding_values(weights, returns, dates), "values")
    costs = trading_costs(weights, drifted_weights(values), config.cost_bps)
    return BacktestResult(book_costs(period_returns(values), costs), weights, costs)


def buy_and_hold(market: DataFrame, like: DataFrame) -> DataFrame:
    """The market's returns on a strategy's dates, missing ones as 0."""
    return like.select("date").join(market.select("date", "ret"), "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
