"""Report data: formatted tables, stress windows, exposures and chart frames. No figures are drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The named stress windows, both ends included.
STRESS_WINDOWS = {
    "COVID crash (Feb-Mar 2020)": ("2020-02-19", "2020-03-23"),
    "COVID recovery (Apr-Dec 2020)": ("2020-03-24", "2020-12-31"),
    "2022 rate shock (Jan-Jun 2022)": ("2022-01-01", "2022-06-17"),
    "Oct 2021 - Mar 2023 (flat market)": ("2021-10-19", "2023-03-31"),
    "2024-25 correction (Sep 24-Feb 25)": ("2024-09-27", "2025-02-28"),
}
MISSING = "—"


def percent(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.1f%%", F.col(c) * 100)).otherwise(MISSING)


def ratio(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise(MISSING)


def format_table(df: DataFrame, percents: Sequence[str], ratios: Sequence[str]) -> DataFrame:
    return df.select(*(percent(c).alias(c) if c in percents else ratio(c).alias(c) if c in ratios else F.col(c) for c in df.columns))


def to_markdown(table: DataFrame) -> str:
    """A small table as markdown text."""
    rows = [table.columns, ["---"] * len(table.columns), *([MISSING if v is None else str(v) for v in r] for r in table.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def fill_placeholders(template: str, values: dict[str, str]) -> str:
    """``{{NAME}}`` replaced by its text."""
    for name, text in values.items():
        template = template.replace("{{" + name + "}}", text)
    return template


# The order of a comparison's columns; others follow.
COMPARED = ("name", "cagr", "annual_vol", "sharpe", "sortino", "max_drawdown", "calmar", "beta", "alpha", "information_ratio", "hit_rate", "turnover", "cost_drag")


def comparison_table(sheets: DataFrame, turnover: DataFrame | None = None, cost_drag: DataFrame | None = None) -> DataFrame:
    """Tearsheets with mean turnover and cost drag by name where they are given, in the order of ``COMPARED``."""
    for extra in (turnover, cost_drag):
        if extra is not None:
            sheets = sheets.join(extra, "name", "left")
    return sheets.select(*(c for c in COMPARED if c in sheets.columns), *(c for c in sheets.columns if c not in COMPARED))


def mean_turnover(costs: DataFrame) -> DataFrame:
    """``name, turnover``: the mean one-way turnover of each strategy's rebalances."""
    return costs.groupBy("name").agg(F.avg("turnover").alias("turnover"))


def stress_frame(stress: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each window with a column for each name; a window's remark in brackets goes to a line of its own."""
    wide = stress.groupBy("window").pivot("name", list(names)).agg(F.first("total"))
    return wide.withColumn("window", F.replace("window", F.lit(" ("), F.lit("\n(")))


def heat_map(returns: DataFrame, most: int = 40) -> DataFrame:
    """Correlations (a, b, value) of the first ``most`` tickers by name."""
    from .matrix import correlation

    first = returns.select("ticker").distinct().orderBy("ticker").limit(most)
    return correlation(returns.join(F.broadcast(first), "ticker", "left_semi"))


def stress_test(streams: DataFrame, windows: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``window, name, total``: total return of each stream in each window; NULL without rows there."""
    spark = streams.sparkSession
    named = spark.createDataFrame([(k, a, b) for k, (a, b) in (windows or STRESS_WINDOWS).items()], "window string, a string, b string")
    named = named.select("window", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    hit = streams.join(F.broadcast(named), F.col("date").between(F.col("a"), F.col("b")))
    total = hit.groupBy("window", "name").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("total"))
    every = streams.select("name").distinct().crossJoin(F.broadcast(named.select("window")))
    return every.join(total, ["window", "name"], "left")


def sector_exposure(weights: DataFrame, sectors: DataFrame, top: int = 8) -> DataFrame:
    """``as_of, sector, weight``: the ``top`` sectors by mean weight over all dates, the rest as Other."""
    from .panel import with_sector

    sums = with_sector(weights, sectors).groupBy("as_of", "sector").agg(F.sum("weight").alias("weight"))
    rank = sums.groupBy("sector").agg(F.sum("weight").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("s"), "sector")))
    name = F.when(F.col("r") <= top, F.col("sector")).otherwise("Other")
    return sums.join(F.broadcast(rank.select("sector", "r")), "sector").groupBy("as_of", name.alias("sector")).agg(F.sum("weight").alias("weight"))


def scatter(preds: DataFrame, pred: str = "boosted") -> DataFrame:
    """Axis limit (99th percentile of actual values) and correlation of a forecast with what came."""
    corr = F.covar_samp("actual", pred) / F.nullif(F.stddev_samp("actual") * F.stddev_samp(pred), F.lit(0.0))
    return preds.agg(F.percentile("actual", 0.99).alias("axis_limit"), corr.alias("corr"), F.count("actual").alias("n"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most important features, scaled by the greatest."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(n)
    return top.withColumn("share", F.col("importance") / F.nullif(F.max("importance").over(Window.partitionBy(F.lit(1))), F.lit(0.0)))
