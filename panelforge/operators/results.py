"""Built portfolios in money, and result tables: written, read back and put into a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RISK_FREE_ANNUAL
from . import frames, tailrisk
from .perf import safe


def allocation_table(weights: DataFrame, metrics: DataFrame, sectors: DataFrame, capital: float) -> DataFrame:
    """``ticker, weight, amount, sector, sharpe, volatility, beta`` of the holdings (ticker, weight).

    A holding without sector shows as missing; one without metrics has NULLs there.
    """
    rows = weights.where("weight > 0").select("ticker", "weight").join(sectors, "ticker", "left").join(metrics.select("ticker", "sharpe", "volatility", "beta"), "ticker", "left")
    return rows.select("ticker", "weight", (F.col("weight") * capital).alias("amount"), F.coalesce("sector", F.lit(frames.MISSING)).alias("sector"), "sharpe", "volatility", "beta")


def portfolio_estimates(weights: DataFrame, metrics: DataFrame, cov: DataFrame, rf_annual: float = RISK_FREE_ANNUAL) -> DataFrame:
    """One row: ``holdings, est_return, est_vol, est_sharpe`` from annual mean returns and annual covariances (a, b, value)."""
    held = weights.where("weight > 0").select("ticker", "weight")
    back = held.join(metrics.select("ticker", "mean_return"), "ticker", "left").agg(F.count("*").alias("holdings"), F.sum(F.col("weight") * F.col("mean_return")).alias("est_return"))
    side = lambda s: held.select(F.col("ticker").alias(s), F.col("weight").alias(f"w{s}"))
    var = cov.join(side("a"), "a").join(side("b"), "b").agg(F.sqrt(F.sum(F.col("wa") * F.col("wb") * F.col("value"))).alias("est_vol"))
    return back.crossJoin(var).withColumn("est_sharpe", safe(F.col("est_return") - rf_annual, F.col("est_vol")))  # one row each


def portfolio_series(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """``date, ret``: the weighted sum of the holdings' returns, a missing one as 0."""
    rows = returns.select("ticker", "date", "ret").join(weights.select("ticker", "weight"), "ticker")
    return rows.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def money_at_risk(series: DataFrame, capital: float) -> DataFrame:
    """One row: one-day loss in money at 95 % and 99 %, and the mean loss of the worst 5 % of days."""
    limit = series.agg(*(tailrisk.historical(c).alias(f"v{round(c * 100)}") for c in (0.95, 0.99)))
    rows = series.crossJoin(F.broadcast(limit))  # one row
    worst = F.avg(F.when(F.col("ret") <= -F.col("v95"), F.col("ret")))
    return rows.agg(*(tailrisk.in_money(F.first(v), capital).alias(n) for v, n in (("v95", "var_95"), ("v99", "var_99"))), (-worst * capital).alias("cvar_95"))


def write_result(table: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as ``parquet``, ``csv`` (with a header) or ``json``, in place of what was there."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind of result: {kind}")
    out = table.write.mode("overwrite")
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def read_result(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A result that ``write_result`` wrote, None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def render_document(spark: SparkSession, template: str, tables: dict[str, str], percents: Sequence[str] = (), ratios: Sequence[str] = ()) -> str:
    """``<!-- NAME -->`` in a document replaced by the CSV result at ``tables[NAME]`` as markdown.

    Names that the document or the results lack are left out. Result tables are small: they are read by people.
    """
    for name, path in tables.items():
        mark, table = f"<!-- {name} -->", read_result(spark, path, "csv")
        if mark in template and table is not None:
            template = template.replace(mark, frames.to_markdown(frames.format_table(table, percents, ratios)))
    return template
