"""Price relations derived from the order tables, for Spark and as SQL text.

``rets``  (ticker, date, ret): a day's average discount and price of a brand's line items, scaled to a return
``mkt``   (date, ret): the same over all line items; its dates are the trading calendar
``px``    (ticker, date, close): 100 times the compounded returns
``panel`` (ticker, date, close): ``px`` on every calendar date, filled forward over at most five rows
``crets`` (ticker, date, close, ret): simple returns on ``panel``
``bars``  (ticker, date, open, high, low, close, volume): a day's line items as an intraday bar
``sector`` (ticker, sector); ``ebars``: events by type and hour as bars
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FFILL_LIMIT
from ..operators import panel as ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ret() -> Column:
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100
    return cents("l_discount") - F.lit(0.05) + (cents("l_extendedprice") - F.lit(50000.0)) / F.lit(1.1e7)


def _items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), *columns)
    return items.join(part, items.l_partkey == part.p_partkey).drop("p_partkey")


def rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "l_discount", "l_extendedprice").groupBy("ticker", "date").agg(_ret().alias("ret"))


def mkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(_ret().alias("ret"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.product(F.col("ret") + 1).over(Window.partitionBy("ticker").orderBy("date"))
    return rets(spark, sf_dir).select("ticker", "date", F.round(curve * 100, 6).alias("close"))


def mkt_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.product(F.col("ret") + 1).over(Window.orderBy("date"))
    return mkt(spark, sf_dir).select("date", F.round(curve * 100, 6).alias("close"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.densify(px(spark, sf_dir), mkt(spark, sf_dir).select("date"), ["close"], limit=FFILL_LIMIT)


def crets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.to_returns(panel(spark, sf_dir))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice")
    items = _items(spark, sf_dir, "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    return items.groupBy("ticker", "date").agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    return brands.select("ticker", F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector"))


def ebars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 0")
    key = F.struct("ts", "event_id")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.min_by("value", key).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", key).alias("close"),
        F.count(F.lit(1)).alias("n"),
    )


def _sql_ret() -> str:
    cents = "cast(sum(cast(round(100 * {}) as bigint)) as double) / count(*) / 100"
    return f"{cents.format('l_discount')} - 0.05::double + ({cents.format('l_extendedprice')} - 50000::double) / 1.1e7::double"


#: The same relations as common table expressions; a query's SQL goes on after them.
SQL = f"""WITH RECURSIVE rets AS (
  SELECT p_brand AS ticker, cast(l_shipdate as date) AS date, {_sql_ret()} AS ret
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), mkt AS (
  SELECT cast(l_shipdate as date) AS date, {_sql_ret()} AS ret FROM lineitem GROUP BY 1
), px AS (
  SELECT ticker, date, round(100 * product(1 + ret) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS close FROM rets
), mkt_px AS (
  SELECT date, round(100 * product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS close FROM mkt
), grid AS (
  SELECT t.ticker, c.date, p.close FROM (SELECT DISTINCT ticker FROM px) t CROSS JOIN (SELECT date FROM mkt) c LEFT JOIN px p ON p.ticker = t.ticker AND p.date = c.date
), panel AS (
  SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM grid
), crets AS (
  SELECT ticker, date, close, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM panel
), bars AS (
  SELECT p_brand AS ticker, cast(l_shipdate as date) AS date,
    arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), sector AS (
  SELECT DISTINCT p_brand AS ticker, 'S' || (cast(regexp_extract(p_brand, '(\\d+)$', 1) as int) % 5) AS sector FROM part
), ebars AS (
  SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2
)
"""
