"""Source tables derived from the star-schema test tables, in exact integer steps.

A supplier is a ticker and a shipping week a session; discounts drive a random walk, and
quantities add shocks, so that every bar status occurs. The same rules stand in SQL in
plans/oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INDEX_CODE = "VNINDEX"
INDEX_STARTS = 60  # the index begins so many weeks after the bars
FIRST_SHIPPED, FIRST_SESSION = "1995-01-02", "2015-01-01"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    week = F.expr(f"datediff(cast(l_shipdate as date), date'{FIRST_SHIPPED}') div 7")
    step = F.round(F.col("l_discount") * 100).cast("long") - 5
    return rows.select("l_suppkey", week.cast("int").alias("wk"), step.alias("step"), F.col("l_quantity").cast("long").alias("qty"))


def _session(week: str) -> F.Column:
    return F.date_add(F.lit(FIRST_SESSION).cast("date"), F.col(week))


def _ticker(key: str) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 5, "0"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _items(spark, sf_dir).groupBy("l_suppkey", "wk").agg(F.sum("step").alias("step"), F.sum("qty").alias("qty"))
    walk = Window.partitionBy("l_suppkey").orderBy("wk").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.withColumn("lvl", 60000 + 100 * F.sum("step").over(walk))
    shock = F.expr("CASE WHEN qty % 41 = 0 THEN lvl div 2 WHEN qty % 13 = 0 THEN lvl * 7 div 100 ELSE 0L END")
    rows = rows.withColumn("c", F.col("lvl") + shock)
    return rows.select(
        _ticker("l_suppkey").alias("ticker"),
        _session("wk").alias("date"),
        F.expr("cast(c - 50 * (qty % 5 - 2) as double)").alias("open"),
        F.expr("cast(c + CASE WHEN qty % 37 = 0 THEN -500 ELSE 150 END as double)").alias("high"),
        F.expr("cast(c - 150 as double)").alias("low"),
        F.col("c").cast("double").alias("close"),
        F.expr("CASE WHEN qty % 31 = 0 THEN 0L ELSE qty * 200 * (1 + l_suppkey % 5) END").alias("volume"),
        F.lit(1).cast("long").alias("adjustment_epoch"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    venue = F.expr("CASE s_nationkey % 4 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' WHEN 2 THEN 'UPCOM' END")
    return rows.select(_ticker("s_suppkey").alias("ticker"), venue.alias("exchange"), F.lit("active").alias("status"))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _items(spark, sf_dir).groupBy("wk").agg(F.sum("step").alias("total"), F.count(F.lit(1)).alias("n"))
    weeks = weeks.select("wk", F.floor(F.col("total") * F.lit(1000.0) / F.col("n")).cast("long").alias("step"))
    walk = Window.partitionBy(F.lit(0)).orderBy("wk").rowsBetween(Window.unboundedPreceding, 0)
    rows = weeks.withColumn("close", (100000 + F.sum("step").over(walk)).cast("double")).filter(F.col("wk") >= INDEX_STARTS)
    return rows.select(F.lit(INDEX_CODE).alias("index_code"), _session("wk").alias("date"), "close")


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _items(spark, sf_dir).select("wk").filter(F.col("wk") >= INDEX_STARTS).distinct()
    return weeks.select(_session("wk").alias("date"), F.lit(True).alias("is_trading_day"))
