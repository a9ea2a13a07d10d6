"""Panels from the order and event tables: exact integer sums, so every engine gets the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _month(c: str):
    return F.date_format(F.date_trunc("month", F.col(c)), "yyyy-MM-dd")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset_id (supplier), price, factor (mean discount), factor2 (mean tax), market_cap, region."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(_month("l_shipdate").alias("date"), F.col("l_suppkey").alias("asset_id"), cents("l_extendedprice").alias("c"), F.round("l_quantity").cast("long").alias("q"), cents("l_discount").alias("d"), cents("l_tax").alias("t"))
    months = lines.groupBy("date", "asset_id").agg(F.sum("c").alias("c"), F.sum("q").alias("q"), F.sum("d").alias("d"), F.sum("t").alias("t"), F.count("*").alias("n"))
    dbl = lambda c: F.col(c).cast("double")
    return months.select("date", "asset_id", (dbl("c") / dbl("q")).alias("price"), (dbl("d") / dbl("n")).alias("factor"), (dbl("t") / dbl("n")).alias("factor2"), dbl("c").alias("market_cap"))


def with_region(spark: SparkSession, sf_dir: str, panel: DataFrame) -> DataFrame:
    """Add the supplier's region: three dimension tables, the largest of which is joined by key."""
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return panel.join(where.select(F.col("s_suppkey").alias("asset_id"), F.col("r_name").alias("region")), "asset_id")


def common_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier months with one signal for all suppliers: the change of the month's order total, in millions."""
    totals = table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("date")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"))
    change = totals.withColumn("factor", (F.col("c") - F.lag("c").over(Window.orderBy("date"))).cast("double") / 1e8).where("factor is not null").select("date", "factor")
    return supplier_months(spark, sf_dir).drop("factor", "factor2").join(F.broadcast(change), "date")


def single_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as one asset."""
    months = table(spark, sf_dir, "lineitem").groupBy(_month("l_shipdate").alias("date")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"), F.sum(F.round("l_quantity").cast("long")).alias("q"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.count("*").alias("n"))
    dbl = lambda c: F.col(c).cast("double")
    return months.select("date", F.lit(0).cast("long").alias("asset_id"), (dbl("c") / dbl("q")).alias("price"), (dbl("d") / dbl("n")).alias("factor"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user on every day: a sparse signal (purchases less errors of value over 75, its magnitude kept) and a price from running value."""
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("user_id").alias("asset_id"), "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    side = F.when(F.col("v") > 7500, F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)).otherwise(0)
    days = events.groupBy("date", "asset_id").agg(F.sum(side).cast("double").alias("factor"), F.sum("v").alias("v"))
    grid = F.broadcast(events.select("date").distinct()).crossJoin(events.select("asset_id").distinct())
    full = grid.join(days, ["date", "asset_id"], "left").select("date", "asset_id", F.coalesce("factor", F.lit(0.0)).alias("factor"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    running = F.sum("v").over(Window.partitionBy("asset_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return full.select("date", "asset_id", "factor", (100.0 + running.cast("double") / 10000.0).alias("price"))
