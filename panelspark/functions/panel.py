"""Column expressions and small relational steps that the producers share.

A long panel has the columns factor_name, date, asset_id, factor, forward_return and
whatever else the input carries; every step works for all signals at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9
BY_DATE = ("factor_name", "date")
BY_ASSET = ("factor_name", "asset_id")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def long_panel(panel: DataFrame, factor_cols: list[str]) -> DataFrame:
    """One row per signal, date and asset.

    Signals are unpivoted in one pass, so a plan on the result serves any number of
    them.  Columns other than date, asset_id, returns, price and the signals stay.
    """
    keep = [c for c in panel.columns if c not in factor_cols]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("factor_name"), F.col(f"`{f}`").cast("double").alias("factor")) for f in factor_cols)))
    return panel.select(*(F.col(f"`{c}`") for c in keep), each.alias("_f")).select("_f.factor_name", "_f.factor", *(F.col(f"`{c}`") for c in keep))


def dates(panel: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct dates with their ordinal from 0: a table of the size of a time axis."""
    each = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    return panel.select(*keys, "date").distinct().withColumn("date_ordinal", F.row_number().over(each) - 1)


def strided(panel: DataFrame, horizon: int) -> DataFrame:
    """Rows of every ``horizon``-th date from the first on."""
    if horizon <= 1:
        return panel
    kept = dates(panel).where(F.col("date_ordinal") % horizon == 0).select("date")
    return panel.join(F.broadcast(kept), "date", "left_semi").select(panel.columns)


def together(panel: DataFrame, keys: tuple[str, ...] = BY_DATE) -> DataFrame:
    """Deal rows by ``keys`` once: windows and groups by these and further keys then need no exchange of their own."""
    return panel.repartition(*keys)


def mean_rank(x: str, by: tuple[str, ...]) -> Column:
    """Average rank among non-null values; null stays null."""
    window = Window.partitionBy(*by, F.col(x).isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(window.orderBy(x)) + (ties - 1) / F.lit(2.0))


def order_rank(x: str, by: tuple[str, ...], *, descending: bool = False) -> Column:
    """Rank among non-null values, ties by asset_id ascending."""
    window = Window.partitionBy(*by, F.col(x).isNull())
    return F.when(F.col(x).isNotNull(), F.row_number().over(window.orderBy(F.desc(x) if descending else F.asc(x), "asset_id")))


def bucketed(panel: DataFrame, n_groups: int, tie_policy: str = "ordinal") -> DataFrame:
    """Add ``bucket``: floor((rank - 1) * n_groups / N) in 0..n_groups - 1, N counting the date's non-null signals."""
    if tie_policy not in ("ordinal", "average"):
        raise ValueError(f"tie_policy must be 'ordinal' or 'average', got {tie_policy!r}")
    rank = order_rank("factor", BY_DATE) if tie_policy == "ordinal" else mean_rank("factor", BY_DATE)
    counted = together(panel).withColumn("_rank", rank).withColumn("_n", F.count("factor").over(Window.partitionBy(*BY_DATE)))
    bucket = F.least(F.floor((F.col("_rank") - 1) * n_groups / F.col("_n")), F.lit(n_groups - 1)).cast("int")
    return counted.withColumn("bucket", F.when(F.col("_rank").isNotNull(), bucket)).drop("_rank", "_n")


def moments(x: str, y: str) -> list[Column]:
    """Count, means and centred sums of squares of a pair of columns, null where there are too few rows."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.var_samp(x).alias("vx"),
        F.var_samp(y).alias("vy"),
        F.covar_samp(x, y).alias("cxy"),
    ]


def rank_correlation(a: str, b: str) -> Column:
    """Correlation of two rank columns from exact sums; null where either is constant."""
    n = F.count(F.lit(1)).cast("double")
    sa, sb, saa, sbb, sab = F.sum(a), F.sum(b), F.sum(F.col(a) * F.col(a)), F.sum(F.col(b) * F.col(b)), F.sum(F.col(a) * F.col(b))
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return F.when((va > 0) & (vb > 0), (n * sab - sa * sb) / F.sqrt(va * vb))


def tie_columns(x: str = "factor") -> list[Column]:
    """Rows and distinct values (null counts as one) of a date."""
    return [F.count(F.lit(1)).alias("n_rows"), (F.countDistinct(x) + F.max(F.when(F.col(x).isNull(), 1).otherwise(0))).alias("n_unique")]
