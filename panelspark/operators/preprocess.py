"""Returns and signal preparation: every step is one plan over the whole panel."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel import EPSILON, finite
from ..plans.errors import UserInputError

HORIZON = "_forward_periods"
MAD_SCALE = 1.4826


def compute_forward_return(data: DataFrame, forward_periods: int = 5, *, overwrite: bool = False, check: bool = True) -> DataFrame:
    """Per-row return from the next row to ``forward_periods`` rows later, divided by the horizon, per asset.

    Rows without a finite return are dropped and the horizon is stamped on the
    panel.  ``check`` runs a job to make sure that any row is left.
    """
    if isinstance(forward_periods, bool) or not isinstance(forward_periods, int) or forward_periods <= 0:
        raise UserInputError("compute_forward_return", "forward_periods", forward_periods, "a positive int row horizon")
    if "forward_return" in data.columns:
        if not overwrite:
            raise UserInputError("compute_forward_return", "data", data.columns, "a panel without forward_return (the step drops rows, so it can't be repeated); pass overwrite=True to recompute")
        data = data.drop("forward_return")
    by = Window.partitionBy("asset_id").orderBy("date")
    first, last = F.lead("price", 1).over(by), F.lead("price", forward_periods + 1).over(by)
    out = data.withColumn("_first", first).withColumn("_last", last)
    out = out.withColumn("forward_return", (F.try_divide(F.col("_last"), F.col("_first")) - 1) / forward_periods).drop("_first", "_last").where(finite(F.col("forward_return")))
    if check and out.isEmpty():
        raise UserInputError("compute_forward_return", "data", "no rows left", f"at least one finite return at horizon {forward_periods}")
    return out.drop(HORIZON).withColumn(HORIZON, F.lit(forward_periods))


def _nearest(q: float):
    """The quantile that is an observation: place round(q * (n - 1)) of the sorted values, halves up."""
    values = F.array_sort(F.collect_list("forward_return"))
    return F.get(values, F.floor(F.lit(q) * (F.size(values) - 1) + 0.5).cast("int"))


def winsorize_forward_return(data: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip returns to two quantiles of their date; a date's values are one group."""
    if isinstance(lower, bool) or isinstance(upper, bool) or not isinstance(lower, int | float) or not isinstance(upper, int | float) or not 0.0 <= lower <= upper <= 1.0:
        raise UserInputError("winsorize_forward_return", "bounds", (lower, upper), "0 <= lower <= upper <= 1")
    if lower <= 0.0 and upper >= 1.0:
        return data
    bounds = data.groupBy("date").agg(_nearest(float(lower)).alias("_lo"), _nearest(float(upper)).alias("_hi"))
    clipped = F.when(F.col("forward_return").isNull(), None).otherwise(F.greatest(F.least("forward_return", "_hi"), F.col("_lo")))
    return data.join(bounds, "date", "left").withColumn("forward_return", clipped).select(data.columns)


def compute_abnormal_return(data: DataFrame) -> DataFrame:
    """Add the return less its date's mean."""
    return data.withColumn("abnormal_return", F.col("forward_return") - F.avg("forward_return").over(Window.partitionBy("date")))


def _centres(data: DataFrame, column: str) -> DataFrame:
    """Median and scaled median absolute deviation by date."""
    medians = data.groupBy("date").agg(F.median(column).alias("_median"))
    apart = data.select("date", column).join(medians, "date").groupBy("date").agg((F.median(F.abs(F.col(column) - F.col("_median"))) * MAD_SCALE).alias("_mad"))
    return medians.join(apart, "date")


def mad_winsorize(data: DataFrame, factor_col: str = "factor", n_mad: float = 3.0) -> DataFrame:
    """Clip a signal to its date's median plus and minus ``n_mad`` scaled deviations; none for n_mad <= 0."""
    if n_mad <= 0:
        return data
    low, high = F.col("_median") - n_mad * F.col("_mad"), F.col("_median") + n_mad * F.col("_mad")
    x = F.col(factor_col)
    return data.join(_centres(data, factor_col), "date", "left").withColumn(factor_col, F.when(x.isNull(), None).otherwise(F.greatest(F.least(x, high), low))).select(data.columns)


def cross_sectional_zscore(data: DataFrame, factor_col: str = "factor") -> DataFrame:
    """Add ``factor_zscore``: distance from the date's median in scaled deviations; 0 for null and 0/0, infinite for x/0."""
    gap = F.col(factor_col) - F.col("_median")
    infinite = F.signum(gap) * float("inf")
    score = F.when(F.col("_mad") > 0, gap / F.when(F.col("_mad") > 0, F.col("_mad"))).when(gap != 0, infinite).otherwise(0.0)
    return data.join(_centres(data, factor_col), "date", "left").withColumn("factor_zscore", F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))).select(*data.columns, "factor_zscore")


@dataclass
class OrthogonalizeResult:
    data: DataFrame
    mean_betas: dict[str, float] = field(default_factory=dict)
    mean_r_squared: float = 0.0
    n_dates: int = 0
    coverage: float = 0.0
    n_base: int = 0


def _residuals(base_cols: list[str], factor_col: str):
    """Least squares of one date's rows; the first row carries the date's coefficients and fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[factor_col].to_numpy(float)
        x = np.column_stack([np.ones(len(y)), pdf[base_cols].to_numpy(float)])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        rest = y - x @ beta
        total = float(((y - y.mean()) ** 2).sum())
        out = pdf[["date", "asset_id"]].copy()
        out["_residual"] = rest
        out["_betas"] = [list(map(float, beta[1:]))] + [None] * (len(y) - 1)
        out["_r2"] = [1.0 - float(rest @ rest) / total if total > EPSILON else 0.0] + [None] * (len(y) - 1)
        return out

    return run


def orthogonalize_factor(factor_df: DataFrame, base_factors: DataFrame, factor_col: str = "factor", base_cols: list[str] | None = None) -> OrthogonalizeResult:
    """Replace a signal by its residual on base exposures (with intercept), date by date; rows without exposures keep it.

    Each date is one group of its assets; only the summary reaches the driver.
    """
    if base_cols is None:
        base_cols = [c for c in base_factors.columns if c not in ("date", "asset_id")]
    if not base_cols:
        return OrthogonalizeResult(factor_df)
    keys = ["date", "asset_id"]
    merged = factor_df.select(*keys, F.col(factor_col).cast("double").alias(factor_col)).join(base_factors.select(*keys, *(F.col(c).cast("double").alias(f"_base_{c}") for c in base_cols)), keys)
    kinds = dict(factor_df.dtypes)
    schema = f"date {kinds['date']}, asset_id {kinds['asset_id']}, _residual double, _betas array<double>, _r2 double"
    rest = merged.groupBy("date").applyInPandas(_residuals([f"_base_{c}" for c in base_cols], factor_col), schema).persist()
    betas = [F.avg(F.when(F.col("_r2").isNotNull(), F.get("_betas", F.lit(i)))) for i in range(len(base_cols))]
    row = rest.agg(F.count("*"), F.count("_r2"), F.avg("_r2"), *betas).first()
    total = factor_df.count()
    if not row[1]:
        return OrthogonalizeResult(factor_df)
    data = factor_df.withColumn("factor_pre_ortho", F.col(factor_col)).join(rest.select(*keys, "_residual"), keys, "left")
    data = data.withColumn(factor_col, F.coalesce("_residual", factor_col)).drop("_residual")
    return OrthogonalizeResult(data, dict(zip(base_cols, row[3:], strict=True)), float(row[2]), int(row[1]), row[0] / total if total else 0.0, len(base_cols))
