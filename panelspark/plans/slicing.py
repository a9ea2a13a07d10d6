"""Sliced evaluation and tests of equality between slices.

A slice is one more key: series of all slices come from one plan in which the signal's
name and the slice's label form the key together.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inference as st
from ..functions.dist import chi2_sf
from ..functions.panel import long_panel
from ..operators.metrics import Metric, positive_rate
from ..operators.preprocess import HORIZON
from .errors import UserInputError
from .evaluate import evaluate, horizon
from .results import EvaluationResult, Warning

RESAMPLES = 999


def _labels(data: DataFrame, by: str, func: str) -> list[str]:
    if by not in data.columns:
        raise UserInputError(func, "by", by, "a column of the panel", data.columns)
    found = [r[0] for r in data.select(F.col(by).cast("string")).distinct().collect()]
    if not found or None in found:
        raise UserInputError(func, "by", by, "a column without nulls on a panel with rows")
    return sorted(found)


def by_slice(data: DataFrame, metric: Metric, *, by: str, factor_col: str, forward_periods: int | None = None, strict: bool = True) -> dict[str, EvaluationResult]:
    """Evaluate a metric on each slice; metrics that look along the time axis get a truncation warning."""
    out = {}
    for label in _labels(data, by, "by_slice"):
        (r,) = evaluate(data.where(F.col(by).cast("string") == label).drop(by), metrics={metric.name: metric}, factor_cols=[factor_col], forward_periods=forward_periods, strict=strict)
        if metric.boundary_sensitive:
            r.warnings.append(Warning("slice_boundary_truncation", metric.name, "windows end at the slice's boundary"))
        out[label] = r
    return out


def strict_subsets(slices: dict[str, DataFrame], key_cols: tuple[str, ...] = ("date", "asset_id")) -> list[tuple[str, str]]:
    """Pairs (smaller, larger) of slices of which one's keys are a true subset of the other's.

    Keys are grouped with the labels that hold them, so what is counted and collected is
    pairs of labels, not keys.
    """
    for label, data in slices.items():
        lost = [c for c in key_cols if c not in data.columns]
        if lost:
            raise ValueError(f"slice {label!r} lacks the key columns {lost}; it has {data.columns}")
    if len(slices) < 2:
        return []
    rows = reduce(DataFrame.unionByName, (data.select(*key_cols, F.lit(label).alias("_label")) for label, data in slices.items()))
    held = rows.groupBy(*key_cols).agg(F.collect_set("_label").alias("a")).groupBy("a").count()
    both = held.select("a", F.explode("a").alias("x"), "count").select("x", F.explode("a").alias("y"), "count").groupBy("x", "y").agg(F.sum("count").alias("n"))
    common = {(r.x, r.y): r.n for r in both.collect()}
    size = {k: common.get((k, k), 0) for k in slices}
    nested = lambda a, b: size[a] < size[b] and common.get((a, b), 0) == size[a]
    return [(a, b) if nested(a, b) else (b, a) for a, b in combinations(slices, 2) if nested(a, b) or nested(b, a)]


def _series(data: DataFrame, metric: Metric, by: str, factor_col: str, func: str) -> tuple[list[str], dict[str, pd.Series], int | None]:
    """Per-date series of every slice (collected: dates x slices rows), and the horizon."""
    if isinstance(metric, type) or not isinstance(metric, Metric):
        raise UserInputError(func, "metric", metric, "a metric instance")
    if metric.series_value is None:
        raise TypeError(f"{func}: {metric.name} has no per-date series")
    if factor_col not in data.columns:
        raise UserInputError(func, "factor_col", factor_col, "a column of the panel", data.columns)
    labels = _labels(data, by, func)
    if len(labels) < 2:
        raise ValueError(f"{func}: at least two slices are needed")
    h = horizon(data, None, None)
    panel = long_panel(data.drop(HORIZON), [factor_col]).withColumn("factor_name", F.col(by).cast("string")).drop(by)
    table = metric.source(panel, h or 5)
    if "full" in table.columns:
        table = table.where(~F.col("full"))
    value = F.col(metric.series_value)
    if isinstance(metric, positive_rate):
        value = (value > 0).cast("double")
    pdf = table.select("factor_name", "date", value.cast("double").alias("value")).where("value is not null").toPandas()
    return labels, {k: pdf[pdf["factor_name"] == k].set_index("date")["value"].sort_index() for k in labels}, h


def _aligned(data, metric, by, factor_col, func) -> tuple[list[str], np.ndarray, int]:
    labels, series, h = _series(data, metric, by, factor_col, func)
    wide = pd.concat([series[k].rename(k) for k in labels], axis=1, join="inner")
    if len(wide) < 2:
        raise ValueError(f"{func}: slices share {len(wide)} dates; at least two are needed (date-disjoint slices have the period tests)")
    y = wide.to_numpy(float)
    return labels, y, st.hac_lags(len(y), None, h)


def _equal(k: int) -> np.ndarray:
    return np.hstack([np.ones((k - 1, 1)), -np.eye(k - 1)])


def slice_pairwise_test(data: DataFrame, metric: Metric, *, by: str, factor_col: str) -> pd.DataFrame:
    """Equality of each pair of slices that share dates: HAC Wald F, Holm adjusted."""
    labels, y, lags = _aligned(data, metric, by, factor_col, "slice_pairwise_test")
    mean, cov = st.mean_hac(y, lags)
    rows = []
    for i, j in combinations(range(len(labels)), 2):
        r = np.zeros((1, len(labels)))
        r[0, i], r[0, j] = 1.0, -1.0
        stat, p = st.wald(mean, cov, r, len(y) - 1)
        rows.append({"slice_a": labels[i], "slice_b": labels[j], "n_obs": len(y), "mean_diff": float(mean[i] - mean[j]), "stat": stat, "p_raw": p})
    out = pd.DataFrame(rows)
    return out.assign(p_adj=st.holm_adjusted_p(out["p_raw"]), stat_type="wald", reference_dist="F", df_num=1, df_denom=len(y) - 1, multiplicity="holm")


def slice_joint_test(data: DataFrame, metric: Metric, *, by: str, factor_col: str) -> pd.DataFrame:
    """Equality of all slices at once."""
    labels, y, lags = _aligned(data, metric, by, factor_col, "slice_joint_test")
    stat, p = st.wald(*st.mean_hac(y, lags), _equal(len(labels)), len(y) - 1)
    return pd.DataFrame([{"n_obs": len(y), "k_slices": len(labels), "stat": stat, "p_value": p, "stat_type": "wald", "reference_dist": "F", "df_num": len(labels) - 1, "df_denom": len(y) - 1, "multiplicity": None}])


def _disjoint(data, metric, by, factor_col, func, method) -> tuple[list[str], list[np.ndarray], int | None]:
    if method not in ("bootstrap", "analytic"):
        raise UserInputError(func, "method", method, "'bootstrap' or 'analytic'")
    labels, series, h = _series(data, metric, by, factor_col, func)
    arrays = [series[k].to_numpy(float) for k in labels]
    limit = metric.threshold(h or 5)
    floor = max([2, *(x for x in (limit.min_periods, limit.min_events) if x is not None)])
    thin = [f"{k} ({len(x)})" for k, x in zip(labels, arrays, strict=True) if len(x) < floor]
    if thin:
        raise ValueError(f"{func}: {', '.join(thin)} below the floor of {floor}")
    return labels, arrays, h


def _boot(arrays: list[np.ndarray], seed: int | None) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draws = [x[st.stationary_indices(len(x), RESAMPLES, st.block_length(x), rng)].mean(1) for x in arrays]
    return np.array([x.mean() for x in arrays]), np.array(draws)


def _moments(arrays: list[np.ndarray], h: int | None) -> tuple[np.ndarray, np.ndarray]:
    both = [st.mean_hac(x[:, None], st.hac_lags(len(x), None, h)) for x in arrays]
    return np.array([m[0] for m, _ in both]), np.array([v[0, 0] for _, v in both])


def slice_period_pairwise_test(data: DataFrame, metric: Metric, *, by: str, factor_col: str, method: str = "bootstrap", rng_seed: int | None = None) -> pd.DataFrame:
    """Equality of each pair of date-disjoint slices."""
    labels, arrays, h = _disjoint(data, metric, by, factor_col, "slice_period_pairwise_test", method)
    pairs = list(combinations(range(len(labels)), 2))
    rows, null = [], []
    if method == "bootstrap":
        means, boot = _boot(arrays, rng_seed)
        for i, j in pairs:
            d = boot[i] - boot[j]
            se = float(d.std(ddof=1))
            t = 0.0 if se < st.EPSILON else float(means[i] - means[j]) / se
            null.append(np.zeros(RESAMPLES) if se < st.EPSILON else (d - d.mean()) / se)
            rows.append((t * t, (int((np.abs(null[-1]) >= abs(t)).sum()) + 1.0) / (RESAMPLES + 1.0), t))
        adjusted = st.romano_wolf_adjusted_p([r[2] for r in rows], np.column_stack(null))
    else:
        means, variances = _moments(arrays, h)
        for i, j in pairs:
            v = float(variances[i] + variances[j])
            w = 0.0 if v <= st.EPSILON else float(means[i] - means[j]) ** 2 / v
            rows.append((w, 1.0 if v <= st.EPSILON else chi2_sf(w, 1), 0.0))
        adjusted = st.holm_adjusted_p([r[1] for r in rows])
    boots = method == "bootstrap"
    return pd.DataFrame(
        [
            {"slice_a": labels[i], "slice_b": labels[j], "n_periods_a": len(arrays[i]), "n_periods_b": len(arrays[j]), "mean_diff": float(means[i] - means[j]), "stat": r[0], "p_raw": r[1], "p_adj": float(a)}
            for (i, j), r, a in zip(pairs, rows, adjusted, strict=True)
        ]
    ).assign(stat_type="wald", reference_dist="bootstrap_null" if boots else "chi2", df_num=1, df_denom=None, multiplicity="romano_wolf" if boots else "holm")


def slice_period_joint_test(data: DataFrame, metric: Metric, *, by: str, factor_col: str, method: str = "bootstrap", rng_seed: int | None = None) -> pd.DataFrame:
    """Equality of all date-disjoint slices at once."""
    labels, arrays, h = _disjoint(data, metric, by, factor_col, "slice_period_joint_test", method)
    r = _equal(len(labels))
    if method == "analytic":
        means, variances = _moments(arrays, h)
        stat, p = st.wald(means, np.diag(variances), r, None)
    else:
        means, boot = _boot(arrays, rng_seed)
        stat, p = st.wald(means, np.diag(boot.var(axis=1, ddof=1)), r, None)
        if (stat, p) != (0.0, 1.0):
            inverse = np.linalg.inv(r @ np.diag(boot.var(axis=1, ddof=1)) @ r.T)
            null = r @ (boot - means[:, None])
            p = (int((np.einsum("ib,ij,jb->b", null, inverse, null) >= stat).sum()) + 1.0) / (RESAMPLES + 1.0)
    return pd.DataFrame([{"k_slices": len(labels), "stat": stat, "p_value": float(p), "stat_type": "wald", "reference_dist": "bootstrap_null" if method == "bootstrap" else "chi2", "df_num": len(labels) - 1, "df_denom": None, "multiplicity": None}])
