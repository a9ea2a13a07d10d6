"""Series to scalar: the metrics.

A metric names the series it needs (a plan over all signals) and a summary of one
signal's finished series.  Summaries run grouped by signal on the executors; a group
is one time axis, one set of assets or one signal's events.
"""

from __future__ import annotations

import inspect
import math
import warnings
from dataclasses import dataclass, field, fields, make_dataclass, replace
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inference as st
from ..functions.dist import norm_sf, skew_test, spearman_p
from ..functions.inference import EPSILON
from ..plans.errors import IncompatibleInferenceError
from ..plans.results import MetricResult
from . import producers as p

@dataclass(frozen=True)
class InferenceResult:
    stat: float
    p_value: float
    metadata: dict
    warnings: frozenset[str]


class Inference(str):
    """A way to test that a series has mean zero; equal to, and usable as, its name."""

    @property
    def test(self) -> str:
        return "bootstrap-mean" if self == STATIONARY_BOOTSTRAP else "t"

    @property
    def summary(self) -> str:
        return SUMMARY[self]

    def min_input_periods(self, forward_periods: int) -> int:
        """Length that a series needs before it is sampled or smoothed."""
        return MIN_SERIES * max(forward_periods, 1) if self == NON_OVERLAPPING else st.MIN_PERIODS

    def compute(self, series, *, value_col: str = "value", forward_periods: int = 5, seed: int | None = None) -> InferenceResult:
        """Test one finished series (pandas, or a DataFrame of that size) in date order, nulls left out."""
        s = series.toPandas() if isinstance(series, DataFrame) else series
        stat, pv, meta, codes = infer(self, values(s, value_col), forward_periods, seed)
        return InferenceResult(stat, pv, meta, frozenset(codes))


NON_OVERLAPPING, NEWEY_WEST, HANSEN_HODRICK, STATIONARY_BOOTSTRAP = map(Inference, ("non_overlapping", "newey_west", "hansen_hodrick", "stationary_bootstrap"))
SUMMARY = {NON_OVERLAPPING: "non-overlapping t-test", NEWEY_WEST: "Newey-West HAC t-test", HANSEN_HODRICK: "Hansen-Hodrick HAC t-test", STATIONARY_BOOTSTRAP: "stationary-bootstrap empirical p-test"}
MIN_SERIES, MIN_EVENTS, WARN_EVENTS, MIN_PORTFOLIO, WARN_PORTFOLIO, MIN_MONOTONE, MIN_OOS = 10, 4, 30, 3, 20, 5, 5
MIN_PAIRS, WARN_PAIRS, DROP_WARN, TIE_WARN, GROUP_ASSETS = 10, 30, 0.05, 0.3, 5

INDIVIDUAL, COMMON, DENSE, SPARSE, PANEL, TIMESERIES = "individual", "common", "dense", "sparse", "panel", "timeseries"


@dataclass(frozen=True)
class Context:
    """Facts of one signal's panel that a summary needs besides its series."""

    forward_periods: int = 5
    n_periods: int = 0
    n_assets: int = 0
    n_assets_sampled: int = 0
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Threshold:
    min_periods: int | None = None
    warn_periods: int | None = None
    min_assets: int | None = None
    min_pairs: int | None = None
    warn_pairs: int | None = None
    min_events: int | None = None
    warn_events: int | None = None


REGISTRY: dict[str, type[Metric]] = {}


@dataclass(frozen=True)
class Metric:
    """Base of all metrics; instances are configurations."""

    cell: ClassVar[tuple] = (INDIVIDUAL, DENSE, PANEL)
    aggregation: ClassVar[str] = "cs_then_ts"
    producer: ClassVar[str] = ""
    series_value: ClassVar[str | None] = None  # column of the per-date series that slice tests compare
    boundary_sensitive: ClassVar[bool] = False
    continuous_magnitude: ClassVar[bool] = False
    needs: ClassVar[tuple[str, ...]] = ()

    def __init_subclass__(cls):
        if not cls.__name__.startswith("_"):
            REGISTRY[cls.__name__] = cls

    @property
    def name(self) -> str:
        return type(self).__name__

    def threshold(self, h: int) -> Threshold:
        return Threshold()

    def source(self, panel: DataFrame, h: int) -> DataFrame:
        raise NotImplementedError

    def source_key(self, h: int) -> tuple:
        return (self.producer or self.name, h, *((f.name, getattr(self, f.name)) for f in fields(self) if f.name in self.producer_fields()))

    def producer_fields(self) -> tuple[str, ...]:
        return () if self.producer else tuple(f.name for f in fields(self))

    def missing(self, columns) -> str | None:
        return next((f"no_{c}_column" if c != "price" else "no_price_data" for c in self.needs if c not in columns), None)

    def summarise(self, s: pd.DataFrame, c: Context) -> MetricResult:
        raise NotImplementedError

    def __call__(self, series, **facts) -> MetricResult:
        """Summarise one signal's finished series (pandas, or a DataFrame of that size); facts are fields of ``Context``."""
        s = series.toPandas() if isinstance(series, DataFrame) else series
        widest = next((int(s[c].max()) for c in ("universe", "n_assets") if c in s and len(s)), 0)
        known = {"n_periods": len(s), "n_assets": widest, "n_assets_sampled": widest, "columns": tuple(s.columns)}
        return replace(self.summarise(s, Context(**(known | facts))), name=self.name)


def metric(source, *, cell: tuple = (INDIVIDUAL, DENSE, PANEL), aggregation: str = "cs_then_ts", needs: tuple[str, ...] = (), threshold: Threshold | None = None, series_value: str | None = None):
    """Make a metric of a function of (series, context, **parameters) and register it under the function's name.

    ``source`` is a function of (panel, horizon) that plans the series, or a registered
    metric whose series is taken over; that series is then planned once for both.
    Keyword parameters with defaults become the metric's configuration.
    """

    def add(f):
        if f.__name__ in REGISTRY:
            raise ValueError(f"a metric named {f.__name__!r} exists")
        taken = source() if isinstance(source, type) else None
        options = [(k, v.default) for k, v in inspect.signature(f).parameters.items() if v.default is not v.empty]
        body = {
            "__doc__": f.__doc__,
            "cell": cell,
            "aggregation": aggregation,
            "needs": needs,
            "series_value": series_value,
            "threshold": lambda self, h: threshold or Threshold(),
            "source": lambda self, panel, h: taken.source(panel, h) if taken else source(panel, h),
            "summarise": lambda self, s, c: f(s, c, **{k: getattr(self, k) for k, _ in options}),
        }
        if taken:
            body["source_key"] = lambda self, h: taken.source_key(h)
        return make_dataclass(f.__name__, [(k, type(v), field(default=v)) for k, v in options], bases=(Metric,), namespace=body, frozen=True)

    return add


def short(reason: str, *, n: int | None = None, axis: str | None = None, descriptive: bool = False, alternative: str = "two-sided", **extra) -> MetricResult:
    """A result that could not be had: not a number, p of 1 (none for descriptive metrics), and why."""
    return MetricResult(float("nan"), None if descriptive else 1.0, None if descriptive else alternative, n, axis, None, {"reason": reason, **extra})


def no_signal(n: int, **extra) -> MetricResult:
    return MetricResult(0.0, 1.0, "two-sided", n, "periods", 0.0, {"n_periods": n, "stat_type": "t", "h0": "mu=0", "method": "no-signal zero-variance factor", "signal_status": "no_signal_zero_variance_factor", **extra})


def values(s: pd.DataFrame, column: str) -> np.ndarray:
    """Non-null values in date order."""
    s = s.sort_values("date") if "date" in s else s
    return s[column].dropna().to_numpy(float)


def series_column(s: pd.DataFrame, wanted: str) -> str:
    """The column to summarise: the one asked for, or ``ic`` where the default is not there."""
    return "ic" if wanted == "value" and "value" not in s else wanted


def drops(n_in: int, n_out: int, reason: str, axis: str = "periods") -> tuple[dict, list[str]]:
    lost = n_in - n_out
    rate = lost / n_in if n_in else 0.0
    meta = {f"n_{axis}_in": n_in, f"n_{axis}_out": n_out, f"dropped_{axis}": lost, "drop_rate": rate, "drop_reason": reason if lost else None}
    return meta, [f"excessive_{axis[:-1]}_drops"] if rate > DROP_WARN else []


def median_tie(s: pd.DataFrame) -> float:
    ratio = 1.0 - s["n_unique"] / s["n_rows"] if "n_unique" in s else s.get("tie_ratio")
    return float(ratio.median()) if ratio is not None and len(ratio) else float("nan")


def infer(kind: str, x: np.ndarray, h: int, seed: int | None = None) -> tuple[float, float, dict, list[str]]:
    """(stat, p, metadata, warnings) of a zero mean of a date-ordered series."""
    codes = []
    if kind == NON_OVERLAPPING:
        own = x[::h]
        t = st.mean_t(own)
        stat, pv, meta, n = t, st.t_p(t, len(own)), {"stride": h, "n_obs_original": len(x), "n_obs_sampled": len(own)}, len(own)
    elif kind == NEWEY_WEST:
        n, lags = len(x), st.hac_lags(len(x), None, h)
        stat, pv = st.newey_west(x, lags)
        meta = {"nw_lags": lags}
    elif kind == HANSEN_HODRICK:
        n = len(x)
        stat, pv, clamped = st.hansen_hodrick(x, h)
        meta, codes = {"kernel": "rectangular", "variance_clamped": clamped}, ["rect_kernel_negative_variance"] * clamped
    else:
        n = len(x)
        pv, meta = st.bootstrap_p(x, seed=seed)
        stat = float(x.mean()) if n else float("nan")
    return stat, pv, meta, codes + ["unreliable_se_short_periods"] * (0 < n < st.WARN_PERIODS)


def allowed(metric: str, kind: str, offered: tuple[str, ...]) -> None:
    if kind not in offered:
        raise IncompatibleInferenceError(f"{metric}: inference {kind!r} is not one of {', '.join(offered)}")


def spread_test(x: np.ndarray, full: np.ndarray | None, kind: str, c: Context, seed: int = 0) -> tuple[float, float, float, str, dict, list[str]]:
    """(mean, t, p, method, extra, warnings) of a sampled spread; few assets get a block bootstrap whatever was asked for."""
    mean = float(np.mean(x))
    n_assets = c.n_assets_sampled
    if kind == NEWEY_WEST and n_assets >= st.WARN_ASSETS and full is not None:
        t, pv, meta, codes = infer(NEWEY_WEST, full, c.forward_periods)
        return float(np.mean(full)), t, pv, SUMMARY[NEWEY_WEST], {**meta, "n_periods_full": len(full)}, codes
    t = st.t_stat(mean, float(np.std(x, ddof=1)) if len(x) > 1 else float("nan"), len(x))
    over = {"inference_requested": SUMMARY[NEWEY_WEST], "inference_overridden": True} if kind == NEWEY_WEST else {}
    if n_assets >= st.WARN_ASSETS:
        return mean, t, st.t_p(t, len(x)), SUMMARY[NON_OVERLAPPING], over, []
    pv, meta = st.bootstrap_p(x, seed=seed)
    extra = {"p_value_t": st.t_p(t, len(x)), "bootstrap_block_length": meta["block_length"], "bootstrap_n_resamples": meta["n_resamples"], "bootstrap_seed": meta["rng_seed"], **over}
    return mean, t, pv, "block-bootstrap CI", extra, ["few_assets"] if n_assets >= 2 else []


# --- rank correlation -----------------------------------------------------------


class _FromIC(Metric):
    producer = "compute_ic"
    series_value = "ic"

    def source(self, panel, h):
        return p.compute_ic(panel)


def _ic_frame(s: pd.DataFrame, c: Context) -> tuple[np.ndarray, dict, list[str]]:
    x = values(s, "ic")
    meta = {"n_periods": len(x), "tie_ratio": median_tie(s)}
    codes = []
    if len(s):
        least = int(s["n_assets"].min())
        meta |= {"min_assets_per_period": least, "warn_assets_per_period": 10}
        codes += ["few_assets"] * (least < 10)
    more, lost = drops(c.n_periods, len(s), "per-date cross-section below 2 valid pairs")
    return x, meta | more, codes + lost


@dataclass(frozen=True)
class ic(_FromIC):
    """Mean rank correlation."""

    inference: str = NON_OVERLAPPING
    seed: int | None = None

    def threshold(self, h):
        return Threshold(min_periods=Inference(self.inference).min_input_periods(h))

    def summarise(self, s, c):
        allowed("ic", self.inference, (NON_OVERLAPPING, NEWEY_WEST, STATIONARY_BOOTSTRAP))
        x, meta, codes = _ic_frame(s, c)
        h, floor = c.forward_periods, self.threshold(c.forward_periods).min_periods
        if len(x) < floor:
            lost = meta["dropped_periods"] > 0 and meta["n_periods_in"] >= floor
            return short("insufficient_ic_assets" if lost else "insufficient_ic_periods", n=len(x), axis="periods", min_required=floor, forward_periods=h)
        stat, pv, more, extra = infer(self.inference, x, h, self.seed)
        if more.get("n_obs_sampled", MIN_SERIES) < MIN_SERIES:
            return short("insufficient_sampled_ic_periods", n=more["n_obs_sampled"], axis="periods", min_required=MIN_SERIES, forward_periods=h)
        meta |= {"forward_periods": h, "stat_type": "bootstrap-mean" if self.inference == STATIONARY_BOOTSTRAP else "t", "h0": "mu=0", "method": SUMMARY[self.inference]}
        return MetricResult(float(x.mean()), pv, "two-sided", len(x), "periods", stat, meta, tuple(dict.fromkeys(codes + extra)))


@dataclass(frozen=True)
class ic_ir(_FromIC):
    """Mean over standard deviation of the rank correlation."""

    def threshold(self, h):
        return Threshold(min_periods=st.MIN_PERIODS, warn_periods=st.WARN_PERIODS)

    def summarise(self, s, c):
        x, meta, codes = _ic_frame(s, c)
        if len(x) < st.MIN_PERIODS:
            return short("insufficient_ic_periods", n=len(x), axis="periods", min_required=st.MIN_PERIODS)
        std = float(x.std(ddof=1))
        if std < EPSILON:
            return short("degenerate_ic_variance", std_ic=std)
        codes = ["unreliable_se_short_periods"] * (len(x) < st.WARN_PERIODS) + codes
        return MetricResult(float(x.mean()) / std, n_obs=len(x), n_obs_axis="periods", metadata={"mean_ic": float(x.mean()), "std_ic": std, **meta}, warning_codes=tuple(codes))


@dataclass(frozen=True)
class positive_rate(_FromIC):
    """Share of sampled dates with a positive rank correlation, or value of any other series."""

    value_col: str = "value"
    aggregation: ClassVar[str] = "ts_only"
    boundary_sensitive: ClassVar[bool] = True

    def threshold(self, h):
        return Threshold(min_periods=MIN_SERIES * max(h, 1))

    def summarise(self, s, c):
        h = c.forward_periods
        if len(s) < MIN_SERIES * max(h, 1):
            return short("insufficient_positive_rate_samples", n=len(s), axis="periods", min_required=MIN_SERIES * max(h, 1))
        own = s.sort_values("date")[series_column(s, self.value_col)].to_numpy(float)[:: max(h, 1)]
        x = own[~np.isnan(own)]
        n, hits = len(x), int((x > 0).sum())
        if n < MIN_SERIES:
            return short("insufficient_positive_rate_samples", n=n, axis="periods", min_required=MIN_SERIES)
        exact = n < st.EXACT_BINOMIAL_BELOW
        stat = float(hits) if exact else (hits / n - 0.5) * math.sqrt(n) / 0.5
        more, codes = drops(len(own), n, "null value observations in the series")
        method = "binomial exact test" if exact else "binomial score test (normal approximation)"
        return MetricResult(hits / n, st.binomial_p(hits, n), "two-sided", n, "periods", stat, {"n_hits": hits, "stat_type": "binomial_hits" if exact else "z", "h0": "p=0.5", "method": method, **more}, tuple(codes))


@dataclass(frozen=True)
class ic_trend(_FromIC):
    """Theil-Sen slope of the rank correlation, or any other series, over time."""

    value_col: str = "value"
    adf_threshold: float | None = 0.1
    aggregation: ClassVar[str] = "ts_only"
    boundary_sensitive: ClassVar[bool] = True

    def threshold(self, h):
        return Threshold(min_periods=10)

    def summarise(self, s, c):
        if self.adf_threshold is not None and not 0.0 < self.adf_threshold < 1.0:
            raise ValueError("adf_threshold must be in (0, 1) or None")
        x = values(s, series_column(s, self.value_col))
        x = x[np.isfinite(x)]
        n = len(x)
        if n < 10:
            return short("insufficient_trend_periods", n=n, axis="periods", min_required=10)
        slope, intercept, low, high = st.theil_sen(x)
        margin = (high - low) / 2
        t = slope / (margin / 1.96) if margin > 0 else 0.0
        meta = {"stat_type": "t", "h0": "slope=0", "method": "theil-sen CI approximation", "n_periods": n, "ci_low": low, "ci_high": high, "ci_excludes_zero": low > 0 or high < 0, "intercept": intercept}
        if self.adf_threshold is not None:
            tau, pv = st.adf(x)
            meta |= {"adf_stat": tau, "adf_p": pv, "unit_root_suspected": pv > self.adf_threshold}
        more, codes = drops(len(s), n, "null or non-finite value observations in the series")
        return MetricResult(slope, st.t_p(t, n), "two-sided", n, "periods", t, meta | more, tuple(codes))


@dataclass(frozen=True)
class oos_decay(_FromIC):
    """Mean of the later part of the series over that of the earlier part, vetoed on a change of sign."""

    value_col: str = "value"
    is_ratio: float = 0.7
    survival_threshold: float = 0.5
    aggregation: ClassVar[str] = "ts_only"
    boundary_sensitive: ClassVar[bool] = True

    def threshold(self, h):
        return Threshold(min_periods=2 * MIN_OOS)

    def summarise(self, s, c):
        x = values(s, series_column(s, self.value_col))
        n = len(x)
        echo = {"is_ratio": self.is_ratio, "survival_threshold": self.survival_threshold}
        if n < 2 * MIN_OOS:
            return short("insufficient_oos_periods", n=n, axis="periods", descriptive=True, min_required=2 * MIN_OOS, sign_flipped=False, status="VETOED", **echo)
        cut = int(n * self.is_ratio)
        first, later = float(x[:cut].mean()), float(x[cut:].mean())
        flipped = first * later < 0
        kept = 0.0 if abs(first) < EPSILON else abs(later) / abs(first)
        status = "PASS" if not flipped and kept >= self.survival_threshold else "VETOED"
        more, codes = drops(len(s), n, "null value observations in the series")
        return MetricResult(kept, n_obs=n, n_obs_axis="periods", metadata={"sign_flipped": flipped, "status": status, "mean_is": first, "mean_oos": later, **echo, **more}, warning_codes=tuple(codes))


# --- cross-sectional regression ---------------------------------------------------


class _FromFM(Metric):
    producer = "compute_fm_betas"
    series_value = "beta"

    def source(self, panel, h):
        return p.compute_fm_betas(panel)


def _fm_frame(s: pd.DataFrame, c: Context) -> tuple[np.ndarray, dict, list[str]]:
    x = values(s, "beta")
    least = int(s["n_assets"].min()) if len(s) else None
    more, codes = drops(c.n_periods, len(s), "per-date cross-section below 3 valid pairs or without signal variation")
    return x, {"n_periods": len(x), "min_assets_per_period": least, "warn_assets_per_period": 10, **more}, ["few_assets"] * (least is not None and least < 10) + codes


@dataclass(frozen=True)
class fm_beta(_FromFM):
    """Mean per-date slope with a Newey-West t, optionally corrected for an estimated factor."""

    newey_west_lags: int | None = None
    is_estimated_factor: bool = False
    factor_return_var: float | None = None

    def threshold(self, h):
        return Threshold(min_periods=4, warn_periods=30)

    def summarise(self, s, c):
        x, meta, codes = _fm_frame(s, c)
        n, h = len(x), c.forward_periods
        if n < 4:
            return short("insufficient_fm_periods", n=n, axis="periods", min_required=4)
        mean = float(x.mean())
        t, pv = st.newey_west(x, self.newey_west_lags, h)
        meta = {"stat_type": "t", "h0": "mean(beta)=0", "method": "Fama-MacBeth + Newey-West", "newey_west_lags": st.hac_lags(n, self.newey_west_lags, h), "forward_periods": h, "is_estimated_factor": self.is_estimated_factor, **meta}
        if self.is_estimated_factor:
            given = self.factor_return_var
            variance = float(given) if given is not None else float(x.var(ddof=1))
            if variance < EPSILON:
                meta["shanken_correction"] = "skipped_zero_factor_variance"
            else:
                k = 1.0 + mean * mean / variance
                meta |= {"p_value_uncorrected": pv, "stat_uncorrected": t, "shanken_c": k, "shanken_factor_return_var": variance, "shanken_factor_return_var_source": "betas_timeseries_proxy" if given is None else "user_supplied", "method": "Fama-MacBeth + Newey-West + Shanken (1992) EIV"}
                t /= math.sqrt(k)
                pv = st.t_p(t, n)
        return MetricResult(mean, pv, "two-sided", n, "periods", t, meta, tuple(["unreliable_se_short_periods"] * (n < 30) + codes))


@dataclass(frozen=True)
class fm_beta_sign_consistency(_FromFM):
    """Share of dates whose slope has the expected sign."""

    expected_sign: int = 1

    def threshold(self, h):
        return Threshold(min_periods=1)

    def summarise(self, s, c):
        x, meta, codes = _fm_frame(s, c)
        if not len(x):
            return short("no_beta_observations", n=0, axis="periods", min_required=1)
        share = float((x > 0).mean() if self.expected_sign >= 0 else (x < 0).mean())
        return MetricResult(share, n_obs=len(x), n_obs_axis="periods", metadata={"expected_sign": self.expected_sign, **meta}, warning_codes=tuple(codes))


@dataclass(frozen=True)
class pooled_beta(Metric):
    """Pooled slope with clustered, two-way clustered or Driscoll-Kraay errors."""

    cluster_col: str = "date"
    two_way_cluster_col: str | None = None
    driscoll_kraay: bool = False
    driscoll_kraay_lags: int | None = None

    def threshold(self, h):
        return Threshold(min_pairs=10, min_periods=3, warn_periods=30)

    def source(self, panel, h):
        return p.cluster_scores(panel, [self.cluster_col] + [x for x in [self.two_way_cluster_col] if x], summed=not self.driscoll_kraay)

    def summarise(self, s, c):
        if self.driscoll_kraay and self.two_way_cluster_col:
            raise ValueError("driscoll_kraay and two_way_cluster_col exclude each other")
        n = int(s["n"].iloc[0]) if len(s) else 0
        if n < 10:
            return short("insufficient_pooled_observations", n=n, axis="pairs", min_required=10)
        slope, sx, sxx = (float(s[x].iloc[0]) for x in ("slope", "sx", "sxx"))
        try:
            inverse = np.linalg.inv(np.array([[n, sx], [sx, sxx]]))
        except np.linalg.LinAlgError:
            return short("singular_pooled_design_matrix", n=n, axis="pairs")

        def meat(axis):
            own = s[s["axis"] == axis].iloc[0]
            return np.array([[own.m00, own.m01], [own.m01, own.m11]]), int(own.g)

        def low(reason, g, least=3, **extra):
            return MetricResult(slope, 1.0, "two-sided", n, "pairs", None, {"reason": reason, "min_required": least, **extra})

        if self.driscoll_kraay:
            a = s.sort_values("cluster")[["s0", "s1"]].to_numpy(float)
            ga = len(a)
            lags = max(0, min(st.auto_lags(ga) if self.driscoll_kraay_lags is None else self.driscoll_kraay_lags, ga - 1))
            if ga < 3:
                return low("insufficient_periods", ga, n_periods=ga)
            se = math.sqrt(max(float((inverse @ st.bartlett(a, lags) @ inverse)[1, 1]), 0.0))
            t = 0.0 if se < EPSILON else slope / se
            meta = {"stat_type": "t", "h0": "beta=0", "method": f"Pooled OLS + Driscoll-Kraay (1998) SE ({self.cluster_col})", "se_method": "driscoll_kraay", "n_periods": ga, "driscoll_kraay_lags": lags}
            return MetricResult(slope, st.t_p(t, ga), "two-sided", n, "pairs", t, meta, tuple(["unreliable_se_short_periods"] * (ga < 30)))
        a, ga = meat(self.cluster_col)
        one = ga / max(ga - 1, 1) * a
        small = (n - 1) / (n - 2)
        variance = lambda x: float((small * inverse @ x @ inverse)[1, 1])
        if self.two_way_cluster_col is None:
            if ga < 3:
                return low("insufficient_clusters", ga, n_clusters=ga)
            v, g, meta, how = variance(one), ga, {"n_clusters": ga}, f"clustered SE ({self.cluster_col})"
        else:
            (b, gb), (i, gi) = meat(self.two_way_cluster_col), meat("both")
            if min(ga, gb) < 3:
                return low("insufficient_clusters", min(ga, gb), n_clusters=min(ga, gb), n_clusters_a=ga, n_clusters_b=gb)
            v = variance(one + gb / (gb - 1) * b - gi / max(gi - 1, 1) * i)
            g, meta, how = min(ga, gb), {"n_clusters_a": ga, "n_clusters_b": gb, "n_clusters_intersection": gi}, f"two-way clustered SE ({self.cluster_col}, {self.two_way_cluster_col})"
            if v < 0:
                v, meta["variance_non_psd_fallback"] = variance(one), f"one_way_{self.cluster_col}"
        se = math.sqrt(max(v, 0.0))
        t = 0.0 if se < EPSILON else slope / se
        return MetricResult(slope, st.t_p(t, g), "two-sided", n, "pairs", t, {"stat_type": "t", "h0": "beta=0", "method": f"Pooled OLS + {how}", **meta})


# --- portfolios --------------------------------------------------------------------


def _few(name: str, c: Context, base: int, **extra) -> MetricResult | None:
    floor = base * max(c.forward_periods, 1)
    return short(f"insufficient_{name}_periods", n=c.n_periods, axis="periods", min_required=floor, **extra) if c.n_periods < floor else None


def _too_narrow(s: pd.DataFrame, n_groups: int) -> MetricResult | None:
    if len(s) and not (s["n_assets"] < n_groups).all():
        return None
    most = int(s["n_assets"].max()) if len(s) else 0
    return short("insufficient_assets_for_quantile_groups", n=most, axis="assets", n_groups=n_groups, min_required=n_groups, max_assets_per_date=most)


@dataclass(frozen=True)
class quantile_spread(Metric):
    """Mean return of the top less the bottom bucket."""

    n_groups: int = 5
    tie_policy: str = "ordinal"
    inference: str = NON_OVERLAPPING
    producer: ClassVar[str] = "compute_spread_series"
    series_value: ClassVar[str] = "spread"

    def producer_fields(self):
        return ("n_groups", "tie_policy", "inference")

    def threshold(self, h):
        return Threshold(min_periods=MIN_PORTFOLIO * max(h, 1), min_assets=self.n_groups)

    def source(self, panel, h):
        own = p.compute_spread_series(panel, h, self.n_groups, tie_policy=self.tie_policy).withColumn("full", F.lit(False))
        if self.inference != NEWEY_WEST:
            return own
        return own.unionByName(p.compute_spread_series(panel, 1, self.n_groups, tie_policy=self.tie_policy).withColumn("full", F.lit(True)))

    def summarise(self, s, c):
        allowed("quantile_spread", self.inference, (NON_OVERLAPPING, NEWEY_WEST))
        full = s[s["full"]] if "full" in s else s[:0]
        s = s[~s["full"].astype(bool)] if "full" in s else s
        echo = {"tie_ratio": median_tie(s), "tie_policy": self.tie_policy}
        sc = _few("portfolio", c, MIN_PORTFOLIO, **echo) or _too_narrow(s, self.n_groups)
        if sc:
            return sc
        if s["zero_variance"].all():
            return no_signal(len(s), n_groups=self.n_groups, **echo)
        x = values(s, "spread")
        mean, t, pv, method, extra, codes = spread_test(x, values(full, "spread") if len(full) else None, self.inference, c)
        meta = {"n_periods": len(x), "stat_type": "t", "h0": "mu=0", "method": method}
        for leg, excess in (("long", s["top_return"] - s["universe_return"]), ("short", s["universe_return"] - s["bottom_return"])):
            e = excess.dropna().to_numpy(float)
            lt = st.mean_t(e)
            meta |= {f"{leg}_alpha": float(e.mean()), f"{leg}_stat": lt, f"{leg}_p_value": st.t_p(lt, len(e))}
        if int(s["universe"].median()) // self.n_groups < GROUP_ASSETS:
            codes = [*codes, "thin_quantile_groups"]
        more, lost = drops(len(s), len(x), "null spread observations in the series")
        return MetricResult(mean, pv, "two-sided", len(x), "periods", t, {**meta, **echo, **extra, **more}, tuple(codes + lost))


@dataclass(frozen=True)
class quantile_spread_vw(Metric):
    """Value-weighted spread, weights one sampled period old."""

    n_groups: int = 5
    weight_col: str = "market_cap"
    tie_policy: str = "ordinal"
    lag_weights: bool = True

    def threshold(self, h):
        return Threshold(min_periods=MIN_PORTFOLIO * max(h, 1), min_assets=self.n_groups)

    def missing(self, columns):
        return None if self.weight_col in columns else "no_weight_column"

    def source(self, panel, h):
        return p.weighted_spread_series(panel, h, self.n_groups, weight_col=self.weight_col, tie_policy=self.tie_policy, lag_weights=self.lag_weights)

    def summarise(self, s, c):
        echo = {"tie_ratio": median_tie(s), "tie_policy": self.tie_policy}
        sc = _few("portfolio", c, MIN_PORTFOLIO, **echo) or _too_narrow(s, self.n_groups)
        if sc:
            return sc
        x = values(s, "spread_vw")
        if s["zero_variance"].all():
            return no_signal(len(x), n_groups=self.n_groups, weights_lagged=self.lag_weights, **echo)
        t = st.mean_t(x)
        more, codes = drops(len(s), len(x), "null spread observations in the series")
        return MetricResult(float(x.mean()), st.t_p(t, len(x)), "two-sided", len(x), "periods", t, {"n_periods": len(x), "method": SUMMARY[NON_OVERLAPPING], "stat_type": "t", "h0": "mu=0", "weights_lagged": self.lag_weights, **echo, **more}, tuple(codes))


@dataclass(frozen=True)
class k_spread(Metric):
    """Mean return of the k highest less the k lowest signals."""

    k: int = 5
    rng_seed: int = 0
    inference: str = NON_OVERLAPPING

    def threshold(self, h):
        return Threshold(min_periods=MIN_PORTFOLIO * max(h, 1), min_assets=2 * self.k)

    def source(self, panel, h):
        if self.k < 1:
            raise ValueError(f"k must be >= 1, got {self.k}")
        own = p.k_spread_series(panel, h, self.k).withColumn("full", F.lit(False))
        return own if self.inference != NEWEY_WEST else own.unionByName(p.k_spread_series(panel, 1, self.k).withColumn("full", F.lit(True)))

    def summarise(self, s, c):
        allowed("k_spread", self.inference, (NON_OVERLAPPING, NEWEY_WEST))
        wide = lambda x: x[x["n_assets"] >= 2 * self.k]
        full, s = (s[s["full"].astype(bool)], s[~s["full"].astype(bool)]) if len(s) else (s, s)
        most = int(s["n_assets"].max()) if len(s) else 0
        echo = {"k": self.k, "min_required": 2 * self.k, "max_assets_per_date": most}
        if c.n_assets_sampled < 2 * self.k:
            return short("insufficient_assets_for_k_legs", n=c.n_assets_sampled, axis="assets", **echo)
        flat = len(s) and s["zero_variance"].all()
        if not flat and not len(wide(s)):
            return short("insufficient_assets_for_k_legs", n=0, axis="periods", **echo)
        sc = _few("portfolio", c, MIN_PORTFOLIO, k=self.k)
        if sc:
            return sc
        if flat:
            return no_signal(len(s), k=self.k, cross_sectional_dispersion=float(s["xs_dispersion"].mean()), top_return=float(s["universe"].mean()), bottom_return=float(s["universe"].mean()))
        s = wide(s)
        x = values(s, "spread")
        mean, t, pv, method, extra, codes = spread_test(x, values(wide(full), "spread") if len(full) else None, self.inference, c, self.rng_seed)
        more, lost = drops(len(s), len(x), "null spread observations in the series")
        meta = {"n_periods": len(x), "k": self.k, "stat_type": "t", "h0": "mu=0", "method": method, "cross_sectional_dispersion": float(s["xs_dispersion"].mean()), "top_return": float(s["top_return"].mean()), "bottom_return": float(s["bottom_return"].mean())}
        return MetricResult(mean, pv, "two-sided", len(x), "periods", t, {**meta, **extra, **more}, tuple(codes + lost))


@dataclass(frozen=True)
class monotonicity(Metric):
    """Mean absolute rank correlation of bucket returns with the bucket; t of the signed one."""

    n_groups: int = 10
    tie_policy: str = "ordinal"

    def threshold(self, h):
        return Threshold(min_periods=MIN_MONOTONE * max(h, 1))

    def source(self, panel, h):
        return p.monotonicity_series(panel, h, self.n_groups, tie_policy=self.tie_policy)

    def summarise(self, s, c):
        echo = {"n_groups": self.n_groups, "tie_ratio": median_tie(s), "tie_policy": self.tie_policy}
        x = values(s, "rho")
        sc = _few("monotonicity", c, MIN_MONOTONE, **echo)
        if sc or not len(x):
            return sc or short("insufficient_monotonicity_periods", n=0, axis="periods", **echo)
        t = st.mean_t(x)
        return MetricResult(float(np.abs(x).mean()), st.t_p(t, len(x)), "two-sided", len(x), "periods", t, {"method": "t-test on per-period signed monotonicity", "stat_type": "t", "h0": "mu=0", "mean_signed": float(x.mean()), "n_valid_periods": len(x), **echo})


@dataclass(frozen=True)
class top_concentration(Metric):
    """Effective number of names at the top; tests that it is below half of their number."""

    q_top: float = 0.2
    weight_by: str = "abs_factor"

    def threshold(self, h):
        return Threshold(min_periods=MIN_PORTFOLIO * max(h, 1), warn_periods=WARN_PORTFOLIO * max(h, 1))

    def source(self, panel, h):
        return p.concentration_series(panel, h, self.q_top, weight_by=self.weight_by)

    def summarise(self, s, c):
        tie = median_tie(s)
        sc = _few("portfolio", c, MIN_PORTFOLIO, tie_ratio=tie)
        if sc:
            return sc
        s = s[s["eff_n"].notna()]
        eff, top = s["eff_n"].to_numpy(float), s["n_top"].to_numpy(float)
        if not len(eff):
            return short("insufficient_portfolio_periods", n=0, axis="periods", alternative="less", tie_ratio=tie)
        ratio = eff / np.maximum(top, 1)
        t = st.t_stat(float(ratio.mean()) - 0.5, float(ratio.std(ddof=1)) if len(ratio) > 1 else float("nan"), len(ratio))
        meta = {"stat_type": "t", "h0": "ratio>=0.5", "method": "one-sided t-test on ratio", "mean_n_top": float(top.mean()), "ratio_eff_to_total": float(eff.mean()) / max(float(top.mean()), 1), "tie_ratio": tie, "weight_by": self.weight_by}
        codes = ["borderline_portfolio_periods"] * (c.n_periods < WARN_PORTFOLIO * max(c.forward_periods, 1))
        return MetricResult(float(eff.mean()), st.t_p(t, len(ratio), "less"), "less", len(ratio), "periods", t, meta, tuple(codes))


@dataclass(frozen=True)
class directional_pair_accuracy(Metric):
    """Share of same-date pairs that signal and return put in the same order."""

    needs: ClassVar[tuple[str, ...]] = ("factor", "forward_return")

    def source(self, panel, h):
        return p.pair_accuracy_series(panel, h)

    def summarise(self, s, c):
        total = {k: int(s[k].sum()) if len(s) else 0 for k in ("raw_pairs", "correct", "incorrect", "factor_ties", "return_ties", "both_ties")}
        n = total["correct"] + total["incorrect"]
        usable = (s["correct"] + s["incorrect"]) if len(s) else pd.Series(dtype=float)
        per_date = (s["correct"] / usable)[usable > 0] if len(s) else usable
        meta = {"n_pairs": n, "n_raw_pairs": total["raw_pairs"], "n_periods": len(per_date), "factor_tie_pairs": total["factor_ties"], "return_tie_pairs": total["return_ties"], "both_tie_pairs": total["both_ties"], "dropped_pairs": total["raw_pairs"] - n}
        if n < MIN_PAIRS:
            return short("insufficient_ordering_pairs", n=n, axis="pairs", descriptive=True, min_required=MIN_PAIRS, **meta)
        pairs = usable[usable > 0]
        meta |= {"method": "pooled pairwise ordering accuracy (descriptive; no p-value)", "n_correct_pairs": total["correct"], "n_incorrect_pairs": total["incorrect"], "pooled_accuracy": total["correct"] / n, "mean_per_date_accuracy": float(per_date.mean()), "mean_pairs_per_period": float(pairs.mean()), "min_pairs_per_period": int(pairs.min()), "max_pairs_per_period": int(pairs.max()), "tie_epsilon": EPSILON}
        return MetricResult(total["correct"] / n, n_obs=n, n_obs_axis="pairs", metadata=meta, warning_codes=tuple(["few_ordering_pairs"] * (n < WARN_PAIRS)))


def icc(m: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[float | None, float, str]:
    """(within-date correlation, mean cluster size, source) from per-date means, variances and counts."""
    if not len(n):
        return None, 0.0, "no_multi_event_dates"
    multi = n >= 2
    if multi.sum() < 2:
        return None, float(n.sum() / len(n)), "no_multi_event_dates"
    within = float((v[multi] * (n[multi] - 1)).sum() / (n[multi] - 1).sum())
    between = float(m[multi].var(ddof=1))
    total = between + within
    return (0.0 if total < EPSILON else min(1.0, max(0.0, between / total))), float(n[multi].mean()), "icc"


def cluster_scale(r: float, n: float) -> float:
    return math.sqrt((1.0 - r) / (1.0 + (n - 1.0) * r))


@dataclass(frozen=True)
class directional_hit_rate(Metric):
    """Pesaran-Timmermann test of direction, deflated for dependence within dates."""

    cell: ClassVar[tuple] = (None, DENSE, None)
    aggregation: ClassVar[str] = "ts_only"
    boundary_sensitive: ClassVar[bool] = True
    needs: ClassVar[tuple[str, ...]] = ("forward_return",)

    def threshold(self, h):
        return Threshold(min_pairs=MIN_PAIRS, warn_pairs=WARN_PAIRS)

    def source(self, panel, h):
        return p.directional_series(panel, h)

    def summarise(self, s, c):
        n = int(s["n"].sum()) if len(s) else 0
        if n < MIN_PAIRS:
            return short("insufficient_directional_samples", n=n, axis="pairs", alternative="greater", min_required=MIN_PAIRS)
        hit, px, py = (float(s[k].sum()) / n for k in ("hits", "up_signal", "up_return"))
        star = px * py + (1 - px) * (1 - py)
        variance = star * (1 - star) / n - ((2 * py - 1) ** 2 * px * (1 - px) / n + (2 * px - 1) ** 2 * py * (1 - py) / n + 4 * px * py * (1 - px) * (1 - py) / n**2)
        if variance <= 0:
            return short("degenerate_directional_variance", n=n, axis="pairs", alternative="greater", p_correct=hit, p_up_pred=px, p_up_real=py)
        z = (hit - star) / math.sqrt(variance)
        k, m = s["n"].to_numpy(float), (s["hits"] / s["n"]).to_numpy(float)
        spread = np.where(k > 1, k * m * (1 - m) / np.maximum(k - 1, 1), np.nan)
        r, size, _ = icc(m, spread, k)
        applied = r is not None and size > 1.0
        stat = z * cluster_scale(r, size) if applied else z
        meta = {"stat_type": "z", "h0": "independent_direction", "method": "Pesaran-Timmermann (1992)", "p_correct": hit, "p_expected": star, "p_up_pred": px, "p_up_real": py, "kolari_pynnonen_r": r, "kolari_pynnonen_n_eff": size, "kolari_pynnonen_applied": applied}
        if applied:
            meta |= {"stat_uncorrected": z, "method": "Pesaran-Timmermann (1992) + Kolari-Pynnonen (2010) cross-sectional-correlation adjustment"}
        return MetricResult(hit, norm_sf(stat), "greater", n, "pairs", stat, meta, tuple(["few_directional_pairs"] * (n < WARN_PAIRS)))


@dataclass(frozen=True)
class rank_turnover(Metric):
    """One less the mean autocorrelation of ranks."""

    quantile: float | None = None
    aggregation: ClassVar[str] = "ts_only"
    boundary_sensitive: ClassVar[bool] = True

    def threshold(self, h):
        return Threshold(min_periods=2 * h + 1)

    def source(self, panel, h):
        return p.rank_autocorrelation(panel, h, self.quantile)

    def summarise(self, s, c):
        h = c.forward_periods
        if c.n_periods < 2 * h + 1:
            return short("insufficient_dates", n=c.n_periods, min_required=2 * h + 1, forward_periods=h)
        x = values(s, "rc")
        if len(x) < 2:
            return short("insufficient_pairs", n=len(x), min_required=2, forward_periods=h, quantile=self.quantile)
        meta = {"mean_rank_autocorrelation": float(x.mean()), "std_rank_autocorrelation": float(x.std(ddof=1)), "n_pairs": len(x), "forward_periods": h, "quantile": self.quantile, "n_cross_section_mean": float(s["n_pair"].mean())}
        return MetricResult(1.0 - float(x.mean()), n_obs=len(x), n_obs_axis="pairs", metadata=meta)


@dataclass(frozen=True)
class notional_turnover(Metric):
    """Mean share of the top and bottom buckets replaced at each rebalance."""

    n_groups: int = 10

    def threshold(self, h):
        return Threshold(min_periods=2)

    def source(self, panel, h):
        return p.membership_turnover(panel, self.n_groups, h)

    def summarise(self, s, c):
        h = c.forward_periods
        if -(-c.n_periods // max(h, 1)) < 2:
            return short("insufficient_dates", n=-(-c.n_periods // max(h, 1)), axis="periods", min_required=2, forward_periods=h)
        x = values(s, "turnover")
        if not len(x):
            return short("no_valid_pairs", forward_periods=h, n_groups=self.n_groups)
        meta = {"n_rebalances": len(x), "n_groups": self.n_groups, "forward_periods": h, "mean_tail_size": float(((s["n_top"] + s["n_bot"]) / 2).mean()), "method": f"one-sided overlap on top/bottom {1 / self.n_groups:.0%} quantile, top/bot averaged"}
        return MetricResult(float(x.mean()), n_obs=len(x), n_obs_axis="pairs", metadata=meta)


def breakeven_cost(gross_spread: float, turnover: float, *, forward_periods: int = 1) -> MetricResult:
    """Cost in basis points at which the spread is gone; infinite without turnover."""
    if forward_periods < 1:
        raise ValueError("forward_periods must be >= 1")
    cost = float("inf") if turnover < EPSILON else gross_spread * forward_periods / (2 * turnover) * 1e4
    return MetricResult(cost, metadata={"gross_spread": gross_spread, "turnover": turnover, "forward_periods": forward_periods}, name="breakeven_cost")


def net_spread(gross_spread: float, turnover: float, estimated_cost_bps: float = 30.0, *, forward_periods: int = 1) -> MetricResult:
    """Spread after a cost per unit of turnover."""
    if forward_periods < 1:
        raise ValueError("forward_periods must be >= 1")
    drag = 2 * (estimated_cost_bps / 1e4) * turnover / forward_periods
    return MetricResult(gross_spread - drag, metadata={"gross_spread": gross_spread, "cost_drag": drag, "estimated_cost_bps": estimated_cost_bps, "turnover": turnover, "forward_periods": forward_periods}, name="net_spread")


# --- spanning --------------------------------------------------------------------


def ols_alpha(y: np.ndarray, base: np.ndarray) -> tuple[float, float, list[float], float, int]:
    """(intercept, its t, betas, R squared, degrees of freedom) of a regression on base columns."""
    n = len(y)
    if n < 3:
        return 0.0, 0.0, [], 0.0, 0
    x = np.column_stack([np.ones(n), base]) if base.size else np.ones((n, 1))
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    total = float(((y - y.mean()) ** 2).sum())
    fit = 1.0 - float(rest @ rest) / total if total > EPSILON else 0.0
    dof = n - x.shape[1]
    t = 0.0
    if dof > 0 and float(rest @ rest) / dof >= EPSILON:
        try:
            se = math.sqrt(max(float(rest @ rest) / dof * float(np.linalg.inv(x.T @ x)[0, 0]), 0.0))
            t = float(beta[0]) / se if se >= EPSILON else 0.0
        except np.linalg.LinAlgError:
            pass
    return float(beta[0]), t, [float(b) for b in beta[1:]], fit, max(dof, 0)


def aligned(series: dict[str, pd.DataFrame]) -> dict[str, np.ndarray]:
    """Spreads on the dates that all series have; none if those are fewer than ten."""
    wide = pd.concat({k: s.dropna(subset=["spread"]).set_index("date")["spread"] for k, s in series.items()}, axis=1, join="inner").sort_index() if series else pd.DataFrame()
    return {k: wide[k].to_numpy(float) for k in series} if len(wide) >= 10 else {}


def spanning_alpha(factor_spread: pd.DataFrame, base_spreads: dict[str, pd.DataFrame] | None = None) -> MetricResult:
    """Intercept of a spread series on base spread series (each with date and spread)."""
    if base_spreads:
        arrays = aligned({"_candidate": factor_spread, **base_spreads})
        if not arrays:
            return short("no_overlapping_dates_with_candidate", n=0, axis="periods")
        y = arrays.pop("_candidate")
        base = np.column_stack(list(arrays.values()))
    else:
        arrays, y = {}, values(factor_spread, "spread")
        base = np.empty((len(y), 0))
    if len(y) < 10:
        return short("insufficient_spread_observations", n=len(y), axis="periods", min_required=10)
    alpha, t, betas, fit, dof = ols_alpha(y, base)
    meta = {"stat_type": "t", "h0": "alpha=0", "method": "OLS spanning regression", "n_base_factors": base.shape[1], "base_factors": list(arrays), "betas": dict(zip(arrays, betas, strict=True)), "r_squared": fit}
    return MetricResult(alpha, st.t_p(t, len(y), dof=dof), "two-sided", len(y), "periods", t, meta, name="spanning_alpha")


def greedy_forward_selection(factor_spreads: dict[str, pd.DataFrame], base_spreads: dict[str, pd.DataFrame] | None = None, significance_threshold: float = 2.0, max_factors: int = 20, suppress_snooping_warning: bool = False) -> MetricResult:
    """Stepwise selection by |alpha| among |t| >= threshold, with backward elimination; names break ties.  Its t's are no valid inference."""
    if not suppress_snooping_warning:
        warnings.warn("stepwise selection inflates t statistics; evaluate survivors on other data", UserWarning, stacklevel=2)
    base_spreads = base_spreads or {}
    arrays = aligned({**base_spreads, **factor_spreads})
    bases = [arrays[k] for k in base_spreads if k in arrays]
    left = {k: arrays[k] for k in sorted(factor_spreads) if k in arrays}
    chosen: dict[str, dict] = {}
    tried, removed = [], []

    def test(y: np.ndarray, others: list[np.ndarray]) -> tuple[float, float]:
        columns = bases + others
        return ols_alpha(y, np.column_stack(columns) if columns else np.empty((len(y), 0)))[:2]

    row = lambda k, a, t, s: {"factor_name": k, "alpha": a, "t_stat": t, "selected": s}
    for _ in range(max_factors):
        found = {k: test(y, [arrays[x] for x in chosen]) for k, y in left.items()}
        tried += [row(k, a, t, False) for k, (a, t) in found.items()]
        able = [k for k, (a, t) in found.items() if abs(t) >= significance_threshold and a != 0.0]
        if not able:
            break
        best = min(able, key=lambda k: (-abs(found[k][0]), k))
        del left[best]
        chosen[best] = row(best, *found[best], True)
        while True:
            weak = next(((k, a, t) for k in chosen for a, t in [test(arrays[k], [arrays[x] for x in chosen if x != k])] if abs(t) < significance_threshold), None)
            if weak is None:
                break
            removed.append(row(*weak, False))
            del chosen[weak[0]]
    n = len(next(iter(arrays.values()))) if arrays else 0
    meta = {"method": "greedy forward selection", "selected_factors": list(chosen.values()), "eliminated_factors": removed, "all_candidates": tried, "t_stats_inference_invalid": True}
    return MetricResult(float(len(chosen)), n_obs=n, n_obs_axis="periods", metadata=meta, name="greedy_forward_selection")


# --- events ----------------------------------------------------------------------


class _Event(Metric):
    cell = (None, SPARSE, None)
    aggregation = "event_time"

    def threshold(self, h):
        return Threshold(min_events=MIN_EVENTS)


def _few_events(n: int, **extra) -> MetricResult | None:
    return short("insufficient_events", n=n, axis="events", min_required=MIN_EVENTS, **extra) if n < MIN_EVENTS else None


def spaced(ordinals: np.ndarray, h: int) -> np.ndarray:
    """Greedy choice of events at least ``h`` dates apart, from the first on."""
    keep, last = np.zeros(len(ordinals), bool), None
    for i, o in enumerate(ordinals):
        if last is None or o - last >= h:
            keep[i], last = True, o
    return keep if h > 1 else np.ones(len(ordinals), bool)


@dataclass(frozen=True)
class caar(_Event):
    """Mean abnormal return over event dates; t on dates that don't overlap."""

    producer: ClassVar[str] = "compute_caar"
    series_value: ClassVar[str] = "caar"
    boundary_sensitive: ClassVar[bool] = True

    def threshold(self, h):
        return Threshold(min_events=MIN_EVENTS * max(h, 1), warn_events=WARN_EVENTS * max(h, 1))

    def source(self, panel, h):
        return p.compute_caar(panel)

    def summarise(self, s, c):
        s = s.dropna(subset=["caar"]).sort_values("date") if len(s) else s
        limit, n = self.threshold(c.forward_periods), len(s)
        if n < limit.min_events:
            return short("insufficient_event_periods", n=n, axis="events", min_required=limit.min_events, forward_periods=c.forward_periods)
        x = s["caar"].to_numpy(float)
        own = x[spaced(s["date_ordinal"].to_numpy(), c.forward_periods)]
        t = st.mean_t(own)
        meta = {"n_event_periods": n, "total_events": int(s["n_events"].sum()), "n_event_periods_sampled": len(own), "stat_type": "t", "h0": "mu=0", "method": SUMMARY[NON_OVERLAPPING]}
        return MetricResult(float(x.mean()), st.t_p(t, len(own)), "two-sided", len(own), "events", t, meta, tuple(["few_events"] * (n < limit.warn_events)))


@dataclass(frozen=True)
class bmp_z(_Event):
    """Standardised cross-sectional event test."""

    estimation_window: int = 60
    kolari_pynnonen_adjust: bool = False
    include_prediction_error_variance: bool = False
    boundary_sensitive: ClassVar[bool] = True

    def source(self, panel, h):
        return p.standardized_events(panel, estimation_window=self.estimation_window, forward_periods=h, prediction_error=self.include_prediction_error_variance)

    def summarise(self, s, c):
        if not len(s):
            return short("no_events", n=0, axis="events", min_required=1)
        valid = s.dropna(subset=["sar"])
        n, x, priced = len(valid), valid["sar"].to_numpy(float), "price" in c.columns
        if n < MIN_EVENTS:
            return short("insufficient_estimation_window", n=n, axis="events", min_required=MIN_EVENTS)
        z = st.mean_t(x)
        meta = {"n_events": n, "n_dropped": len(s) - n, "std_sar": float(x.std(ddof=1)), "estimation_window": self.estimation_window, "stat_type": "z", "h0": "mu_SAR=0", "method": "BMP standardized cross-sectional test", "include_prediction_error_variance": self.include_prediction_error_variance, "vol_source": "price" if priced else "forward_return", "vol_estimation_lag": 0 if priced else c.forward_periods}
        if self.kolari_pynnonen_adjust:
            by = valid.groupby("date")["sar"].agg(["mean", "var", "count"])
            r, size, source = icc(by["mean"].to_numpy(float), by["var"].to_numpy(float), by["count"].to_numpy(float))
            applied = r is not None and size > 1.0
            meta |= {"kolari_pynnonen_r": r, "kolari_pynnonen_n_eff": size, "kolari_pynnonen_r_source": source, "kolari_pynnonen_applied": applied}
            if applied:
                meta |= {"kolari_pynnonen_scaling": cluster_scale(r, size), "stat_uncorrected": z, "method": "BMP + Kolari-Pynnonen (2010) cross-sectional-correlation adjustment"}
                z *= cluster_scale(r, size)
        return MetricResult(float(x.mean()), st.z_p(z), "two-sided", n, "events", z, meta, tuple(["bmp_return_vol_fallback"] * (not priced)))


@dataclass(frozen=True)
class corrado_rank(_Event):
    """Mean signed rank of event returns over the pooled deviation of all ranks."""

    boundary_sensitive: ClassVar[bool] = True

    def source(self, panel, h):
        ranked = p.rank_scores(panel)
        event = F.col("factor") != 0
        signed = F.when(event, F.col("u") * F.signum("factor"))
        return ranked.groupBy("factor_name").agg(F.count(F.when(event, 1)).alias("n_events"), F.avg(signed).alias("mean_u"), F.stddev_pop("u").alias("std_u"), F.count(F.lit(1)).alias("n_total"))

    def summarise(self, s, c):
        n = int(s["n_events"].iloc[0]) if len(s) else 0
        sc = _few_events(n, alternative="greater")
        if sc:
            return sc
        mean, std = float(s["mean_u"].iloc[0]), float(s["std_u"].iloc[0])
        if std < EPSILON:
            return short("degenerate_rank_variance", alternative="greater", std_u=std)
        z = st.t_stat(mean, std, n)
        return MetricResult(mean, norm_sf(z), "greater", n, "events", z, {"n_events": n, "n_total_obs": int(s["n_total"].iloc[0]), "stat_type": "z", "h0": "mu_rank<=0", "method": "Corrado (1989) rank test"})


class _FromSigned(_Event):
    producer = "signed_returns"

    def source(self, panel, h):
        return p.signed_returns(panel)


@dataclass(frozen=True)
class event_hit_rate(_FromSigned):
    """Share of events whose signed return is positive."""

    def summarise(self, s, c):
        n = len(s)
        sc = _few_events(n)
        if sc:
            return sc
        hits, exact = int((s["signed"] > 0).sum()), n < st.EXACT_BINOMIAL_BELOW
        stat = float(hits) if exact else (hits - n * 0.5) / (math.sqrt(n) * 0.5)
        method = "binomial exact test" if exact else "binomial score test (normal approximation)"
        return MetricResult(hits / n, st.binomial_p(hits, n), "two-sided", n, "events", stat, {"n_events": n, "n_hits": hits, "stat_type": "binomial_hits" if exact else "z", "h0": "p=0.5", "method": method})


@dataclass(frozen=True)
class event_ic(_FromSigned):
    """Rank correlation of signal magnitude and signed return over events."""

    continuous_magnitude: ClassVar[bool] = True

    def summarise(self, s, c):
        n = len(s)
        sc = _few_events(n)
        if sc:
            return sc
        size = s["factor"].abs()
        if float(size.max() - size.min()) < EPSILON:
            return short("not_applicable_discrete_signal", n_events=n)
        rho = float(size.rank().corr(s["signed"].rank()))
        pv = spearman_p(rho, n)
        if math.isnan(rho) or math.isnan(pv):
            return short("degenerate_rank_variance", n=n, axis="events")
        z = math.atanh(rho) * math.sqrt(n - 3) if abs(rho) < 1.0 - 1e-10 and n > 3 else 0.0
        return MetricResult(rho, min(1.0, pv), "two-sided", n, "events", z, {"n_events": n, "stat_type": "z", "h0": "rho=0", "method": "Spearman rank correlation (|signal| vs signed return)"})


@dataclass(frozen=True)
class profit_factor(_FromSigned):
    """Sum of gains over sum of losses."""

    def summarise(self, s, c):
        n = len(s)
        sc = _few_events(n)
        if sc:
            return sc
        x = s["signed"].dropna().to_numpy(float)
        gains, losses = float(x[x > 0].sum()), abs(float(x[x < 0].sum()))
        none, free = gains <= EPSILON, losses <= EPSILON
        value, status = (float("nan"), "undefined_no_gains_or_losses") if none and free else (float("inf"), "unbounded_no_losses") if free else (gains / losses, "finite")
        return MetricResult(value, n_obs=n, n_obs_axis="events", metadata={"total_gains": gains, "total_losses": losses, "n_events": n, "n_wins": int((x > 0).sum()), "n_losses": int((x < 0).sum()), "no_gains": none, "no_losses": free, "profit_factor_status": status})


@dataclass(frozen=True)
class event_skewness(_FromSigned):
    """Bias-corrected skewness of signed returns."""

    def summarise(self, s, c):
        n = len(s)
        sc = _few_events(n)
        if sc:
            return sc
        x = s["signed"].to_numpy(float)
        d = x - x.mean()
        m2 = float((d**2).mean())
        raw = float((d**3).mean()) / m2**1.5 if m2 > 0 else float("nan")
        z, pv = skew_test(raw, n) if n >= 20 and not math.isnan(raw) else (None, None)
        meta = {"n_events": n} | ({"stat_type": "z", "h0": "skew=0", "method": "D'Agostino skew test"} if pv is not None else {})
        return MetricResult(raw * math.sqrt(n * (n - 1)) / (n - 2), pv, None if pv is None else "two-sided", n, "events", z, meta)


@dataclass(frozen=True)
class signal_density(_Event):
    """Mean bars per event over assets with at least two events."""

    def threshold(self, h):
        return Threshold()

    def source(self, panel, h):
        return panel.groupBy("factor_name", "asset_id").agg(F.count("date").alias("bars"), F.count(F.when(F.col("factor") != 0, 1)).alias("events")).where("events > 0")

    def summarise(self, s, c):
        n = int(s["events"].sum()) if len(s) else 0
        if n < 2:
            return short("insufficient_events", n=n, axis="events", min_required=2)
        s = s[s["events"] >= 2]
        if not len(s):
            return short("no_asset_has_min_two_events", n=n, axis="events", min_required_per_asset=2)
        gap = float((s["bars"] / s["events"]).mean())
        return MetricResult(gap, n_obs=n, n_obs_axis="events", metadata={"n_events_total": n, "n_assets_with_events": len(s), "mean_events_per_asset": float(s["events"].mean()), "mean_bars_between_events": gap})


@dataclass(frozen=True)
class event_around_return(_Event):
    """Returns at offsets around events; the value is the mean absolute return before them."""

    offsets: tuple[int, ...] = p.OFFSETS
    boundary_sensitive: ClassVar[bool] = True
    needs: ClassVar[tuple[str, ...]] = ("price",)

    def threshold(self, h):
        return Threshold()

    def source(self, panel, h):
        x = F.col("signed_return")
        quantile = lambda q: F.percentile(x, F.lit(q))
        return p.compute_event_returns(panel, self.offsets).groupBy("factor_name", "offset").agg(F.avg(x).alias("mean"), quantile(0.5).alias("median"), quantile(0.25).alias("p25"), quantile(0.75).alias("p75"), F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.count(F.lit(1)).alias("n"))

    def summarise(self, s, c):
        if not len(s):
            return short("no_price_data", descriptive=True, per_offset={})
        rows = {int(r.offset): r for r in s.itertuples()}
        each = {}
        for k in self.offsets:
            r = rows.get(k)
            n = int(r.n) if r is not None else 0
            each[k] = {"mean": None, "n": n} if n < 5 else {"mean": float(r.mean), "median": float(r.median), "p25": float(r.p25), "p75": float(r.p75), "hit_rate": float(r.hit_rate), "n": n}
        before = [abs(v["mean"]) for k, v in each.items() if k < 0 and v["mean"] is not None]
        return MetricResult(float(np.mean(before)) if before else 0.0, metadata={"per_offset": each, "interpretation": "mean size of the average return before an event; a large one hints at leaks of the event"})


def nearest(x: np.ndarray, q: float) -> float:
    return float(np.sort(x)[int(math.floor(q * (len(x) - 1) + 0.5))])


@dataclass(frozen=True)
class mfe_mae(_Event):
    """Median best excursion over the third quartile of the worst."""

    window: int = 20
    estimation_window: int = 60
    producer: ClassVar[str] = "compute_mfe_mae"
    boundary_sensitive: ClassVar[bool] = True
    needs: ClassVar[tuple[str, ...]] = ("price",)

    def producer_fields(self):
        return ("window", "estimation_window")

    def source(self, panel, h):
        return p.compute_mfe_mae(panel, self.window, self.estimation_window)

    def summarise(self, s, c):
        if not len(s):
            return short("no_price_data", mfe_mae_ratio=float("nan"), n_events=0)
        best, worst = (s[k].dropna().to_numpy(float) for k in ("mfe", "mae"))
        n = min(len(best), len(worst))
        sc = _few_events(n, n_events=n)
        if sc:
            return sc

        def ratio(a, b, tag):
            hi, lo = nearest(a, 0.5), nearest(b, 0.75)
            return {f"mfe{tag}_p50": hi, f"mae{tag}_p75": lo, f"mfe_mae_ratio{tag}": hi / abs(lo) if abs(lo) > EPSILON else 0.0}

        meta = ratio(best, worst, "") | {"n_events": n}
        bz, wz = (s[k].dropna().to_numpy(float) for k in ("mfe_z", "mae_z"))
        if min(len(bz), len(wz)) >= MIN_EVENTS:
            meta |= ratio(bz, wz, "_z") | {"n_events_z": min(len(bz), len(wz))}
        return MetricResult(meta["mfe_mae_ratio"], n_obs=n, n_obs_axis="events", metadata=meta)


@dataclass(frozen=True)
class clustering_hhi(_Event):
    """Concentration of events on dates."""

    cluster_window: int = 3
    cell: ClassVar[tuple] = (None, SPARSE, PANEL)
    aggregation: ClassVar[str] = "cs_snapshot"

    def source(self, panel, h):
        return p.events(panel).groupBy("factor_name", "date").agg(F.count(F.lit(1)).alias("events"))

    def summarise(self, s, c):
        n = int(s["events"].sum()) if len(s) else 0
        sc = _few_events(n)
        if sc:
            return sc
        share = s["events"].to_numpy(float) / n
        hhi, m = float((share**2).sum()), len(s)
        meta = {"n_events": n, "n_event_periods": m, "effective_n_periods": 1.0 / hhi, "hhi_normalized": (hhi - 1 / m) / (1 - 1 / m) if m > 1 else 0.0, "cluster_window": self.cluster_window}
        return MetricResult(hhi, n_obs=n, n_obs_axis="events", metadata=meta)


# --- common signals ----------------------------------------------------------------


class _FromBetas(Metric):
    cell = (COMMON, DENSE, PANEL)
    aggregation = "ts_then_cs"
    producer = "compute_common_betas"
    boundary_sensitive = True

    def source(self, panel, h):
        return p.compute_common_betas(panel)


def _lost_assets(s: pd.DataFrame, c: Context):
    return drops(c.n_assets, len(s), "per-asset history below 20, zero factor variation, or no complete pairs", "assets")


@dataclass(frozen=True)
class common_beta(_FromBetas):
    """Mean exposure across assets."""

    def threshold(self, h):
        return Threshold(min_assets=3)

    def summarise(self, s, c):
        x = values(s, "beta")
        if len(x) < 3:
            return short("insufficient_assets", n=len(x), axis="assets", min_required=3)
        t = st.mean_t(x)
        more, codes = _lost_assets(s, c)
        return MetricResult(float(x.mean()), st.t_p(t, len(x)), "two-sided", len(x), "assets", t, {"stat_type": "t", "h0": "mean(beta)=0", "method": "cross-sectional t-test on per-asset TS betas", "n_assets": len(x), "beta_std": float(x.std(ddof=1)), "median_beta": float(np.median(x)), **more}, tuple(codes))


@dataclass(frozen=True)
class common_beta_profile(_FromBetas):
    """Mean positive less mean negative exposure."""

    neutral_epsilon: float = EPSILON

    def threshold(self, h):
        return Threshold(min_assets=1)

    def summarise(self, s, c):
        if self.neutral_epsilon < 0:
            raise ValueError("neutral_epsilon must be non-negative")
        x = values(s, "beta")
        if not len(x):
            return short("no_asset_beta_observations", n=0, axis="assets", descriptive=True, min_required=1)
        up, down = x[x > self.neutral_epsilon], x[x < -self.neutral_epsilon]
        mean = lambda v: float(v.mean()) if len(v) else float("nan")
        gap = mean(up) - mean(down)
        more, codes = _lost_assets(s, c)
        meta = {"n_assets": len(x), "n_positive_beta": len(up), "n_negative_beta": len(down), "n_neutral_beta": len(x) - len(up) - len(down), "positive_beta_mean": mean(up), "negative_beta_mean": mean(down), "abs_beta_mean": float(np.abs(x).mean()), "beta_std": float(x.std(ddof=1)) if len(x) > 1 else float("nan"), "positive_minus_negative_beta_spread": gap, "neutral_epsilon": self.neutral_epsilon, "method": "descriptive per-asset beta sign and dispersion profile", **more}
        if math.isnan(gap):
            meta["spread_status"] = "requires_positive_and_negative_betas"
        return MetricResult(gap, n_obs=len(x), n_obs_axis="assets", metadata=meta, warning_codes=tuple(codes))


@dataclass(frozen=True)
class common_beta_r_squared(_FromBetas):
    """Mean fit of the per-asset regressions."""

    def threshold(self, h):
        return Threshold(min_assets=1)

    def summarise(self, s, c):
        x = values(s, "r_squared")
        if not len(x):
            return short("no_asset_r_squared_observations", n=0, axis="assets", min_required=1)
        more, codes = _lost_assets(s, c)
        return MetricResult(float(x.mean()), n_obs=len(x), n_obs_axis="assets", metadata={"n_assets": len(x), "median_r_squared": float(np.median(x)), "min_r_squared": float(x.min()), "max_r_squared": float(x.max()), **more}, warning_codes=tuple(codes))


@dataclass(frozen=True)
class common_beta_sign_consistency(_FromBetas):
    """Share of assets whose exposure has the more frequent sign."""

    def threshold(self, h):
        return Threshold(min_assets=2)

    def summarise(self, s, c):
        x = values(s, "beta")
        if len(x) < 2:
            return short("insufficient_assets_for_sign_consistency", n=len(x), axis="assets", min_required=2)
        up = float((x > 0).mean())
        more, codes = _lost_assets(s, c)
        return MetricResult(max(up, 1 - up), n_obs=len(x), n_obs_axis="assets", metadata={"n_assets": len(x), "fraction_positive": up, **more}, warning_codes=tuple(codes))


class _FromDateMeans(Metric):
    cell = (COMMON, DENSE, PANEL)
    producer = "per_date_means"
    needs = ("date", "factor", "forward_return")

    def threshold(self, h):
        return Threshold(min_periods=MIN_PORTFOLIO)

    def source(self, panel, h):
        return p.per_date_means(panel)


@dataclass(frozen=True)
class common_asymmetry(_FromDateMeans):
    """Sum of mean returns under positive and negative signals, and whether slopes differ by sign."""

    nw_lags: int | None = None

    def summarise(self, s, c):
        s = s.sort_values("date") if len(s) else s
        n = len(s)
        if n < MIN_PORTFOLIO:
            return short("insufficient_portfolio_periods", n=n, axis="periods", min_required=MIN_PORTFOLIO)
        f, r = s["f"].to_numpy(float), s["r"].to_numpy(float)
        up, down = f > 0, f < 0
        zero = ~(up | down)
        sides = {"n_pos": int(up.sum()), "n_neg": int(down.sum()), "n_zero": int(zero.sum()), "n_periods": n}
        if not sides["n_pos"] or not sides["n_neg"]:
            return short("no_two_sided_factor", **sides)
        lags = st.hac_lags(n, self.nw_lags, c.forward_periods)
        x = np.column_stack([up, down] + [zero] * bool(sides["n_zero"])).astype(float)
        beta, cov, _ = st.ols_hac(r, x, lags)
        both = np.zeros((1, x.shape[1]))
        both[0, :2] = 1.0
        value, variance = float(beta[0] + beta[1]), float((both @ cov @ both.T)[0, 0])
        _, pv = st.wald(beta, cov, both, n - x.shape[1])
        meta = {"stat_type": "wald (NW HAC)", "h0": "beta_long + beta_short = 0", "method": "method A: dummy regression on sign(factor)", "beta_long": float(beta[0]), "beta_short": float(beta[1]), "abs_short_over_long": abs(float(beta[1])) / abs(float(beta[0])) if beta[0] else float("nan"), **({"beta_zero": float(beta[2])} if sides["n_zero"] else {}), **sides, "nw_lags_used": lags}
        if min(len(np.unique(f[up])), len(np.unique(f[down]))) < 2:
            meta["method_b_skipped"] = "each side needs at least two distinct signal values"
        else:
            b, v, _ = st.ols_hac(r, np.column_stack([np.ones(n), np.where(up, f, 0.0), np.where(down, f, 0.0)]), lags)
            meta |= {"method_b": "split-slope regression on signed factor", "intercept": float(b[0]), "beta_pos": float(b[1]), "beta_neg": float(b[2]), "p_wald_slopes": st.wald(b, v, np.array([[0.0, 1.0, -1.0]]), n - 3)[1], "h0_method_b": "beta_pos = beta_neg"}
        return MetricResult(value, pv, "two-sided", n, "periods", value / math.sqrt(variance) if variance > 0 else 0.0, meta)


@dataclass(frozen=True)
class common_quantile_spread(_FromDateMeans):
    """Mean return of dates in the top less the bottom bucket of the signal."""

    n_groups: int = 5
    nw_lags: int | None = None

    def summarise(self, s, c):
        s = s.sort_values("date") if len(s) else s
        n, g = len(s), self.n_groups
        if n < MIN_PORTFOLIO:
            return short("insufficient_portfolio_periods", n=n, axis="periods", min_required=MIN_PORTFOLIO, n_groups=g)
        distinct = int(s["f"].nunique())
        if distinct < 2 * g:
            return short("insufficient_factor_variation", n_distinct=distinct, n_groups=g, n_periods=n)
        rank = s["f"].rank(method="first").to_numpy(int)
        bucket = np.minimum((rank - 1) * g // n, g - 1)
        lags = st.hac_lags(n, self.nw_lags, c.forward_periods)
        beta, cov, _ = st.ols_hac(s["r"].to_numpy(float), np.eye(g)[bucket], lags)
        ends = np.zeros((1, g))
        ends[0, 0], ends[0, -1] = -1.0, 1.0
        value, variance = float(beta[-1] - beta[0]), float((ends @ cov @ ends.T)[0, 0])
        _, pv = st.wald(beta, cov, ends, n - g)
        rho = float(pd.Series(beta).rank().corr(pd.Series(range(g)).rank())) if g >= 3 else float("nan")
        rho_p = spearman_p(rho, g) if g >= 3 else 1.0
        meta = {"stat_type": "wald (NW HAC)", "h0": "beta_top = beta_bottom", "method": "OLS on bucket dummies + Newey-West HAC", "spearman_rho": rho, "spearman_p": 1.0 if math.isnan(rho_p) else rho_p, "n_groups": g, "n_periods": n, "n_distinct_factor": distinct, "nw_lags_used": lags, "buckets": [{"idx": k, "mean_return": float(beta[k]), "n": int((bucket == k).sum())} for k in range(g)]}
        return MetricResult(value, pv, "two-sided", n, "periods", value / math.sqrt(variance) if variance >= EPSILON else 0.0, meta)


@dataclass(frozen=True)
class predictive_beta(Metric):
    """Slope of a single asset's return on its signal."""

    newey_west_lags: int | None = None
    adf_threshold: float | None = 0.1
    cell: ClassVar[tuple] = (None, DENSE, TIMESERIES)
    aggregation: ClassVar[str] = "ts_only"
    boundary_sensitive: ClassVar[bool] = True
    needs: ClassVar[tuple[str, ...]] = ("factor", "forward_return")

    def threshold(self, h):
        return Threshold(min_periods=st.MIN_PERIODS, warn_periods=st.WARN_PERIODS)

    def source(self, panel, h):
        return panel.where("factor is not null and forward_return is not null").select("factor_name", "date", "factor", "forward_return")

    def summarise(self, s, c):
        if self.adf_threshold is not None and not 0.0 < self.adf_threshold < 1.0:
            raise ValueError("adf_threshold must be in (0, 1) or None")
        s = s.sort_values("date") if len(s) else s
        n = len(s)
        if n < st.MIN_PERIODS:
            return short("insufficient_predictive_periods", n=n, axis="periods", min_required=st.MIN_PERIODS)
        x, y = s["factor"].to_numpy(float), s["forward_return"].to_numpy(float)
        std = float(x.std(ddof=1))
        if std < EPSILON:
            return short("degenerate_factor_variance", n=n, axis="periods", factor_std=std)
        lags = st.hac_lags(n, self.newey_west_lags, c.forward_periods)
        beta, t, pv, rest = st.slope_hac(y, x, lags)
        total = float(((y - y.mean()) ** 2).sum())
        meta = {"stat_type": "t", "h0": "beta=0", "method": "single-asset predictive regression + Newey-West", "n_periods": n, "newey_west_lags": lags, "forward_periods": c.forward_periods, "alpha": float(y.mean() - beta * x.mean()), "r_squared": 0.0 if total < EPSILON else max(0.0, 1 - float(rest @ rest) / total), "factor_std": std}
        codes = []
        if self.adf_threshold is not None:
            tau, adf_p = st.adf(x)
            meta |= {"adf_stat": tau, "adf_p": adf_p, "adf_threshold": self.adf_threshold, "unit_root_suspected": adf_p > self.adf_threshold}
            codes += ["persistent_regressor"] * (adf_p > self.adf_threshold)
        return MetricResult(beta, pv, "two-sided", n, "periods", t, meta, tuple(codes + ["unreliable_se_short_periods"] * (n < st.WARN_PERIODS)))
