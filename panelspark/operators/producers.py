"""Panel to series: one row per signal and date, asset or event, for all signals in one plan.

Inputs are long panels (``functions.panel.long_panel``).  Nothing here collects, and only
the count of ordered pairs runs Python on the executors; a date's or an asset's rows are
the largest unit that a window needs together.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import pair_counts
from ..functions.panel import BY_ASSET, BY_DATE, EPSILON, bucketed, dates, finite, mean_rank, moments, order_rank, rank_correlation, strided, tie_columns, together

MIN_IC_ASSETS, MIN_FM_ASSETS, MIN_COMMON_PERIODS, MIN_ROLLING_PAIRS = 2, 3, 20, 10
OFFSETS = (-6, -3, -1, 1, 6, 12, 24)
PAIR_COUNTS = ("raw_pairs", "correct", "incorrect", "factor_ties", "return_ties", "both_ties")


def _complete(panel: DataFrame, return_col: str) -> DataFrame:
    return panel.where(F.col("factor").isNotNull() & F.col(return_col).isNotNull())


def compute_ic(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Spearman correlation per date: ic, tie_ratio, n_assets.  A date where either side is constant has a null ic."""
    ranked = together(_complete(panel, return_col)).withColumn("rf", mean_rank("factor", BY_DATE)).withColumn("rr", mean_rank(return_col, BY_DATE))
    series = ranked.groupBy(*BY_DATE).agg(rank_correlation("rf", "rr").alias("ic"), (1 - F.countDistinct("factor") / F.count(F.lit(1))).alias("tie_ratio"), F.count(F.lit(1)).alias("n_assets"))
    return series.where(F.col("n_assets") >= MIN_IC_ASSETS)


def compute_fm_betas(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Slope of the return on the signal per date: beta, n_assets."""
    each = _complete(panel, return_col).groupBy(*BY_DATE).agg(*moments("factor", return_col))
    return each.where((F.col("n") >= MIN_FM_ASSETS) & (F.col("vx") > 0)).select(*BY_DATE, (F.col("cxy") / F.col("vx")).alias("beta"), F.col("n").alias("n_assets"))


def compute_common_betas(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Time-series regression per asset: beta, alpha, t_stat, r_squared, n_obs."""
    each = _complete(panel, return_col).groupBy(*BY_ASSET).agg(*moments("factor", return_col)).where((F.col("n") >= MIN_COMMON_PERIODS) & (F.col("vx") > EPSILON))
    n, dof = F.col("n"), F.col("n") - 2
    fitted = each.withColumn("beta", F.col("cxy") / F.col("vx")).withColumn("rest", F.greatest((n - 1) * (F.col("vy") - F.col("beta") * F.col("cxy")), F.lit(0.0)))
    fitted = fitted.withColumn("se", F.sqrt(F.col("rest") / dof / ((n - 1) * F.col("vx"))))
    total = (n - 1) * F.col("vy")
    return fitted.select(
        *BY_ASSET,
        "beta",
        (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"),
        F.when((F.col("rest") / dof > EPSILON) & (F.col("se") > EPSILON), F.try_divide("beta", "se")).otherwise(0.0).alias("t_stat"),
        F.when(total > EPSILON, 1 - F.try_divide(F.col("rest"), total)).otherwise(0.0).alias("r_squared"),
        n.alias("n_obs"),
    )


def _legs(n_groups: int, value: str):
    top, bottom = F.col("bucket") == n_groups - 1, F.col("bucket") == 0
    return F.avg(F.when(top, F.col(value))), F.avg(F.when(bottom, F.col(value)))


def compute_spread_series(panel: DataFrame, forward_periods: int = 5, n_groups: int = 5, return_col: str = "forward_return", tie_policy: str = "ordinal") -> DataFrame:
    """Top less bottom bucket per sampled date, with the legs, the universe mean and the date's counts.

    Where a date's signal is constant both legs are the universe and the spread is 0.
    """
    grouped = bucketed(strided(panel, forward_periods), n_groups, tie_policy)
    top, bottom = _legs(n_groups, return_col)
    each = grouped.groupBy(*BY_DATE).agg(
        top.alias("t"), bottom.alias("b"), F.avg(return_col).alias("universe_return"), F.countDistinct("factor").alias("distinct"), F.count("factor").alias("n_assets"), F.countDistinct("asset_id").alias("universe"), *tie_columns()
    )
    flat = (F.col("n_assets") > 0) & (F.col("distinct") <= 1)
    return each.select(
        *BY_DATE,
        F.when(flat, F.col("universe_return")).otherwise(F.col("t")).alias("top_return"),
        F.when(flat, F.col("universe_return")).otherwise(F.col("b")).alias("bottom_return"),
        "universe_return",
        F.when(flat, 0.0).otherwise(F.col("t") - F.col("b")).alias("spread"),
        flat.alias("zero_variance"),
        "n_assets",
        "universe",
        "n_rows",
        "n_unique",
    )


def compute_group_returns(panel: DataFrame, forward_periods: int = 5, n_groups: int = 5, return_col: str = "forward_return", tie_policy: str = "ordinal") -> DataFrame:
    """Mean return per bucket over all sampled rows."""
    grouped = bucketed(strided(panel, forward_periods), n_groups, tie_policy).where(F.col("bucket").isNotNull())
    return grouped.groupBy("factor_name", F.col("bucket").alias("group")).agg(F.avg(return_col).alias("mean_return"))


def weighted_spread_series(panel: DataFrame, forward_periods: int = 5, n_groups: int = 5, return_col: str = "forward_return", weight_col: str = "market_cap", tie_policy: str = "ordinal", lag_weights: bool = True) -> DataFrame:
    """Value-weighted top less bottom bucket per sampled date; weights are those of the asset's sampled date before."""
    sampled = strided(panel, forward_periods)
    if lag_weights:
        sampled = sampled.withColumn(weight_col, F.lag(weight_col).over(Window.partitionBy(*BY_ASSET).orderBy("date"))).where(F.col(weight_col).isNotNull())
    grouped = bucketed(sampled, n_groups, tie_policy).withColumn("_wr", F.col(return_col) * F.col(weight_col))

    def leg(group: int):
        own = F.col("bucket") == group
        return F.try_divide(F.sum(F.when(own, F.col("_wr"))), F.sum(F.when(own, F.col(weight_col))))

    each = grouped.groupBy(*BY_DATE).agg(leg(n_groups - 1).alias("top_return_vw"), leg(0).alias("bottom_return_vw"), F.count("factor").alias("n_assets"), F.countDistinct("factor").alias("distinct"), *tie_columns())
    flat = (F.col("n_assets") > 0) & (F.col("distinct") <= 1)
    return each.withColumn("spread_vw", F.when(flat, 0.0).otherwise(F.col("top_return_vw") - F.col("bottom_return_vw"))).withColumn("zero_variance", F.col("distinct") <= 1).drop("distinct")


def k_spread_series(panel: DataFrame, forward_periods: int = 5, k: int = 5, return_col: str = "forward_return") -> DataFrame:
    """Mean return of the k highest less the k lowest signals per sampled date, with the date's dispersion."""
    rows = together(_complete(strided(panel, forward_periods), return_col))
    ranked = rows.withColumn("_rank", order_rank("factor", BY_DATE, descending=True)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*BY_DATE)))
    each = ranked.groupBy(*BY_DATE).agg(
        F.avg(F.when(F.col("_rank") <= k, F.col(return_col))).alias("top"),
        F.avg(F.when(F.col("_rank") > F.col("_n") - k, F.col(return_col))).alias("bottom"),
        F.avg(return_col).alias("universe"),
        F.stddev_samp(return_col).alias("xs_dispersion"),
        F.count(F.lit(1)).alias("n_assets"),
        F.countDistinct("factor").alias("distinct"),
    )
    return each.select(*BY_DATE, F.col("top").alias("top_return"), F.col("bottom").alias("bottom_return"), (F.col("top") - F.col("bottom")).alias("spread"), "universe", "xs_dispersion", "n_assets", (F.col("distinct") <= 1).alias("zero_variance"))


def monotonicity_series(panel: DataFrame, forward_periods: int = 5, n_groups: int = 10, return_col: str = "forward_return", tie_policy: str = "ordinal") -> DataFrame:
    """Rank correlation of bucket means with the bucket number per sampled date; null where a bucket is empty or the means are all equal."""
    grouped = bucketed(strided(panel, forward_periods), n_groups, tie_policy)
    ties = grouped.groupBy(*BY_DATE).agg(*tie_columns())
    means = grouped.where(F.col("bucket").isNotNull()).groupBy(*BY_DATE, "bucket").agg(F.avg(return_col).alias("m")).where(finite(F.col("m")))
    ranked = means.withColumn("rm", mean_rank("m", BY_DATE)).withColumn("rb", F.col("bucket").cast("double"))
    rho = ranked.groupBy(*BY_DATE).agg(F.when(F.count(F.lit(1)) == n_groups, rank_correlation("rm", "rb")).alias("rho"))
    return ties.join(rho, list(BY_DATE), "left")


def concentration_series(panel: DataFrame, forward_periods: int = 5, q_top: float = 0.2, return_col: str = "forward_return", weight_by: str = "abs_factor") -> DataFrame:
    """Effective number of names among the top ``q_top`` by rank per sampled date: eff_n, n_top."""
    if weight_by not in ("abs_factor", "alpha_contribution"):
        raise ValueError(f"weight_by must be 'abs_factor' or 'alpha_contribution', got {weight_by!r}")
    sampled = together(strided(panel, forward_periods))
    raw = F.abs("factor") if weight_by == "abs_factor" else F.abs(F.signum("factor") * F.col(return_col))
    ranked = sampled.withColumn("_pct", mean_rank("factor", BY_DATE) / F.count(F.lit(1)).over(Window.partitionBy(*BY_DATE))).withColumn("_raw", raw)
    top = F.col("_pct") >= 1 - q_top
    ties = tie_columns()
    each = ranked.groupBy(*BY_DATE).agg(F.sum(F.when(top, F.col("_raw"))).alias("s"), F.sum(F.when(top, F.col("_raw") * F.col("_raw"))).alias("ss"), F.sum(F.when(top, 1).otherwise(0)).alias("n_top"), *ties)
    hhi = F.try_divide(F.col("ss"), F.col("s") * F.col("s"))
    return each.withColumn("eff_n", F.when(hhi > EPSILON, 1 / hhi)).drop("s", "ss")


def pair_accuracy_series(panel: DataFrame, forward_periods: int = 5, return_col: str = "forward_return") -> DataFrame:
    """Concordance of signal and return over all pairs of a sampled date, ties within 1e-9 left out.

    Pairs are never made: a date's cross-section of n rows goes to one Python group, in
    Arrow batches, and its six counts take n log n.  Rows without an order (not a
    number) drop out, as do dates of a single row.
    """
    x, y = F.col("factor"), F.col(return_col)
    rows = _complete(strided(panel, forward_periods), return_col).where(~F.isnan(x) & ~F.isnan(y)).select(*BY_DATE, x, y.alias("ret"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame()
        return pd.DataFrame([{"factor_name": key[0], "date": key[1], **pair_counts(pdf["factor"].to_numpy(float), pdf["ret"].to_numpy(float), EPSILON)}])

    date_type = panel.schema["date"].dataType.simpleString()
    return rows.groupBy(*BY_DATE).applyInPandas(count, f"factor_name string, date {date_type}, " + ", ".join(f"{c} long" for c in PAIR_COUNTS))


def directional_series(panel: DataFrame, forward_periods: int = 5, return_col: str = "forward_return") -> DataFrame:
    """Counts of rising signals, rising returns and agreement per sampled date, zeros left out."""
    x, y = F.signum("factor"), F.signum(return_col)
    rows = strided(panel, forward_periods).where((x != 0) & (y != 0))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(*BY_DATE).agg(F.count(F.lit(1)).alias("n"), count(x == y).alias("hits"), count(x > 0).alias("up_signal"), count(y > 0).alias("up_return"))


def rank_autocorrelation(panel: DataFrame, forward_periods: int = 1, quantile: float | None = None) -> DataFrame:
    """Correlation per sampled date of ranks with each asset's ranks on its sampled date before: rc, n_pair."""
    if quantile is not None and not 0.0 < quantile < 0.5:
        raise ValueError(f"quantile must be in (0, 0.5), got {quantile!r}")
    sampled = together(strided(panel, forward_periods)).withColumn("rank_now", mean_rank("factor", BY_DATE)).withColumn("n_now", F.count(F.lit(1)).over(Window.partitionBy(*BY_DATE)))
    before = Window.partitionBy(*BY_ASSET).orderBy("date")
    paired = sampled.withColumn("rank_was", F.lag("rank_now").over(before)).withColumn("n_was", F.lag("n_now").over(before)).where(F.col("rank_was").isNotNull())
    if quantile is not None:
        tail = lambda r, n: (F.col(r) <= F.col(n) * quantile) | (F.col(r) > F.col(n) * (1.0 - quantile))
        paired = paired.where(tail("rank_now", "n_now") | tail("rank_was", "n_was"))
    full = F.col("rank_now").isNotNull()
    return paired.groupBy(*BY_DATE).agg(F.count(F.lit(1)).alias("n_pair"), F.count(F.when(full, 1)).alias("n_full"), rank_correlation("rank_now", "rank_was").alias("rc")).where(F.col("rc").isNotNull()).drop("n_full")


def membership_turnover(panel: DataFrame, n_groups: int = 10, forward_periods: int = 1) -> DataFrame:
    """Share of the top and bottom buckets that was not in them on the sampled date before, averaged: turnover, n_top, n_bot."""
    if forward_periods < 1 or n_groups < 3:
        raise ValueError("forward_periods must be >= 1 and n_groups >= 3")
    sampled = strided(panel, forward_periods)
    previous = dates(sampled).select("date", F.lag("date").over(Window.orderBy("date")).alias("prev_date")).where("prev_date is not null")
    grouped = bucketed(sampled, n_groups).select(*BY_DATE, "asset_id", F.coalesce(F.col("bucket") == n_groups - 1, F.lit(False)).alias("is_top"), F.coalesce(F.col("bucket") == 0, F.lit(False)).alias("is_bot"))
    was = grouped.select("factor_name", F.col("date").alias("prev_date"), "asset_id", F.col("is_top").alias("was_top"), F.col("is_bot").alias("was_bot"))
    paired = grouped.join(F.broadcast(previous), "date").join(was, ["factor_name", "prev_date", "asset_id"], "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    each = paired.groupBy(*BY_DATE).agg(
        count(F.col("is_top")).alias("n_top"), count(F.col("is_top") & F.coalesce("was_top", F.lit(False))).alias("top_kept"), count(F.col("is_bot")).alias("n_bot"), count(F.col("is_bot") & F.coalesce("was_bot", F.lit(False))).alias("bot_kept")
    )
    return each.where("n_top > 0 and n_bot > 0").withColumn("turnover", (1 - F.col("top_kept") / F.col("n_top") + (1 - F.col("bot_kept") / F.col("n_bot"))) / 2)


# --- events --------------------------------------------------------------------


def events(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("factor") != 0)


def signed_returns(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Events with the return times the signal's sign."""
    return events(panel).select(*BY_DATE, "asset_id", "factor", (F.col(return_col) * F.signum("factor")).alias("signed"))


def compute_caar(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Mean of return times signal over a date's events, with the date's place on the whole calendar."""
    each = events(panel).groupBy(*BY_DATE).agg(F.avg(F.col(return_col) * F.col("factor")).alias("caar"), F.count(F.lit(1)).alias("n_events"))
    return each.join(dates(panel, ("factor_name",)), list(BY_DATE))


def compute_event_returns(panel: DataFrame, offsets=OFFSETS, price_col: str = "price") -> DataFrame:
    """Signed returns around events.

    For k > 0: from the bar after the event, over k bars; for k <= 0: of the one bar
    at offset k.  Rows without both prices, or with a base price near zero, are left out.
    """
    by = Window.partitionBy(*BY_ASSET).orderBy("date")
    at = lambda k: F.col(price_col) if k == 0 else (F.lead(price_col, k) if k > 0 else F.lag(price_col, -k)).over(by)
    ends = [(k, *((1, 1 + k) if k > 0 else (k - 1, k))) for k in offsets]
    needed = sorted({p for _, a, b in ends for p in (a, b)})
    priced = panel.select(*BY_ASSET, "date", "factor", *(at(p).alias(f"p{p}") for p in needed))
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("offset"), F.col(f"`p{a}`").alias("a"), F.col(f"`p{b}`").alias("b")) for k, a, b in ends)))
    rows = events(priced).select("factor_name", "date", "asset_id", "factor", each.alias("e")).where((F.col("e.a") >= EPSILON) & F.col("e.b").isNotNull())
    return rows.select("factor_name", "e.offset", "date", "asset_id", (F.signum("factor") * (F.col("e.b") / F.col("e.a") - 1)).alias("signed_return"))


def compute_mfe_mae(panel: DataFrame, window: int = 20, estimation_window: int = 60, min_estimation_periods: int = 20, price_col: str = "price") -> DataFrame:
    """Best and worst signed return over the bars after each event, and both in units of the volatility before it."""
    if min_estimation_periods < 2:
        raise ValueError(f"min_estimation_periods must be >= 2, got {min_estimation_periods}")
    by = Window.partitionBy(*BY_ASSET).orderBy("date")
    prior = F.lag(price_col).over(by)
    path = F.collect_list(F.coalesce(F.col(price_col), F.lit(float("nan")))).over(by.rowsBetween(1, window))
    returns = panel.withColumn("_safe", prior > EPSILON).withColumn("_ret", F.when(F.col("_safe"), F.col(price_col) / prior - 1))
    before = by.rowsBetween(-(estimation_window - 1), -1)  # returns among the prices before the event
    prices = F.count(F.lit(1)).over(by.rowsBetween(-estimation_window, -1))
    priced = returns.select(
        *BY_ASSET, "date", "factor", F.col(price_col).alias("entry"), path.alias("path"), prices.alias("n_prices"), F.count("_ret").over(before).alias("n_rets"), F.stddev_samp("_ret").over(before).alias("sd")
    )
    rows = events(priced).where((F.col("entry") >= EPSILON) & (F.size("path") > 0))
    side = F.signum("factor")
    rows = rows.withColumn("signed", F.transform("path", lambda p: side * (p / F.col("entry") - 1))).withColumn("mfe", F.array_max("signed")).withColumn("mae", F.array_min("signed"))
    sigma = F.when((F.col("n_prices") > min_estimation_periods) & (F.col("n_rets") >= min_estimation_periods), F.col("sd"))
    scale = sigma * F.sqrt(F.lit(float(window)))
    rows = rows.withColumn("est_sigma", sigma).withColumn("_scale", F.when(scale > EPSILON, scale))
    return rows.select(
        *BY_DATE,
        "asset_id",
        "mfe",
        "mae",
        F.try_divide("mfe", "_scale").alias("mfe_z"),
        F.try_divide("mae", "_scale").alias("mae_z"),
        "est_sigma",
        F.array_position("signed", F.col("mfe")).cast("int").alias("bars_to_mfe"),
        F.array_position("signed", F.col("mae")).cast("int").alias("bars_to_mae"),
    )


def standardized_events(panel: DataFrame, return_col: str = "forward_return", estimation_window: int = 60, forward_periods: int = 5, prediction_error: bool = False) -> DataFrame:
    """Events with their signed return over the asset's trailing volatility: sar is null where that is missing or near zero.

    Volatility is the rolling deviation of one-bar returns scaled to the horizon, or,
    without prices, of the returns themselves, lagged by the horizon.
    """
    by = Window.partitionBy(*BY_ASSET).orderBy("date")
    priced = "price" in panel.columns
    daily = panel.withColumn("_d", F.try_divide(F.col("price"), F.lag("price").over(by)) - 1 if priced else F.col(return_col))
    trailing = by.rowsBetween(-(estimation_window - 1), 0)
    vol = F.when(F.count("_d").over(trailing) >= 20, F.stddev_samp("_d").over(trailing))
    factor = (1.0 / forward_periods**0.5 if priced else 1.0) * ((1.0 + 1.0 / estimation_window) ** 0.5 if prediction_error else 1.0)
    daily = daily.withColumn("_v", vol * factor)
    if not priced:
        daily = daily.withColumn("_v", F.lag("_v", forward_periods).over(by))
    signed = F.col(return_col) * F.signum("factor")
    return events(daily).select(*BY_DATE, "asset_id", F.when(F.col("_v") > EPSILON, signed / F.when(F.col("_v") > EPSILON, F.col("_v"))).alias("sar"))


def rank_scores(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Each return's average rank within its asset, over count + 1, less a half."""
    own = mean_rank(return_col, BY_ASSET)
    return panel.select(*BY_DATE, "asset_id", "factor", (own / (F.count(return_col).over(Window.partitionBy(*BY_ASSET)) + 1) - 0.5).alias("u"))


# --- one value per date or a single asset ----------------------------------------


def per_date_means(panel: DataFrame, return_col: str = "forward_return") -> DataFrame:
    """Mean signal and mean return by date, dates with both."""
    return panel.groupBy(*BY_DATE).agg(F.avg("factor").alias("f"), F.avg(return_col).alias("r")).where("f is not null and r is not null")


def compute_rolling_common_beta(panel: DataFrame, window: int = 60, return_col: str = "forward_return") -> DataFrame:
    """Mean over assets of the slope on the ``window`` dates before each date (not that date itself), assets with at least ten pairs.

    Each row is added to the windows it belongs to as sums, so an asset's windows cost
    one range frame; an asset constant within a window has slope 0.
    """
    calendar = dates(panel, ("factor_name",))
    rows = _complete(panel, return_col).join(calendar, list(BY_DATE))
    x, y = F.col("factor"), F.col(return_col)
    assets = rows.select(*BY_ASSET).distinct()
    grid = calendar.where(F.col("date_ordinal") >= window).join(assets, "factor_name")
    both = rows.select(*BY_ASSET, "date_ordinal", x.alias("x"), y.alias("y"), F.lit(0).alias("ask")).unionByName(grid.select(*BY_ASSET, "date_ordinal", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("ask")))
    span = Window.partitionBy(*BY_ASSET).orderBy("date_ordinal").rangeBetween(-window, -1)
    found = both.select(*BY_ASSET, "date_ordinal", "ask", F.count("x").over(span).alias("n"), F.covar_samp("x", "y").over(span).alias("c"), F.var_samp("x").over(span).alias("v")).where((F.col("ask") == 1) & (F.col("n") >= MIN_ROLLING_PAIRS))
    beta = F.when(F.col("v") > 0, F.col("c") / F.when(F.col("v") > 0, F.col("v"))).otherwise(0.0)
    return found.groupBy("factor_name", "date_ordinal").agg(F.avg(beta).alias("value")).join(calendar, ["factor_name", "date_ordinal"]).select("factor_name", "date", "value")


def cluster_scores(panel: DataFrame, clusters: list[str], return_col: str = "forward_return", summed: bool = False) -> DataFrame:
    """Pooled regression by moments, then sums of residual scores per cluster: one row per signal and cluster.

    ``summed`` adds up the products of the scores over clusters as well, so that one row
    per axis leaves (g clusters, m00, m01, m11), however fine the clusters are.  Every
    row carries the pooled moments.
    """
    rows = _complete(panel, return_col)
    pooled = rows.groupBy("factor_name").agg(*moments("factor", return_col), F.sum("factor").alias("sx"), F.sum(F.col("factor") * F.col("factor")).alias("sxx"))
    pooled = pooled.withColumn("slope", F.when(F.col("vx") > 0, F.col("cxy") / F.when(F.col("vx") > 0, F.col("vx"))).otherwise(0.0)).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    resid = rows.join(F.broadcast(pooled), "factor_name").withColumn("e", F.col(return_col) - F.col("intercept") - F.col("slope") * F.col("factor"))
    whole = ["n", "sx", "sxx", "slope"]
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    parts = []
    for axis, keys in [(c, [c]) for c in clusters] + ([("both", clusters)] if len(clusters) > 1 else []):
        each = resid.groupBy("factor_name", *keys).agg(F.sum("e").alias("s0"), F.sum(F.col("e") * F.col("factor")).alias("s1"), *(F.first(w).alias(w) for w in whole))
        if summed:
            each = each.groupBy("factor_name").agg(F.count(F.lit(1)).alias("g"), product("s0", "s0").alias("m00"), product("s0", "s1").alias("m01"), product("s1", "s1").alias("m11"), *(F.first(w).alias(w) for w in whole))
            parts.append(each.select("factor_name", F.lit(axis).alias("axis"), "g", "m00", "m01", "m11", *whole))
        else:
            parts.append(each.select("factor_name", F.lit(axis).alias("axis"), F.col(keys[0]).cast("string").alias("cluster"), "s0", "s1", *whole))
    return reduce(DataFrame.unionByName, parts)
