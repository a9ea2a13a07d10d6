"""All queries of the engine, with SQL equivalents over the same tables where SQL can say it.

Doubles are rounded to nine places on both sides: sums of doubles depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel import bucketed, dates, long_panel, strided
from ..operators import metrics as m
from ..operators import preprocess as pre
from ..operators import producers as p
from ..sources import datasets, testdata
from ..sources.adapt import adapt as adapt_columns
from . import evaluate as ev
from . import families, slicing
from .results import FRAME_SCHEMA, number

H = 3
PLACES = 9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c), PLACES).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def _months(spark, sf_dir) -> DataFrame:
    return pre.compute_forward_return(testdata.supplier_months(spark, sf_dir), H, check=False).drop(pre.HORIZON)


def _long(spark, sf_dir) -> DataFrame:
    return long_panel(_months(spark, sf_dir), ["factor", "factor2"])


def _common(spark, sf_dir) -> DataFrame:
    return long_panel(pre.compute_forward_return(testdata.common_months(spark, sf_dir), H, check=False).drop(pre.HORIZON), ["factor"])


def _events(spark, sf_dir) -> DataFrame:
    return long_panel(pre.compute_forward_return(testdata.user_days(spark, sf_dir), 2, check=False).drop(pre.HORIZON), ["factor"])


def _measured(spark, panel: DataFrame, h: int, **metrics: m.Metric) -> DataFrame:
    """Value, statistic and number of observations that the metrics themselves report, by signal."""
    found = ev.run_metrics(panel, metrics, ev.facts(panel, h), h)
    rows = [(f, label, number(r.value), None if r.stat is None else round(float(r.stat), 6), r.n_obs) for (f, label), r in found.items()]
    return spark.createDataFrame(rows, "factor_name string, metric string, value double, stat double, n_obs long")


# --- SQL parts -------------------------------------------------------------------

P1 = """lines AS (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS date, l_suppkey AS asset_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS c,
  CAST(round(l_quantity) AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem),
p1 AS (SELECT date, asset_id, CAST(sum(c) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS price, CAST(sum(d) AS DOUBLE) / count(*) AS factor, CAST(sum(t) AS DOUBLE) / count(*) AS factor2, CAST(sum(c) AS DOUBLE) AS market_cap FROM lines GROUP BY ALL)"""


def _returns(source: str, target: str, h: int) -> str:
    return f"""{target} AS (SELECT * FROM (SELECT *, (lead(price, {h + 1}) OVER w / nullif(lead(price, 1) OVER w, 0) - 1) / {h} AS forward_return FROM {source} WINDOW w AS (PARTITION BY asset_id ORDER BY date)) WHERE isfinite(forward_return))"""


FR = f"WITH {P1}, {_returns('p1', 'fr', H)}"
LONG = FR + """, panel AS (SELECT 'factor' AS factor_name, factor, date, asset_id, price, market_cap, forward_return FROM fr UNION ALL SELECT 'factor2', factor2, date, asset_id, price, market_cap, forward_return FROM fr)"""
STRIDE = """, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_ordinal FROM (SELECT DISTINCT date FROM panel)),
sampled AS (SELECT panel.* FROM panel JOIN cal USING (date) WHERE date_ordinal % {h} = 0)"""
S3 = LONG + STRIDE.format(h=H)
BUCKETS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY factor_name, date ORDER BY factor, asset_id) AS rk, count(factor) OVER (PARTITION BY factor_name, date) AS n FROM sampled),
bucketed AS (SELECT *, CAST(least(floor((rk - 1) * {g} / n), {g} - 1) AS INTEGER) AS bucket FROM ranked)"""
AVG_RANK = "(rank() OVER (PARTITION BY factor_name, date ORDER BY {x}) + (count(*) OVER (PARTITION BY factor_name, date, {x}) - 1) / 2.0)"
CORR = "CASE WHEN {n} * sum({a} * {a}) - sum({a}) * sum({a}) > 0 AND {n} * sum({b} * {b}) - sum({b}) * sum({b}) > 0 THEN ({n} * sum({a} * {b}) - sum({a}) * sum({b})) / sqrt(({n} * sum({a} * {a}) - sum({a}) * sum({a})) * ({n} * sum({b} * {b}) - sum({b}) * sum({b}))) END"
RHO = CORR.format(n="CAST(count(*) AS DOUBLE)", a="rf", b="rr")
IC = LONG + f""", ranks AS (SELECT factor_name, date, factor, {AVG_RANK.format(x='factor')} AS rf, {AVG_RANK.format(x='forward_return')} AS rr FROM panel),
ic AS (SELECT factor_name, date, {RHO} AS ic, 1 - count(DISTINCT factor) / count(*) AS tie_ratio, count(*) AS n_assets FROM ranks GROUP BY ALL HAVING count(*) >= 2)"""
P2 = f"""WITH {P1}, months AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY ALL),
change AS (SELECT * FROM (SELECT date, CAST(c - lag(c) OVER (ORDER BY date) AS DOUBLE) / 1e8 AS factor FROM months) WHERE factor IS NOT NULL),
p2 AS (SELECT p1.date, asset_id, price, market_cap, change.factor FROM p1 JOIN change USING (date)), {_returns('p2', 'fr2', H)}, panel AS (SELECT 'factor' AS factor_name, * FROM fr2)"""
P4 = f"""WITH ev AS (SELECT strftime(ts, '%Y-%m-%d') AS date, user_id AS asset_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events),
days AS (SELECT date, asset_id, CAST(sum(CASE WHEN v > 7500 AND event_type = 'purchase' THEN 1 WHEN v > 7500 AND event_type = 'error' THEN -1 ELSE 0 END) AS DOUBLE) AS factor, sum(v) AS v FROM ev GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT date FROM ev) CROSS JOIN (SELECT DISTINCT asset_id FROM ev)),
full_days AS (SELECT date, asset_id, coalesce(factor, 0.0) AS factor, coalesce(v, 0) AS v FROM grid LEFT JOIN days USING (date, asset_id)),
p4 AS (SELECT date, asset_id, factor, 100.0::DOUBLE + CAST(sum(v) OVER (PARTITION BY asset_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 10000.0::DOUBLE AS price FROM full_days), {_returns('p4', 'fr4', 2)}, panel AS (SELECT 'factor' AS factor_name, * FROM fr4)"""


def _r(*columns: str) -> str:
    """Columns, doubles written as ``~name`` rounded."""
    return ", ".join(f"round({c[1:]}, {PLACES}) AS {c[1:]}" if c[0] == "~" else c for c in columns)


# --- preparation -------------------------------------------------------------------


@query(FR + f" SELECT date, asset_id, round(price, 4) AS price, {_r('~factor', '~forward_return')} FROM fr")
def forward_return(spark, sf_dir):
    return _months(spark, sf_dir).select("date", "asset_id", F.round("price", 4).alias("price"), "factor", "forward_return")


@query(FR + f""", sorted AS (SELECT date, list_sort(list(forward_return)) AS v FROM fr GROUP BY date),
bounds AS (SELECT date, v[CAST(floor(0.05 * (len(v) - 1) + 0.5) AS INTEGER) + 1] AS lo, v[CAST(floor(0.95 * (len(v) - 1) + 0.5) AS INTEGER) + 1] AS hi FROM sorted)
SELECT date, asset_id, round(greatest(least(forward_return, hi), lo), {PLACES}) AS forward_return FROM fr JOIN bounds USING (date)""")
def winsorize_forward_return(spark, sf_dir):
    return pre.winsorize_forward_return(_months(spark, sf_dir), 0.05, 0.95).select("date", "asset_id", "forward_return")


@query(FR + f" SELECT date, asset_id, round(forward_return - avg(forward_return) OVER (PARTITION BY date), {PLACES}) AS abnormal_return FROM fr")
def abnormal_return(spark, sf_dir):
    return pre.compute_abnormal_return(_months(spark, sf_dir)).select("date", "asset_id", "abnormal_return")


_MAD = FR + """, med AS (SELECT date, median(factor) AS md FROM fr GROUP BY date), mad AS (SELECT date, any_value(md) AS md, 1.4826::DOUBLE * median(abs(factor - md)) AS sd FROM fr JOIN med USING (date) GROUP BY date)"""


@query(_MAD + f" SELECT date, asset_id, round(greatest(least(factor, md + 2 * sd), md - 2 * sd), {PLACES}) AS factor FROM fr JOIN mad USING (date)")
def mad_winsorize(spark, sf_dir):
    return pre.mad_winsorize(_months(spark, sf_dir), n_mad=2.0).select("date", "asset_id", "factor")


@query(_MAD + f" SELECT date, asset_id, round(CASE WHEN sd > 0 THEN (factor - md) / sd WHEN factor > md THEN CAST('inf' AS DOUBLE) WHEN factor < md THEN CAST('-inf' AS DOUBLE) ELSE 0 END, {PLACES}) AS factor_zscore FROM fr JOIN mad USING (date)")
def cross_sectional_zscore(spark, sf_dir):
    return pre.cross_sectional_zscore(_months(spark, sf_dir)).select("date", "asset_id", "factor_zscore")


@query(FR + f""", mo AS (SELECT date, avg(factor) AS my, avg(factor2) AS mx, CASE WHEN var_samp(factor2) > 0 THEN covar_samp(factor, factor2) / var_samp(factor2) ELSE 0 END AS b FROM fr GROUP BY date HAVING count(*) > 1)
SELECT date, asset_id, round(factor - my - b * (factor2 - mx), 6) + 0.0 AS residual FROM fr JOIN mo USING (date)""")
def orthogonalize_factor(spark, sf_dir):
    panel = _months(spark, sf_dir)
    out = pre.orthogonalize_factor(panel.select("date", "asset_id", "factor"), panel.select("date", "asset_id", "factor2")).data
    return out.select("date", "asset_id", (F.round("factor", 6) + F.lit(0.0)).alias("residual"))


@query(S3 + f" SELECT factor_name, date, asset_id, {_r('~factor')} FROM sampled")
def stride_sample(spark, sf_dir):
    return strided(_long(spark, sf_dir), H).select("factor_name", "date", "asset_id", "factor")


@query(LONG + ", cal AS (SELECT DISTINCT date FROM panel) SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS date_ordinal FROM cal")
def date_ordinals(spark, sf_dir):
    return dates(_long(spark, sf_dir))


@query(S3 + BUCKETS.format(g=5) + " SELECT factor_name, date, asset_id, bucket FROM bucketed")
def quantile_buckets(spark, sf_dir):
    return bucketed(strided(_long(spark, sf_dir), H), 5).select("factor_name", "date", "asset_id", "bucket")


@query("SELECT l_shipdate AS date, l_suppkey AS asset_id, l_extendedprice AS price, l_quantity AS volume FROM lineitem")
def adapt(spark, sf_dir):
    rows = testdata.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey", "l_extendedprice", "l_quantity")
    return adapt_columns(rows, date="l_shipdate", asset_id="l_suppkey", price="l_extendedprice", volume="l_quantity")


# --- series ------------------------------------------------------------------------


@query(IC + f" SELECT factor_name, date, {_r('~ic', '~tie_ratio')}, n_assets FROM ic")
def ic_per_date(spark, sf_dir):
    return p.compute_ic(_long(spark, sf_dir))


@query(IC + f""", x AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY date) - 1 AS i FROM ic WHERE ic IS NOT NULL)
SELECT factor_name, 'ic' AS metric, round(avg(ic), {PLACES}) AS value, round(avg(ic) FILTER (i % {H} = 0) / (stddev_samp(ic) FILTER (i % {H} = 0) / sqrt(count(ic) FILTER (i % {H} = 0))), 6) AS stat, count(*) AS n_obs FROM x GROUP BY ALL
UNION ALL SELECT factor_name, 'ic_ir', round(avg(ic) / stddev_samp(ic), {PLACES}), NULL, count(*) FROM x GROUP BY ALL""")
def ic_summary(spark, sf_dir):
    return _measured(spark, _long(spark, sf_dir), H, ic=m.ic(), ic_ir=m.ic_ir())


@query(IC + f""", x AS (SELECT factor_name, ic - avg(ic) OVER (PARTITION BY factor_name) AS d, ic, row_number() OVER (PARTITION BY factor_name ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_name) AS n FROM ic WHERE ic IS NOT NULL),
l AS (SELECT factor_name, any_value(n) AS n, greatest(1, greatest(2, CAST(floor(4 * pow(any_value(n) / 100.0, 2 / 9.0)) AS INTEGER))) AS lags, avg(ic) AS mean_ic FROM x GROUP BY ALL),
g AS (SELECT a.factor_name, sum(a.d * b.d * CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (b.i - a.i) / (lags + 1.0)) END) / any_value(l.n) AS v FROM x a JOIN l ON a.factor_name = l.factor_name JOIN x b ON a.factor_name = b.factor_name AND b.i BETWEEN a.i AND a.i + lags GROUP BY ALL)
SELECT factor_name, 'ic' AS metric, round(mean_ic, {PLACES}) AS value, round(mean_ic / sqrt(greatest(v, 0) / n), 6) AS stat, n AS n_obs FROM l JOIN g USING (factor_name)""")
def newey_west_ic(spark, sf_dir):
    return _measured(spark, _long(spark, sf_dir), H, ic=m.ic(inference=m.NEWEY_WEST))


@query(LONG + f", b AS (SELECT factor_name, date, covar_samp(factor, forward_return) / nullif(var_samp(factor), 0) AS beta, count(*) AS n_assets FROM panel GROUP BY ALL HAVING count(*) >= 3 AND var_samp(factor) > 0) SELECT factor_name, date, {_r('~beta')}, n_assets FROM b")
def fm_beta_series(spark, sf_dir):
    return p.compute_fm_betas(_long(spark, sf_dir))


@query(P2 + f""", mo AS (SELECT factor_name, asset_id, count(*) AS n, avg(factor) AS mx, avg(forward_return) AS my, var_samp(factor) AS vx, var_samp(forward_return) AS vy, covar_samp(factor, forward_return) AS cxy FROM panel GROUP BY ALL HAVING count(*) >= 20 AND var_samp(factor) > 1e-9),
f AS (SELECT *, cxy / vx AS beta, greatest((n - 1) * (vy - cxy / vx * cxy), 0) AS rest FROM mo), g AS (SELECT *, sqrt(rest / (n - 2) / ((n - 1) * vx)) AS se FROM f)
SELECT factor_name, asset_id, round(beta, 9) AS beta, round(my - beta * mx, 9) AS alpha, round(CASE WHEN rest / (n - 2) > 1e-9 AND se > 1e-9 THEN beta / se ELSE 0 END, 9) AS t_stat, round(CASE WHEN (n - 1) * vy > 1e-9 THEN 1 - rest / ((n - 1) * vy) ELSE 0 END, 9) AS r_squared, n AS n_obs FROM g""")
def common_betas(spark, sf_dir):
    return p.compute_common_betas(_common(spark, sf_dir))


_SPREAD = S3 + BUCKETS.format(g=5) + """, s AS (SELECT factor_name, date, avg(forward_return) FILTER (bucket = 4) AS t, avg(forward_return) FILTER (bucket = 0) AS b, avg(forward_return) AS universe_return, count(DISTINCT factor) AS k, count(factor) AS n_assets FROM bucketed GROUP BY ALL),
spread AS (SELECT factor_name, date, CASE WHEN k <= 1 THEN universe_return ELSE t END AS top_return, CASE WHEN k <= 1 THEN universe_return ELSE b END AS bottom_return, universe_return, CASE WHEN k <= 1 THEN 0.0::DOUBLE ELSE t - b END AS spread, n_assets FROM s)"""


@query(_SPREAD + f" SELECT factor_name, date, {_r('~top_return', '~bottom_return', '~universe_return', '~spread')}, n_assets FROM spread")
def spread_series(spark, sf_dir):
    return p.compute_spread_series(_long(spark, sf_dir), H, 5).drop("zero_variance", "universe", "n_rows", "n_unique")


@query(S3 + BUCKETS.format(g=5) + f' SELECT factor_name, bucket AS "group", round(avg(forward_return), {PLACES}) AS mean_return FROM bucketed GROUP BY ALL')
def group_returns(spark, sf_dir):
    return p.compute_group_returns(_long(spark, sf_dir), H, 5)


@query(LONG + STRIDE.format(h=H).replace("sampled AS", "sampled0 AS") + """, lagged AS (SELECT * EXCLUDE (market_cap), lag(market_cap) OVER (PARTITION BY factor_name, asset_id ORDER BY date) AS market_cap FROM sampled0), sampled AS (SELECT * FROM lagged WHERE market_cap IS NOT NULL)""" + BUCKETS.format(g=5) + f""", v AS (SELECT factor_name, date, count(DISTINCT factor) AS k, sum(forward_return * market_cap) FILTER (bucket = 4) / sum(market_cap) FILTER (bucket = 4) AS top_return_vw, sum(forward_return * market_cap) FILTER (bucket = 0) / sum(market_cap) FILTER (bucket = 0) AS bottom_return_vw FROM bucketed GROUP BY ALL)
SELECT factor_name, date, {_r('~top_return_vw', '~bottom_return_vw')}, round(CASE WHEN k <= 1 THEN 0 ELSE top_return_vw - bottom_return_vw END, {PLACES}) AS spread_vw FROM v""")
def spread_series_vw(spark, sf_dir):
    return p.weighted_spread_series(_long(spark, sf_dir), H, 5).select("factor_name", "date", "top_return_vw", "bottom_return_vw", "spread_vw")


@query(S3 + f""", k AS (SELECT *, row_number() OVER (PARTITION BY factor_name, date ORDER BY factor DESC, asset_id) AS rk, count(*) OVER (PARTITION BY factor_name, date) AS n FROM sampled),
s AS (SELECT factor_name, date, avg(forward_return) FILTER (rk <= 5) AS top_return, avg(forward_return) FILTER (rk > n - 5) AS bottom_return, stddev_samp(forward_return) AS xs_dispersion, count(*) AS n_assets FROM k GROUP BY ALL)
SELECT factor_name, date, {_r('~top_return', '~bottom_return', '~xs_dispersion')}, round(top_return - bottom_return, {PLACES}) AS spread, n_assets FROM s""")
def k_spread_series(spark, sf_dir):
    return p.k_spread_series(_long(spark, sf_dir), H, 5).drop("universe", "zero_variance")


@query(S3 + BUCKETS.format(g=5) + f""", means AS (SELECT factor_name, date, bucket, avg(forward_return) AS mm FROM bucketed GROUP BY ALL), rm AS (SELECT factor_name, date, CAST(bucket AS DOUBLE) AS rr, {AVG_RANK.format(x='mm')} AS rf FROM means)
SELECT factor_name, date, round(CASE WHEN count(*) = 5 THEN {RHO} END, {PLACES}) AS rho FROM rm GROUP BY ALL""")
def monotonicity_series(spark, sf_dir):
    return p.monotonicity_series(_long(spark, sf_dir), H, 5).select("factor_name", "date", "rho")


@query(S3 + f""", pct AS (SELECT *, {AVG_RANK.format(x='factor')} / count(*) OVER (PARTITION BY factor_name, date) AS pr FROM sampled), top AS (SELECT * FROM pct WHERE pr >= 1 - 0.2::DOUBLE),
c AS (SELECT factor_name, date, sum(abs(factor) * abs(factor)) / (sum(abs(factor)) * sum(abs(factor))) AS hhi, count(*) AS n_top FROM top GROUP BY ALL) SELECT factor_name, date, round(1 / hhi, {PLACES}) AS eff_n, n_top FROM c WHERE hhi > 1e-9""")
def concentration_series(spark, sf_dir):
    return p.concentration_series(_long(spark, sf_dir), H).where("eff_n is not null").select("factor_name", "date", "eff_n", "n_top")


@query(S3 + """, pairs AS (SELECT a.factor_name, a.date, a.factor - b.factor AS df, a.forward_return - b.forward_return AS dr FROM sampled a JOIN sampled b ON a.factor_name = b.factor_name AND a.date = b.date AND a.asset_id < b.asset_id)
SELECT factor_name, date, count(*) AS raw_pairs, count(*) FILTER (abs(df) > 1e-9 AND abs(dr) > 1e-9 AND df * dr > 0) AS correct, count(*) FILTER (abs(df) > 1e-9 AND abs(dr) > 1e-9 AND df * dr < 0) AS incorrect, count(*) FILTER (abs(df) <= 1e-9) AS factor_ties, count(*) FILTER (abs(dr) <= 1e-9) AS return_ties, count(*) FILTER (abs(df) <= 1e-9 AND abs(dr) <= 1e-9) AS both_ties FROM pairs GROUP BY ALL""")
def pair_accuracy_series(spark, sf_dir):
    return p.pair_accuracy_series(_long(spark, sf_dir), H)


@query(S3 + " SELECT factor_name, date, count(*) AS n, count(*) FILTER (sign(factor) = sign(forward_return)) AS hits, count(*) FILTER (factor > 0) AS up_signal, count(*) FILTER (forward_return > 0) AS up_return FROM sampled WHERE factor <> 0 AND forward_return <> 0 GROUP BY ALL")
def directional_series(spark, sf_dir):
    return p.directional_series(_long(spark, sf_dir), H)


@query(S3 + f""", rk AS (SELECT factor_name, date, asset_id, {AVG_RANK.format(x='factor')} AS rf FROM sampled), both_ranks AS (SELECT *, lag(rf) OVER (PARTITION BY factor_name, asset_id ORDER BY date) AS rr FROM rk),
rc AS (SELECT factor_name, date, count(*) AS n_pair, {RHO} AS rc FROM both_ranks WHERE rr IS NOT NULL GROUP BY ALL) SELECT factor_name, date, n_pair, {_r('~rc')} FROM rc WHERE rc IS NOT NULL""")
def rank_autocorrelation(spark, sf_dir):
    return p.rank_autocorrelation(_long(spark, sf_dir), H)


@query(S3 + BUCKETS.format(g=5) + f""", days AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM sampled)),
j AS (SELECT a.factor_name, a.date, a.bucket = 4 AS is_top, a.bucket = 0 AS is_bot, coalesce(b.bucket = 4, false) AS was_top, coalesce(b.bucket = 0, false) AS was_bot FROM bucketed a JOIN days ON a.date = days.date AND prev IS NOT NULL LEFT JOIN bucketed b ON b.factor_name = a.factor_name AND b.asset_id = a.asset_id AND b.date = prev),
t AS (SELECT factor_name, date, count(*) FILTER (is_top) AS n_top, count(*) FILTER (is_top AND was_top) AS top_kept, count(*) FILTER (is_bot) AS n_bot, count(*) FILTER (is_bot AND was_bot) AS bot_kept FROM j GROUP BY ALL)
SELECT *, round((1 - top_kept / n_top + (1 - bot_kept / n_bot)) / 2, {PLACES}) AS turnover FROM t WHERE n_top > 0 AND n_bot > 0""")
def notional_turnover_series(spark, sf_dir):
    return p.membership_turnover(_long(spark, sf_dir), 5, H)


# --- events ----------------------------------------------------------------------


@query(P4 + f""", cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS date_ordinal FROM (SELECT DISTINCT date FROM panel)), c AS (SELECT factor_name, date, avg(forward_return * factor) AS caar, count(*) AS n_events FROM panel WHERE factor <> 0 GROUP BY ALL)
SELECT factor_name, date, {_r('~caar')}, n_events, date_ordinal FROM c JOIN cal USING (date)""")
def caar_series(spark, sf_dir):
    return p.compute_caar(_events(spark, sf_dir))


_ENDS = [(k, *((1, 1 + k) if k > 0 else (k - 1, k))) for k in p.OFFSETS]


def _at(k: int) -> str:
    return "price" if k == 0 else f"{'lead' if k > 0 else 'lag'}(price, {abs(k)}) OVER w"


@query(P4 + ", px AS (SELECT factor_name, date, asset_id, factor, " + ", ".join(f"{_at(a)} AS a{i}, {_at(b)} AS b{i}" for i, (_, a, b) in enumerate(_ENDS)) + " FROM panel WINDOW w AS (PARTITION BY factor_name, asset_id ORDER BY date)), e AS (" + " UNION ALL ".join(f"SELECT factor_name, CAST({k} AS INTEGER) AS \"offset\", date, asset_id, sign(factor) * (b{i} / a{i} - 1) AS signed_return FROM px WHERE factor <> 0 AND a{i} >= 1e-9 AND b{i} IS NOT NULL" for i, (k, _, _) in enumerate(_ENDS)) + f') SELECT factor_name, "offset", date, asset_id, {_r("~signed_return")} FROM e')
def event_returns(spark, sf_dir):
    return p.compute_event_returns(_events(spark, sf_dir))


@query(P4 + f""", r AS (SELECT *, lag(price) OVER w AS prior FROM panel WINDOW w AS (PARTITION BY asset_id ORDER BY date)), d AS (SELECT *, CASE WHEN prior > 1e-9 THEN price / prior - 1 END AS ret FROM r),
x AS (SELECT factor_name, date, asset_id, factor, price AS entry, list(price) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS path, count(*) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS np, count(ret) OVER w2 AS nr, stddev_samp(ret) OVER w2 AS sd FROM d WINDOW w2 AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, list_transform(path, lambda q: sign(factor) * (q / entry - 1)) AS s FROM x WHERE factor <> 0 AND entry >= 1e-9 AND len(path) > 0),
z AS (SELECT *, list_max(s) AS mfe, list_min(s) AS mae, CASE WHEN np > 5 AND nr >= 5 THEN sd END AS est_sigma FROM y)
SELECT factor_name, date, asset_id, {_r('~mfe', '~mae')}, round(CASE WHEN est_sigma * sqrt(5.0::DOUBLE) > 1e-9 THEN mfe / (est_sigma * sqrt(5.0::DOUBLE)) END, 6) AS mfe_z, CAST(list_position(s, mfe) AS INTEGER) AS bars_to_mfe, CAST(list_position(s, mae) AS INTEGER) AS bars_to_mae FROM z""")
def mfe_mae_events(spark, sf_dir):
    out = p.compute_mfe_mae(_events(spark, sf_dir), window=5, estimation_window=10, min_estimation_periods=5)
    return out.select("factor_name", "date", "asset_id", "mfe", "mae", F.round("mfe_z", 6).alias("mfe_z"), "bars_to_mfe", "bars_to_mae")


@query(P4 + """, d AS (SELECT *, price / lag(price) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS ret FROM panel), v AS (SELECT *, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END / sqrt(2.0::DOUBLE) AS vol FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT factor_name, date, asset_id, round(CASE WHEN vol > 1e-9 THEN forward_return * sign(factor) / vol END, 6) AS sar FROM v WHERE factor <> 0""")
def standardized_event_returns(spark, sf_dir):
    return p.standardized_events(_events(spark, sf_dir), forward_periods=2).withColumn("sar", F.round("sar", 6))


@query(P4 + f""", u AS (SELECT *, (rank() OVER (PARTITION BY asset_id ORDER BY forward_return) + (count(*) OVER (PARTITION BY asset_id, forward_return) - 1) / 2.0) / (count(forward_return) OVER (PARTITION BY asset_id) + 1) - 0.5 AS u FROM panel)
SELECT factor_name, count(*) FILTER (factor <> 0) AS n_events, round(avg(u * sign(factor)) FILTER (factor <> 0), {PLACES}) AS mean_u, round(stddev_pop(u), {PLACES}) AS std_u, count(*) AS n_total FROM u GROUP BY ALL""")
def corrado_rank_parts(spark, sf_dir):
    return m.corrado_rank().source(_events(spark, sf_dir), 2)


@query(P4 + f""", s AS (SELECT factor_name, forward_return * sign(factor) AS x FROM panel WHERE factor <> 0), t AS (SELECT factor_name, count(*) AS n, count(*) FILTER (x > 0) AS hits, sum(x) FILTER (x > 0) / abs(sum(x) FILTER (x < 0)) AS pf, skewness(x) AS sk FROM s GROUP BY ALL)
SELECT factor_name, 'hit_rate' AS metric, round(hits / n, {PLACES}) AS value, round((hits - n * 0.5::DOUBLE) / (sqrt(n) * 0.5), 6) AS stat, n AS n_obs FROM t UNION ALL SELECT factor_name, 'profit_factor', round(pf, 6), NULL, n FROM t UNION ALL SELECT factor_name, 'skewness', round(sk, 6), NULL, n FROM t""")
def event_quality(spark, sf_dir):
    found = _measured(spark, _events(spark, sf_dir), 2, hit_rate=m.event_hit_rate(), profit_factor=m.profit_factor(), skewness=m.event_skewness())
    hit = F.col("metric") == "hit_rate"
    return found.select("factor_name", "metric", F.when(hit, F.col("value")).otherwise(F.round("value", 6)).alias("value"), F.when(hit, F.col("stat")).alias("stat"), "n_obs")


@query(P4 + f", a AS (SELECT factor_name, asset_id, count(*) AS bars, count(*) FILTER (factor <> 0) AS k FROM panel GROUP BY ALL) SELECT factor_name, 'signal_density' AS metric, round(avg(bars / k) FILTER (k >= 2), {PLACES}) AS value, CAST(NULL AS DOUBLE) AS stat, CAST(sum(k) AS BIGINT) AS n_obs FROM a WHERE k > 0 GROUP BY ALL")
def signal_density_value(spark, sf_dir):
    return _measured(spark, _events(spark, sf_dir), 2, signal_density=m.signal_density())


@query(P4 + f", d AS (SELECT factor_name, date, count(*) AS k FROM panel WHERE factor <> 0 GROUP BY ALL), t AS (SELECT factor_name, sum(k) AS n FROM d GROUP BY ALL) SELECT factor_name, 'clustering_hhi' AS metric, round(sum((k / n) * (k / n)), {PLACES}) AS value, CAST(NULL AS DOUBLE) AS stat, CAST(any_value(n) AS BIGINT) AS n_obs FROM d JOIN t USING (factor_name) GROUP BY ALL")
def clustering_hhi_value(spark, sf_dir):
    return _measured(spark, _events(spark, sf_dir), 2, clustering_hhi=m.clustering_hhi())


# --- common signals and pooled regression ---------------------------------------------


@query(P2 + f" SELECT factor_name, date, round(avg(factor), {PLACES}) AS f, round(avg(forward_return), {PLACES}) AS r FROM panel GROUP BY ALL")
def per_date_means(spark, sf_dir):
    return p.per_date_means(_common(spark, sf_dir))


@query(P2 + """, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o FROM (SELECT DISTINCT date FROM panel)), rows_ AS (SELECT panel.*, o FROM panel JOIN cal USING (date)), w AS (SELECT cal.date, asset_id, covar_samp(factor, forward_return) / nullif(var_samp(factor), 0) AS b FROM cal JOIN rows_ ON rows_.o BETWEEN cal.o - 24 AND cal.o - 1 WHERE cal.o >= 24 GROUP BY cal.date, asset_id HAVING count(*) >= 10)
SELECT 'factor' AS factor_name, date, round(avg(coalesce(b, 0)), 9) AS value FROM w GROUP BY date""")
def rolling_common_beta(spark, sf_dir):
    return p.compute_rolling_common_beta(_common(spark, sf_dir), 24)


@query(LONG + """, o AS (SELECT factor_name, count(*) AS n, sum(factor) AS sx, sum(factor * factor) AS sxx, covar_samp(factor, forward_return) / var_samp(factor) AS slope, avg(forward_return) - covar_samp(factor, forward_return) / var_samp(factor) * avg(factor) AS a FROM panel GROUP BY ALL),
e AS (SELECT factor_name, date, sum(forward_return - a - slope * factor) AS s0, sum((forward_return - a - slope * factor) * factor) AS s1 FROM panel JOIN o USING (factor_name) GROUP BY ALL),
t AS (SELECT factor_name, count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM e GROUP BY ALL)
SELECT factor_name, 'pooled_beta' AS metric, round(slope, 9) AS value, round(slope / (sqrt((n - 1) / (n - 2) * g / (g - 1) * (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11)) / (n * sxx - sx * sx)), 6) AS stat, n AS n_obs FROM o JOIN t USING (factor_name)""")
def pooled_beta_clustered(spark, sf_dir):
    return _measured(spark, _long(spark, sf_dir), H, pooled_beta=m.pooled_beta())


@query(f"""WITH lines AS (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS date, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_quantity) AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
p3 AS (SELECT date, 0 AS asset_id, CAST(sum(c) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS price, CAST(sum(d) AS DOUBLE) / count(*) AS factor FROM lines GROUP BY date), {_returns('p3', 'fr3', H)}, o AS (SELECT count(*) AS n, avg(factor) AS mx, avg(forward_return) AS my, covar_samp(factor, forward_return) / var_samp(factor) AS beta, var_pop(factor) * count(*) AS sxx, greatest({H - 1}, 1, CAST(floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS INTEGER)) AS lags FROM fr3),
sc AS (SELECT row_number() OVER (ORDER BY date) AS i, (factor - mx) * (forward_return - my - beta * (factor - mx)) AS s FROM fr3, o),
v AS (SELECT sum(a.s * b.s * CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (b.i - a.i) / (lags + 1.0::DOUBLE)) END) AS meat FROM o, sc a JOIN sc b ON b.i BETWEEN a.i AND a.i + (SELECT lags FROM o))
SELECT 'factor' AS factor_name, 'predictive_beta' AS metric, round(beta, 9) AS value, round(beta / (sqrt(meat) / sxx), 6) AS stat, n AS n_obs FROM o, v""")
def predictive_regression(spark, sf_dir):
    panel = long_panel(pre.compute_forward_return(testdata.single_months(spark, sf_dir), H, check=False).drop(pre.HORIZON), ["factor"])
    return _measured(spark, panel, H, predictive_beta=m.predictive_beta())


@query(IC + f""", x AS (SELECT factor_name, ic, row_number() OVER (PARTITION BY factor_name ORDER BY date) - 1 AS i FROM ic WHERE ic IS NOT NULL), s AS (SELECT a.factor_name, (b.ic - a.ic) / (b.i - a.i) AS slope FROM x a JOIN x b ON a.factor_name = b.factor_name AND a.i < b.i),
k AS (SELECT factor_name, sum(c * (c - 1) * (2 * c + 5)) AS tied, sum(c) AS n FROM (SELECT factor_name, ic, count(*) AS c FROM x GROUP BY ALL) GROUP BY ALL),
o AS (SELECT factor_name, median(slope) AS slope, list_sort(list(slope)) AS l, count(*) AS cnt FROM s GROUP BY ALL),
r AS (SELECT *, 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18.0::DOUBLE) AS reach FROM o JOIN k USING (factor_name)),
ends AS (SELECT *, l[least(CAST(round_even((cnt + reach) / 2, 0) AS INTEGER), cnt - 1) + 1] AS high, l[greatest(CAST(round_even((cnt - reach) / 2, 0) AS INTEGER) - 1, 0) + 1] AS low FROM r)
SELECT factor_name, 'ic_trend' AS metric, round(slope, {PLACES}) AS value, round(slope / ((high - low) / 2 / 1.96), 6) AS stat, CAST(n AS BIGINT) AS n_obs FROM ends""")
def ic_trend_slope(spark, sf_dir):
    return _measured(spark, _long(spark, sf_dir), H, ic_trend=m.ic_trend())


# --- slices ------------------------------------------------------------------------


@query(FR + f""", panel AS (SELECT r_name AS factor_name, fr.factor, fr.date, fr.asset_id, fr.forward_return FROM fr JOIN supplier ON s_suppkey = asset_id JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ranks AS (SELECT factor_name, date, {AVG_RANK.format(x='factor')} AS rf, {AVG_RANK.format(x='forward_return')} AS rr FROM panel) SELECT factor_name AS region, date, round({RHO}, {PLACES}) AS ic, count(*) AS n_assets FROM ranks GROUP BY ALL HAVING count(*) >= 2""")
def ic_by_region(spark, sf_dir):
    panel = testdata.with_region(spark, sf_dir, _months(spark, sf_dir))
    return p.compute_ic(long_panel(panel, ["factor"]).withColumn("factor_name", F.col("region"))).select(F.col("factor_name").alias("region"), "date", "ic", "n_assets")


# --- families ------------------------------------------------------------------------

_FAMILY = "fam AS (SELECT CAST(s_suppkey AS VARCHAR) AS factor, 'm' AS metric, s_nationkey % 5 AS bucket, CAST((s_suppkey * 7919) % 9973 AS DOUBLE) / 9973 * 0.2 AS p_value FROM supplier)"


def _family(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    return testdata.table(spark, sf_dir, "supplier").select(key.cast("string").alias("factor"), F.lit("m").alias("metric"), F.lit(H).alias("forward_periods"), (F.col("s_nationkey") % 5).alias("bucket"), ((key * 7919) % 9973).cast("double").alias("k")).select("factor", "metric", "forward_periods", "bucket", (F.col("k") / 9973 * 0.2).alias("p_value"), F.lit(None).cast("string").alias("reason"))


_BHY = """WITH {f}, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p_value, factor) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM fam), s AS (SELECT *, n * list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)) / k * p_value AS v FROM r) SELECT factor, {cols} round(least(1.0::DOUBLE, min(v) OVER (PARTITION BY {by} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS adj_p FROM s"""


@query(_BHY.format(f=_FAMILY, by="metric", cols=""))
def bhy_adjusted(spark, sf_dir):
    return families.bhy(_family(spark, sf_dir), metrics=["m"]).select("factor", "adj_p")


@query(_BHY.format(f=_FAMILY, by="metric, bucket", cols="bucket,"))
def bhy_by_bucket(spark, sf_dir):
    return families.bhy(_family(spark, sf_dir), metrics=["m"], expand_over=("bucket",)).select("factor", "bucket", "adj_p")


@query(f"WITH {_FAMILY}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, factor) AS k, count(*) OVER () AS n FROM fam) SELECT factor, round(least(1.0::DOUBLE, max((n - k + 1) * p_value) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 9) AS adj_p FROM r")
def holm_adjusted(spark, sf_dir):
    return families.adjust(_family(spark, sf_dir), "p_value", ["metric"], "holm").select("factor", "adj_p")


@query(f"WITH {_FAMILY}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_value) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM fam) SELECT bucket, round(least(1.0::DOUBLE, min(p_value * n / k)), 9) AS simes_p FROM r GROUP BY bucket")
def simes_by_bucket(spark, sf_dir):
    return families.simes(_family(spark, sf_dir), ["bucket"])


@query(f"WITH {_FAMILY}, c AS (SELECT CAST(CAST(factor AS BIGINT) % 3 AS VARCHAR) AS f, p_value FROM fam), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p_value) AS k, count(*) OVER (PARTITION BY f) AS n FROM c) SELECT f AS factor, any_value(n) AS n_conditions, round(least(1.0::DOUBLE, max((n - 2 + 1) * p_value) FILTER (k = 2)), 9) AS pc_p FROM r GROUP BY f")
def partial_conjunction_p(spark, sf_dir):
    rows = _family(spark, sf_dir).drop("bucket").withColumn("condition", F.col("factor")).withColumn("factor", (F.col("factor").cast("long") % 3).cast("string"))
    return families.partial_conjunction(rows, metrics=["m"], min_pass=2, expand_over=("condition",)).select("factor", "n_conditions", "pc_p")


_TWO = _FAMILY + ", two AS (SELECT factor, metric, p_value FROM fam UNION ALL SELECT factor, 'n', p_value / 2 FROM fam)"
_HARMONIC = "list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i))"


@query(f"""WITH {_FAMILY}, i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_value, factor) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM fam), si AS (SELECT *, n * {_HARMONIC} / k * p_value AS v FROM i),
inner_ AS (SELECT factor, bucket, least(1.0::DOUBLE, min(v) OVER (PARTITION BY bucket ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS inner_p FROM si),
g AS (SELECT bucket, least(1.0::DOUBLE, min(p_value * n / k)) AS p FROM i GROUP BY bucket), o AS (SELECT *, row_number() OVER (ORDER BY p, bucket) AS k, count(*) OVER () AS n FROM g), so AS (SELECT *, n * {_HARMONIC} / k * p AS v FROM o),
outer_ AS (SELECT bucket, least(1.0::DOUBLE, min(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS outer_p FROM so)
SELECT factor, bucket, {_r('~inner_p', '~outer_p')}, round(greatest(inner_p, outer_p), {PLACES}) AS adj_p, greatest(inner_p, outer_p) <= 0.05 AS survived FROM inner_ JOIN outer_ USING (bucket)""")
def bhy_hierarchical(spark, sf_dir):
    return families.bhy_hierarchical(_family(spark, sf_dir), metrics=["m"], group="bucket").select("factor", "bucket", "inner_p", "outer_p", "adj_p", "survived")


@query(f"""WITH {_TWO}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, factor, metric) AS k, count(*) OVER () AS n FROM two), s AS (SELECT *, n * {_HARMONIC} / k * p_value AS v FROM r), a AS (SELECT factor, metric, least(1.0::DOUBLE, min(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj_p FROM s)
SELECT factor, metric, {_r('~adj_p')}, adj_p <= 0.05 AS survived FROM a""")
def bhy_across_metrics(spark, sf_dir):
    one = _family(spark, sf_dir)
    both = one.unionByName(one.withColumn("metric", F.lit("n")).withColumn("p_value", F.col("p_value") / 2))
    return families.bhy_across_metrics(both, metrics=["m", "n"]).select("factor", "metric", "adj_p", "survived")


@query(f"""WITH {_TWO}, c AS (SELECT factor, max(p_value) AS pc_p FROM two GROUP BY factor), r AS (SELECT *, row_number() OVER (ORDER BY pc_p, factor) AS k, count(*) OVER () AS n FROM c), s AS (SELECT *, n * {_HARMONIC} / k * pc_p AS v FROM r), a AS (SELECT factor, pc_p, least(1.0::DOUBLE, min(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj_p FROM s)
SELECT factor, {_r('~pc_p', '~adj_p')}, adj_p <= 0.05 AS survived FROM a""")
def partial_conjunction_across_metrics(spark, sf_dir):
    one = _family(spark, sf_dir)
    both = one.unionByName(one.withColumn("metric", F.lit("n")).withColumn("p_value", F.col("p_value") / 2))
    return families.partial_conjunction_across_metrics(both, metrics=["m", "n"], min_pass=2).select("factor", "pc_p", "adj_p", "survived")


# --- whole evaluations ------------------------------------------------------------------

INDIVIDUAL_METRICS = {
    "ic": m.ic(), "ic_newey_west": m.ic(m.NEWEY_WEST), "ic_bootstrap": m.ic(m.STATIONARY_BOOTSTRAP, seed=0), "ic_ir": m.ic_ir(), "positive_rate": m.positive_rate(), "ic_trend": m.ic_trend(), "oos_decay": m.oos_decay(), "fm_beta": m.fm_beta(), "fm_beta_shanken": m.fm_beta(is_estimated_factor=True),
    "fm_beta_sign_consistency": m.fm_beta_sign_consistency(), "pooled_beta": m.pooled_beta(), "pooled_beta_two_way": m.pooled_beta(two_way_cluster_col="asset_id"), "pooled_beta_dk": m.pooled_beta(driscoll_kraay=True), "quantile_spread": m.quantile_spread(), "quantile_spread_nw": m.quantile_spread(inference=m.NEWEY_WEST), "quantile_spread_vw": m.quantile_spread_vw(),
    "k_spread": m.k_spread(), "monotonicity": m.monotonicity(n_groups=5), "top_concentration": m.top_concentration(), "directional_pair_accuracy": m.directional_pair_accuracy(), "directional_hit_rate": m.directional_hit_rate(), "rank_turnover": m.rank_turnover(), "notional_turnover": m.notional_turnover(n_groups=5),
}
EVENT_METRICS = {
    "caar": m.caar(), "bmp_z": m.bmp_z(), "bmp_z_kp": m.bmp_z(kolari_pynnonen_adjust=True), "corrado_rank": m.corrado_rank(), "event_hit_rate": m.event_hit_rate(), "event_ic": m.event_ic(), "profit_factor": m.profit_factor(), "event_skewness": m.event_skewness(),
    "signal_density": m.signal_density(), "event_around_return": m.event_around_return(), "mfe_mae": m.mfe_mae(window=5, estimation_window=25), "clustering_hhi": m.clustering_hhi(),
}
COMMON_METRICS = {"common_beta": m.common_beta(), "common_beta_profile": m.common_beta_profile(), "common_beta_r_squared": m.common_beta_r_squared(), "common_beta_sign_consistency": m.common_beta_sign_consistency(), "common_asymmetry": m.common_asymmetry(), "common_quantile_spread": m.common_quantile_spread()}


def _frame(spark, results) -> DataFrame:
    return spark.createDataFrame([row for r in results for row in r.rows()], FRAME_SCHEMA)


def _evaluate_months(spark, sf_dir):
    return ev.evaluate(_months(spark, sf_dir), metrics=INDIVIDUAL_METRICS, factor_cols=["factor", "factor2"], forward_periods=H, strict=False)


@query()
def evaluate_individual(spark, sf_dir):
    return _frame(spark, _evaluate_months(spark, sf_dir))


@query(IC + f""", vals AS (SELECT factor_name, 'ic' AS metric_name, avg(ic) AS value FROM ic GROUP BY ALL UNION ALL SELECT factor_name, 'ic_ir', avg(ic) / stddev_samp(ic) FROM ic GROUP BY ALL
UNION ALL SELECT factor_name, 'fm_beta', avg(beta) FROM (SELECT factor_name, date, covar_samp(factor, forward_return) / nullif(var_samp(factor), 0) AS beta FROM panel GROUP BY ALL HAVING count(*) >= 3 AND var_samp(factor) > 0) GROUP BY ALL
UNION ALL SELECT factor_name, 'pooled_beta', covar_samp(factor, forward_return) / var_samp(factor) FROM panel GROUP BY ALL) SELECT factor_name AS factor, metric_name, round(value, {PLACES}) AS value FROM vals""")
def evaluate_values(spark, sf_dir):
    own = {k: INDIVIDUAL_METRICS[k] for k in ("ic", "ic_ir", "fm_beta", "pooled_beta")}
    return _frame(spark, ev.evaluate(_months(spark, sf_dir), metrics=own, factor_cols=["factor", "factor2"], forward_periods=H, strict=False)).select("factor", "metric_name", "value")


@query()
def evaluate_events(spark, sf_dir):
    panel = pre.compute_forward_return(testdata.user_days(spark, sf_dir), 2, check=False)
    return _frame(spark, ev.evaluate(panel, metrics=EVENT_METRICS, factor_cols=["factor"], strict=False))


@query()
def evaluate_common(spark, sf_dir):
    panel = pre.compute_forward_return(testdata.common_months(spark, sf_dir), H, check=False)
    return _frame(spark, ev.evaluate(panel, metrics=COMMON_METRICS, factor_cols=["factor"], strict=False))


@query()
def evaluate_single_asset(spark, sf_dir):
    panel = pre.compute_forward_return(testdata.single_months(spark, sf_dir), H, check=False)
    return _frame(spark, ev.evaluate(panel, metrics={"predictive_beta": m.predictive_beta(), "directional_hit_rate": m.directional_hit_rate()}, factor_cols=["factor"], strict=False))


@query()
def evaluate_horizons(spark, sf_dir):
    own = {"ic": m.ic(), "fm_beta": m.fm_beta()}
    results = ev.evaluate_horizons(testdata.supplier_months(spark, sf_dir), metrics=own, factor_cols=["factor"], forward_periods=[1, 3], strict=False)
    return ev.compare(results, metrics=list(own), spark=spark, sort_by="ic")


@query()
def compare(spark, sf_dir):
    return ev.compare(_evaluate_months(spark, sf_dir), metrics=["ic", "fm_beta", "quantile_spread"], spark=spark, sort_by="quantile_spread")


@query()
def inspect_data(spark, sf_dir):
    found = ev.inspect_data(_months(spark, sf_dir), ["factor", "factor2"], forward_periods=H)
    return spark.createDataFrame([(k, v.tier, list(v.blockers), list(v.cautions)) for k, v in found.verdicts.items()], "metric string, tier string, blockers array<string>, cautions array<string>")


@query()
def metrics_summary(spark, sf_dir):
    return ev.metrics_summary(spark)


@query()
def slice_joint(spark, sf_dir):
    panel = testdata.with_region(spark, sf_dir, _months(spark, sf_dir))
    return spark.createDataFrame(slicing.slice_joint_test(panel, m.ic(), by="region", factor_col="factor").drop(columns="multiplicity"))


@query()
def slice_period_pairwise(spark, sf_dir):
    panel = _months(spark, sf_dir).withColumn("era", F.when(F.col("date") < "1998", "early").otherwise("late"))
    return spark.createDataFrame(slicing.slice_period_pairwise_test(panel, m.ic(m.NEWEY_WEST), by="era", factor_col="factor", rng_seed=0).drop(columns="df_denom"))


@query()
def slice_period_joint(spark, sf_dir):
    panel = _months(spark, sf_dir).withColumn("era", F.when(F.col("date") < "1998", "early").otherwise("late"))
    return spark.createDataFrame(slicing.slice_period_joint_test(panel, m.ic(m.NEWEY_WEST), by="era", factor_col="factor", method="analytic").drop(columns=["df_denom", "multiplicity"]))


def _spreads(spark, sf_dir) -> dict:
    s = p.compute_spread_series(_long(spark, sf_dir), 1, 5).select("factor_name", "date", "spread").toPandas()
    return {k: v.drop(columns="factor_name") for k, v in s.groupby("factor_name")}


@query()
def greedy_forward_selection(spark, sf_dir):
    r = m.greedy_forward_selection(_spreads(spark, sf_dir), significance_threshold=0.5, suppress_snooping_warning=True)
    return spark.createDataFrame([(x["factor_name"], x["alpha"], x["t_stat"]) for x in r.metadata["all_candidates"]], "factor string, alpha double, t_stat double")


@query()
def make_cs_panel(spark, sf_dir):
    return datasets.make_cs_panel(spark, n_assets=20, n_dates=60)


@query()
def make_event_panel(spark, sf_dir):
    return datasets.make_event_panel(spark, n_assets=20, n_dates=60)


@query()
def make_multi_factor_panel(spark, sf_dir):
    return datasets.make_multi_factor_panel(spark, n_factors=3, n_assets=20, n_dates=60)


@query()
def make_multi_factor_event_panel(spark, sf_dir):
    return datasets.make_multi_factor_event_panel(spark, n_factors=3, n_assets=10, n_dates=60)
