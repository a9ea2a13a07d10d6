"""Queries of what the metrics report - value, statistic, p value, number of observations - with SQL equivalents.

Tails of the t and normal distributions are integrals by Simpson's rule on the SQL side.
Spreads over few assets take p values from a bootstrap, so those queries leave p out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import producers as p
from ..sources import testdata
from . import evaluate as ev
from . import slicing
from .registry import AVG_RANK, BUCKETS, FR, H, IC, LONG, ORACLES, P2, P4, PLACES, QUERIES, RHO, S3, STRIDE, _at, _common, _ENDS, _events, _long, _months, _SPREAD, _spreads, query
from .results import number

SCHEMA = "factor_name string, metric string, value double, stat double, p_value double, n_obs long"
STEPS = 1000


def _reported(spark, panel: DataFrame, h: int, p_values: bool = True, **metrics: m.Metric) -> DataFrame:
    """What the metrics themselves report, by signal."""
    found = ev.run_metrics(panel, metrics, ev.facts(panel, h), h)
    places = lambda x, k: None if number(x) is None else round(number(x), k)
    table = spark.createDataFrame([(f, label, number(r.value), places(r.stat, 6), places(r.p_value, 6), r.n_obs) for (f, label), r in found.items()], SCHEMA)
    return table if p_values else table.drop("p_value")


# --- SQL parts -------------------------------------------------------------------


def _simpson(upper: str, integrand: str) -> str:
    """Integral from 0 to ``upper`` of ``integrand`` in u."""
    weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({upper}) / {3.0 * STEPS} * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: ({weight}) * ({integrand.format(u=f'(({upper}) * i / {float(STEPS)})')}))))"


def _t2(t: str, df: str) -> str:
    """Two-sided p of a t statistic."""
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {_simpson(f'atan(abs({t}) / sqrt({df}))', f'pow(cos({{u}}), ({df}) - 1)')})"


def _z2(z: str) -> str:
    return f"(1 - sqrt(2 / pi()) * {_simpson(f'least(abs({z}), 9.0)', 'exp(-{u} * {u} / 2)')})"


def _upper(two_sided: str, stat: str) -> str:
    """One-sided p for large statistics."""
    return f"(CASE WHEN {stat} > 0 THEN {two_sided} / 2 ELSE 1 - {two_sided} / 2 END)"


def _row(metric: str, source: str, *, p_value: str | None = "NULL", key: str = "factor_name") -> str:
    """One metric's rows from a relation with v, t and n by signal."""
    tail = "" if p_value is None else f", CAST(round({p_value}, 6) AS DOUBLE) AS p_value"
    return f"SELECT {key}, '{metric}' AS metric, round(v, {PLACES}) AS value, CAST(round(t, 6) AS DOUBLE) AS stat{tail}, CAST(n AS BIGINT) AS n_obs FROM {source}"


def _mean_test(x: str) -> str:
    return f"avg({x}) AS v, avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) AS t, count({x}) AS n"


def _lags(n: str, h: int = H) -> str:
    return f"least(greatest(greatest(1, CAST(floor(4 * pow({n} / 100.0, 2 / 9.0)) AS INTEGER)), {h - 1}), {n} - 1)"


def _bartlett(name: str, rows: str, x: str) -> str:
    """CTE of the kernel-weighted sum of products of ``x`` by signal; ``rows`` has factor_name, i, n and x."""
    w = f"CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (b.i - a.i) / ({_lags('a.n')} + 1.0::DOUBLE)) END"
    return f"{name} AS (SELECT a.factor_name, sum(a.{x} * b.{x} * {w}) AS meat FROM {rows} a JOIN {rows} b ON a.factor_name = b.factor_name AND b.i BETWEEN a.i AND a.i + {_lags('a.n')} GROUP BY ALL)"


def _union(*rows: str) -> str:
    return " " + " UNION ALL ".join(rows)


# --- rank correlation and per-date slopes --------------------------------------------


@query(IC + """, x AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY date) - 1 AS i FROM ic), own AS (SELECT * FROM x WHERE i % 3 = 0 AND ic IS NOT NULL),
rate AS (SELECT factor_name, v, (v - 0.5) * sqrt(n) / 0.5 AS t, n FROM (SELECT factor_name, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END) AS v, count(*) AS n FROM own GROUP BY ALL)),
y AS (SELECT factor_name, ic, row_number() OVER (PARTITION BY factor_name ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY factor_name) AS n FROM x WHERE ic IS NOT NULL),
decay AS (SELECT factor_name, abs(avg(ic) FILTER (i >= floor(n * 0.7::DOUBLE))) / abs(avg(ic) FILTER (i < floor(n * 0.7::DOUBLE))) AS v, NULL AS t, any_value(n) AS n FROM y GROUP BY ALL)""" + _union(_row("positive_rate", "rate", p_value=_z2("t")), _row("oos_decay", "decay")))
def ic_series_metrics(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, positive_rate=m.positive_rate(), oos_decay=m.oos_decay())


@query(LONG + """, b AS (SELECT factor_name, date, covar_samp(factor, forward_return) / nullif(var_samp(factor), 0) AS beta FROM panel GROUP BY ALL HAVING count(*) >= 3 AND var_samp(factor) > 0),
x AS (SELECT *, beta - avg(beta) OVER (PARTITION BY factor_name) AS d, row_number() OVER (PARTITION BY factor_name ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_name) AS n FROM b), """ + _bartlett("g", "x", "d") + """,
f AS (SELECT factor_name, avg(beta) AS v, avg(beta) / (sqrt(any_value(meat)) / count(*)) AS t, var_samp(beta) AS s2, avg(CASE WHEN beta > 0 THEN 1.0::DOUBLE ELSE 0 END) AS up, count(*) AS n FROM x JOIN g USING (factor_name) GROUP BY ALL),
k AS (SELECT factor_name, v, t / sqrt(1 + v * v / s2) AS t, n FROM f), u AS (SELECT factor_name, up AS v, NULL AS t, n FROM f)""" + _union(_row("fm_beta", "f", p_value=_t2("t", "n - 1")), _row("fm_beta_shanken", "k", p_value=_t2("t", "n - 1")), _row("fm_beta_sign_consistency", "u")))
def fm_metrics(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, fm_beta=m.fm_beta(), fm_beta_shanken=m.fm_beta(is_estimated_factor=True), fm_beta_sign_consistency=m.fm_beta_sign_consistency())


_SCORES = """, o AS (SELECT factor_name, count(*) AS n, sum(factor) AS sx, sum(factor * factor) AS sxx, covar_samp(factor, forward_return) / var_samp(factor) AS slope, avg(forward_return) - covar_samp(factor, forward_return) / var_samp(factor) * avg(factor) AS a FROM panel GROUP BY ALL),
e AS (SELECT factor_name, date, asset_id, forward_return - a - slope * factor AS s0, (forward_return - a - slope * factor) * factor AS s1 FROM panel JOIN o USING (factor_name))"""
_MEAT = "(sx * sx * {q}00 - 2 * n * sx * {q}01 + n * n * {q}11)"


def _axis(name: str, keys: str) -> str:
    return f"{name} AS (SELECT factor_name, g / (g - 1.0::DOUBLE) AS c, g, c00, c01, c11 FROM (SELECT factor_name, count(*) AS g, sum(s0 * s0) AS c00, sum(s0 * s1) AS c01, sum(s1 * s1) AS c11 FROM (SELECT factor_name, sum(s0) AS s0, sum(s1) AS s1 FROM e GROUP BY factor_name, {keys}) GROUP BY ALL))"


@query(LONG + _SCORES + ", " + ", ".join([_axis("ca", "date"), _axis("cb", "asset_id"), _axis("ci", "date, asset_id")]) + """,
w AS (SELECT o.*, least(ca.g, cb.g) AS g, ca.c * ca.c00 + cb.c * cb.c00 - ci.c * ci.c00 AS c00, ca.c * ca.c01 + cb.c * cb.c01 - ci.c * ci.c01 AS c01, ca.c * ca.c11 + cb.c * cb.c11 - ci.c * ci.c11 AS c11, ca.c * ca.c00 AS a00, ca.c * ca.c01 AS a01, ca.c * ca.c11 AS a11 FROM o JOIN ca USING (factor_name) JOIN cb USING (factor_name) JOIN ci USING (factor_name)),
two AS (SELECT factor_name, slope AS v, slope * (n * sxx - sx * sx) / sqrt((n - 1) / (n - 2) * CASE WHEN """ + _MEAT.format(q="c") + " < 0 THEN " + _MEAT.format(q="a") + " ELSE " + _MEAT.format(q="c") + """ END) AS t, n, g FROM w),
pd AS (SELECT factor_name, date, sum(s0) AS s0, sum(s1) AS s1 FROM e GROUP BY ALL), q AS (SELECT factor_name, n * s1 - sx * s0 AS x, row_number() OVER (PARTITION BY factor_name ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_name) AS n FROM (SELECT pd.*, o.n, o.sx FROM pd JOIN o USING (factor_name))),
""" + _bartlett("dk0", "q", "x").replace(_lags("a.n"), "greatest(1, CAST(floor(4 * pow(a.n / 100.0, 2 / 9.0)) AS INTEGER))") + """,
dk AS (SELECT o.factor_name, slope AS v, slope * (o.n * sxx - sx * sx) / sqrt(meat) AS t, o.n, (SELECT count(DISTINCT date) FROM pd) AS g FROM o JOIN dk0 USING (factor_name))""" + _union(_row("pooled_beta_two_way", "two", p_value=_t2("t", "g - 1")), _row("pooled_beta_dk", "dk", p_value=_t2("t", "g - 1"))))
def pooled_beta_metrics(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, pooled_beta_two_way=m.pooled_beta(two_way_cluster_col="asset_id"), pooled_beta_dk=m.pooled_beta(driscoll_kraay=True))


# --- portfolios --------------------------------------------------------------------


@query(_SPREAD + f", q AS (SELECT factor_name, {_mean_test('spread')} FROM spread GROUP BY ALL)" + _union(_row("quantile_spread", "q", p_value=None)))
def quantile_spread_metric(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, False, quantile_spread=m.quantile_spread())


@query(LONG + STRIDE.format(h=H).replace("sampled AS", "sampled0 AS") + """, lagged AS (SELECT * EXCLUDE (market_cap), lag(market_cap) OVER (PARTITION BY factor_name, asset_id ORDER BY date) AS market_cap FROM sampled0), sampled AS (SELECT * FROM lagged WHERE market_cap IS NOT NULL)""" + BUCKETS.format(g=5) + f""",
s AS (SELECT factor_name, date, count(DISTINCT factor) AS k, sum(forward_return * market_cap) FILTER (bucket = 4) / sum(market_cap) FILTER (bucket = 4) - sum(forward_return * market_cap) FILTER (bucket = 0) / sum(market_cap) FILTER (bucket = 0) AS d FROM bucketed GROUP BY ALL),
q AS (SELECT factor_name, {_mean_test('CASE WHEN k <= 1 THEN 0 ELSE d END')} FROM s GROUP BY ALL)""" + _union(_row("quantile_spread_vw", "q", p_value=_t2("t", "n - 1"))))
def quantile_spread_vw_metric(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, quantile_spread_vw=m.quantile_spread_vw())


@query(S3 + f""", k AS (SELECT *, row_number() OVER (PARTITION BY factor_name, date ORDER BY factor DESC, asset_id) AS rk, count(*) OVER (PARTITION BY factor_name, date) AS n FROM sampled),
s AS (SELECT factor_name, date, avg(forward_return) FILTER (rk <= 3) - avg(forward_return) FILTER (rk > n - 3) AS d FROM k WHERE n >= 6 GROUP BY ALL), q AS (SELECT factor_name, {_mean_test('d')} FROM s GROUP BY ALL)""" + _union(_row("k_spread", "q", p_value=None)))
def k_spread_metric(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, False, k_spread=m.k_spread(k=3))


@query(S3 + BUCKETS.format(g=5) + f""", means AS (SELECT factor_name, date, bucket, avg(forward_return) AS mm FROM bucketed GROUP BY ALL), rm AS (SELECT factor_name, date, CAST(bucket AS DOUBLE) AS rr, {AVG_RANK.format(x='mm')} AS rf FROM means),
r AS (SELECT factor_name, date, CASE WHEN count(*) = 5 THEN {RHO} END AS rho FROM rm GROUP BY ALL), mono AS (SELECT factor_name, avg(abs(rho)) AS v, avg(rho) / (stddev_samp(rho) / sqrt(count(rho))) AS t, count(rho) AS n FROM r GROUP BY ALL),
pct AS (SELECT *, {AVG_RANK.format(x='factor')} / count(*) OVER (PARTITION BY factor_name, date) AS pr FROM sampled), top AS (SELECT * FROM pct WHERE pr >= 1 - 0.2::DOUBLE),
c AS (SELECT factor_name, date, sum(abs(factor)) * sum(abs(factor)) / sum(abs(factor) * abs(factor)) AS eff, count(*) AS n_top FROM top GROUP BY ALL HAVING sum(abs(factor)) > 0),
conc AS (SELECT factor_name, avg(eff) AS v, (avg(eff / n_top) - 0.5) / (stddev_samp(eff / n_top) / sqrt(count(*))) AS t, count(*) AS n FROM c GROUP BY ALL)""" + _union(_row("monotonicity", "mono", p_value=_t2("t", "n - 1")), _row("top_concentration", "conc", p_value=_upper(_t2("t", "n - 1"), "-t"))))
def rank_shape_metrics(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, monotonicity=m.monotonicity(n_groups=5), top_concentration=m.top_concentration())


_TURNOVER = """, days AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM sampled)),
j AS (SELECT a.factor_name, a.date, a.bucket = 4 AS is_top, a.bucket = 0 AS is_bot, coalesce(b.bucket = 4, false) AS was_top, coalesce(b.bucket = 0, false) AS was_bot FROM bucketed a JOIN days ON a.date = days.date AND prev IS NOT NULL LEFT JOIN bucketed b ON b.factor_name = a.factor_name AND b.asset_id = a.asset_id AND b.date = prev),
tn AS (SELECT factor_name, date, (2.0::DOUBLE - count(*) FILTER (is_top AND was_top) / count(*) FILTER (is_top) - count(*) FILTER (is_bot AND was_bot) / count(*) FILTER (is_bot)) / 2 AS turnover FROM j GROUP BY ALL)"""


@query(S3 + BUCKETS.format(g=5) + _TURNOVER + f""", rk AS (SELECT factor_name, date, asset_id, {AVG_RANK.format(x='factor')} AS rf FROM sampled), pairs AS (SELECT *, lag(rf) OVER (PARTITION BY factor_name, asset_id ORDER BY date) AS rr FROM rk),
rc AS (SELECT factor_name, date, {RHO} AS rc FROM pairs WHERE rr IS NOT NULL GROUP BY ALL), a AS (SELECT factor_name, 1 - avg(rc) AS v, NULL AS t, count(rc) AS n FROM rc GROUP BY ALL), b AS (SELECT factor_name, avg(turnover) AS v, NULL AS t, count(*) AS n FROM tn GROUP BY ALL)""" + _union(_row("rank_turnover", "a"), _row("notional_turnover", "b")))
def turnover_metrics(spark, sf_dir):
    return _reported(spark, _long(spark, sf_dir), H, rank_turnover=m.rank_turnover(), notional_turnover=m.notional_turnover(n_groups=5))


@query(_SPREAD + _TURNOVER + f""", g AS (SELECT factor_name, avg(spread) AS gross FROM spread GROUP BY ALL), u AS (SELECT factor_name, avg(turnover) AS turnover FROM tn GROUP BY ALL)
SELECT factor_name, round(gross * {H} / (2 * turnover) * 1e4, 6) AS breakeven_bps, round(gross - 2 * 0.003::DOUBLE * turnover / {H}, {PLACES}) AS net FROM g JOIN u USING (factor_name)""")
def cost_metrics(spark, sf_dir):
    panel = _long(spark, sf_dir)
    found = ev.run_metrics(panel, {"gross": m.quantile_spread(), "turnover": m.notional_turnover(n_groups=5)}, ev.facts(panel, H), H)
    signals = sorted({f for f, _ in found})
    costs = [(f, found[f, "gross"].value, found[f, "turnover"].value) for f in signals]
    return spark.createDataFrame([(f, round(m.breakeven_cost(g, t, forward_periods=H).value, 6), m.net_spread(g, t, forward_periods=H).value) for f, g, t in costs], "factor_name string, breakeven_bps double, net double")


@query(S3.replace("AS factor_name, factor,", "AS factor_name, factor - 4.5::DOUBLE AS factor,").replace("'factor2', factor2,", "'factor2', factor2 - 3.5::DOUBLE,") + """, pairs AS (SELECT a.factor_name, (a.factor - b.factor) * (a.forward_return - b.forward_return) > 0 AS good FROM sampled a JOIN sampled b ON a.factor_name = b.factor_name AND a.date = b.date AND a.asset_id < b.asset_id WHERE abs(a.factor - b.factor) > 1e-9 AND abs(a.forward_return - b.forward_return) > 1e-9),
pa AS (SELECT factor_name, avg(CASE WHEN good THEN 1.0::DOUBLE ELSE 0 END) AS v, NULL AS t, count(*) AS n FROM pairs GROUP BY ALL),
d AS (SELECT factor_name, date, CAST(count(*) AS DOUBLE) AS k, count(*) FILTER (sign(factor) = sign(forward_return)) AS hits, count(*) FILTER (factor > 0) AS fu, count(*) FILTER (forward_return > 0) AS ru FROM sampled WHERE factor <> 0 AND forward_return <> 0 GROUP BY ALL),
a AS (SELECT factor_name, sum(k) AS n, sum(hits) / sum(k) AS hit, sum(fu) / sum(k) AS px, sum(ru) / sum(k) AS py, var_samp(hits / k) FILTER (k >= 2) AS between_, sum(hits * (1 - hits / k)) FILTER (k >= 2) / sum(k - 1) FILTER (k >= 2) AS within_, avg(k) FILTER (k >= 2) AS size, count(*) FILTER (k >= 2) AS dates FROM d GROUP BY ALL),
b AS (SELECT *, px * py + (1 - px) * (1 - py) AS star FROM a),
c AS (SELECT *, (hit - star) / sqrt(star * (1 - star) / n - ((2 * py - 1) ** 2 * px * (1 - px) / n + (2 * px - 1) ** 2 * py * (1 - py) / n + 4 * px * py * (1 - px) * (1 - py) / n ** 2)) AS z, CASE WHEN between_ + within_ < 1e-9 THEN 0 ELSE between_ / (between_ + within_) END AS r FROM b),
hr AS (SELECT factor_name, hit AS v, CASE WHEN dates >= 2 AND size > 1 THEN z * sqrt((1 - r) / (1 + (size - 1) * r)) ELSE z END AS t, n FROM c)""" + _union(_row("directional_pair_accuracy", "pa"), _row("directional_hit_rate", "hr", p_value=_upper(_z2("t"), "t"))))
def direction_metrics(spark, sf_dir):
    panel = _long(spark, sf_dir).withColumn("factor", F.col("factor") - F.when(F.col("factor_name") == "factor", 4.5).otherwise(3.5))
    return _reported(spark, panel, H, directional_pair_accuracy=m.directional_pair_accuracy(), directional_hit_rate=m.directional_hit_rate())


# --- events ----------------------------------------------------------------------


@query(P4 + f""", cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o FROM (SELECT DISTINCT date FROM panel)), c AS (SELECT factor_name, o, avg(forward_return * factor) AS x FROM panel JOIN cal USING (date) WHERE factor <> 0 GROUP BY ALL),
runs AS (SELECT *, o - row_number() OVER (PARTITION BY factor_name ORDER BY o) AS run FROM c), kept AS (SELECT *, row_number() OVER (PARTITION BY factor_name, run ORDER BY o) % 2 = 1 AS own FROM runs),
ca AS (SELECT factor_name, avg(x) AS v, avg(x) FILTER (own) / (stddev_samp(x) FILTER (own) / sqrt(count(*) FILTER (own))) AS t, count(*) FILTER (own) AS n FROM kept GROUP BY ALL),
u AS (SELECT *, (rank() OVER (PARTITION BY asset_id ORDER BY forward_return) + (count(*) OVER (PARTITION BY asset_id, forward_return) - 1) / 2.0) / (count(forward_return) OVER (PARTITION BY asset_id) + 1) - 0.5 AS u FROM panel),
cr AS (SELECT factor_name, avg(u * sign(factor)) FILTER (factor <> 0) AS v, avg(u * sign(factor)) FILTER (factor <> 0) / (stddev_pop(u) / sqrt(count(*) FILTER (factor <> 0))) AS t, count(*) FILTER (factor <> 0) AS n FROM u GROUP BY ALL)""" + _union(_row("caar", "ca", p_value=_t2("t", "n - 1")), _row("corrado_rank", "cr", p_value=_upper(_z2("t"), "t"))))
def event_tests(spark, sf_dir):
    return _reported(spark, _events(spark, sf_dir), 2, caar=m.caar(), corrado_rank=m.corrado_rank())


@query(P4 + """, d AS (SELECT *, price / lag(price) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS ret FROM panel), w AS (SELECT *, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END / sqrt(2.0::DOUBLE) AS vol FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
x AS (SELECT factor_name, date, forward_return * sign(factor) / vol AS sar FROM w WHERE factor <> 0 AND vol > 1e-9), b AS (SELECT factor_name, """ + _mean_test("sar") + """ FROM x GROUP BY ALL),
g AS (SELECT factor_name, date, avg(sar) AS mm, var_samp(sar) AS vv, count(*) AS k FROM x GROUP BY ALL), i AS (SELECT factor_name, sum(vv * (k - 1)) FILTER (k >= 2) / sum(k - 1) FILTER (k >= 2) AS within_, var_samp(mm) FILTER (k >= 2) AS between_, avg(k) FILTER (k >= 2) AS size, count(*) FILTER (k >= 2) AS dates FROM g GROUP BY ALL),
kp AS (SELECT factor_name, v, CASE WHEN dates >= 2 THEN t * sqrt((1 - between_ / (between_ + within_)) / (1 + (size - 1) * between_ / (between_ + within_))) ELSE t END AS t, n FROM b JOIN i USING (factor_name))""" + _union(_row("bmp_z", "b", p_value=_z2("t")), _row("bmp_z_kp", "kp", p_value=_z2("t"))))
def standardized_event_tests(spark, sf_dir):
    return _reported(spark, _events(spark, sf_dir), 2, bmp_z=m.bmp_z(), bmp_z_kp=m.bmp_z(kolari_pynnonen_adjust=True))


@query(P4 + f""", s AS (SELECT factor_name, abs(factor) * (1 + asset_id % 5) AS size, forward_return * sign(factor) AS x FROM panel WHERE factor <> 0),
r AS (SELECT factor_name, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS rf, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rr FROM s),
e AS (SELECT factor_name, v, atanh(v) * sqrt(n - 3) AS t, n, v * sqrt((n - 2) / (1 - v * v)) AS tt FROM (SELECT factor_name, {RHO} AS v, count(*) AS n FROM r GROUP BY ALL))""" + _union(_row("event_ic", "e", p_value=_t2("tt", "n - 2"))))
def event_ic_metric(spark, sf_dir):
    panel = _events(spark, sf_dir).withColumn("factor", F.col("factor") * (1 + F.col("asset_id") % 5))
    return _reported(spark, panel, 2, event_ic=m.event_ic())


@query(P4 + ", px AS (SELECT factor_name, date, asset_id, factor, " + ", ".join(f"{_at(a)} AS a{i}, {_at(b)} AS b{i}" for i, (_, a, b) in enumerate(_ENDS)) + " FROM panel WINDOW w AS (PARTITION BY factor_name, asset_id ORDER BY date)), e AS (" + " UNION ALL ".join(f"SELECT factor_name, {k} AS k, sign(factor) * (b{i} / a{i} - 1) AS x FROM px WHERE factor <> 0 AND a{i} >= 1e-9 AND b{i} IS NOT NULL" for i, (k, _, _) in enumerate(_ENDS)) + f""")
SELECT factor_name, round(avg(abs(mm)), {PLACES}) AS value FROM (SELECT factor_name, avg(x) AS mm FROM e WHERE k < 0 GROUP BY factor_name, k HAVING count(*) >= 5) GROUP BY ALL""")
def event_around_return_metric(spark, sf_dir):
    return _reported(spark, _events(spark, sf_dir), 2, event_around_return=m.event_around_return()).select("factor_name", "value")


@query(P4 + """, y AS (SELECT factor_name, factor, price AS entry, list(price) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS path FROM panel), z AS (SELECT factor_name, list_transform(path, lambda q: -sign(factor) * (q / entry - 1)) AS s FROM y WHERE factor <> 0 AND entry >= 1e-9 AND len(path) > 0),
l AS (SELECT factor_name, list_sort(list(list_max(s))) AS hi, list_sort(list(list_min(s))) AS lo, count(*) AS n FROM z GROUP BY ALL), q AS (SELECT factor_name, n, hi[CAST(floor(0.5 * (n - 1) + 0.5) AS INTEGER) + 1] AS best, abs(lo[CAST(floor(0.75 * (n - 1) + 0.5) AS INTEGER) + 1]) AS worst FROM l),
mm AS (SELECT factor_name, CASE WHEN worst > 1e-9 THEN best / worst ELSE 0 END AS v, NULL AS t, n FROM q)""" + _union(_row("mfe_mae", "mm")))
def mfe_mae_metric(spark, sf_dir):
    return _reported(spark, _events(spark, sf_dir).withColumn("factor", -F.col("factor")), 2, mfe_mae=m.mfe_mae(window=5))


# --- common signals ----------------------------------------------------------------


@query(P2 + f""", mo AS (SELECT factor_name, asset_id, count(*) AS n, var_samp(factor) AS vx, var_samp(forward_return) AS vy, covar_samp(factor, forward_return) AS cxy FROM panel GROUP BY ALL HAVING count(*) >= 20 AND var_samp(factor) > 1e-9),
f AS (SELECT factor_name, cxy / vx AS beta, CASE WHEN (n - 1) * vy > 1e-9 THEN cxy / vx * cxy / vy ELSE 0 END AS r2 FROM mo),
a AS (SELECT factor_name, {_mean_test('beta')} FROM f GROUP BY ALL), b AS (SELECT factor_name, avg(beta) FILTER (beta > 1e-9) - avg(beta) FILTER (beta < -1e-9) AS v, NULL AS t, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT factor_name, avg(r2) AS v, NULL AS t, count(*) AS n FROM f GROUP BY ALL), d AS (SELECT factor_name, greatest(avg(CASE WHEN beta > 0 THEN 1.0::DOUBLE ELSE 0 END), 1 - avg(CASE WHEN beta > 0 THEN 1.0::DOUBLE ELSE 0 END)) AS v, NULL AS t, count(*) AS n FROM f GROUP BY ALL)"""
    + _union(_row("common_beta", "a", p_value=_t2("t", "n - 1")), _row("common_beta_profile", "b"), _row("common_beta_r_squared", "c"), _row("common_beta_sign_consistency", "d")))
def common_beta_metrics(spark, sf_dir):
    return _reported(spark, _common(spark, sf_dir), H, common_beta=m.common_beta(), common_beta_profile=m.common_beta_profile(), common_beta_r_squared=m.common_beta_r_squared(), common_beta_sign_consistency=m.common_beta_sign_consistency())


@query(P2 + """, day AS (SELECT factor_name, date, avg(factor) AS f, avg(forward_return) AS r FROM panel GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_name) AS n, sign(f) AS side, CAST(least(floor((row_number() OVER (PARTITION BY factor_name ORDER BY f, date) - 1) * 5 / count(*) OVER (PARTITION BY factor_name)), 4) AS INTEGER) AS q FROM day),
k AS (SELECT *, CASE WHEN side <> 0 THEN (r - avg(r) OVER (PARTITION BY factor_name, side)) / count(*) OVER (PARTITION BY factor_name, side) ELSE 0 END AS x, CASE WHEN q IN (0, 4) THEN (r - avg(r) OVER (PARTITION BY factor_name, q)) / count(*) OVER (PARTITION BY factor_name, q) * (q - 2) / 2.0 ELSE 0 END AS y FROM s), """ + _bartlett("gx", "k", "x") + ", " + _bartlett("gy", "k", "y") + """,
a AS (SELECT factor_name, avg(r) FILTER (side > 0) + avg(r) FILTER (side < 0) AS v, (avg(r) FILTER (side > 0) + avg(r) FILTER (side < 0)) / sqrt(any_value(gx.meat)) AS t, any_value(n) AS n, any_value(n) - count(DISTINCT side) AS df FROM k JOIN gx USING (factor_name) GROUP BY ALL),
b AS (SELECT factor_name, avg(r) FILTER (q = 4) - avg(r) FILTER (q = 0) AS v, (avg(r) FILTER (q = 4) - avg(r) FILTER (q = 0)) / sqrt(any_value(gy.meat)) AS t, any_value(n) AS n FROM k JOIN gy USING (factor_name) GROUP BY ALL)""" + _union(_row("common_asymmetry", "a", p_value=_t2("t", "df")), _row("common_quantile_spread", "b", p_value=_t2("t", "n - 5"))))
def common_date_metrics(spark, sf_dir):
    return _reported(spark, _common(spark, sf_dir), H, common_asymmetry=m.common_asymmetry(), common_quantile_spread=m.common_quantile_spread())


# --- spanning and slices -------------------------------------------------------------


@query(_SPREAD.replace(f"date_ordinal % {H} = 0", "date_ordinal % 1 = 0") + f""", xy AS (SELECT a.spread AS y, b.spread AS x FROM spread a JOIN spread b ON a.date = b.date AND a.factor_name = 'factor' AND b.factor_name = 'factor2' WHERE a.spread IS NOT NULL AND b.spread IS NOT NULL),
o AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_samp(x, y) / var_samp(x) AS b, var_pop(y) * count(*) - covar_samp(x, y) / var_samp(x) * covar_pop(x, y) * count(*) AS rest FROM xy), a AS (SELECT n, my - b * mx AS v, (my - b * mx) / sqrt(rest / (n - 2) * (1.0 / n + mx * mx / sxx)) AS t FROM o)
SELECT round(v, {PLACES}) AS alpha, round(t, 6) AS t_stat, round({_t2('t', 'n - 2')}, 6) AS p_value, n AS n_obs FROM a""")
def spanning_alpha(spark, sf_dir):
    s = _spreads(spark, sf_dir)
    r = m.spanning_alpha(s["factor"], {"factor2": s["factor2"]})
    return spark.createDataFrame([(r.value, round(r.stat, 6), round(r.p_value, 6), r.n_obs)], "alpha double, t_stat double, p_value double, n_obs long")


_REGIONS = FR + f""", panel AS (SELECT r_name AS factor_name, fr.factor, fr.date, fr.asset_id, fr.forward_return FROM fr JOIN supplier ON s_suppkey = asset_id JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ranks AS (SELECT factor_name, date, {AVG_RANK.format(x='factor')} AS rf, {AVG_RANK.format(x='forward_return')} AS rr FROM panel), ic AS (SELECT factor_name, date, {RHO} AS ic FROM ranks GROUP BY ALL HAVING count(*) >= 2)"""


@query(_REGIONS + f""", own AS (SELECT * FROM ic WHERE ic IS NOT NULL AND date IN (SELECT date FROM ic WHERE ic IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT factor_name) FROM panel))),
d AS (SELECT a.factor_name || '|' || b.factor_name AS factor_name, a.factor_name AS slice_a, b.factor_name AS slice_b, date, a.ic - b.ic AS d FROM own a JOIN own b USING (date) WHERE a.factor_name < b.factor_name),
x AS (SELECT *, d - avg(d) OVER (PARTITION BY factor_name) AS e, row_number() OVER (PARTITION BY factor_name ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_name) AS n FROM d), {_bartlett('g', 'x', 'e')},
w AS (SELECT slice_a, slice_b, count(*) AS n, avg(d) AS m, avg(d) * avg(d) / (any_value(meat) / (count(*) * count(*))) AS w FROM x JOIN g USING (factor_name) GROUP BY ALL), r AS (SELECT *, {_t2('sqrt(w)', 'n - 1')} AS p FROM w),
k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS c FROM r)
SELECT slice_a, slice_b, n AS n_obs, round(m, {PLACES}) AS mean_diff, round(w, 6) AS stat, round(p, 6) AS p_raw, round(least(1.0::DOUBLE, max((c - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM k""")
def slice_pairwise(spark, sf_dir):
    panel = testdata.with_region(spark, sf_dir, _months(spark, sf_dir))
    found = slicing.slice_pairwise_test(panel, m.ic(), by="region", factor_col="factor")
    return spark.createDataFrame(found[["slice_a", "slice_b", "n_obs", "mean_diff"]].assign(**{c: found[c].round(6) for c in ("stat", "p_raw", "p_adj")}))


@query(_REGIONS + f""", x AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY date) - 1 AS i FROM ic WHERE ic IS NOT NULL),
s AS (SELECT factor_name AS slice, avg(ic) AS v, avg(ic) FILTER (i % {H} = 0) / (stddev_samp(ic) FILTER (i % {H} = 0) / sqrt(count(*) FILTER (i % {H} = 0))) AS t, count(*) AS n, count(*) FILTER (i % {H} = 0) AS k FROM x GROUP BY ALL HAVING count(*) >= {10 * H})
SELECT slice, round(v, {PLACES}) AS value, round(t, 6) AS stat, round({_t2('t', 'k - 1')}, 6) AS p_value, n AS n_obs FROM s""")
def by_slice(spark, sf_dir):
    panel = testdata.with_region(spark, sf_dir, _months(spark, sf_dir))
    found = slicing.by_slice(panel, m.ic(), by="region", factor_col="factor", forward_periods=H, strict=False)
    valued = {k: r.metric("ic") for k, r in found.items() if "ic" in r.metrics and r.metric("ic").is_applicable}
    return spark.createDataFrame([(k, r.value, round(r.stat, 6), round(r.p_value, 6), r.n_obs) for k, r in valued.items()], "slice string, value double, stat double, p_value double, n_obs long")
