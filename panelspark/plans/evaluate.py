"""Evaluation: detect each signal's cell, plan the series once, summarise all signals together.

A job finds the facts of every signal, then each distinct series is one plan over
all signals of a cell, and the summaries of all metrics come back as one small table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel import dates, long_panel
from ..operators import metrics as m
from ..operators import producers as p
from ..operators.metrics import COMMON, DENSE, INDIVIDUAL, PANEL, REGISTRY, SPARSE, TIMESERIES, Context, Metric
from ..operators.preprocess import HORIZON, compute_forward_return
from .errors import IncompatibleAxisError, InsufficientSampleError, UserInputError
from .results import EvaluationResult, MetricResult, Warning, number

SPARSE_RATIO, LOW_CARDINALITY, WARN_DATE_ASSETS = 0.5, 5, 10
_SUMMARY = "factor_name string, label string, payload string"


@dataclass(frozen=True)
class Facts:
    """What one job tells of a signal."""

    factor: str
    n_periods: int
    n_assets: int
    n_pairs: int
    n_events: int
    n_assets_sampled: int
    zero_ratio: float
    max_distinct_per_date: int
    n_distinct: int
    constant_magnitude: bool
    ic_dates: tuple[int, int, int] = (0, 0, 0)  # dates with a rank correlation, their fewest pairs, the most pairs of any date
    fm_dates: tuple[int, int, int] = (0, 0, 0)  # the same for a per-date slope

    @property
    def cell(self) -> tuple[str, str, str]:
        scope = COMMON if self.n_assets <= 1 or self.max_distinct_per_date <= 1 else INDIVIDUAL
        return scope, SPARSE if self.zero_ratio >= SPARSE_RATIO else DENSE, TIMESERIES if self.n_assets <= 1 else PANEL


def facts(panel: DataFrame, h: int) -> dict[str, Facts]:
    """Facts of every signal of a long panel, in one collected row per signal."""
    sampled = panel.join(F.broadcast(dates(panel).withColumn("sampled", F.col("date_ordinal") % max(h, 1) == 0).drop("date_ordinal")), "date")
    x, ret = F.col("factor"), F.col("forward_return") if "forward_return" in panel.columns else F.lit(0.0)
    pair = x.isNotNull() & ret.isNotNull()
    dated = sampled.groupBy("factor_name", "date").agg((F.countDistinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))).alias("k"), F.count(F.when(pair, 1)).alias("pairs"), F.var_samp(F.when(pair, x)).alias("v"))
    ranked, sloped = F.col("pairs") >= p.MIN_IC_ASSETS, (F.col("pairs") >= p.MIN_FM_ASSETS) & (F.col("v") > 0)
    stage = lambda c, name: F.struct(F.count(F.when(c, 1)), F.coalesce(F.min(F.when(c, F.col("pairs"))), F.lit(0)), F.max("pairs")).alias(name)
    per_date = dated.groupBy("factor_name").agg(F.max("k").alias("k"), F.count("*").alias("n_periods"), stage(ranked, "ic_dates"), stage(sloped, "fm_dates"))
    whole = sampled.groupBy("factor_name").agg(
        F.countDistinct("asset_id").alias("n_assets"),
        F.countDistinct(F.when(F.col("sampled"), F.col("asset_id"))).alias("n_assets_sampled"),
        F.count(F.when(x.isNotNull() & ret.isNotNull(), 1)).alias("n_pairs"),
        F.count(F.when(x != 0, 1)).alias("n_events"),
        F.count(F.when(x == 0, 1)).alias("zeros"),
        F.count(x).alias("valid"),
        F.approx_count_distinct(x).alias("n_distinct"),
        (F.max(F.when(x != 0, F.abs(x))) - F.min(F.when(x != 0, F.abs(x)))).alias("magnitude_range"),
    )
    found = whole.join(per_date, "factor_name").collect()
    few = [r.factor_name for r in found if r.n_distinct <= 64]  # an estimate that low can't hide a count near the gate
    exact = {r.factor_name: r.k for r in panel.where(F.col("factor_name").isin(few)).groupBy("factor_name").agg(F.countDistinct(x).alias("k")).collect()} if few else {}
    out = {}
    for r in found:
        ratio = r.zeros / r.valid if r.valid else float("nan")
        out[r.factor_name] = Facts(r.factor_name, r.n_periods, r.n_assets, r.n_pairs, r.n_events, r.n_assets_sampled, ratio, r.k, exact.get(r.factor_name, r.n_distinct), r.magnitude_range is not None and r.magnitude_range < m.EPSILON, tuple(r.ic_dates), tuple(r.fm_dates))
    return out


def _columns(data: DataFrame, factor_cols: list[str]) -> None:
    if not isinstance(data, DataFrame):
        raise TypeError(f"expected a Spark DataFrame, got {type(data).__name__}; use spark.createDataFrame")
    for c in ("date", "asset_id", "forward_return"):
        if c not in data.columns:
            raise UserInputError("evaluate", "data", c, "a panel with date, asset_id and forward_return", data.columns)
    if not factor_cols or len(set(factor_cols)) != len(factor_cols):
        raise UserInputError("evaluate", "factor_cols", factor_cols, "a non-empty list of distinct columns")
    for f in factor_cols:
        if f not in data.columns:
            raise UserInputError("evaluate", "factor_cols", f, "a column of the panel", data.columns)
        if not isinstance(data.schema[f].dataType, T.NumericType):
            raise UserInputError("evaluate", "factor_cols", f, "a numeric column")


def horizon(data: DataFrame, declared: int | None, default: int | None = 5) -> int:
    """The panel's stamped horizon, or the declared one; they must agree."""
    stamped = None
    if HORIZON in data.columns:
        row = data.select(HORIZON).first()
        stamped = None if row is None else int(row[0])
    if stamped is not None and declared is not None and stamped != declared:
        raise UserInputError("evaluate", "forward_periods", declared, f"the panel's horizon {stamped}")
    return stamped or declared or default


def _matches(metric: Metric, cell: tuple, override: bool) -> bool:
    scope, density, structure = metric.cell
    return (scope is None or scope == cell[0]) and (density is None or density == cell[1] or override and density == SPARSE) and (structure is None or structure == cell[2])


def _check_metrics(metrics: dict) -> None:
    if not isinstance(metrics, dict) or not metrics:
        raise UserInputError("evaluate", "metrics", metrics, "a non-empty dict of label to metric instance")
    for label, x in metrics.items():
        if isinstance(x, type):
            raise UserInputError("evaluate", f"metrics[{label!r}]", x.__name__, f"an instance: {x.__name__}()")
        if not isinstance(x, Metric):
            raise UserInputError("evaluate", f"metrics[{label!r}]", x, "a metric instance", sorted(REGISTRY))


def _payload(r: MetricResult) -> str:
    special = lambda x: x if x is None or number(x) is not None else str(float(x))
    return json.dumps({"value": special(r.value), "p_value": r.p_value, "alternative": r.alternative, "n_obs": r.n_obs, "n_obs_axis": r.n_obs_axis, "stat": special(r.stat), "metadata": r.metadata, "warning_codes": list(r.warning_codes)}, default=float)


def _unpack(label: str, payload: str) -> MetricResult:
    d = json.loads(payload)
    for k in ("value", "stat"):
        if isinstance(d[k], str):
            d[k] = float(d[k])
    if d["value"] is None:
        d["value"] = float("nan")
    return MetricResult(**{**d, "warning_codes": tuple(d["warning_codes"])}, name=label)


def _summariser(chosen: list[tuple[str, Metric]], contexts: dict[str, Context]):
    def run(s: pd.DataFrame) -> pd.DataFrame:
        factor = s["factor_name"].iloc[0]
        return pd.DataFrame([(factor, label, _payload(x.summarise(s, contexts[factor]))) for label, x in chosen], columns=["factor_name", "label", "payload"])

    return run


def plan_text(metrics: dict[str, Metric], h: int) -> str:
    """One line per distinct series and the metrics that share it."""
    shared: dict[tuple, list[str]] = {}
    for label, x in metrics.items():
        shared.setdefault(x.source_key(h), []).append(label)
    return "\n".join(f"{k[0]}({', '.join(f'{a}={b}' if isinstance(i, tuple) else str(i) for i in k[1:] for a, b in [i if isinstance(i, tuple) else (i, i)])}) -> {', '.join(v)}" for k, v in shared.items())


def run_metrics(panel: DataFrame, metrics: dict[str, Metric], known: dict[str, Facts], h: int) -> dict[tuple[str, str], MetricResult]:
    """Results by (signal, label): one plan per distinct series, one action for all of them."""
    columns = tuple(panel.columns)
    contexts = {f: Context(h, k.n_periods, k.n_assets, k.n_assets_sampled, columns) for f, k in known.items()}
    out: dict[tuple[str, str], MetricResult] = {}
    shared: dict[tuple, list[tuple[str, Metric]]] = {}
    for label, x in metrics.items():
        reason = x.missing(columns)
        if reason:
            out |= {(f, label): m.short(reason, descriptive=isinstance(x, m.event_around_return | m.directional_pair_accuracy)) for f in known}
        else:
            shared.setdefault(x.source_key(h), []).append((label, x))
    tables = []
    for chosen in shared.values():
        series = chosen[0][1].source(panel, h)
        tables.append(series.groupBy("factor_name").applyInPandas(_summariser(chosen, contexts), _SUMMARY))
    if tables:
        for r in reduce(DataFrame.unionByName, tables).collect():
            out[r.factor_name, r.label] = _unpack(r.label, r.payload)
    empty = pd.DataFrame({c: [] for c in ("date", "ic", "beta", "spread", "caar", "sar", "rho", "eff_n", "n_top", "n_assets", "n_rows", "n_unique", "r_squared", "f", "r", "spread_vw", "zero_variance", "turnover", "rc")})
    for f in known:  # signals of which no row was left have no group
        for label, x in metrics.items():
            out.setdefault((f, label), x.summarise(empty, contexts[f]) if (f, label) not in out else None)
    return out


def evaluate(data: DataFrame, *, metrics: dict[str, Metric], factor_cols: list[str], forward_periods: int | None = None, strict: bool = True, expected_warnings: tuple[str, ...] = ()) -> list[EvaluationResult]:
    """One result per signal with all metrics that apply to it.

    Under ``strict``, a metric of another cell, or one that lacks the data it needs,
    raises; otherwise it is left out or comes back not applicable with its reason.
    """
    _check_metrics(metrics)
    _columns(data, factor_cols)
    h = horizon(data, forward_periods)
    panel = long_panel(data.drop(HORIZON), factor_cols).persist()
    try:
        known = facts(panel, h)
        by_cell: dict[tuple, list[str]] = {}
        for f in factor_cols:
            if f not in known:
                raise UserInputError("evaluate", "data", f, "a panel with rows")
            by_cell.setdefault((known[f].cell, 0 < known[f].zero_ratio < SPARSE_RATIO), []).append(f)
        found: dict[tuple[str, str], MetricResult] = {}
        notes: dict[str, list[Warning]] = {f: [] for f in factor_cols}
        for (cell, frequent), names in by_cell.items():
            runnable = {k: x for k, x in metrics.items() if _matches(x, cell, frequent)}
            foreign = [k for k in metrics if k not in runnable]
            if foreign and strict:
                raise IncompatibleAxisError(f"{', '.join(foreign)} don't apply to {', '.join(names)}, whose cell is {cell}")
            own = panel if len(names) == len(factor_cols) else panel.where(F.col("factor_name").isin(names))
            found |= run_metrics(own, runnable, {f: known[f] for f in names}, h)
            for f in names:
                notes[f] += [Warning("structure_mismatch", k, f"the metric's cell is {metrics[k].cell}", "structure_mismatch" in expected_warnings) for k in foreign]
                if frequent and any(x.cell[1] == SPARSE for x in runnable.values()):
                    notes[f].append(Warning("frequent_event_signal", None, f"{known[f].zero_ratio:.0%} of the signal is zero", "frequent_event_signal" in expected_warnings))
    finally:
        panel.unpersist()
    results = []
    for f in factor_cols:
        own = {k: found[f, k] for k in metrics if (f, k) in found}
        for k, r in own.items():
            if strict and r.value != r.value and r.reason and not r.reason.startswith("not_applicable"):
                raise InsufficientSampleError(f"{k} on {f}: {r.reason} {({x: v for x, v in r.metadata.items() if x != 'reason'})}")
            if r.value != r.value and r.reason:
                code = "upstream_unavailable" if r.reason == "upstream_unavailable" else "metric_unavailable"
                notes[f].append(Warning(code, k, r.reason, code in expected_warnings))
            notes[f] += [Warning(code, k, "", code in expected_warnings) for code in r.warning_codes]
        k = known[f]
        results.append(EvaluationResult(f, k.cell, h, k.n_periods, k.n_pairs, k.n_assets, own, plan_text(metrics, h), warnings=notes[f]))
    return results


def evaluate_horizons(data: DataFrame, *, metrics: dict[str, Metric], factor_cols: list[str], forward_periods: list[int], strict: bool = True, expected_warnings: tuple[str, ...] = ()) -> list[EvaluationResult]:
    """Evaluate at several horizons, each from the raw prices."""
    if not forward_periods or len(set(forward_periods)) != len(forward_periods):
        raise UserInputError("evaluate_horizons", "forward_periods", forward_periods, "a non-empty list of distinct horizons")
    out = []
    for h in forward_periods:
        out += evaluate(compute_forward_return(data, h), metrics=metrics, factor_cols=factor_cols, strict=strict, expected_warnings=expected_warnings)
    return out


def compare(results: list[EvaluationResult], *, metrics: list[str], spark, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """A row per result with each metric's value and p value; ranked when sorted, nulls last."""
    if not results or not metrics:
        raise UserInputError("compare", "results", results, "non-empty lists")
    params = list(dict.fromkeys(k for r in results for k in r.params))
    rows = []
    for r in results:
        for k in metrics:
            if k not in r.metrics:
                raise UserInputError("compare", "metrics", k, f"a metric on every result; missing on {r.factor}", sorted(r.metrics))
        rows.append((r.factor, r.forward_periods, *(None if r.params.get(k) is None else str(r.params[k]) for k in params), *(x for k in metrics for x in (number(r.metrics[k].value), number(r.metrics[k].p_value)))))
    schema = ", ".join(["factor string", "forward_periods int", *(f"`{k}` string" for k in params), *(f"`{k}` double, `{k}_p_value` double" for k in metrics)])
    table = spark.createDataFrame(rows, schema)
    if sort_by is None:
        return table
    if sort_by not in table.columns:
        raise UserInputError("compare", "sort_by", sort_by, "a column of the table", table.columns)
    from pyspark.sql import Window

    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return table.withColumn("rank", F.row_number().over(Window.orderBy(order, "factor", "forward_periods")).cast("long")).orderBy("rank")


# --- inspection and catalogue ---------------------------------------------------------


@dataclass(frozen=True)
class Verdict:
    metric: str
    tier: str  # clean, degraded or unusable
    blockers: tuple[str, ...] = ()
    cautions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Inspection:
    properties: dict[str, Facts]
    cell: tuple[str, str, str]
    verdicts: dict[str, Verdict]
    warnings: tuple[Warning, ...]

    def usable(self) -> list[str]:
        return [k for k, v in self.verdicts.items() if v.tier != "unusable"]


def judge(metric: Metric, k: Facts, h: int, columns) -> Verdict:
    """Whether a metric can run on a signal, from its cell, its columns and its floors."""
    blockers, cautions = [], []
    if not _matches(metric, k.cell, 0 < k.zero_ratio < SPARSE_RATIO):
        blockers.append(f"cell {k.cell} does not match {metric.cell}")
    if reason := metric.missing(columns):
        blockers.append(reason)
    if metric.continuous_magnitude and k.constant_magnitude:
        blockers.append("not_applicable_discrete_signal")
    limit = metric.threshold(h)
    n_periods = k.n_periods
    first_stage = {"compute_ic": (k.ic_dates, p.MIN_IC_ASSETS), "compute_fm_betas": (k.fm_dates, p.MIN_FM_ASSETS)}.get(metric.producer)
    if first_stage and "forward_return" in columns:
        (n_periods, fewest, most), floor = first_stage
        if most < floor:
            blockers.append(f"n_assets_per_period_max={most} below {floor}")
        elif not n_periods:
            blockers.append("no date on which the signal varies")
        elif fewest < WARN_DATE_ASSETS:
            cautions.append(f"n_assets_per_period_min={fewest} below {WARN_DATE_ASSETS}")
    for axis, have in (("periods", n_periods), ("assets", k.n_assets), ("pairs", k.n_pairs), ("events", k.n_events)):
        floor, warn = getattr(limit, f"min_{axis}", None), getattr(limit, f"warn_{axis}", None)
        if floor is not None and have < floor:
            blockers.append(f"n_{axis}={have} below {floor}")
        elif warn is not None and have < warn:
            cautions.append(f"n_{axis}={have} below {warn}")
    return Verdict(metric.name, "unusable" if blockers else "degraded" if cautions else "clean", tuple(blockers), tuple(cautions))


def inspect_data(data: DataFrame, factor_cols: list[str] | None = None, *, forward_periods: int | None = None) -> Inspection:
    """Properties of the signals and, from the first one's, what each metric can do."""
    reserved = {"date", "asset_id", "forward_return", "price", HORIZON}
    if factor_cols is None:
        factor_cols = [f.name for f in data.schema.fields if f.name not in reserved and isinstance(f.dataType, T.NumericType)]
    if not factor_cols:
        raise UserInputError("inspect_data", "factor_cols", factor_cols, "at least one numeric signal column")
    h = horizon(data, forward_periods)
    known = facts(long_panel(data.drop(HORIZON), factor_cols), h)
    first = known[factor_cols[0]]
    notes = []
    for f in factor_cols[1:]:
        notes += [Warning("cross_factor_scope_mismatch", f)] * (known[f].cell[0] != first.cell[0]) + [Warning("cross_factor_density_mismatch", f)] * (known[f].cell[1] != first.cell[1])
    if first.cell[1] == DENSE and first.n_distinct <= LOW_CARDINALITY:
        notes.append(Warning("low_cardinality_dense_signal", first.factor))
    if first.cell[1] == SPARSE and first.n_assets <= 1:
        notes.append(Warning("single_asset_event_data", first.factor))
    verdicts = {k: judge(x(), first, h, data.columns) for k, x in sorted(REGISTRY.items())}
    return Inspection(known, first.cell, verdicts, tuple(notes))


def list_metrics() -> list[str]:
    return sorted(REGISTRY)


def spec_by_name(name: str) -> type[Metric]:
    if name not in REGISTRY:
        raise UserInputError("spec_by_name", "name", name, "a metric's name", sorted(REGISTRY))
    return REGISTRY[name]


def metrics_summary(spark) -> DataFrame:
    """The catalogue as a table."""
    star = lambda x: "*" if x is None else x
    rows = [(k, *(star(x) for x in v.cell), v.aggregation, v.producer or None, v.boundary_sensitive, v.continuous_magnitude, [f.name for f in fields(v)]) for k, v in sorted(REGISTRY.items())]
    return spark.createDataFrame(rows, "name string, scope string, density string, structure string, aggregation string, producer string, slice_boundary_sensitive boolean, requires_continuous_magnitude boolean, parameters array<string>")


def register(metric: type[Metric]) -> type[Metric]:
    """Add a third-party metric class; subclasses of Metric register themselves, this checks the name."""
    if not issubclass(metric, Metric) or REGISTRY.get(metric.__name__, metric) is not metric:
        raise UserInputError("register", "metric", metric, "a Metric subclass with a name of its own")
    REGISTRY[metric.__name__] = metric
    return metric
