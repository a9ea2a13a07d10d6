"""Multiple testing over families of results, as window queries on a results table.

A results table has the columns factor, metric, forward_periods, p_value and reason; any
further column is a parameter or condition and part of a hypothesis' identity.  Ranks, running extremes and family sizes are windows, so a
family may be as large as the cluster can sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import UserInputError

IDENTITY = ("factor", "forward_periods")
MEASURED = ("metric", "value", "p_value", "reason")
RESULT_SCHEMA = "factor string, metric string, forward_periods int, value double, p_value double, reason string"


def results_table(spark, results) -> DataFrame:
    """EvaluationResults as rows, their params as string columns."""
    params = list(dict.fromkeys(k for r in results for k in r.params))
    rows = [(r.factor, label, r.forward_periods, x.value, x.p_value, x.reason, *(None if r.params.get(k) is None else str(r.params[k]) for k in params)) for r in results for label, x in r.metrics.items()]
    return spark.createDataFrame(rows, ", ".join([RESULT_SCHEMA, *(f"`{k}` string" for k in params)]))


def _checked(table: DataFrame, metrics: list[str], keys: list[str], func: str, q: float) -> DataFrame:
    if isinstance(q, bool) or not 0 < q < 1:
        raise UserInputError(func, "q", q, "a number in (0, 1)")
    if not isinstance(metrics, list) or not metrics or len(set(metrics)) != len(metrics):
        raise UserInputError(func, "metrics", metrics, "a non-empty list of distinct labels")
    own = table.where(F.col("metric").isin(metrics))
    bad = own.groupBy("metric", *keys).agg(F.count("*").alias("k"), F.max(F.col("p_value").isNull() | F.isnan("p_value")).alias("none")).where("k > 1 or none").limit(1).collect()
    if bad:
        raise UserInputError(func, "results", bad[0].asDict(), "one p value for each metric and identity")
    return own


def identity(table: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that tell hypotheses apart: signal, horizon and every parameter, less those that replicate them."""
    return [c for c in (*IDENTITY, *(x for x in table.columns if x not in (*IDENTITY, *MEASURED))) if c not in exclude]


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: exact below 1000, beyond by its expansion (error under 1e-15)."""
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(1000)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / k)
    x = m.cast("double")
    return F.when(m <= 1000, exact).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x))


def adjust(table: DataFrame, p: str, family: list[str], method: str = "bhy", n_tests: Column | None = None) -> DataFrame:
    """Add ``adj_p``: step-up BHY or step-down Holm within each family; rows with a null p have none and don't count."""
    rows = Window.partitionBy(*family, F.col(p).isNull())
    m = n_tests if n_tests is not None else F.count(p).over(rows)
    ranked = table.withColumn("_k", F.row_number().over(rows.orderBy(p))).withColumn("_m", m)
    if method == "bhy":
        ranked = ranked.withColumn("_s", F.col("_m") * harmonic(F.col("_m")) / F.col("_k") * F.col(p))
        best = F.min("_s").over(rows.orderBy("_k").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    else:
        ranked = ranked.withColumn("_s", (F.col("_m") - F.col("_k") + 1) * F.col(p))
        best = F.max("_s").over(rows.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("adj_p", F.when(F.col(p).isNotNull(), F.least(best, F.lit(1.0)))).drop("_k", "_m", "_s")


def _active(p: str = "p_value") -> Column:
    return F.when(F.coalesce(~F.col("reason").startswith("insufficient_"), F.lit(True)), F.col(p))


def bhy(table: DataFrame, *, metrics: list[str], expand_over: tuple[str, ...] = (), q: float = 0.05) -> DataFrame:
    """BHY per metric and bucket of ``expand_over``; rows short of a sample are not hypotheses."""
    own = _checked(table, metrics, identity(table), "bhy", q).withColumn("_p", _active())
    return adjust(own, "_p", ["metric", *expand_over]).drop("_p").withColumn("survived", F.coalesce(F.col("adj_p") <= q, F.lit(False)))


def bhy_across_metrics(table: DataFrame, *, metrics: list[str], expand_over: tuple[str, ...] = (), q: float = 0.05) -> DataFrame:
    """BHY over all pairs of signal and metric together."""
    if len(metrics) < 2:
        raise UserInputError("bhy_across_metrics", "metrics", metrics, "at least two labels")
    own = _checked(table, metrics, identity(table), "bhy_across_metrics", q).withColumn("_p", _active())
    return adjust(own, "_p", list(expand_over) or [F.lit(1)]).drop("_p").withColumn("survived", F.coalesce(F.col("adj_p") <= q, F.lit(False)))


def _conjunction(rows: DataFrame, keys: list[str], p: str, min_pass: int, *more: Column) -> DataFrame:
    """(m - k + 1) times the k-th smallest p of each group, and ``more`` aggregates of it."""
    ordered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(p))))
    return ordered.groupBy(*keys).agg(F.count(p).alias("n_conditions"), F.max(F.when(F.col("_k") == min_pass, F.col(p))).alias("_kth"), *more).withColumn("pc_p", F.least((F.col("n_conditions") - min_pass + 1) * F.col("_kth"), F.lit(1.0))).drop("_kth")


def partial_conjunction(table: DataFrame, *, metrics: list[str], min_pass: int, expand_over: tuple[str, ...], n_conditions: int | None = None, q: float = 0.05) -> DataFrame:
    """Signals that hold under at least ``min_pass`` conditions, BHY over signals per metric."""
    if not expand_over:
        raise UserInputError("partial_conjunction", "expand_over", expand_over, "the condition columns")
    own = _checked(table, metrics, identity(table), "partial_conjunction", q)
    keys = ["metric", *identity(table, expand_over)]
    each = _conjunction(own, keys, "p_value", min_pass)
    bound = n_conditions if n_conditions is not None else 0
    low = each.where((F.col("n_conditions") < min_pass) | (F.lit(bound) > 0) & (F.col("n_conditions") != bound)).limit(1).collect()
    if low:
        raise UserInputError("partial_conjunction", "results", low[0].asDict(), f"{bound or f'at least {min_pass}'} conditions for each signal")
    return adjust(each, "pc_p", ["metric"]).withColumn("survived", F.col("adj_p") <= q)


def partial_conjunction_across_metrics(table: DataFrame, *, metrics: list[str], min_pass: int, q: float = 0.05) -> DataFrame:
    """Signals that pass at least ``min_pass`` metrics; a metric short of a sample counts as p = 1, a signal with too few others has none."""
    keys = identity(table)
    own = _checked(table, metrics, keys, "partial_conjunction_across_metrics", q)
    if not 1 <= min_pass <= len(metrics):
        raise UserInputError("partial_conjunction_across_metrics", "min_pass", min_pass, f"1..{len(metrics)}")
    own = own.withColumn("_a", _active()).withColumn("_p", F.coalesce("_a", F.lit(1.0)))
    each = _conjunction(own, keys, "_p", min_pass, F.count("_a").alias("n_active"))
    each = each.withColumn("pc_p", F.when(F.col("n_active") >= min_pass, F.col("pc_p")))
    return adjust(each, "pc_p", [F.lit(1)]).withColumn("survived", F.coalesce(F.col("adj_p") <= q, F.lit(False)))


def simes(rows: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """Simes p of each group."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_s", F.col(p) * F.count(p).over(by) / F.row_number().over(by.orderBy(p)))
    return ranked.groupBy(*keys).agg(F.least(F.min("_s"), F.lit(1.0)).alias("simes_p"))


def bhy_hierarchical(table: DataFrame, *, metrics: list[str], group: str, q: float = 0.05) -> DataFrame:
    """The larger of BHY over groups' Simes p and BHY within the group."""
    own = _checked(table, metrics, identity(table), "bhy_hierarchical", q)
    outer = adjust(simes(own, ["metric", group]), "simes_p", ["metric"]).withColumnRenamed("adj_p", "outer_p").drop("simes_p")
    inner = adjust(own, "p_value", ["metric", group]).withColumnRenamed("adj_p", "inner_p")
    return inner.join(outer, ["metric", group]).withColumn("adj_p", F.greatest("inner_p", "outer_p")).withColumn("survived", F.col("adj_p") <= q)
