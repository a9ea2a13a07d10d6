import numpy as np
import pandas as pd
import pytest

from panelspark.operators import metrics as m
from panelspark.plans import evaluate as ev
from panelspark.plans import families, slicing
from panelspark.plans.errors import UserInputError
from panelspark.plans.results import EvaluationResult, MetricResult


def series(n=60, column="spread", seed=0):
    return pd.DataFrame({"date": range(n), column: np.random.default_rng(seed).normal(0.2, 1, n)})


@pytest.mark.parametrize("make", [m.positive_rate, m.ic_trend, m.oos_decay])
def test_value_col_names_the_series(make):
    s = series()
    named, default = make(value_col="spread")(s, forward_periods=1), make()(s.rename(columns={"spread": "value"}), forward_periods=1)
    assert named.value == default.value == make()(s.rename(columns={"spread": "ic"}), forward_periods=1).value
    assert named.n_obs == 60


def test_value_before_ic_where_both_are_there():
    s = series(column="value").assign(ic=-1.0)
    assert m.positive_rate()(s, forward_periods=1).value > 0


def test_inference_objects():
    s = series(40, "value")
    assert m.NON_OVERLAPPING.min_input_periods(5) == 50 and m.NEWEY_WEST.min_input_periods(5) == 20 and m.STATIONARY_BOOTSTRAP.test == "bootstrap-mean"
    r = m.NON_OVERLAPPING.compute(s, forward_periods=2)
    x = s["value"].to_numpy()[::2]
    assert r.stat == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(20))) and r.metadata["n_obs_sampled"] == 20 and r.warnings == {"unreliable_se_short_periods"}
    assert m.ic(inference="newey_west") == m.ic(inference=m.NEWEY_WEST)


def test_params_are_part_of_identity(spark):
    result = lambda f, w, p: EvaluationResult(f, ("individual", "dense", "panel"), 5, 10, 10, 10, {"m": MetricResult(0.1, p, "two-sided")}, "", params={"window": w})
    table = families.results_table(spark, [result("a", 5, 0.01), result("a", 10, 0.04), result("b", 5, 0.2)])
    assert families.bhy(table, metrics=["m"]).count() == 3
    with pytest.raises(UserInputError):
        families.bhy(table.drop("window"), metrics=["m"])
    got = families.partial_conjunction(table.where("factor = 'a'"), metrics=["m"], min_pass=2, expand_over=("window",)).collect()
    assert [(r.factor, r.n_conditions, round(r.pc_p, 6)) for r in got] == [("a", 2, 0.04)]


def test_a_null_param_is_a_hypothesis_too(spark):
    rows = [(f, k, 5, 0.0, p, None, w) for f, w in [("a", None), ("b", "1")] for k, p in [("m", 0.01), ("n", 0.02)]]
    table = spark.createDataFrame(rows, families.RESULT_SCHEMA + ", w string")
    assert families.partial_conjunction_across_metrics(table, metrics=["m", "n"], min_pass=2).count() == 2


def panel(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(d, a, float(rng.normal()), float(rng.normal())) for d, k in enumerate(sizes) for a in range(k)]
    return spark.createDataFrame(rows, "date int, asset_id int, factor double, forward_return double")


def test_inspect_looks_at_dates_that_producers_keep(spark):
    found = ev.inspect_data(panel(spark, [12] * 30 + [1] * 30), forward_periods=1)
    assert found.properties["factor"].ic_dates == (30, 12, 12) and found.verdicts["ic"].tier == "clean"
    thin = ev.inspect_data(panel(spark, [12] * 15 + [2] * 20 + [4] * 30), forward_periods=1)
    assert any("n_assets_per_period_min=2" in x for x in thin.verdicts["ic"].cautions) and any("n_assets_per_period_min=4" in x for x in thin.verdicts["fm_beta"].cautions)
    two = ev.inspect_data(panel(spark, [2] * 30), forward_periods=1)
    assert any("n_assets_per_period_max=2" in x for x in two.verdicts["fm_beta"].blockers)


def test_short_metrics_warn(spark):
    (r,) = ev.evaluate(panel(spark, [12] * 8), metrics={"ic": m.ic()}, factor_cols=["factor"], forward_periods=1, strict=False)
    assert [(w.code, w.source) for w in r.warnings][0] == ("metric_unavailable", "ic") and r.warnings[0].message == "insufficient_ic_periods"


def test_strict_subsets(spark):
    keys = lambda *k: spark.createDataFrame([(x, x) for x in k], "date int, asset_id int")
    found = slicing.strict_subsets({"all": keys(1, 2, 3, 3), "some": keys(1, 2), "same": keys(3, 2, 1), "other": keys(3, 4)})
    assert found == [("some", "all"), ("some", "same")]
    assert slicing.strict_subsets({"one": keys(1)}) == []
    with pytest.raises(ValueError, match="lacks"):
        slicing.strict_subsets({"a": keys(1), "b": keys(1).drop("date")})


def test_metric_decorator(spark):
    @m.metric(m.ic, needs=("forward_return",), threshold=m.Threshold(min_periods=5))
    def best_ic(s, c, share: float = 1.0):
        """Highest rank correlation."""
        return MetricResult(float(s["ic"].max()) * share, n_obs=len(s), n_obs_axis="periods")

    try:
        data = panel(spark, [12] * 30)
        metrics = {"ic": m.ic(), "best": best_ic(), "half": best_ic(share=0.5)}
        (r,) = ev.evaluate(data, metrics=metrics, factor_cols=["factor"], forward_periods=1)
        assert r.metric("half").value == r.metric("best").value / 2 > 0 and len(r.plan.splitlines()) == 1
        assert ev.spec_by_name("best_ic") is best_ic
        with pytest.raises(ValueError, match="exists"):
            m.metric(m.ic)(best_ic)
    finally:
        m.REGISTRY.pop("best_ic")
