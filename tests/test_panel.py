import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.panel import long_panel
from panelspark.operators import metrics as m
from panelspark.operators import preprocess as pre
from panelspark.operators import producers as p
from panelspark.plans import evaluate as ev
from panelspark.plans import families, slicing
from panelspark.plans.errors import IncompatibleAxisError, IncompatibleInferenceError, InsufficientSampleError, UserInputError
from panelspark.sources import datasets
from panelspark.sources.adapt import adapt


@pytest.fixture(scope="module")
def golden(spark):
    return pre.compute_forward_return(datasets.make_cs_panel(spark, n_assets=80, n_dates=180, seed=0), 5).persist()


@pytest.fixture(scope="module")
def events(spark):
    return pre.compute_forward_return(datasets.make_event_panel(spark, n_assets=20, n_dates=120, event_rate=0.05, event_magnitude_jitter=0.5, seed=1), 5).persist()


def test_golden_rank_correlation(golden):
    (r,) = ev.evaluate(golden, metrics={"ic": m.ic()}, factor_cols=["factor"])
    assert r.metrics["ic"].value == pytest.approx(0.049163258267725024, rel=1e-12)
    assert r.metrics["ic"].stat == pytest.approx(4.136962357146272, rel=1e-11)
    assert r.metrics["ic"].p_value == pytest.approx(0.00021830177834358518, rel=1e-10)
    s = p.compute_ic(long_panel(golden, ["factor"])).toPandas().sort_values("date")["ic"].to_numpy()
    assert m.infer(m.NON_OVERLAPPING, s, 1)[0] == pytest.approx(5.404723194889399, rel=1e-11)


def test_direct_call_equals_evaluation(golden):
    panel = long_panel(golden, ["factor"])
    (r,) = ev.evaluate(golden, metrics={"ic": m.ic(), "fm": m.fm_beta(), "spread": m.quantile_spread()}, factor_cols=["factor"])
    assert m.ic()(p.compute_ic(panel)).p_value == pytest.approx(r.metrics["ic"].p_value, rel=1e-9)
    assert m.fm_beta()(p.compute_fm_betas(panel)).stat == pytest.approx(r.metrics["fm"].stat, rel=1e-9)
    assert m.quantile_spread()(m.quantile_spread().source(panel, 5), n_periods=r.n_periods).value == pytest.approx(r.metrics["spread"].value, rel=1e-9)


def test_forward_return_by_hand(spark):
    rows = [(d, a, float(x)) for a, xs in {"A": [100, 110, 121, 133.1, 146.41], "B": [200, 190, 180, 170, 160]}.items() for d, x in enumerate(xs)]
    raw = spark.createDataFrame(rows, "date int, asset_id string, price double")
    out = pre.compute_forward_return(raw, 1).orderBy("asset_id", "date").collect()
    assert [round(r.forward_return, 12) for r in out if r.asset_id == "A"] == [0.1, 0.1, 0.1]
    with pytest.raises(UserInputError):
        pre.compute_forward_return(pre.compute_forward_return(raw, 1), 1)
    with pytest.raises(UserInputError):
        pre.compute_forward_return(raw, True)
    with pytest.raises(UserInputError):
        pre.compute_forward_return(raw, 9)


def test_preprocess_by_hand(spark):
    rows = [(0, i, float(x), float(x)) for i, x in enumerate([1, 2, 3, 4, 100])]
    panel = spark.createDataFrame(rows, "date int, asset_id int, factor double, forward_return double")
    z = {r.asset_id: r.factor_zscore for r in pre.cross_sectional_zscore(panel).collect()}
    assert z[0] == pytest.approx(-2 / 1.4826) and z[2] == 0
    w = {r.asset_id: r.factor for r in pre.mad_winsorize(panel, n_mad=2).collect()}
    assert w[4] == pytest.approx(3 + 2 * 1.4826)
    c = {r.asset_id: r.forward_return for r in pre.winsorize_forward_return(panel, 0.2, 0.8).collect()}
    assert c == {0: 2.0, 1: 2.0, 2: 3.0, 3: 4.0, 4: 4.0}
    assert sum(r.abnormal_return for r in pre.compute_abnormal_return(panel).collect()) == pytest.approx(0)


def test_orthogonalize_is_least_squares(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"date": np.repeat(range(3), 20), "asset_id": np.tile(range(20), 3), "factor": rng.normal(size=60), "a": rng.normal(size=60), "b": rng.normal(size=60)})
    out = pre.orthogonalize_factor(spark.createDataFrame(pdf[["date", "asset_id", "factor"]]), spark.createDataFrame(pdf[["date", "asset_id", "a", "b"]].iloc[:50]))
    got = out.data.toPandas().sort_values(["date", "asset_id"])
    assert out.n_dates == 3 and out.coverage == pytest.approx(50 / 60) and out.n_base == 2
    one = pdf[pdf.date == 0]
    x = np.column_stack([np.ones(20), one[["a", "b"]]])
    want = one.factor - x @ np.linalg.lstsq(x, one.factor, rcond=None)[0]
    assert np.allclose(got[got.date == 0]["factor"], want)
    assert np.allclose(got["factor"].to_numpy()[50:], pdf["factor"].to_numpy()[50:])


def test_regressions_match_lstsq(golden):
    panel = long_panel(golden, ["factor"])
    pdf = golden.toPandas()
    beta = {r.date: r.beta for r in p.compute_fm_betas(panel).collect()}
    for d, g in list(pdf.groupby("date"))[:10]:
        assert beta[d.to_pydatetime()] == pytest.approx(np.polyfit(g["factor"], g["forward_return"], 1)[0], rel=1e-8)
    each = {r.asset_id: r for r in p.compute_common_betas(panel).collect()}
    for a, g in list(pdf.groupby("asset_id"))[:10]:
        x = np.column_stack([np.ones(len(g)), g["factor"]])
        b = np.linalg.lstsq(x, g["forward_return"], rcond=None)[0]
        e = g["forward_return"] - x @ b
        se = math.sqrt(e @ e / (len(g) - 2) * np.linalg.inv(x.T @ x)[1, 1])
        assert each[a].beta == pytest.approx(b[1]) and each[a].alpha == pytest.approx(b[0]) and each[a].t_stat == pytest.approx(b[1] / se)


def test_rolling_beta_excludes_the_date(golden):
    got = {r.date: r.value for r in p.compute_rolling_common_beta(long_panel(golden, ["factor"]), 30).collect()}
    pdf = golden.toPandas().sort_values("date")
    days = sorted(pdf["date"].unique())
    for i in (30, 77):
        own = pdf[pdf["date"].isin(days[i - 30 : i])]
        want = np.mean([np.polyfit(g["factor"], g["forward_return"], 1)[0] for _, g in own.groupby("asset_id")])
        assert got[pd.Timestamp(days[i]).to_pydatetime()] == pytest.approx(want, rel=1e-7)
    assert len(got) == len(days) - 30


def test_spread_by_hand(spark):
    rows = [(0, i, float(i), i / 100) for i in range(10)] + [(1, i, 1.0, i / 100) for i in range(10)]
    panel = long_panel(spark.createDataFrame(rows, "date int, asset_id int, factor double, forward_return double"), ["factor"])
    s = {r.date: r for r in p.compute_spread_series(panel, 1, 5).collect()}
    assert s[0].spread == pytest.approx(0.085 - 0.005) and not s[0].zero_variance
    assert s[1].spread == 0 and s[1].zero_variance and s[1].top_return == pytest.approx(0.045)
    k = {r.date: r.spread for r in p.k_spread_series(panel, 1, 2).collect()}
    assert k[0] == pytest.approx(0.08)


def test_batch_equals_single(spark):
    raw = datasets.make_multi_factor_panel(spark, n_factors=3, n_assets=40, n_dates=90)
    panel = pre.compute_forward_return(raw, 2).persist()
    names = [f"factor_{i:04d}" for i in range(3)]
    metrics = {"ic": m.ic(), "spread": m.quantile_spread(), "fm": m.fm_beta(), "mono": m.monotonicity(n_groups=5)}
    together = ev.evaluate(panel, metrics=metrics, factor_cols=names, strict=False)
    for f, r in zip(names, together, strict=True):
        (alone,) = ev.evaluate(panel, metrics=metrics, factor_cols=[f], strict=False)
        for k in metrics:
            assert alone.metrics[k].value == pytest.approx(r.metrics[k].value, rel=1e-9) and alone.metrics[k].p_value == pytest.approx(r.metrics[k].p_value, rel=1e-7)


def test_every_individual_metric_runs(golden):
    from panelspark.plans.registry import INDIVIDUAL_METRICS

    own = {k: v for k, v in INDIVIDUAL_METRICS.items() if k != "quantile_spread_vw"}
    (r,) = ev.evaluate(golden, metrics=own, factor_cols=["factor"], strict=False)
    assert set(r.metrics) == set(own)
    assert all(x.reason is None for x in r.metrics.values()), {k: x.reason for k, x in r.metrics.items() if x.reason}
    assert 0.4 < r.metrics["directional_pair_accuracy"].value < 0.7
    assert r.metrics["pooled_beta"].value == pytest.approx(r.metrics["pooled_beta_dk"].value)
    assert r.to_json() and r._repr_html_()


def test_every_event_metric_runs(events):
    from panelspark.plans.registry import EVENT_METRICS

    (r,) = ev.evaluate(events, metrics=EVENT_METRICS, factor_cols=["factor"], strict=False)
    assert r.cell[1] == "sparse"
    assert all(x.reason is None for x in r.metrics.values()), {k: x.reason for k, x in r.metrics.items() if x.reason}


def test_event_series_by_brute_force(events):
    panel = long_panel(events, ["factor"])
    pdf = events.toPandas().sort_values(["asset_id", "date"])
    got = p.compute_event_returns(panel).toPandas()
    mm = p.compute_mfe_mae(panel).toPandas().set_index(["asset_id", "date"])
    want, n = [], 0
    for a, g in pdf.groupby("asset_id"):
        x, f, d = g["price"].to_numpy(), g["factor"].to_numpy(), g["date"].tolist()
        for i in np.flatnonzero(f):
            for k in p.OFFSETS:
                lo, hi = (i + 1, i + 1 + k) if k > 0 else (i + k - 1, i + k)
                if lo >= 0 and hi < len(x):
                    want.append((k, a, d[i], np.sign(f[i]) * (x[hi] / x[lo] - 1)))
            path = np.sign(f[i]) * (x[i + 1 : i + 21] / x[i] - 1)
            if len(path):
                row = mm.loc[(a, d[i])]
                assert row.mfe == pytest.approx(path.max()) and row.bars_to_mae == path.argmin() + 1
                before = x[max(0, i - 60) : i]
                if len(before) > 20:
                    sd = np.std(before[1:] / before[:-1] - 1, ddof=1)
                    assert row.mfe_z == pytest.approx(path.max() / (sd * math.sqrt(20)))
                else:
                    assert pd.isna(row.mfe_z)
                n += 1
    assert len(mm) == n
    both = got.sort_values(["offset", "asset_id", "date"])["signed_return"].to_numpy()
    assert np.allclose(both, [w[3] for w in sorted(want, key=lambda w: w[:3])])


def test_event_spacing_is_greedy():
    assert list(m.spaced(np.array([0, 1, 3, 4, 9]), 3)) == [True, False, True, False, True]
    assert m.spaced(np.array([0, 1]), 1).all()


def test_strict_policy_and_validation(golden, events):
    with pytest.raises(IncompatibleAxisError):
        ev.evaluate(golden, metrics={"caar": m.caar()}, factor_cols=["factor"])
    (r,) = ev.evaluate(golden, metrics={"caar": m.caar(), "ic": m.ic()}, factor_cols=["factor"], strict=False)
    assert list(r.metrics) == ["ic"] and r.warnings[0].code == "structure_mismatch"
    with pytest.raises(UserInputError):
        ev.evaluate(golden, metrics={"ic": m.ic}, factor_cols=["factor"])
    with pytest.raises(UserInputError, match="Did you mean factor"):
        ev.evaluate(golden, metrics={"ic": m.ic()}, factor_cols=["facto"])
    with pytest.raises(UserInputError):
        ev.evaluate(golden, metrics={"ic": m.ic()}, factor_cols=["factor"], forward_periods=3)
    with pytest.raises(InsufficientSampleError):
        few = golden.where(F.col("date") < "2020-01-20")
        ev.evaluate(few, metrics={"ic": m.ic()}, factor_cols=["factor"])
    with pytest.raises(IncompatibleInferenceError):
        m.k_spread(inference=m.STATIONARY_BOOTSTRAP).summarise(pd.DataFrame({"full": []}), m.Context())


def test_common_and_single_asset(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=120)
    beta = rng.uniform(-2, 2, 15)
    rows = [(d, f"c{i}", float(f[d]), float(beta[i] * f[d] + 0.1 * rng.normal())) for d in range(120) for i in range(15)]
    panel = spark.createDataFrame(rows, "date int, asset_id string, factor double, forward_return double")
    from panelspark.plans.registry import COMMON_METRICS

    (r,) = ev.evaluate(panel, metrics=COMMON_METRICS, factor_cols=["factor"], forward_periods=1)
    assert r.cell == ("common", "dense", "panel")
    assert r.metrics["common_beta"].value == pytest.approx(beta.mean(), abs=0.05)
    (one,) = ev.evaluate(panel.where("asset_id = 'c0'"), metrics={"b": m.predictive_beta()}, factor_cols=["factor"], forward_periods=1)
    assert one.cell[2] == "timeseries" and one.metrics["b"].value == pytest.approx(beta[0], abs=0.05)


def test_empty_series_short_circuits(spark):
    rows = [(d, a, None, 0.1) for d in range(30) for a in range(5)]
    panel = spark.createDataFrame(rows, "date int, asset_id int, factor double, forward_return double")
    (r,) = ev.evaluate(panel, metrics={"ic": m.ic(), "fm": m.fm_beta(), "q": m.quantile_spread(), "k": m.k_spread(), "p": m.pooled_beta(), "mono": m.monotonicity()}, factor_cols=["factor"], forward_periods=1, strict=False)
    assert all(x.reason for x in r.metrics.values())


def test_slices(spark, golden):
    a = golden.withColumn("side", F.when(F.substring("asset_id", 5, 1) < "5", "x").otherwise("y"))
    pair = slicing.slice_pairwise_test(a, m.ic(), by="side", factor_col="factor")
    joint = slicing.slice_joint_test(a, m.ic(), by="side", factor_col="factor")
    assert pair["stat"][0] == pytest.approx(joint["stat"][0]) and pair["p_adj"][0] == pair["p_raw"][0]
    b = golden.withColumn("era", F.when(F.col("date") < "2020-04-01", "1").otherwise("2"))
    with pytest.raises(ValueError, match="share 0 dates"):
        slicing.slice_joint_test(b, m.ic(), by="era", factor_col="factor")
    one = slicing.slice_period_pairwise_test(b, m.ic(m.NEWEY_WEST), by="era", factor_col="factor", rng_seed=0)
    two = slicing.slice_period_pairwise_test(b, m.ic(m.NEWEY_WEST), by="era", factor_col="factor", rng_seed=0)
    assert one.equals(two) and 0 < one["p_raw"][0] <= 1
    both = slicing.by_slice(a, m.positive_rate(), by="side", factor_col="factor")
    assert sorted(both) == ["x", "y"] and any(w.code == "slice_boundary_truncation" for w in both["x"].warnings)


def test_families_match_arrays(spark):
    from panelspark.functions import inference as st

    rng = np.random.default_rng(0)
    ps = rng.random(30) * 0.1
    table = spark.createDataFrame([(f"f{i:02d}", "m", 5, 0.0, float(x), None if i else "insufficient_periods") for i, x in enumerate(ps)], families.RESULT_SCHEMA)
    got = {r.factor: r.adj_p for r in families.bhy(table, metrics=["m"]).collect()}
    assert got["f00"] is None
    assert np.allclose([got[f"f{i:02d}"] for i in range(1, 30)], st.bhy_adjusted_p(ps[1:]))
    holm = {r.factor: r.adj_p for r in families.adjust(table, "p_value", ["metric"], "holm").collect()}
    assert np.allclose([holm[f"f{i:02d}"] for i in range(30)], st.holm_adjusted_p(ps))
    with pytest.raises(UserInputError):
        families.bhy(table.union(table), metrics=["m"])


def test_inspect_compare_catalogue(spark, golden):
    found = ev.inspect_data(golden)
    assert found.verdicts["ic"].tier == "clean" and found.verdicts["caar"].tier == "unusable" and "fm_beta" in found.usable()
    results = ev.evaluate_horizons(golden.select("date", "asset_id", "price", "factor"), metrics={"ic": m.ic()}, factor_cols=["factor"], forward_periods=[1, 2])
    table = ev.compare(results, metrics=["ic"], spark=spark, sort_by="ic").collect()
    assert [r["rank"] for r in table] == [1, 2] and table[0].ic >= table[1].ic
    assert ev.metrics_summary(spark).count() == len(ev.list_metrics()) == len(m.REGISTRY)
    with pytest.raises(UserInputError, match="Did you mean"):
        ev.spec_by_name("fm_betas")


def test_adapt(spark):
    raw = spark.createDataFrame([("2024-01-01", "A", 1.0, 5.0), ("2024-01-02", "A", float("nan"), 6.0)], "d string, t string, c double, v double").withColumn("d", F.to_date("d"))
    out = adapt(raw, date="d", asset_id="t", price="c", volume="v", fill_forward=True).orderBy("date").collect()
    assert [r.price for r in out] == [1.0, 1.0] and str(out[0].date) == "2024-01-01 00:00:00"
    with pytest.raises(ValueError, match="not found"):
        adapt(raw, date="x")
    with pytest.raises(ValueError, match="exists"):
        adapt(raw.withColumn("date", F.col("d")), date="d", asset_id="t", price="c")


def test_costs_and_spanning():
    assert m.breakeven_cost(0.01, 0.5).value == pytest.approx(100.0)
    assert math.isinf(m.breakeven_cost(0.01, 0.0).value)
    assert m.net_spread(0.01, 0.5).value == pytest.approx(0.01 - 2 * 0.003 * 0.5)
    rng = np.random.default_rng(0)
    base = rng.normal(size=60)
    frame = lambda x: pd.DataFrame({"date": range(60), "spread": x})
    strong = 0.5 + base + 0.1 * rng.normal(size=60)
    r = m.spanning_alpha(frame(strong), {"b": frame(base)})
    assert r.value == pytest.approx(0.5, abs=0.05) and r.p_value < 1e-6
    g = m.greedy_forward_selection({"s": frame(strong), "noise": frame(rng.normal(size=60))}, {"b": frame(base)}, suppress_snooping_warning=True)
    assert [x["factor_name"] for x in g.metadata["selected_factors"]] == ["s"]
