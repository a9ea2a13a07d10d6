import numpy as np
import pytest

import panelspark as ps
from panelspark.functions.estimators import BlockBootstrap, DriscollKraay, WaldNWCluster, WaldTwoWayCluster


def test_public_names():
    for name in ("evaluate", "evaluate_horizons", "inspect_data", "compare", "adapt", "compute_forward_return", "by_slice", "slice_joint_test", "spanning_alpha"):
        assert callable(getattr(ps, name))


def test_estimators():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.normal(size=200)])
    y = x @ [0.0, 1.0] + rng.normal(size=200)
    dates, assets = np.repeat(range(20), 10), np.tile(range(10), 20)
    slope = np.array([[0.0, 1.0]])
    w, p = WaldTwoWayCluster().test(y, x, slope, dates, assets)
    assert w > 10 and p < 0.01
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    cov = DriscollKraay(lags=0).covariance(x, y - x @ beta, dates)
    sums = np.array([(x * (y - x @ beta)[:, None])[dates == d].sum(0) for d in range(20)])
    inverse = np.linalg.inv(x.T @ x)
    assert np.allclose(cov, inverse @ sums.T @ sums @ inverse)
    both = rng.normal(size=(60, 2)) + [0, 2]
    assert WaldNWCluster().test(both, np.array([[1.0, -1.0]]))[1] < 1e-6
    assert BlockBootstrap(rng_seed=0).p_value(rng.normal(1, 1, 50)) == pytest.approx(0.001)
    with pytest.raises(ValueError):
        BlockBootstrap(scheme="other")
