"""A PySpark-native engine for evaluating predictive signals on long panels."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.metrics import HANSEN_HODRICK, NEWEY_WEST, NON_OVERLAPPING, STATIONARY_BOOTSTRAP, Metric, breakeven_cost, greedy_forward_selection, net_spread, spanning_alpha  # noqa: E402
from .operators.preprocess import compute_abnormal_return, compute_forward_return, cross_sectional_zscore, mad_winsorize, orthogonalize_factor, winsorize_forward_return  # noqa: E402
from .plans.evaluate import compare, evaluate, evaluate_horizons, inspect_data, list_metrics, metrics_summary, register, spec_by_name  # noqa: E402
from .plans.slicing import by_slice, slice_joint_test, slice_pairwise_test, slice_period_joint_test, slice_period_pairwise_test  # noqa: E402
from .sources.adapt import adapt  # noqa: E402

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "sys", "cloudpickle")]
