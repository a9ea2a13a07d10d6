import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from panelspark.functions.ordering import pair_counts

EPS = 1e-9
VALUE = hs.sampled_from([0.0, 1.0, 1.0 + 5e-10, 1.0 + 1e-9, 1.0 + 2e-9, -3.0, 2.5, float("inf"), float("-inf")]) | hs.floats(-2, 2)


def brute(x, y):
    out = dict.fromkeys(("raw_pairs", "correct", "incorrect", "factor_ties", "return_ties", "both_ties"), 0)
    for i in range(len(x)):
        for j in range(i):
            dx, dy = x[i] - x[j], y[i] - y[j]
            fx, fy = not abs(dx) > EPS, not abs(dy) > EPS
            out["raw_pairs"] += 1
            out["factor_ties"] += fx
            out["return_ties"] += fy
            out["both_ties"] += fx and fy
            out["correct"] += not fx and not fy and (dx > 0) == (dy > 0)
            out["incorrect"] += not fx and not fy and (dx > 0) != (dy > 0)
    return out


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.tuples(VALUE, VALUE), max_size=40))
def test_pair_counts_equal_brute_force(rows):
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    assert pair_counts(x, y, EPS) == brute(x.tolist(), y.tolist())


@pytest.mark.parametrize("n", [1, 2, 3, 127, 128, 300])
def test_sizes_around_powers_of_two(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 20, n).astype(float), rng.normal(size=n)
    assert pair_counts(x, y, EPS) == brute(x.tolist(), y.tolist())
