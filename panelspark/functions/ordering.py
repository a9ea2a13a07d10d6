"""Pairs of a cross-section in the same or opposite order, counted without making the pairs."""

from __future__ import annotations

import numpy as np


def below(ordered: np.ndarray, at: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """For each value of ``at``, how many of the ascending ``ordered`` are lower by more than ``gap``.

    Without ``strict``: how many are not higher by more than ``gap``.  The difference
    itself is compared, as a comparison of two rows would, in a binary search for all
    values together.
    """
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(ordered), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        value = ordered[np.minimum(middle, len(ordered) - 1)]
        with np.errstate(invalid="ignore"):  # equal infinities differ by no number, so they tie
            fits = at - value > gap if strict else ~(value - at > gap)
        low, high = np.where(open_ & fits, middle + 1, low), np.where(open_ & ~fits, middle, high)
    return low


def prefix_ranks_below(ranks: np.ndarray, prefix: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query, how many of the first ``prefix`` entries of a permutation are below ``bound``.

    All queries descend a wavelet matrix together: one stable split of the permutation
    per bit, so n queries cost n log n.
    """
    n = len(ranks)
    found, left, right = np.zeros(len(prefix), np.int64), np.zeros(len(prefix), np.int64), prefix.astype(np.int64)
    level = ranks.astype(np.int64)
    for bit in range(n.bit_length() - 1, -1, -1):
        zero = (level >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        a, b, ones = zeros[left], zeros[right], (bound >> bit) & 1 == 1
        found += np.where(ones, b - a, 0)
        left, right = np.where(ones, zeros[-1] + left - a, a), np.where(ones, zeros[-1] + right - b, b)
        level = np.concatenate([level[zero], level[~zero]])
    return found


def pair_counts(x: np.ndarray, y: np.ndarray, epsilon: float) -> dict[str, int]:
    """All, concordant, discordant and tied pairs of rows; a difference within ``epsilon`` is a tie."""
    n = len(x)
    raw = n * (n - 1) // 2
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    by_y = np.argsort(y, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[by_y] = np.arange(n)
    ascending = y[by_y]
    lower_x = below(x, x, epsilon, True)
    correct = int(prefix_ranks_below(ranks, lower_x, below(ascending, y, epsilon, True)).sum())
    incorrect = int((lower_x - prefix_ranks_below(ranks, lower_x, below(ascending, y, epsilon, False))).sum())
    x_ties, y_ties = raw - int(lower_x.sum()), raw - int(below(ascending, ascending, epsilon, True).sum())
    return {"raw_pairs": raw, "correct": correct, "incorrect": incorrect, "factor_ties": x_ties, "return_ties": y_ties, "both_ties": x_ties + y_ties - (raw - correct - incorrect)}
