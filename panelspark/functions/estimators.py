"""Descriptions of the estimators behind test statistics, each of which can compute itself."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import inference as st


@dataclass(frozen=True)
class BlockBootstrap:
    """Resampling of blocks; ``block_length`` None is automatic."""

    block_length: int | None = None
    n_resamples: int = 999
    scheme: str = "stationary"
    rng_seed: int | None = None

    def __post_init__(self):
        if self.scheme not in ("stationary", "fixed") or self.n_resamples < 1 or self.block_length is not None and self.block_length < 1:
            raise ValueError("scheme must be 'stationary' or 'fixed', sizes positive")

    def p_value(self, x) -> float:
        return st.bootstrap_p(np.asarray(x, float), resamples=self.n_resamples, seed=self.rng_seed, length=self.block_length, scheme=self.scheme)[0]


@dataclass(frozen=True)
class DriscollKraay:
    """Errors robust to dependence within and between periods."""

    lags: int | None = None

    def covariance(self, x: np.ndarray, resid: np.ndarray, periods: np.ndarray) -> np.ndarray:
        _, of = np.unique(periods, return_inverse=True)
        scores = np.zeros((of.max() + 1, x.shape[1]))
        np.add.at(scores, of, x * resid[:, None])
        lags = st.auto_lags(len(scores)) if self.lags is None else self.lags
        inverse = np.linalg.inv(x.T @ x)
        return inverse @ st.bartlett(scores, max(0, min(lags, len(scores) - 1))) @ inverse


@dataclass(frozen=True)
class WaldNWCluster:
    """Wald test on the means of date-aligned columns with a HAC covariance."""

    lags: int | None = None

    def test(self, y: np.ndarray, restriction: np.ndarray) -> tuple[float, float]:
        if len(y) < 2:
            return 0.0, 1.0
        return st.wald(*st.mean_hac(y, st.hac_lags(len(y), self.lags, None)), restriction, len(y) - 1)


@dataclass(frozen=True)
class WaldTwoWayCluster:
    """Wald test on a regression with errors clustered by date and by asset."""

    def test(self, y: np.ndarray, x: np.ndarray, restriction: np.ndarray, dates: np.ndarray, assets: np.ndarray) -> tuple[float, float]:
        if len(y) < x.shape[1] + 1:
            return 0.0, 1.0
        try:
            inverse = np.linalg.inv(x.T @ x)
        except np.linalg.LinAlgError:
            return 0.0, 1.0
        beta = inverse @ (x.T @ y)
        scores = x * (y - x @ beta)[:, None]
        ids = [np.unique(k, return_inverse=True)[1] for k in (dates, assets)]
        ids.append(np.unique(ids[0].astype(np.int64) * (ids[1].max() + 1) + ids[1], return_inverse=True)[1])
        meats = []
        for of in ids:
            sums = np.zeros((of.max() + 1, x.shape[1]))
            np.add.at(sums, of, scores)
            meats.append(sums.T @ sums)
        cov = inverse @ (meats[0] + meats[1] - meats[2]) @ inverse
        cov = 0.5 * (cov + cov.T)
        if not np.isfinite(cov).all() or (np.diag(cov) < -st.EPSILON).any():
            return 0.0, 1.0
        return st.wald(beta, cov, restriction, min(ids[0].max(), ids[1].max()))
