"""Genotype statistics of one site as vectorised functions over Arrow batches: exact tests, allele frequency, linkage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def fisher_two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum over tables with the same margins that are no likelier than the one seen."""
    lf = _log_factorials(int((a + b + c + d).max(initial=0)))
    out = np.ones(len(a))
    for i, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        row, col, n = w + x, w + y, w + x + y + z
        lo, hi = max(0, row + col - n), min(row, col)
        if lo == hi:
            continue
        k = np.arange(lo, hi + 1)
        logp = lf[row] + lf[n - row] + lf[col] + lf[n - col] - lf[n] - lf[k] - lf[row - k] - lf[col - k] - lf[n - row - col + k]
        p = np.exp(logp)
        out[i] = min(1.0, p[p <= p[w - lo] * 1.00000001].sum())
    return out


def hwe_exact(hom1: np.ndarray, hom2: np.ndarray, het: np.ndarray) -> np.ndarray:
    """Chance of as few or as many heterozygotes as seen, or a less likely number, given the alleles."""
    out = np.ones(len(hom1))
    lf = _log_factorials(2 * int((hom1 + hom2 + het).max(initial=0)))
    for i, (x, y, h) in enumerate(zip(hom1.tolist(), hom2.tolist(), het.tolist(), strict=True)):
        n, rare = x + y + h, 2 * min(x, y) + h
        if not n:
            continue
        k = np.arange(rare % 2, rare + 1, 2)
        r = (rare - k) // 2
        logp = k * math.log(2) - lf[k] - lf[r] - lf[n - k - r]
        p = np.exp(logp - logp.max())
        p /= p.sum()
        out[i] = min(1.0, p[p <= p[(h - rare % 2) // 2] * (1 + 1e-9)].sum())
    return out


#: Samples of like sites that go through a model together, a site at least.
TOGETHER = 1 << 15


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the sites that go through a model together: sites of one number of samples, in pieces of about TOGETHER samples."""
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, TOGETHER // max(1, int(n)))
        yield from (at[i : i + step] for i in range(0, len(at), step))


def _frequencies(g: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """allele_frequency of (sites, samples, 3) likelihoods; a site that has come to rest leaves the steps."""
    informed = (g != 1).any(2)
    some = informed.sum(1)
    f = np.clip((g.argmax(2) * informed).sum(1) / np.maximum(some, 1) / 2, 1e-3, 1 - 1e-3)
    f[some == 0] = -1.0
    at = np.flatnonzero(some)
    g = g[at]
    for _ in range(steps):
        if not len(at):
            break
        p = f[at]
        w = g * np.stack([(1 - p) ** 2, 2 * p * (1 - p), p * p], 1)[:, None]
        new = ((w[..., 1] + 2 * w[..., 2]) / w.sum(2)).mean(1) / 2
        f[at] = new
        on = ~(np.abs(new - p) < enough)
        if not on.all():
            at, g = at[on], g[on]
    return f


def allele_frequency(likelihoods: list[np.ndarray], steps: int = 50, enough: float = 1e-5) -> np.ndarray:
    """Greatest-likelihood frequency of the second allele, by expectation and maximisation; a site is (samples, 3) likelihoods of 0, 1, 2 copies."""
    out = np.full(len(likelihoods), -1.0)
    for at in _alike(np.array([len(g) for g in likelihoods], int)):
        out[at] = _frequencies(np.stack([likelihoods[i] for i in at]), steps, enough)
    return out


def prior_of_counts(m: int, kind: str = "full", theta: float = 1e-3) -> np.ndarray:
    """Chances of 0 to m second alleles before anything is seen: `full`: theta / count, and none with what is left; `cond2`: falling evenly, as for a site found in two other chromosomes; `flat`: all alike."""
    k = np.arange(m + 1)
    if kind == "flat":
        return np.full(m + 1, 1 / (m + 1))
    if kind == "cond2":
        return 2 * (m - k + 1) / ((m + 1) * (m + 2))
    return np.concatenate([[1 - theta * (1 / k[1:]).sum()], theta / k[1:]])


def frequency_posteriors(g: np.ndarray, theta: float = 1e-3, kind: str = "full") -> np.ndarray:
    """frequency_posterior of many sites of as many samples: (sites, samples, 3) likelihoods."""
    with np.errstate(divide="ignore"):
        logs = np.log(np.asarray(g, float)) + np.log([1.0, 2.0, 1.0])
        z = np.zeros((len(logs), 1))  # all in logarithms: counts of many samples leave the range of doubles
        for i in range(logs.shape[1]):
            new = np.full((3, len(z), z.shape[1] + 2), -np.inf)
            for copies in range(3):
                new[copies, :, copies : copies + z.shape[1]] = z + logs[:, i, copies, None]
            z = np.logaddexp.reduce(new)
            z -= z.max(1, keepdims=True)
        m = logs.shape[1] * 2
        k = np.arange(m + 1)
        lf = _log_factorials(m)
        p = z - (lf[m] - lf[k] - lf[m - k]) + np.log(prior_of_counts(m, kind, theta))
    p = np.exp(p - p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def frequency_posterior(g: np.ndarray, theta: float = 1e-3, kind: str = "full") -> np.ndarray:
    """Posterior of the number of second alleles in diploid samples, (samples, 3) likelihoods, under a prior of prior_of_counts."""
    return frequency_posteriors(np.asarray(g, float)[None], theta, kind)[0]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, terms: int = 300) -> np.ndarray:
    """Regularised incomplete beta function of arrays, by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), b, x)
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    f = d.copy()
    for n in range(1, terms):
        for step in (n * (q - n) * z / ((p + 2 * n - 1) * (p + 2 * n)), -(p + n) * (p + q + n) * z / ((p + 2 * n) * (p + 2 * n + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    part = np.where(z > 0, front * f, 0.0)
    return np.where(turned, 1 - part, part)


def lower_mean(n1: np.ndarray, n2: np.ndarray, s1: np.ndarray, q1: np.ndarray, s2: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """One-sided t-test, variances taken as equal, of the second mean being lower: counts, sums and sums of squares of two groups. 1 where one is empty, both hold less than three, or the second isn't lower."""
    n1, n2, s1, q1, s2, q2 = (np.asarray(x, float) for x in (n1, n2, s1, q1, s2, q2))
    some = (n1 > 0) & (n2 > 0) & (n1 + n2 >= 3)
    m1, m2, v = s1 / np.where(some, n1, 1), s2 / np.where(some, n2, 1), np.where(some, n1 + n2 - 2, 1)
    spread = np.maximum(q1 - n1 * m1 * m1, 0) + np.maximum(q2 - n2 * m2 * m2, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (m1 - m2) / np.sqrt(spread / v * (1 / np.where(some, n1, 1) + 1 / np.where(some, n2, 1)))
    t = np.where(np.isfinite(t), t, 1e150)
    p = 0.5 * incomplete_beta(v / 2, 0.5, v / (v + t * t))
    return np.where(some & (m1 > m2), p, 1.0)


def _pairs(a: np.ndarray, b: np.ndarray, steps: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """pair_frequencies of (pairs, samples, 3) likelihoods; a pair that has come to rest leaves the steps."""
    fa, fb = _frequencies(a, steps, enough), _frequencies(b, steps, enough)
    f = np.stack([(1 - fa) * (1 - fb), (1 - fa) * fb, fa * (1 - fb), fa * fb], 1)
    none = (fa < 0) | (fb < 0)
    f[none] = -1.0
    at = np.flatnonzero(~none)
    h1, h2 = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    like = a[at][:, :, h1[:, None] + h1[None]] * b[at][:, :, h2[:, None] + h2[None]]  # (pairs, samples, 4, 4)
    for _ in range(steps):
        if not len(at):
            break
        p = f[at]
        w = like * p[:, None, :, None] * p[:, None, None]
        w /= w.sum((2, 3), keepdims=True)
        new = (w.sum(3) + w.sum(2)).sum(1) / (2 * a.shape[1])
        f[at] = new
        on = ~(np.abs(new - p).max(1) < enough)
        if not on.all():
            at, like = at[on], like[on]
    p, q = f[:, 0] + f[:, 1], f[:, 0] + f[:, 2]
    d = f[:, 0] * f[:, 3] - f[:, 1] * f[:, 2]
    spread = p * (1 - p) * q * (1 - q)
    some = ~none & (spread > 0)
    return f, np.where(some, np.sqrt(d * d / np.where(some, spread, 1.0)), -1.0)


def pair_frequencies(a: np.ndarray, b: np.ndarray, steps: int = 50, enough: float = 1e-5) -> tuple[np.ndarray, float]:
    """Frequencies of the four haplotypes of two sites, and their correlation r (-1: none), from (samples, 3) likelihoods of each."""
    f, r = _pairs(a[None], b[None], steps, enough)
    return f[0], float(r[0])


def pair_correlations(a: list[np.ndarray], b: list[np.ndarray], steps: int = 50, enough: float = 1e-5) -> np.ndarray:
    """The correlations of pair_frequencies for many pairs of sites; both of a pair have the same samples."""
    out = np.full(len(a), -1.0)
    for at in _alike(np.array([len(x) for x in a], int)):
        out[at] = _pairs(np.stack([a[i] for i in at]), np.stack([b[i] for i in at]), steps, enough)[1]
    return out


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(*(x.to_numpy(np.int64) for x in (a, b, c, d))))


@F.pandas_udf(T.DoubleType())
def hwe(hom1: pd.Series, hom2: pd.Series, het: pd.Series) -> pd.Series:
    return pd.Series(hwe_exact(*(x.to_numpy(np.int64) for x in (hom1, hom2, het))))


@F.pandas_udf(T.DoubleType())
def frequency(likelihoods: pd.Series) -> pd.Series:
    """Sites as flat arrays of three likelihoods a sample."""
    return pd.Series(allele_frequency([np.asarray(x, float).reshape(-1, 3) for x in likelihoods]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def posterior(likelihoods: pd.Series) -> pd.Series:
    return pd.Series([frequency_posterior(np.asarray(x, float).reshape(-1, 3)).tolist() for x in likelihoods])


@F.pandas_udf(T.DoubleType())
def linkage(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(pair_correlations(*([np.asarray(x, float).reshape(-1, 3) for x in col] for col in (a, b))))


@F.pandas_udf(T.DoubleType())
def falls(n1: pd.Series, n2: pd.Series, s1: pd.Series, q1: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.Series:
    return pd.Series(lower_mean(*(x.to_numpy(float) for x in (n1, n2, s1, q1, s2, q2))))
