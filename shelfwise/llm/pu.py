"""Positive-unlabelled learning: a linear classifier under the non-negative unbiased risk.

With class prior ``pi``, positives P and unlabelled rows U, the risk of a scorer f is

    pi * E_P[loss(f)]  +  max(0, E_U[loss(-f)] - pi * E_P[loss(-f)])

The second term estimates the risk on negatives, which nobody has labelled: U holds positives
too, and their share is taken off. In truth it is never negative, so where the sample estimate
falls below zero the step goes the other way and undoes the overfit. The loss is the logistic
loss, so sigmoid(f) is a probability.
"""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


class Present:
    """Sparse rows by presence: feature numbers of all rows one after another, the rows' lengths, one value per feature."""

    def __init__(self, index: np.ndarray, size: np.ndarray, value: np.ndarray):
        self.index, self.size, self.value = index.astype(np.int32), size, value
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), size)

    @property
    def width(self) -> int:
        return len(self.value)

    def __len__(self) -> int:
        return len(self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, (w * self.value).astype(np.float32)[self.index], minlength=len(self.size))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, g.astype(np.float32)[self.owner], minlength=self.width) * self.value

    def take(self, every: int, of: int) -> "Present":
        """Rows number ``every``, ``every + of``, and so on."""
        mine = np.arange(len(self.size)) % of == every
        return Present(self.index[mine[self.owner]], self.size[mine], self.value)


class Dense:
    """Rows of a matrix."""

    def __init__(self, x: np.ndarray):
        self.x = x

    @property
    def width(self) -> int:
        return self.x.shape[1]

    def __len__(self) -> int:
        return len(self.x)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.x.T @ g

    def take(self, every: int, of: int) -> "Dense":
        """Rows number ``every``, ``every + of``, and so on."""
        return Dense(self.x[every::of])


def nn_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, estimated negative part) of the risk for scores of P and of U."""
    soft = lambda z: np.logaddexp(0, z)
    return prior * soft(-fp).mean(), soft(fu).mean() - prior * soft(fp).mean()


def fit(positive: Present | Dense, unlabelled: Present | Dense, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float, list[float]]:
    """Weights, intercept and risks of the minimiser of the non-negative risk (Adam over all rows)."""
    width = positive.width
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    risks = []
    for step in range(1, steps + 1):
        fp, fu = positive.dot(w) + b, unlabelled.dot(w) + b
        good, bad = nn_risk(fp, fu, prior)
        risks.append(good + max(0.0, bad))
        gp_good = -prior * sigmoid(-fp) / len(positive)
        gp_bad, gu_bad = -prior * sigmoid(fp) / len(positive), sigmoid(fu) / len(unlabelled)
        gp, gu = (gp_good + gp_bad, gu_bad) if bad >= 0 else (-gp_bad, -gu_bad)
        g = np.append(positive.back(gp) + unlabelled.back(gu) + decay * w, gp.sum() + gu.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = rate * min(1.0, 2 * (1 - step / (steps + 1))) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b, risks


def estimate_prior(fp: np.ndarray, fu: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores of rows that did not train the scorer.

    Above any score, U holds at least the share ``prior`` of what P holds there, so U's share
    above it divided by P's share bounds the prior; the bound is tightest at a score that negatives
    hardly reach. The score is chosen with a margin for the sample sizes (best-bin estimate).
    """
    cuts = np.unique(fp)
    above_p = 1 - np.searchsorted(np.sort(fp), cuts) / len(fp)
    above_u = 1 - np.searchsorted(np.sort(fu), cuts) / len(fu)
    margin = sum(np.sqrt(np.log(4 / confidence) / (2 * n)) for n in (len(fp), len(fu)))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(above_u[best] / above_p[best])


def fit_with_prior(positive: Present | Dense, unlabelled: Present | Dense, labelled_share: float, **options) -> tuple[np.ndarray, float, float]:
    """Estimate the prior by training on either half and scoring the other, then train on all rows.

    ``labelled_share`` starts the halves. The halves' estimate bounds the prior from above, so the
    smaller of it and the labelled share is taken; with too few rows for halves the labelled share
    stays. Returns weights, intercept and the prior.
    """
    prior = labelled_share
    if min(len(positive), len(unlabelled)) >= 20:
        found = []
        for half in (0, 1):
            w, b, _ = fit(positive.take(half, 2), unlabelled.take(half, 2), labelled_share, **options)
            p, u = positive.take(1 - half, 2), unlabelled.take(1 - half, 2)
            found.append(estimate_prior(p.dot(w) + b, u.dot(w) + b))
        prior = max(min(float(np.mean(found)), labelled_share), 1 / (len(unlabelled) + 2))
    w, b, _ = fit(positive, unlabelled, prior, **options)
    return w, b, prior


def clipped_prior(labelled: int, positive: int) -> float:
    """Share of positives among labelled rows, kept away from 0 and 1 by one row of each kind."""
    return (positive + 1) / (labelled + 2)
