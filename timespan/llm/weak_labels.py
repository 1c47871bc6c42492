"""Expectation-maximisation over the votes of overlapping labellers, and a hashed logistic scorer.

Labellers vote ABSTAIN, NO or YES. Only counts of vote patterns reach the driver: 3 to the number of labellers at
most, however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN, NO, YES = 0, 1, 2


@dataclass
class LabelModel:
    """accuracy[j]: how often labeller j is right when it votes; prior: the share of class 1. Abstaining tells nothing."""

    accuracy: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each row of votes."""
        weight = np.log(self.accuracy) - np.log1p(-self.accuracy)
        odds = np.where(votes == YES, weight, 0).sum(1) - np.where(votes == NO, weight, 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior) - np.log1p(-self.prior), -50, 50)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60, start: float = 0.85, prior: float = 0.1, strength: float = 20.0) -> LabelModel:
    """votes: patterns by labellers; counts: rows of each pattern. `start` counts as `strength` votes of each labeller."""
    model = LabelModel(np.full(votes.shape[1], start), prior)
    for _ in range(rounds if len(votes) else 0):
        posterior = model.posterior(votes)
        right = ((votes == YES) * (counts * posterior)[:, None] + (votes == NO) * (counts * (1 - posterior))[:, None]).sum(0)
        cast = ((votes != ABSTAIN) * counts[:, None]).sum(0)
        share = ((counts * posterior).sum() + prior * strength) / (counts.sum() + strength)
        model = LabelModel(np.clip((right + start * strength) / (cast + strength), 0.55, 0.995), float(np.clip(share, 0.005, 0.6)))
    return model


def train_scorer(rows: list[np.ndarray], targets: np.ndarray, dimensions: int, epochs: int = 8, rate: float = 0.5, shrink: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Logistic regression over hashed binary features by AdaGrad, with soft targets. The last weight is the bias."""
    weights, seen = np.zeros(dimensions + 1, np.float64), np.full(dimensions + 1, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            own = rows[k]
            gradient = 1 / (1 + np.exp(-np.clip(weights[own].sum() + weights[-1], -30, 30))) - targets[k]
            for at in (own, dimensions):
                g = gradient + shrink * weights[at]
                seen[at] += g * g
                weights[at] -= rate * g / np.sqrt(seen[at])
    return weights.astype(np.float32)


def telling_features(rows: list[np.ndarray], targets: np.ndarray, dimensions: int, most: int, least: int) -> np.ndarray:
    """Which features differ most between the classes by chi-square, `most` of them; those of fewer than `least` rows tell nothing."""
    seen, yes = np.zeros(dimensions), np.zeros(dimensions)
    for own, target in zip(rows, targets, strict=True):
        seen[own] += 1
        yes[own] += target
    share = targets.mean() if len(targets) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where((seen >= least) & (share > 0) & (share < 1), (yes - seen * share) ** 2 / (seen * share * (1 - share)), 0.0)
    kept = np.zeros(dimensions, bool)
    kept[np.argsort(-chi, kind="stable")[:most]] = True
    return kept & (chi > 0)


def train_selected(rows: list[np.ndarray], targets: np.ndarray, dimensions: int, most: int, least: int) -> np.ndarray:
    """The scorer over the telling features alone, both classes with the same weight: rows of the smaller one come several times."""
    kept = telling_features(rows, targets, dimensions, most, least)
    few, many = sorted((np.flatnonzero(targets >= 0.5), np.flatnonzero(targets < 0.5)), key=len)
    order = np.concatenate([np.repeat(few, max(1, round(len(many) / max(1, len(few))))), many])
    return train_scorer([rows[k][kept[rows[k]]] for k in order], targets[order], dimensions, epochs=6, rate=0.2, shrink=1e-2)


def score(own: np.ndarray, weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[own].sum() + weights[-1], -30, 30))))
