"""Weak labels: what overlapping heuristic labellers say together."""

from __future__ import annotations

import numpy as np


def posteriors(patterns: list[tuple[list[int], int]], steps: int = 50, against: float = 1.0, silent: bool = True, trust: float = 0.0, prior: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Of each vote pattern with its count, the chance of the label 1: a naive mixture fitted by expectation-maximisation.

    Starts from the majority vote, in which a vote of -1 counts ``against`` times.
    ``silent``: an abstention tells something of the class as well; else only votes
    do. ``trust``: so many votes, four fifths of them right, stand for each labeller
    and class before any is counted, so that a lone labeller is believed at first
    and thousands of votes can still show what it is worth; without trust, one vote
    of each sort does. ``prior``: candidates of either label that stand beforehand.
    """
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    p = np.clip(0.5 + 0.2 * np.where(v < 0, against * v, v).sum(axis=1), 0.05, 0.95)
    for _ in range(steps):
        scores = []
        for own, right, before in ((p, 2, prior[0]), (1 - p, 0, prior[1])):
            w = n * own
            counts = np.stack([((v == x) * w[:, None]).sum(axis=0) for x in (-1, 0, 1)])
            counts[right] += 0.8 * trust
            counts[2 - right] += 0.2 * trust
            counts += 0.0 if trust else 1.0
            counts[1] *= silent
            share = np.log(np.where(counts > 0, counts / counts.sum(axis=0), 1.0))
            scores.append(np.log((w.sum() + before) / (n.sum() + sum(prior))) + share[v + 1, np.arange(v.shape[1])].sum(axis=1))
        p = 1 / (1 + np.exp(np.clip(scores[1] - scores[0], -50, 50)))
    return p
