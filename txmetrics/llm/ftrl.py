"""Logistic regression over sparse rows, trained by follow-the-regularised-leader with elastic-net penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    """``alpha``, ``beta``: the step size of a weight; ``l1``, ``l2``: the penalties; ``epochs``: passes over the rows."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 3
    seed: int = 7


class Leader:
    """Per-coordinate state for ``features`` x ``outputs`` weights."""

    def __init__(self, features: int, outputs: int, settings: Settings):
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))
        self.settings = settings

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        """Closed-form weights of these features: zero where the l1 penalty outweighs the evidence."""
        z, s = self.z[rows], self.settings
        shrunk = np.sign(z) * s.l1 - z
        return np.where(np.abs(z) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(self.n[rows])) / s.alpha + s.l2))

    def update(self, rows: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """``rows`` must be distinct."""
        n = self.n[rows]
        more = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.settings.alpha * weights
        self.n[rows] = more


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_softmax(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, outputs: int, settings: Settings) -> np.ndarray:
    """Weights (features x outputs) for sparse rows (index, value) with class numbers ``labels``."""
    leader = Leader(features, outputs, settings)
    random = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            index, value = rows[k]
            w = leader.weights(index)
            error = softmax(value @ w)
            error[labels[k]] -= 1
            leader.update(index, w, np.outer(value, error))
    return leader.weights(slice(None))


def train_logistic(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, settings: Settings) -> np.ndarray:
    """Weights of a two-class model for sparse rows (index, value) and labels 0 or 1."""
    leader = Leader(features, 1, settings)
    random = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            index, value = rows[k]
            w = leader.weights(index)
            p = 1 / (1 + np.exp(-np.clip(value @ w[:, 0], -35, 35)))
            leader.update(index, w, value[:, None] * (p - labels[k]))
    return leader.weights(slice(None))[:, 0]
