"""Logistic regression on hashed n-grams: small fits on the driver, exact integer scores in workers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from orrery.llm.words import ngrams

SCALE = 1 << 20  # weights are whole multiples of 1/SCALE, so a score never depends on the order of a sum
BITS = 16


@dataclass(frozen=True)
class Group:
    """One kind of n-gram: which sequence it is taken from, its length, its own part of the slots."""

    source: str
    n: int


def slots(groups: tuple[Group, ...], sequences: dict[str, tuple[np.ndarray, np.ndarray]], bits: int = BITS):
    """For every group: (slots of all n-grams, offsets per text)."""
    for at, group in enumerate(groups):
        values, offsets = sequences[group.source]
        hashed, _, bounds = ngrams(values, offsets, group.n, salt=at + 1)
        yield (hashed >> np.uint64(64 - bits)).astype(np.int64) + (at << bits), bounds


@dataclass(frozen=True)
class Logit:
    """Weights per slot; a text's score is the mean weight of each group, summed, then calibrated."""

    groups: tuple[Group, ...]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    bits: int = BITS

    def raw(self, sequences: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        score = None
        for found, bounds in slots(self.groups, sequences, self.bits):
            total = np.zeros(len(found) + 1, dtype=np.int64)
            np.cumsum(self.weights[found], out=total[1:])
            mean = (total[bounds[1:]] - total[bounds[:-1]]) / (np.maximum(np.diff(bounds), 1) * float(SCALE))
            score = mean if score is None else score + mean
        return score + self.bias

    def probability(self, sequences: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Calibrated probability of the positive class, rounded to 6 places."""
        return np.round(_sigmoid(self.slope * self.raw(sequences) + self.shift), 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def features(groups: tuple[Group, ...], sequences: dict[str, tuple[np.ndarray, np.ndarray]], bits: int = BITS):
    """Per text: distinct slots and their share inside their group, as (text, slot, share)."""
    texts, at, shares = [], [], []
    for found, bounds in slots(groups, sequences, bits):
        counts = np.diff(bounds)
        owner = np.repeat(np.arange(len(counts)), counts)
        pair, n = np.unique((owner << 40) | found, return_counts=True)
        texts.append(pair >> 40)
        at.append(pair & ((1 << 40) - 1))
        shares.append(n / counts[pair >> 40])
    return np.concatenate(texts), np.concatenate(at), np.concatenate(shares)


def fit(groups: tuple[Group, ...], rows: np.ndarray, at: np.ndarray, shares: np.ndarray, labels: np.ndarray,
        bits: int = BITS, rounds: int = 150, held_out: int = 5) -> Logit:
    """A balanced fit on four fifths of the rows, calibrated on the other fifth.

    With one class only, or no rows, the model answers that class (or yes) for everything.
    """
    width = len(groups) << bits
    positive = float(labels.sum())
    if not len(labels) or positive in (0.0, float(len(labels))):
        return Logit(groups, np.zeros(width, np.int64), 0.0, 0.0, 20.0 if positive or not len(labels) else -20.0, bits)
    # a fifth of each class in turn
    place = np.empty(len(labels), dtype=np.int64)
    for value in (0, 1):
        of = np.flatnonzero(labels == value)
        place[of] = np.arange(len(of))
    train = place % held_out != held_out - 1
    share = labels[train].mean()
    if share in (0.0, 1.0):
        train[:] = True
        share = labels.mean()
    # a slot of one row says nothing about other rows
    often = (np.bincount(at, minlength=width) > 1)[at]
    rows, at, shares = rows[often], at[often], shares[often]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) * train / train.sum()
    # columns with a common scale, so that rare slots are learned as well
    scale = 1.0 / np.sqrt(np.bincount(at, weights=np.square(shares), minlength=width) / len(labels) + 1e-6)
    values = (shares * scale[at]).astype(np.float32)
    w, bias = np.zeros(width), 0.0
    square = np.full(width, 1e-8)
    square_b = 1e-8
    for _ in range(rounds):
        score = np.bincount(rows, weights=values * w[at], minlength=len(labels)) + bias
        miss = (_sigmoid(score) - labels) * weight
        slope = np.bincount(at, weights=values * miss[rows], minlength=width) + 1e-5 * w
        square += slope**2
        w -= 0.05 * slope / np.sqrt(square)
        square_b += miss.sum() ** 2
        bias -= 0.05 * miss.sum() / np.sqrt(square_b)
    whole = np.round(w * scale * SCALE).astype(np.int64)
    score = np.bincount(rows, weights=shares * whole[at] / SCALE, minlength=len(labels)) + bias
    check = ~train if (~train).any() and len(set(labels[~train])) == 2 else np.ones(len(labels), bool)
    slope, shift = _calibrate(score[check], labels[check].astype(float))
    return Logit(groups, whole, bias, slope, shift, bits)


def _calibrate(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid through the held-out scores, with smoothed targets (Newton steps)."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    spread = max(float(score.std()), 1e-9)
    x = score / spread
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * x + shift)
        r, v = p - target, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(r * x).sum() + 1e-3 * slope, r.sum()])
        curve = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
    return float(max(slope, 1e-6) / spread), float(shift)
