"""A two-label linear-chain conditional random field.

Label 1 is content, label 0 boilerplate.  The score of a labelling is the sum of
``emit[label] . features`` over the items and of ``move[from, to]`` over
neighbours.  Training maximises the conditional log-likelihood with an L2
penalty by Adam on padded batches; decoding is Viterbi, one pass per sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    emit: np.ndarray  # (features,) : label 1 against label 0
    move: np.ndarray  # (2, 2)

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.emit


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def train(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 160, rate: float = 0.08, penalty: float = 1e-3) -> Crf:
    """Fits the field; ``sequences`` holds (features by item, labels) pairs.

    Without sequences the field is all zeros, and every item decodes as content.
    """
    sequences = [s for s in sequences if len(s[1])]
    if not sequences:
        return Crf(np.zeros(1), np.zeros((2, 2)))
    n, most, width = len(sequences), max(len(y) for _, y in sequences), sequences[0][0].shape[1]
    x, y, mask = np.zeros((n, most, width)), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (f, lab) in enumerate(sequences):
        x[i, : len(lab)], y[i, : len(lab)], mask[i, : len(lab)] = f, lab, True
    items = mask.sum()
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pair = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    for step in range(1, steps + 1):
        emit, move = theta[:width], theta[width:].reshape(2, 2)
        up = x @ emit
        node = np.stack([np.zeros_like(up), up], -1)
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = node[:, 0]
        for t in range(1, most):
            step_in = _log_add(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + node[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step_in, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = beta[:, t + 1] + node[:, t + 1]
            step_in = _log_add(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], step_in, 0.0)
        z = _log_add(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
        grad_emit = np.einsum("ij,ijk->k", (y * mask) - p1, x)
        between = alpha[:, :-1, :, None] + move[None, None] + (node[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        grad_move = seen - (np.exp(between) * pair[:, :, None, None]).sum((0, 1))
        grad = np.concatenate([grad_emit, grad_move.ravel()]) / items - penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[:width], theta[width:].reshape(2, 2))


def viterbi(margins: list[float], move: list[list[float]]) -> list[int]:
    """The best labelling of one sequence; a tie goes to content."""
    if not margins:
        return []
    (m00, m01), (m10, m11) = move
    a, b = 0.0, margins[0]
    from0, from1 = [], []
    for m in margins[1:]:
        stay, came = a + m00, b + m10
        zero, back0 = (stay, 0) if stay > came else (came, 1)
        left, kept = a + m01, b + m11
        one, back1 = (left, 0) if left > kept else (kept, 1)
        from0.append(back0)
        from1.append(back1)
        a, b = zero, one + m
    label = 1 if b >= a else 0
    out = [label]
    for k in range(len(from0) - 1, -1, -1):
        label = from1[k] if label else from0[k]
        out.append(label)
    return out[::-1]
