"""Linear recurrences in blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class StateSpace:
    """state' = A state + B x and y = C state + D x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    def then(self, other: StateSpace) -> StateSpace:
        """This filter followed by another."""
        n, m = len(self.a), len(other.a)
        a = np.block([[self.a, np.zeros((n, m))], [np.outer(other.b, self.c), other.a]])
        return StateSpace(a, np.concatenate([self.b, other.b * self.d]), np.concatenate([other.d * self.c, other.c]), other.d * self.d)

    def run(self, x: np.ndarray, start: np.ndarray, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(output, last state). Rows of ``width`` samples run side by side from rest; then the state
        that each row really starts from is carried along and its response added."""
        n = len(x)
        rows = -(-n // width)
        grid = np.append(x, np.zeros(rows * width - n)).reshape(rows, width)
        state, out = np.zeros((rows, len(self.a))), np.empty((rows, width))
        states = np.empty((width, rows, len(self.a)))
        decay = [np.eye(len(self.a))]
        for k in range(width):
            out[:, k] = state @ self.c + self.d * grid[:, k]
            state = state @ self.a.T + np.outer(grid[:, k], self.b)
            states[k] = state
            decay.append(self.a @ decay[-1])
        starts = np.empty_like(state)
        now = start
        for r in range(rows):
            starts[r] = now
            now = decay[width] @ now + state[r]
        out += starts @ (self.c @ np.array(decay[:width])).T
        k, r = (n - 1) % width, rows - 1
        last = states[k, r] + decay[k + 1] @ starts[r] if n else start
        return out.ravel()[:n], last

    def run_many(self, x: np.ndarray, lengths: np.ndarray, starts: np.ndarray, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, last states) of many signals that lie one after the other in ``x``, as ``run`` gives them one by one.

        Rows of at most ``width`` samples of all signals run side by side.
        """
        lengths = np.asarray(lengths, dtype=np.int64)
        width = max(1, min(width, int(lengths.max(initial=0))))
        rows = -(-lengths // width)
        first = np.cumsum(rows) - rows
        at = np.arange(len(x)) + np.repeat(first * width - (np.cumsum(lengths) - lengths), lengths)
        grid = np.zeros((int(rows.sum()), width))
        grid.ravel()[at] = x
        some = np.flatnonzero(lengths)
        final, ends = (lengths - 1) % width, np.array(starts, dtype=float)
        state, out, last, decay = np.zeros((len(grid), len(self.a))), np.empty_like(grid), np.zeros_like(ends), [np.eye(len(self.a))]
        for k in range(width):
            out[:, k] = state @ self.c + self.d * grid[:, k]
            state = state @ self.a.T + np.outer(grid[:, k], self.b)
            here = some[final[some] == k]
            last[here] = state[first[here] + rows[here] - 1]
            decay.append(self.a @ decay[-1])
        begun, now = np.empty_like(state), ends.copy()
        for r in range(int(rows.max(initial=0))):
            here = np.flatnonzero(rows > r)
            begun[first[here] + r] = now[here]
            now[here] = now[here] @ decay[width].T + state[first[here] + r]
        out += begun @ (self.c @ np.array(decay[:width])).T
        powers = np.array(decay)[final[some] + 1]
        ends[some] = last[some] + np.einsum("nij,nj->ni", powers, begun[first[some] + rows[some] - 1])
        return out.ravel()[at], ends

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)


def biquad(b: tuple[float, float, float], a: tuple[float, float]) -> StateSpace:
    """y = b0 x + b1 x1 + b2 x2 - a1 y1 - a2 y2."""
    return StateSpace(np.array([[-a[0], 1.0], [-a[1], 0.0]]), np.array([b[1] - a[0] * b[0], b[2] - a[1] * b[0]]), np.array([1.0, 0.0]), b[0])


# Corner frequency and quality of the two stages of the loudness weighting.
PRE_HZ, PRE_Q = 1681.974450955533, 0.7071752369554196
LOW_HZ, LOW_Q = 38.13547087602444, 0.5003270373238773


def loudness_weighting(rate: float) -> StateSpace:
    """The loudness weighting: a high-pass stage and a shelf stage. It is not that of BS.1770."""

    def denominator(hz: float, q: float) -> tuple[float, float, float, float]:
        k = math.tan(math.pi * hz / rate)
        return k, k / q, 1.0 / (1.0 + k / q + k * k), k * k

    _, slope, unit, square = denominator(PRE_HZ, PRE_Q)
    high = biquad((unit, -2.0 * unit, unit), (2.0 * (square - 1.0) * unit, (1.0 - slope + square) * unit))
    _, slope, unit, square = denominator(LOW_HZ, LOW_Q)
    shelf = biquad(((slope + square) * unit, 2.0 * square * unit, square * unit), (2.0 * (square - 1.0) * unit, (1.0 - slope + square) * unit))
    return high.then(shelf)
