"""Weighted sums over runs of ascending numbers without visiting every number of every run."""

from __future__ import annotations

from math import comb

import numpy as np

#: Degrees of the tricube weight, and of the moments that a line needs.
_WEIGHT, _LINE = 9, 2
_TOP = _WEIGHT + _LINE


def _weight_terms(side: int) -> np.ndarray:
    """For t = (centre - p) / h: G[m, j], the factor of moment j in the sum of (x - p)^m (1 - |x - p|^3 / h^3)^3, as a matrix from
    powers of t. side: 1 where x is above p, -1 below."""
    out = np.zeros((_TOP + 1, _LINE + 1, _TOP + 1))
    for m in range(_LINE + 1):
        for q, c in ((m, 1), (m + 3, -3 * side), (m + 6, 3), (m + 9, -side)):
            for j in range(q + 1):
                out[q - j, m, j] += c * comb(q, j)
    return out.reshape(_TOP + 1, -1)


_TERMS = {s: _weight_terms(s) for s in (1, -1)}
_BINOMIAL = np.array([[comb(j, i) for i in range(_TOP + 1)] for j in range(_TOP + 1)], dtype=float)


def _powers(t: np.ndarray) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones((len(t), 1)), np.repeat(t[:, None], _TOP, axis=1)], axis=1), axis=1)


def _moved(moments: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moments about a centre that lies ``by`` below their own."""
    p, out = _powers(by), np.empty_like(moments)
    for j in range(moments.shape[1]):
        out[:, j] = (moments[:, : j + 1] * p[:, j::-1] * _BINOMIAL[j, : j + 1]).sum(1)
    return out


class TricubeSums:
    """Tricube-weighted sums over runs of ascending x. The weight is a polynomial in the distance, so what a run gives is a
    sum over the moments of the few tree nodes that make it up, each about its own centre: no power of a distance greater
    than the run's width arises, and a point costs the logarithm of the run's length."""

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, dtype=float)
        low = high = self.x
        self.centres: list[np.ndarray] = []
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            low, high = low[0::2], high[1::2]
            self.centres.append((low + high) / 2)

    def weigh(self, r: np.ndarray, y: np.ndarray) -> None:
        """Set the weight of every x, and its value."""
        self.r, self.ry = np.asarray(r, dtype=float), r * y
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        below = self.x
        for k, centre in enumerate(self.centres):
            if not k:
                both = [np.zeros((len(below), _TOP + 1)) for _ in range(2)]
                both[0][:, 0], both[1][:, 0] = self.r, self.ry
            up = []
            for m in both:
                if len(m) % 2:
                    m = np.concatenate([m, np.zeros((1, _TOP + 1))])
                at = below if len(below) % 2 == 0 else np.append(below, below[-1])
                up.append(_moved(m[0::2], at[0::2] - centre) + _moved(m[1::2], at[1::2] - centre))
            both, below = up, centre
            self.nodes.append((up[0], up[1]))

    def sums(self, p: np.ndarray, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of r w (x - p)^m for m = 0, 1, 2; of r w y (x - p)^m for m = 0, 1) over x[first:end] of each point, all within
        h of it."""
        s, t = np.zeros((len(p), 3)), np.zeros((len(p), 2))
        middle = np.clip(np.searchsorted(self.x, p), first, end)
        for side, lo, hi in ((-1, first, middle), (1, middle, end)):
            lo, hi = lo.astype(np.int64), hi.astype(np.int64)
            for level in range(len(self.centres) + 1):
                some = np.flatnonzero((lo < hi) & (lo % 2 == 1))
                self._add(level, side, some, lo[some], p, h, s, t)
                lo[some] += 1
                some = np.flatnonzero((lo < hi) & (hi % 2 == 1))
                hi[some] -= 1
                self._add(level, side, some, hi[some], p, h, s, t)
                lo, hi = lo // 2, hi // 2
        return s, t

    def _add(self, level: int, side: int, some: np.ndarray, nodes: np.ndarray, p: np.ndarray, h: np.ndarray, s: np.ndarray, t: np.ndarray) -> None:
        if not len(some):
            return
        p, h = p[some], h[some]
        if not level:
            d = self.x[nodes] - p
            w = 1 - (np.abs(d) / h) ** 3
            w = w * w * w
            for m in range(3):
                s[some, m] += self.r[nodes] * w * d**m
            for m in range(2):
                t[some, m] += self.ry[nodes] * w * d**m
            return
        m, y = (x[nodes] / _powers(h) for x in self.nodes[level - 1])
        g = (_powers((self.centres[level - 1][nodes] - p) / h) @ _TERMS[side]).reshape(len(some), 3, _TOP + 1)
        scale = np.stack([np.ones(len(h)), h, h * h], axis=1)
        s[some] += np.einsum("pmj,pj->pm", g, m) * scale
        t[some] += np.einsum("pmj,pj->pm", g[:, :2], y) * scale[:, :2]
