"""Small models trained in numpy on a bounded sample: boosted trees, logistic regression, isotonic steps."""

from __future__ import annotations

import zlib

import numpy as np

BINS = 32


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def set_aside(ids: list[int], y: np.ndarray, share: int = 5) -> np.ndarray:
    """Mask of about one in ``share`` rows of each label, chosen by a hash of the id."""
    order = np.argsort([zlib.crc32(b"aside %d" % i) for i in ids], kind="stable") if len(ids) else np.zeros(0, int)
    mask = np.zeros(len(y), bool)
    for label in np.unique(y):
        mask[order[y[order] == label][::share]] = True
    return mask


class BoostedTrees:
    """Gradient-boosted trees on the logistic loss, over at most ``BINS`` quantile bins a feature.

    With no rows, or rows of one class, the score is the constant prior.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: int = 5):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least
        self.nodes: list[list[tuple[int, float, float]]] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1) if n else 0.0
        self.prior = float(np.log(share / (1 - share))) if n else -30.0
        if not n or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        raw = np.full(n, self.prior)
        for _ in range(self.trees):
            p = sigmoid(raw)
            tree, leaf = self._tree(codes, edges, y - p, p * (1 - p))
            self.nodes.append(tree)
            raw += leaf
        return self

    def _tree(self, codes: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray):
        """A complete binary tree as (feature, bound, value) per heap position; feature -1 is a leaf."""
        size = 2 ** (self.depth + 1) - 1
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * size
        at = np.zeros(len(gradient), int)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = gradient[rows], hessian[rows]
            value = self.rate * g.sum() / (h.sum() + self.ridge)
            best = (1e-6, -1, 0)
            if node < size // 2:
                whole = g.sum() ** 2 / (h.sum() + self.ridge)
                for f, edge in enumerate(edges):
                    if not len(edge):
                        continue
                    c = codes[rows, f]
                    left_n = np.cumsum(np.bincount(c, minlength=len(edge) + 1))[:-1]
                    left_g = np.cumsum(np.bincount(c, g, len(edge) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(c, h, len(edge) + 1))[:-1]
                    gain = left_g**2 / (left_h + self.ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + self.ridge) - whole
                    gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            _, f, k = best
            if f < 0:
                tree[node] = (-1, 0.0, float(value))
            else:
                tree[node] = (f, float(edges[f][k]), float(value))
                at[rows] = np.where(codes[rows, f] <= k, 2 * node + 1, 2 * node + 2)
        return tree, np.array([t[2] for t in tree])[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for tree in self.nodes:
            feature = np.array([t[0] for t in tree])
            bound = np.array([t[1] for t in tree])
            value = np.array([t[2] for t in tree])
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                rows = np.flatnonzero(inner)
                at[rows] = 2 * at[rows] + np.where(x[rows, f[rows]] <= bound[at[rows]], 1, 2)
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, ridge: float = 1.0, steps: int = 25):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        deviation = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        self.scale = np.where(deviation > 1e-9, deviation, 1.0)
        z = self._design(x)
        self.weight = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-3
        for _ in range(self.steps if len(x) else 0):
            p = sigmoid(z @ self.weight)
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.weight)
            self.weight += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


class Isotonic:
    """Non-decreasing steps from scores to label shares (pool adjacent violators), linear in between."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, first and last score
        for s, label in zip(score[order].tolist(), y[order].tolist()):
            if blocks and blocks[-1][3] == s:
                blocks[-1][0] += label
                blocks[-1][1] += 1
            else:
                blocks.append([label, 1, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                total, rows, _, last = blocks.pop()
                blocks[-1][0] += total
                blocks[-1][1] += rows
                blocks[-1][3] = last
        self.at = np.array([s for b in blocks for s in (b[2], b[3])])
        self.share = np.array([s for b in blocks for s in [b[0] / b[1]] * 2])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.share) if len(self.at) else score
