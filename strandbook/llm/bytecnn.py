"""A byte-level convolutional network in numpy.

Bytes are embedded, filters of several widths slide over them, and every filter keeps its largest
response (max pooling).  Because a filter's response is a sum over its offsets, each offset has a
table from byte to contribution, and applying the network is looking up and adding rows.
"""

from __future__ import annotations

import numpy as np

DIM, WIDTHS, FILTERS = 8, (2, 3, 4), 16


class ByteCNN:
    """Features of fixed-length windows and a linear head on top; trained with Adam."""

    def __init__(self, classes: int, head_inputs: int = 1, seed: int = 0):
        rng = np.random.default_rng(seed)
        n, top = FILTERS * len(WIDTHS), max(WIDTHS)
        #: filters by offset; a filter of width k has no weights beyond offset k - 1
        self.mask = (np.repeat(WIDTHS, FILTERS)[None, :] > np.arange(top)[:, None]).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": (rng.normal(0, 1 / np.sqrt(DIM * 3), (top, DIM, n)) * self.mask[:, None, :]).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "head": rng.normal(0, 1 / np.sqrt(n), (head_inputs * n, classes)).astype(np.float32),
            "out": np.zeros(classes, np.float32),
        }
        self.tables = self._tables()

    def _tables(self) -> list[np.ndarray]:
        return [np.ascontiguousarray((self.p["embed"] @ w)[:, (0 if j == 0 else FILTERS * sum(k <= j for k in WIDTHS)) :]) for j, w in enumerate(self.p["filters"])]

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, filters) before pooling."""
        last = x.shape[1] - len(self.tables) + 1
        out = self.tables[0][x[:, :last]]
        for j, t in enumerate(self.tables[1:], 1):
            out[..., out.shape[2] - t.shape[1] :] += t[x[:, j : j + last]]
        return out

    def features(self, x: np.ndarray) -> np.ndarray:
        """(windows, filters) for uint8 windows of equal length."""
        step = max(1, 16_384 // x.shape[1])
        parts = [self.responses(x[i : i + step]).max(1) for i in range(0, len(x), step)]
        n = self.p["bias"].shape[0]
        return np.maximum(np.concatenate(parts) + self.p["bias"], 0) if parts else np.zeros((0, n), np.float32)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return z @ self.p["head"] + self.p["out"]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.responses(x)
        where = r.argmax(1)
        return np.maximum(np.take_along_axis(r, where[:, None, :], 1)[:, 0] + self.p["bias"], 0), where

    def gradients(self, x: np.ndarray, z: np.ndarray, where: np.ndarray, dz: np.ndarray) -> dict[str, np.ndarray]:
        """Of embedding, filters and bias, given the gradient of the pooled features."""
        dz = dz * (z > 0)
        g = {"embed": np.zeros_like(self.p["embed"]), "filters": np.zeros_like(self.p["filters"]), "bias": dz.sum(0)}
        row = np.arange(len(x))[:, None]
        for j in range(len(self.tables)):
            seen = x[row, where + j]
            d = dz * self.mask[j]
            g["filters"][j] = np.einsum("bf,bfd->df", d, self.p["embed"][seen])
            np.add.at(g["embed"], seen, d[..., None] * self.p["filters"][j].T[None])
        return g

    def adam(self, g: dict[str, np.ndarray], state: dict, rate: float) -> None:
        state["t"] = t = state.get("t", 0) + 1
        for k, grad in g.items():
            m, v = state.get(k, (np.zeros_like(grad), np.zeros_like(grad)))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            state[k] = m, v
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.tables = self._tables()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
