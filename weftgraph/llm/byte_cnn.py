"""A small convolutional network over bytes, in numpy: forward pass and training.

Bytes are looked up in a learned table, filters slide over them, each filter keeps its largest
response in each region of a window, and a hidden layer makes one logit of these features.
"""

from __future__ import annotations

import numpy as np

PAD = 256


class ByteNet:
    def __init__(self, width: int, stride: int, dim: int, filters: int, features: int, hidden: int, seed: int, channels: int = 0):
        """features: inputs of the hidden layer; channels: further numbers given with each byte."""
        r = np.random.default_rng(seed)
        self.width, self.stride, self.dim, self.filters = width, stride, dim + channels, filters
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "table": (r.standard_normal((257, dim)) * 0.5).astype(np.float32),
            "filter": scale(width * self.dim, filters),
            "shift": np.zeros(filters, np.float32),
            "hidden": scale(features, hidden),
            "hidden_shift": np.zeros(hidden, np.float32),
            "out": scale(hidden, 1)[:, 0],
            "out_shift": np.zeros(1, np.float32),
        }
        self.p["table"][PAD] = 0

    def looked_up(self, windows: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
        x = self.p["table"][windows]
        return x if extra is None else np.concatenate([x, extra.astype(np.float32)], axis=2)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """What each filter gives at each place: windows x places x filters."""
        if self.width == 2 * self.stride and x.shape[1] % self.stride == 0:
            half = self.stride * self.dim
            w = self.p["filter"]
            parts = x.reshape(-1, half) @ np.concatenate([w[:half], w[half:]], axis=1)
            parts = parts.reshape(len(x), -1, 2 * self.filters)
            out = parts[:, :-1, : self.filters] + parts[:, 1:, self.filters :]
        else:
            out = self.patches(x) @ self.p["filter"]
        return out + self.p["shift"]

    def patches(self, x: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1)[:, :: self.stride]
        return np.ascontiguousarray(view.swapaxes(2, 3)).reshape(len(x), -1, self.width * self.dim)

    def head(self, features: np.ndarray) -> np.ndarray:
        return np.maximum(features @ self.p["hidden"] + self.p["hidden_shift"], 0) @ self.p["out"] + self.p["out_shift"]

    def head_back(self, features: np.ndarray, d_logit: np.ndarray, grads: dict) -> np.ndarray:
        """Adds to grads; the features' own gradient."""
        pre = features @ self.p["hidden"] + self.p["hidden_shift"]
        act = np.maximum(pre, 0)
        grads["out"] += act.T @ d_logit
        grads["out_shift"] += d_logit.sum()
        d_pre = np.outer(d_logit, self.p["out"]) * (pre > 0)
        grads["hidden"] += features.T @ d_pre
        grads["hidden_shift"] += d_pre.sum(axis=0)
        return d_pre @ self.p["hidden"].T

    def filters_back(self, windows: np.ndarray, x: np.ndarray, place: np.ndarray, d: np.ndarray, grads: dict) -> None:
        """place: where each window's largest response of each filter was; d: that response's gradient."""
        rows = np.arange(len(windows))[:, None, None]
        at = place[:, :, None] * self.stride + np.arange(self.width)  # windows x filters x width
        seen = x[rows, at]  # ... x dim
        grads["filter"] += np.einsum("nf,nfk->kf", d, seen.reshape(*d.shape, -1), optimize=True)
        grads["shift"] += d.sum(axis=0)
        w = self.p["filter"].reshape(self.width, self.dim, self.filters)
        dim = self.p["table"].shape[1]
        d_x = np.einsum("nf,wdf->nfwd", d, w[:, :dim], optimize=True)
        flat, codes = d_x.reshape(-1, dim), windows[rows, at].ravel()
        for k in range(dim):
            grads["table"][:, k] += np.bincount(codes, flat[:, k], minlength=257).astype(np.float32)
        grads["table"][PAD] = 0

    def no_grads(self) -> dict:
        return {k: np.zeros_like(v) for k, v in self.p.items()}


class Adam:
    def __init__(self, p: dict, rate: float, decay: float = 1e-4):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def calibration(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the sigmoid of a logit a probability, fitted by Newton's steps."""
    a, b = 1.0, 0.0
    # Platt's targets, so that a clean split doesn't drive the slope up
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * logits.astype(np.float64) + b
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * a * a)

    for _ in range(100):
        p = sigmoid(a * logits + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * logits).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * logits * logits).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        now = loss(a, b)
        while loss(a - step[0], b - step[1]) > now and np.abs(step).max() > 1e-9:  # a whole step can go too far where labels are clearly split
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
