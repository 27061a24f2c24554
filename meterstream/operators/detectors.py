"""Other detectors in numpy: isolation forest, negative-binomial regression, recurrent network, density estimate."""

from __future__ import annotations

from math import lgamma

import numpy as np


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Anomaly score of each row, from 0 to 1: how soon random splits set it apart."""
    rng = np.random.default_rng(seed)
    n = len(x)
    size = min(sample, n)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def usual(k: np.ndarray | int) -> np.ndarray:
        k = np.asarray(k, float)
        return np.where(k > 2, 2 * (np.log(np.maximum(k - 1, 1)) + 0.5772156649) - 2 * (k - 1) / np.maximum(k, 1), np.where(k == 2, 1.0, 0.0))

    depth = np.zeros(n)
    for _ in range(trees):
        todo = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while todo:
            own, rows, level = todo.pop()
            if not len(rows):
                continue
            spread = x[own].max(0) - x[own].min(0) if len(own) else np.zeros(x.shape[1])
            if level >= limit or len(own) <= 1 or not (spread > 0).any():
                depth[rows] += level + usual(len(own))
                continue
            f = rng.choice(np.flatnonzero(spread > 0))
            cut = rng.uniform(x[own, f].min(), x[own, f].max())
            todo.append((own[x[own, f] < cut], rows[x[rows, f] < cut], level + 1))
            todo.append((own[x[own, f] >= cut], rows[x[rows, f] >= cut], level + 1))
    return 2 ** (-depth / trees / max(float(usual(size)), 1e-9))


def negative_binomial(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients and means of a log-linear model by iterated weighted least squares, and the dispersion of its Pearson residuals."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.mean(), 1e-6))
    mu = np.exp(x @ beta)
    for _ in range(rounds):
        w = mu / (1 + alpha * mu)
        z = x @ beta + (y - mu) / mu
        xw = x * w[:, None]
        new = np.linalg.solve(x.T @ xw + 1e-8 * np.eye(x.shape[1]), xw.T @ z)
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        mu = np.exp(np.clip(x @ beta, -30, 30))
        if done:
            break
    scale = float(((y - mu) ** 2 / (mu + alpha * mu**2)).sum() / max(1, len(y) - x.shape[1]))
    return beta, mu, scale


def negative_binomial_pmf(k: np.ndarray, mu: np.ndarray, alpha: float) -> np.ndarray:
    r = 1 / alpha
    return np.exp([lgamma(a + r) - lgamma(r) - lgamma(a + 1) + r * np.log(r / (r + m)) + a * np.log(m / (r + m)) for a, m in zip(k, np.maximum(mu, 1e-12))])


def density(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gaussian kernel density with Scott's bandwidth."""
    n = len(values)
    h = np.std(values, ddof=1) * n ** (-1 / 5) if n > 1 else 0.0
    if not h > 0:
        return np.zeros(len(at))
    return np.exp(-0.5 * ((at[:, None] - values[None]) / h) ** 2).sum(1) / (n * h * np.sqrt(2 * np.pi))


class Gru:
    """A recurrent network of one layer and a linear output, trained by Adam on squared error with clipped gradients."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 0):
        rng = np.random.default_rng(seed)
        k = 1 / np.sqrt(hidden)
        self.hidden = hidden
        self.p = {"W": rng.uniform(-k, k, (inputs, 3 * hidden)), "U": rng.uniform(-k, k, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden), "c": np.zeros(hidden), "V": rng.uniform(-k, k, hidden), "d": np.zeros(1)}
        self.m = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in self.p.items()}
        self.t = 0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        n = self.hidden
        h = np.zeros((len(x), n))
        kept = []
        for t in range(x.shape[1]):
            a, u = x[:, t] @ self.p["W"] + self.p["b"], h @ self.p["U"]
            r, z = (1 / (1 + np.exp(-(a[:, k * n : (k + 1) * n] + u[:, k * n : (k + 1) * n]))) for k in (0, 1))
            hu = u[:, 2 * n :] + self.p["c"]
            g = np.tanh(a[:, 2 * n :] + r * hu)
            kept.append((h, r, z, g, hu))
            h = (1 - z) * g + z * h
        return h, kept

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0] @ self.p["V"] + self.p["d"][0]

    def predict_all(self, x: np.ndarray) -> np.ndarray:
        """The output behind each row of the windows."""
        h, kept = self._forward(x)
        return np.stack([*(k[0] for k in kept[1:]), h], axis=1) @ self.p["V"] + self.p["d"][0]

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, clip: float = 1.0) -> float:
        """One step of Adam on targets behind the last row of each window, or, in two dimensions, behind every row."""
        n = self.hidden
        h, kept = self._forward(x)
        after = [*(k[0] for k in kept[1:]), h]
        every = y.ndim == 2
        e = (np.stack(after, axis=1) if every else h) @ self.p["V"] + self.p["d"][0] - y
        back = 2 * e / e.size
        back = back if every else np.concatenate([np.zeros((len(y), x.shape[1] - 1)), back[:, None]], axis=1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["d"] = np.array([back.sum()])
        dh = np.zeros_like(h)
        for t in range(x.shape[1] - 1, -1, -1):
            g["V"] += after[t].T @ back[:, t]
            dh = dh + np.outer(back[:, t], self.p["V"])
            before, r, z, c, hu = kept[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * hu * r * (1 - r)
            da = np.concatenate([dr, dz, dc], axis=1)
            du = np.concatenate([dr, dz, dc * r], axis=1)
            g["W"] += x[:, t].T @ da
            g["b"] += da.sum(0)
            g["U"] += before.T @ du
            g["c"] += (dc * r).sum(0)
            dh = dh * z + du @ self.p["U"].T
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        self.t += 1
        for k, v in g.items():
            v = v * min(1.0, clip / (norm + 1e-12))
            a, b = self.m[k]
            a[...] = 0.9 * a + 0.1 * v
            b[...] = 0.999 * b + 0.001 * v * v
            self.p[k] -= rate * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.999**self.t)) + 1e-8)
        return float((e * e).mean())

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 32, rate: float = 1e-3, halve_every: int = 10, seed: int = 0) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            parts = [self.step(x[k], y[k], rate * 0.5 ** (epoch // halve_every)) for k in np.array_split(order, max(1, len(order) // batch))]
            losses.append(float(np.mean(parts)))
        return losses


def windows(features: np.ndarray, width: int, last_inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sliding windows and targets: the first feature right after a window, or, ``last_inside``, its last row's own."""
    n = len(features) - width
    if n <= 0:
        return np.zeros((0, width, features.shape[1])), np.zeros(0)
    x = np.lib.stride_tricks.sliding_window_view(features, width, axis=0).transpose(0, 2, 1)[:n]
    return x, features[width - 1 : width - 1 + n, 0] if last_inside else features[width : width + n, 0]
