"""Gaussian-process regression with a Matern-5/2 kernel and one length scale per input."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

JITTER, ROUNDS, MEMORY = 1e-6, 100, 5
#: Greatest size of a log parameter; a step beyond it is halved, as its powers would overflow.
FARTHEST = 100.0


def _kernel(a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariance, scaled distance and scaled squared differences per input. theta: log lengths, log signal, log noise."""
    d2 = ((a[:, None, :] - b[None, :, :]) / np.exp(theta[: a.shape[1]])) ** 2
    r = np.sqrt(5 * d2.sum(2))
    return np.exp(2 * theta[-2]) * (1 + r + r * r / 3) * np.exp(-r), r, d2


def objective(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log marginal likelihood and its gradient."""
    if not np.abs(theta).max() <= FARTHEST:
        return np.inf, np.zeros_like(theta)
    k, r, d2 = _kernel(x, x, theta)
    n = len(y)
    full = k + (np.exp(2 * theta[-1]) + JITTER) * np.eye(n)
    try:
        low = np.linalg.cholesky(full)
    except np.linalg.LinAlgError:
        return np.inf, np.zeros_like(theta)
    inverse = np.linalg.inv(full)
    alpha = inverse @ y
    value = 0.5 * y @ alpha + np.log(np.diag(low)).sum() + 0.5 * n * np.log(2 * np.pi)
    weight = inverse - np.outer(alpha, alpha)
    slope = np.exp(2 * theta[-2]) * 5 / 3 * (1 + r) * np.exp(-r)
    grad = [0.5 * (weight * slope * d2[:, :, j]).sum() for j in range(x.shape[1])]
    grad += [(weight * k).sum(), np.exp(2 * theta[-1]) * np.trace(weight)]
    return float(value), np.array(grad)


def minimize(f, start: np.ndarray) -> np.ndarray:
    """L-BFGS with Armijo backtracking."""
    t = start.copy()
    value, grad = f(t)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if np.linalg.norm(grad) < 1e-5:
            break
        q, kept = grad.copy(), []
        for s, g in reversed(steps):
            a = (s @ q) / (g @ s)
            kept.append(a)
            q -= a * g
        if steps:
            s, g = steps[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(kept), strict=True):
            q += s * (a - (g @ q) / (g @ s))
        direction = -q if grad @ q > 0 else -grad
        size = 1.0
        for _ in range(20):
            new_value, new_grad = f(t + size * direction)
            if new_value <= value + 1e-4 * size * (grad @ direction):
                break
            size /= 2
        else:
            break
        s, g = size * direction, new_grad - grad
        t, value, grad = t + s, new_value, new_grad
        if s @ g > 1e-10:
            steps = [*steps, (s, g)][-MEMORY:]
    return t


@dataclass
class Process:
    x: np.ndarray
    alpha: np.ndarray
    theta: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def predict(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([_kernel((at[a : a + 2000] - self.mean) / self.std, self.x, self.theta)[0] @ self.alpha for a in range(0, len(at), 2000)] or [np.zeros(0)])


def fit(x: np.ndarray, y: np.ndarray) -> Process:
    """Inputs are standardized; the target is not centered."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-12, 1.0, std)
    z = (x - mean) / std
    theta = minimize(lambda t: objective(t, z, y), np.array([0.0] * x.shape[1] + [0.0, -2.0]))
    k = _kernel(z, z, theta)[0] + (np.exp(2 * theta[-1]) + JITTER) * np.eye(len(y))
    return Process(z, np.linalg.solve(k, y), theta, mean, std)
