"""Echo-state reservoir: fixed random recurrent states, linear readout, free-running forecast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators.forecast.arrays import array_method, fit_arrays

# Reservoir settings.
NODES = 500
SPARSITY = 0.2
SPECTRAL_RADIUS = 1.2
NOISE = 0.0005
RESERVOIR_SEED = 23


def reservoir(nodes: int, seed: int):
    """Recurrent, input and feedback weights; the same for every series."""
    draw = np.random.default_rng(seed)
    w = draw.uniform(-0.5, 0.5, (nodes, nodes))
    w[draw.uniform(size=w.shape) < SPARSITY] = 0.0
    w *= SPECTRAL_RADIUS / np.abs(np.linalg.eigvals(w)).max()
    return w, draw.uniform(-1, 1, nodes), draw.uniform(-1, 1, nodes)


class Reservoir:
    order = (None, None)

    def __init__(self, nodes: int, seed: int, ridge: float):
        self.nodes, self.seed, self.ridge = nodes, seed, ridge
        self.built = None

    def weights(self):
        """Built on first use, so once per task and never on the driver."""
        if self.built is None:
            self.built = reservoir(self.nodes, self.seed)
        return self.built

    def fit(self, y: np.ndarray):
        """Drive the reservoir with a constant input and the standardised series, then solve the readout."""
        if len(y) < 10:
            raise ValueError("fewer than 10 training rows")
        w, w_in, w_back = self.weights()
        mean, scale = y.mean(), y.std() or 1.0
        teacher = (y - mean) / scale
        noise = np.random.default_rng(self.seed + 1)
        states = np.zeros((len(y), self.nodes))
        for t in range(1, len(y)):
            jitter = NOISE * noise.uniform(-0.5, 0.5, self.nodes)
            states[t] = np.tanh(w @ states[t - 1] + w_in + w_back * teacher[t - 1]) + jitter
        skip = min(len(y) // 10, 100)
        x = np.hstack([states[skip:], np.ones((len(y) - skip, 1))])
        target = teacher[skip:]
        if len(x) > x.shape[1]:
            readout = np.linalg.solve(x.T @ x + self.ridge * np.eye(x.shape[1]), x.T @ target)
        else:
            readout = x.T @ np.linalg.solve(x @ x.T + self.ridge * np.eye(len(x)), target)
        return readout, states[-1], teacher[-1], mean, scale

    def predict(self, model, horizon: int, _shocks) -> np.ndarray:
        readout, state, last, mean, scale = model
        w, w_in, w_back = self.weights()
        out = np.empty(horizon)
        for k in range(horizon):
            state = np.tanh(w @ state + w_in + w_back * last)
            last = readout[:-1] @ state + readout[-1]
            out[k] = last
        return mean + scale * out


def forecast_esn(train: DataFrame, keys: list[str], horizon, nodes: int = NODES, seed: int = RESERVOIR_SEED,
                 ridge: float = 1e-3, **limits) -> DataFrame:
    return fit_arrays(train, keys, horizon, array_method(Reservoir(nodes, seed, ridge)), **limits)
