"""Seeded panels with planted truth, for tests, simulation and power studies: small, made on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PANEL = "verdict string, unit long, k long, v double, pre boolean"


def factor_panel(units: int, bins: int, pre: int, effect: float, seed: int, noise: float = 0.01) -> np.ndarray:
    """(units + 1, bins): donors on common factors; unit 0 a mix of five of them, shifted by effect from bin pre on."""
    r = np.random.default_rng(seed)
    f = r.normal(0, 1, (4, bins)).cumsum(axis=1) * 0.03 + 0.1 * np.sin(np.arange(bins) / 6.0)
    d = 0.5 + r.normal(0.5, 0.3, (units, 4)) @ f + r.normal(0, noise, (units, bins))
    y = r.dirichlet(np.ones(5)) @ d[:5] + r.normal(0, noise / 2, bins)
    y[pre:] += effect
    return np.vstack([y, d])


def autoregressive(n: int, phi: float, sigma: float, k: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    e = r.normal(0, sigma, (n, k))
    out = np.zeros((n, k))
    for t in range(n):
        out[t] = (phi * out[t - 1] if t else 0) + e[t]
    return out


def as_panel(spark: SparkSession, named: dict[str, tuple[np.ndarray, int]]) -> DataFrame:
    """Matrices (units, bins) with the first bin after the event, as a long panel by verdict."""
    rows = [pd.DataFrame({"verdict": name, "unit": np.repeat(np.arange(len(m)), m.shape[1]), "k": np.tile(np.arange(m.shape[1]), len(m)), "v": m.reshape(-1), "pre": np.tile(np.arange(m.shape[1]) < p, len(m))}) for name, (m, p) in named.items()]
    return spark.createDataFrame(pd.concat(rows, ignore_index=True), PANEL)


def monitors(weeks: int = 170, donors: int = 18, treated: int = 3, event: int = 156, effect: float = -6.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weekly levels (treated, weeks), (donors, weeks) and the pre mask."""
    r = np.random.default_rng(seed)
    t = np.arange(weeks)
    common = 5 * np.cos(2 * np.pi * t / 52) - 0.02 * t + autoregressive(weeks, 0.5, 0.8, 1, seed)[:, 0]
    make = lambda n: 35 + r.normal(0, 2, (n, 1)) + r.uniform(0.8, 1.2, (n, 1)) * common + r.normal(0, 0.8, (n, weeks))
    tr, d = make(treated), make(donors)
    tr[:, event:] += effect
    return tr, d, t < event
