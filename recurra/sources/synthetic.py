"""Synthetic bars with known structure, for acceptance tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("advance_base", "vee", "decline_base", "range_break", "spike_fade")
KNOTS = {"advance_base": (0, 0.5, 0.9, 0.85, 0.9), "vee": (0, -0.3, -0.55, -0.2, 0.1), "decline_base": (0, -0.4, -0.7, -0.68, -0.72), "range_break": (0, 0.03, -0.02, 0.02, 0.35), "spike_fade": (0, 0.1, 0.7, 0.3, 0.15)}


def case(family: str, seed: int, sessions: int = 252, noise: float = 0.01) -> pd.DataFrame:
    """Bars whose log close follows the family's knots, with noise by seed."""
    random = np.random.default_rng([FAMILIES.index(family), seed])
    path = np.interp(np.linspace(0, 4, sessions), range(5), KNOTS[family])
    close = 100 * np.exp(path + np.cumsum(random.normal(0, noise / 4, sessions)) + random.normal(0, noise / 4, sessions))
    open_ = np.concatenate([close[:1], close[:-1]]) * np.exp(random.normal(0, noise / 4, sessions))
    spread = np.abs(random.normal(0, noise / 2, (2, sessions)))
    high, low = np.maximum(open_, close) * np.exp(spread[0]), np.minimum(open_, close) * np.exp(-spread[1])
    volume = np.round(1e5 * np.exp(random.normal(0, 0.2, sessions) + 20 * np.abs(np.diff(path, prepend=0))))
    return pd.DataFrame({"symbol": f"{family}-{seed}", "ts": pd.bdate_range("2015-01-01", periods=sessions), "open": open_, "high": high, "low": low, "close": close, "volume": volume})


def transformed(bars: pd.DataFrame, how: str, seed: int = 0) -> pd.DataFrame:
    """A case in other units (unit, volume), with noise, run backwards, or later (shift)."""
    out = bars.copy()
    prices = ["open", "high", "low", "close"]
    if how == "unit":
        out[prices] *= 7.3
    elif how == "volume":
        out["volume"] *= 11
    elif how == "noise":
        out[prices] = out[prices].mul(np.exp(np.random.default_rng(seed).normal(0, 0.001, len(out))), axis=0)
    elif how == "reverse":
        out[prices + ["volume"]] = out[prices + ["volume"]].to_numpy()[::-1]
        out["open"], out["close"] = out["close"].copy(), out["open"].copy()
    elif how == "shift":
        out["ts"] = out["ts"] + pd.Timedelta(days=364)
    return out


def corpus(spark: SparkSession, seeds: int = 5, sessions: int = 252) -> DataFrame:
    """All families times seeds, made on the executors."""
    grid = spark.createDataFrame([(f, s) for f in FAMILIES for s in range(seeds)], "family string, seed int").repartition(8)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, s in frame.itertuples(index=False):
                yield case(f, s, sessions)

    return grid.mapInPandas(make, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def variants(bars: DataFrame, how: tuple[str, ...]) -> DataFrame:
    """Each case under each transform, as symbol/transform."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts").reset_index(drop=True)
        return pd.concat([transformed(frame, h).assign(symbol=f"{frame['symbol'].iloc[0]}/{h}") for h in how], ignore_index=True)

    return bars.groupBy("symbol").applyInPandas(make, bars.schema)


# --- latent structures: paths through control points, with volatility, volume and market that go with them -----------------

#: Control points (share of the window, log price), volatility at the start, the end and the tail, dryness and
#: participation of the tail's volume, drift and volatility of the market.
LATENT = {
    "latent-00": (((0, 0), (0.28, 0.24), (0.48, 0.16), (0.68, 0.23), (0.88, 0.20), (1, 0.34)), (0.016, 0.005, 0.014), (0.55, 2.2), (0.0005, 0.005)),
    "latent-01": (((0, 0.18), (0.30, -0.14), (0.52, -0.20), (0.72, -0.06), (0.90, 0.06), (1, 0.18)), (0.021, 0.008, 0.012), (0.75, 1.5), (-0.0002, 0.008)),
    "latent-02": (((0, 0), (0.18, 0.13), (0.34, 0.08), (0.50, 0.21), (0.67, 0.16), (0.84, 0.29), (1, 0.36)), (0.011, 0.007, 0.010), (0.90, 1.4), (0.0004, 0.004)),
    "latent-03": (((0, 0), (0.22, 0.04), (0.43, -0.025), (0.64, 0.022), (0.84, -0.008), (0.94, 0.004), (1, 0.13)), (0.014, 0.0035, 0.012), (0.45, 2.5), (0.0001, 0.004)),
    "latent-04": (((0, 0.16), (0.24, 0.04), (0.43, -0.27), (0.61, -0.10), (0.78, 0.02), (0.91, 0.08), (1, 0.17)), (0.024, 0.010, 0.013), (0.85, 1.7), (-0.0004, 0.009)),
    "latent-05": (((0, 0), (0.25, 0.17), (0.50, 0.34), (0.68, 0.43), (0.80, 0.36), (0.94, 0.39), (1, 0.45)), (0.012, 0.005, 0.009), (0.60, 1.6), (0.0007, 0.005)),
    "latent-06": (((0, 0.20), (0.19, 0.08), (0.36, 0.16), (0.55, 0.03), (0.72, 0.10), (0.88, -0.01), (1, -0.08)), (0.014, 0.011, 0.016), (1.10, 1.8), (-0.0003, 0.006)),
    "latent-07": (((0, 0), (0.18, 0.19), (0.38, -0.07), (0.57, 0.16), (0.76, 0.04), (0.91, 0.12), (1, 0.27)), (0.022, 0.012, 0.015), (0.95, 2.0), (0.0002, 0.010)),
}
TAIL, TURN = 0.88, 0.78


def latent(name: str, seed: int, sessions: int = 300, tempo: float = 1.0, noise: float = 1.0, negative: bool = False) -> pd.DataFrame:
    """Bars of a structure and the market's closes. tempo bends time, noise scales it; a critical negative is the same up to
    its last part, whose returns it turns round, with volume against them and a falling market."""
    points, sigmas, (dry, busy), (drift, rough) = LATENT[name]
    random = np.random.default_rng([sorted(LATENT).index(name), seed])
    at = np.arange(sessions) / (sessions - 1)
    tail, turned = at >= TAIL, int(sessions * TURN)
    sigma = np.where(tail, sigmas[2], np.interp(at, (0, 1), sigmas[:2]))
    shocks = pd.Series(random.normal(size=sessions) * sigma * noise)
    wander = 0.28 * (shocks - 0.55 * shocks.rolling(7, min_periods=1).mean()).cumsum().to_numpy()
    path = np.interp(at**tempo, *np.transpose(points)) + wander
    if negative:
        after = np.diff(path)[turned - 1 :]
        path = np.concatenate([path[:turned], path[turned - 1] - 1.15 * np.cumsum(after) + np.linspace(0, -0.16, sessions - turned)])
    moves = np.diff(path, prepend=path[0])
    close, before = 100 * np.exp(path), 100 * np.exp(path - moves)
    open_ = before * np.exp(random.normal(size=sessions) * np.maximum(0.18 * sigma, 0.0008))
    reach = random.uniform(0.2, 0.7, (2, sessions)) * np.maximum(np.abs(moves), 0.45 * sigma)
    drying = np.interp(at, (0.45, TAIL), (1.0, dry))
    tilt = (-1 if negative else 1) * 8 * np.clip(moves, -0.04, 0.04)
    volume = 1e6 * drying * np.where(tail, 1 / busy if negative else busy, 1.0) * np.exp(tilt + 0.16 * noise * random.normal(size=sessions))
    market = drift + 0.18 * moves + rough * random.normal(size=sessions) - 0.0025 * (negative & (np.arange(sessions) >= turned))
    return pd.DataFrame({
        "symbol": f"{name}-{seed}{'-negative' if negative else ''}", "ts": pd.bdate_range("2005-01-03", periods=sessions), "open": open_, "high": np.maximum(open_, close) * (1 + reach[0]),
        "low": np.minimum(open_, close) * (1 - reach[1]), "close": close, "volume": np.maximum(1.0, np.floor(volume)), "bench_close": 1000 * np.exp(np.cumsum(market)),
    })


def latent_corpus(spark: SparkSession, seeds: int = 2, sessions: int = 300) -> DataFrame:
    """Every structure and seed: as it is, at another tempo with more noise, and as a critical negative; made on the executors."""
    grid = spark.createDataFrame([(f, s) for f in LATENT for s in range(seeds)], "name string, seed int").repartition(8)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, s in frame.itertuples(index=False):
                yield latent(f, s, sessions)
                yield latent(f, s, sessions, tempo=1.1, noise=1.2).assign(symbol=f"{f}-{s}-tempo")
                yield latent(f, s, sessions, negative=True)

    return grid.mapInPandas(make, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, bench_close double")
