"""States that have to be folded over time: directional changes, swing legs, and windows at several horizons."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.functions import kernels as K

#: Horizons and their weights.
HORIZONS = {252: 0.18, 126: 0.20, 63: 0.24, 21: 0.20, 10: 0.11, 5: 0.07}


def turns(close: np.ndarray, volume: np.ndarray, threshold: float) -> list[tuple]:
    """Confirmed reversals by a fraction of the extreme: direction, places and prices of extreme and confirmation, size, duration, volume ratio."""
    out, way, top, place, since = [], 1, close[0], 0, 0
    for i in range(1, len(close)):
        p = close[i]
        if (p >= top) if way > 0 else (p <= top):
            top, place = p, i
        elif (p <= top * (1 - threshold)) if way > 0 else (p >= top * (1 + threshold)):
            usual = float(np.median(volume[since : i + 1]))
            out.append((-way, place, i, float(top), float(p), float(p / top - 1), i - place, float(volume[i] / usual) if usual else 0.0))
            way, top, place, since = -way, p, i, i
    return out


def directional_events(bars: DataFrame, thresholds: tuple[float, ...] = K.THRESHOLDS) -> DataFrame:
    names = ["direction", "extreme_index", "confirmation_index", "extreme_price", "confirmation_price", "amplitude", "duration", "volume_ratio"]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        rows = [(frame["symbol"].iloc[0], t, *e) for t in thresholds for e in turns(frame["close"].to_numpy(float), frame["volume"].to_numpy(float), t)]
        return pd.DataFrame(rows, columns=["symbol", "threshold", *names])

    schema = "symbol string, threshold double, direction int, extreme_index int, confirmation_index int, extreme_price double, confirmation_price double, amplitude double, duration int, volume_ratio double"
    return bars.select("symbol", "ts", "close", "volume").groupBy("symbol").applyInPandas(one, schema)


def legs(bars: DataFrame, atr_multiple: float = 3.0) -> DataFrame:
    """Per session, known by then: depth and length of the last falls and rises of an ATR zig-zag, and the open leg."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts").reset_index(drop=True)
        c, h, l = (frame[k].to_numpy(float) for k in ("close", "high", "low"))
        before = np.concatenate([[np.nan], c[:-1]])
        tr = np.nanmax([h - l, np.abs(h - before), np.abs(l - before)], axis=0)
        atr = K.roll_mean(tr[None, :], 20, 20)[0]
        way, top, at, start, closed, out = 1, c[0], 0, (c[0], 0), [], []
        for i in range(len(c)):
            if (c[i] >= top) if way > 0 else (c[i] <= top):
                top, at = c[i], i
            elif np.isfinite(atr[i]) and abs(c[i] - top) >= atr_multiple * atr[i]:
                closed.append((way, abs(top / start[0] - 1), at - start[1]))
                start, way, top, at = (top, at), -way, c[i], i
            falls, rises = [x for x in closed if x[0] < 0][-3:][::-1], [x for x in closed if x[0] > 0][-3:][::-1]
            get = lambda x, k, j: x[k][j] if k < len(x) else np.nan
            shrink = sum(a[1] < b[1] for a, b in zip(falls[:-1], falls[1:]))
            out.append((frame["symbol"].iloc[0], frame["ts"].iloc[i], *[get(x, k, j) for x in (falls, rises) for k in range(3) for j in (1, 2)], shrink, abs(c[i] - start[0]) / atr[i] if np.isfinite(atr[i]) and atr[i] > 0 else np.nan, i - start[1]))
        return pd.DataFrame(out, columns=["symbol", "ts", *LEGS])

    schema = "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in LEGS)
    return bars.select("symbol", "ts", "close", "high", "low").groupBy("symbol").applyInPandas(one, schema)


LEGS = [f"{side}_{k}_{what}" for side in ("down", "up") for k in (1, 2, 3) for what in ("depth", "bars")] + ["contraction_count", "current_leg_atr", "current_leg_bars"]


# --- states at several horizons ---------------------------------------------------------------------------------------

#: Points of a resampled channel; per channel its scale and weight; per summary the same; channels taken from their first common point.
POINTS = 32
CHANNEL = {
    "close_path": (0.15, 3.0), "return": (0.02, 1.2), "overnight": (0.015, 0.5), "intraday": (0.015, 0.7), "range_pct": (0.02, 1.0), "body_atr": (1.0, 0.5), "upper_wick_atr": (0.7, 0.3), "lower_wick_atr": (0.7, 0.3),
    "close_location": (0.35, 0.5), "atr_pct": (0.015, 1.2), "volume_robust_z": (1.5, 1.3), "return_shock_z": (1.5, 0.8), "distance_high_63": (0.10, 1.4), "distance_ma_20": (0.08, 1.0), "distance_ma_50": (0.10, 1.0),
    "compression_ratio": (0.60, 1.5), "benchmark_close": (250.0, 0.0), "benchmark_return": (0.015, 0.4), "benchmark_path": (0.10, 0.5), "benchmark_volatility": (0.012, 0.4), "benchmark_drawdown": (0.10, 0.5),
    "relative_return": (0.02, 0.8), "relative_path": (0.12, 1.0),
}
SUMMARY = {
    "net_log_return": (0.15, 2.0), "maximum_drawdown": (0.12, 1.5), "distance_from_window_high": (0.12, 1.5), "realized_volatility": (0.015, 1.0), "median_range_pct": (0.02, 0.8), "range_contraction": (0.60, 1.4),
    "latest_overnight": (0.02, 0.3), "latest_close_location": (0.35, 0.4), "latest_atr_pct": (0.015, 1.0), "latest_compression_ratio": (0.60, 1.2), "mean_volume_robust_z": (1.2, 0.7), "latest_volume_robust_z": (1.5, 0.7),
    "up_down_volume_z_spread": (1.5, 0.9), "relative_log_return": (0.12, 1.0), "benchmark_log_return": (0.10, 0.4), "benchmark_context_fraction": (0.30, 0.8),
    "directional_events_3pct": (4.0, 0.8), "directional_events_6pct": (3.0, 1.0), "directional_events_12pct": (2.0, 1.2),
}
REBASED = ("close_path", "relative_path", "benchmark_path", "benchmark_close")
CHANNEL_PART, SUMMARY_PART, CLIP, ONE_SIDE = 0.68, 0.32, 4.0, 2.0
#: Fixed values of the second version: weights of horizons, smoothing windows, shares, scales of path marks, of places and of slopes.
TOPOLOGY = {252: 0.55, 126: 0.30, 63: 0.15}
SMOOTHING, MARKS_PART, SLOPES_PART, TOPOLOGY_PART, LEVEL, PLACE, SLOPE, LEAST_COMMON = (1, 3, 5), 0.25, 0.75, 0.20, 0.12, 0.15, 0.025, 8


def horizon_view(bars: dict[str, np.ndarray], channels: dict[str, np.ndarray], h: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the last h sessions of windows: channels at 32 points (windows, 23, 32), NaN where the nearest session has none; and 19 summaries."""
    nearest = np.rint(np.linspace(0, h - 1, POINTS)).astype(int)
    ch = {k: channels[k][:, -h:] for k in CHANNEL}
    sampled = [np.where(np.isfinite(x)[:, nearest], K.resample(x, POINTS)[0].astype(np.float32), np.nan) for x in ch.values()]
    close, third = bars["close"][:, -h:], max(h // 3, 1)
    some = lambda f, x, **kw: np.where(np.isfinite(x).any(axis=1), f(np.where(np.isfinite(x).any(axis=1, keepdims=True), x, 0.0), axis=1, **kw), np.nan)
    middle = lambda x: some(np.nanmedian, x)
    where = lambda x, ok: np.where(ok, x, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        early, vz, ret = middle(ch["range_pct"][:, :third]), ch["volume_robust_z"], ch["return"]
        swings = K.swings(np.log(close))
        out = [
            np.log(close[:, -1] / close[:, 0]), (close / np.maximum.accumulate(close, axis=1) - 1).min(axis=1), close[:, -1] / close.max(axis=1) - 1, np.log(close[:, 1:] / close[:, :-1]).std(axis=1, ddof=1),
            middle(ch["range_pct"]), middle(ch["range_pct"][:, -third:]) / np.where(early == 0, np.nan, early), *[ch[k][:, -1] for k in ("overnight", "close_location", "atr_pct", "compression_ratio")],
            some(np.nanmean, vz), vz[:, -1], some(np.nanmean, where(vz, ret > 0)) - some(np.nanmean, where(vz, ret < 0)), some(np.nansum, ch["relative_return"]), some(np.nansum, ch["benchmark_return"]),
            np.isfinite(ch["benchmark_close"]).mean(axis=1), *[np.rint(swings[:, 3 * k] * h) for k in range(3)],
        ]
    return np.stack(sampled, axis=1), np.stack([np.where(np.isfinite(x), x, np.nan) for x in out], axis=1)


def multiresolution(bars: DataFrame, lookback: int = 252, stride: int = 50) -> DataFrame:
    """episode, symbol, pos, horizon, samples (23 x 32, NaN for none) and summary (19) of windows at the stride: one task for each symbol."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        out = []
        for at in np.split(ends := np.arange(lookback - 1, len(frame), stride), range(256, len(ends), 256)):
            rows = at[:, None] - np.arange(lookback - 1, -1, -1)[None, :]
            a = {c: frame[c].to_numpy(float)[rows] for c in ("open", "high", "low", "close", "volume", "bench_close")}
            channels = K.channels(a["open"], a["high"], a["low"], a["close"], a["volume"], a["bench_close"]) if len(at) else {}
            for h in HORIZONS if len(at) else ():
                samples, summary = horizon_view(a, channels, h)
                pos, symbol = frame["pos"].to_numpy()[at], frame["symbol"].iloc[0]
                out.append(pd.DataFrame({"episode": [f"{symbol}@{p}" for p in pos], "symbol": symbol, "pos": pos, "horizon": h, "samples": list(samples.reshape(len(at), -1)), "summary": list(summary)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["episode", "symbol", "pos", "horizon", "samples", "summary"])

    return bars.groupBy("symbol").applyInPandas(one, "episode string, symbol string, pos int, horizon int, samples array<double>, summary array<double>")


def channel_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples (n, 23, 32) against one (23, 32): the weighted mean of masked, scaled and clipped RMS and of the share of points that one side lacks."""
    own, theirs = np.isfinite(x), np.isfinite(y)[None]
    common, weight = own & theirs, np.array([w for _, w in CHANNEL.values()])
    first = common.argmax(axis=2)[:, :, None]
    start = lambda v: np.take_along_axis(np.broadcast_to(v, x.shape), first, axis=2)
    shift = np.where(np.array([c in REBASED for c in CHANNEL])[None, :, None], start(x) - start(y[None]), 0.0)
    scaled = np.where(common, (x - y[None] - shift) / np.array([s for s, _ in CHANNEL.values()])[None, :, None], 0.0)
    n = common.sum(axis=2)
    mismatch = (own != theirs).mean(axis=2)
    d = np.where(n > 0, np.minimum(np.sqrt((scaled**2).sum(axis=2) / np.maximum(n, 1)), CLIP), ONE_SIDE) + mismatch
    used = (own | theirs).any(axis=2) * weight
    return (d * used).sum(axis=1) / np.where(used.sum(axis=1) > 0, used.sum(axis=1), 1)


def summary_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    own, theirs = np.isfinite(x), np.isfinite(y)[None]
    scale, weight = (np.array(v) for v in zip(*SUMMARY.values()))
    d = np.where(own & theirs, np.minimum(np.abs(np.nan_to_num(x) - np.nan_to_num(y)[None]) / scale, CLIP), ONE_SIDE)
    used = (own | theirs) * weight
    return (d * used).sum(axis=1) / np.where(used.sum(axis=1) > 0, used.sum(axis=1), 1)


def topology_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Close paths (n, 32) against one: marks of the path and its slopes at three smoothings; NaN with too few common points."""
    out = np.full(len(x), np.nan)
    common = np.isfinite(x) & np.isfinite(y)[None]
    for mask in np.unique(common, axis=0) if len(x) else ():
        if mask.sum() >= LEAST_COMMON:
            at = np.flatnonzero((common == mask).all(axis=1))
            a, b = (v[:, mask] - v[:, mask][:, :1] for v in (x[at], y[None]))
            marks = []
            for v in (a, b):
                fall = v - np.maximum.accumulate(v, axis=1)
                low, n = v.argmin(axis=1), v.shape[1] - 1
                bottom = np.take_along_axis(v, low[:, None], axis=1)[:, 0]
                marks.append(np.stack([v.min(axis=1) / LEVEL, v.max(axis=1) / LEVEL, v[:, -1] / LEVEL, low / n / PLACE, fall.argmin(axis=1) / n / PLACE, fall.min(axis=1) / LEVEL, (v[:, -1] - bottom) / LEVEL], axis=1))
            total = MARKS_PART * np.minimum(np.sqrt(((marks[0] - marks[1]) ** 2).mean(axis=1)), CLIP)
            for width in SMOOTHING:
                slopes = [np.gradient(sliding_window_view(np.pad(v, ((0, 0), (width // 2, width // 2)), mode="edge"), width, axis=1).mean(axis=2), axis=1) for v in (a, b)]
                total = total + SLOPES_PART / len(SMOOTHING) * np.minimum(np.sqrt((((slopes[0] - slopes[1]) / SLOPE) ** 2).mean(axis=1)), CLIP)
            out[at] = total
    return out


def state_distances(store: DataFrame, queries: list[tuple[str, int, list[float], list[float]]]) -> DataFrame:
    """a, b, distance and distance_v2 of each query state to each state of the store. queries: rows (episode, horizon, samples, summary) of a stated set."""
    asked: dict[int, list] = {}
    for episode, horizon, samples, summary in queries:
        asked.setdefault(horizon, []).append((episode, np.array(samples, float).reshape(len(CHANNEL), POINTS), np.array(summary, float)))

    def run(frames):
        for frame in frames:
            for h, rows in frame.groupby("horizon"):
                x, z = np.stack(rows["samples"].to_numpy()).astype(float).reshape(len(rows), len(CHANNEL), POINTS), np.stack(rows["summary"].to_numpy()).astype(float)
                for episode, y, w in asked.get(int(h), ()):
                    base = CHANNEL_PART * channel_distance(x, y) + SUMMARY_PART * summary_distance(z, w)
                    path = topology_distance(x[:, 0], y[0]) if h in TOPOLOGY else np.full(len(rows), np.nan)
                    yield pd.DataFrame({"a": episode, "b": rows["episode"].to_numpy(), "base": HORIZONS[int(h)] * base, "path": path * TOPOLOGY.get(int(h), 0.0), "weight": np.where(np.isfinite(path), TOPOLOGY.get(int(h), 0.0), 0.0)})

    parts = store.select("episode", "horizon", "samples", "summary").mapInPandas(run, "a string, b string, base double, path double, weight double")
    sums = parts.groupBy("a", "b").agg(F.sum("base").alias("distance"), F.sum(F.nanvl("path", F.lit(0.0))).alias("path"), F.sum("weight").alias("weight"))
    path = F.coalesce(F.try_divide("path", F.nullif("weight", F.lit(0.0))), F.lit(0.0))
    return sums.select("a", "b", "distance", ((1 - TOPOLOGY_PART) * F.col("distance") + TOPOLOGY_PART * path).alias("distance_v2"))
