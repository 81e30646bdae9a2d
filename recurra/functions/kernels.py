"""Numeric kernels over batches of windows; NumPy only. Arrays are (windows, sessions) with NaN for what is unknown."""

from __future__ import annotations

import warnings

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = 1e-12
VIEWS = ("price_shape", "stage", "candle_volatility", "volume_shock", "structural", "market_context", "coarse")
#: The channels of each group, their weights in the composite, the layout of the coarse vector.
GROUPS = {
    "price": ("close_path", "return", "overnight", "intraday", "distance_high_63", "distance_ma_20"),
    "candle_volatility": ("range_pct", "body_atr", "upper_wick_atr", "lower_wick_atr", "atr_pct", "compression_ratio"),
    "volume_shock": ("volume_robust_z", "return_shock_z"),
    "market_context": ("benchmark_path", "benchmark_return", "benchmark_drawdown", "relative_path", "relative_return"),
}
WEIGHTS = {"coarse": 0.08, "stage": 0.30, "price": 0.23, "candle_volatility": 0.10, "volume_shock": 0.10, "market_context": 0.10, "structural": 0.09}
COARSE = {"close_path": 64, "atr_pct": 16, "volume_robust_z": 16, "relative_path": 16, "benchmark_path": 16}
ELASTIC = ("close_path", "atr_pct", "volume_robust_z", "relative_path")
BAND, RIGID, STAGES, THRESHOLDS = 0.12, 0.55, 12, (0.03, 0.06, 0.12)


# --- channels -------------------------------------------------------------------------------------------------------


def _back(x: np.ndarray, width: int) -> np.ndarray:
    """(windows, sessions, width): each session's last `width` values, NaN before the window's start."""
    return sliding_window_view(np.concatenate([np.full((len(x), width - 1), np.nan), x], axis=1), width, axis=1)


def roll(f, x: np.ndarray, width: int, least: int) -> np.ndarray:
    w = _back(x, min(width, x.shape[1]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.where(np.isfinite(w).sum(axis=2) >= least, f(w, axis=2), np.nan)


def roll_mean(x: np.ndarray, width: int, least: int) -> np.ndarray:
    known = np.isfinite(x)
    both = [np.cumsum(v, axis=1, dtype=float) for v in (np.where(known, x, 0.0), known)]
    s, n = (np.concatenate([c[:, :width], c[:, width:] - c[:, :-width]], axis=1) for c in both)
    return np.where(n >= least, s / np.maximum(n, 1), np.nan)


def _robust_z(x: np.ndarray, width: int) -> np.ndarray:
    least = max(5, width // 2)
    middle = roll(np.nanmedian, x, width, least)
    mad = roll(np.nanmedian, np.abs(x - middle), width, least)
    return (x - middle) / (1.4826 * np.where(mad == 0, np.nan, mad))


def channels(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """The dense channels of windows of bars with the benchmark's closes."""
    first = lambda x: np.concatenate([np.full((len(x), 1), np.nan), x[:, :-1]], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        before, market_before = first(c), first(b)
        tr = np.nanmax([h - l, np.abs(h - before), np.abs(l - before)], axis=0)
        atr = roll_mean(tr, 14, 5)
        atr = np.where(atr == 0, np.nan, atr)
        ret, market = np.log(c / before), np.log(b / market_before)
        spread = np.where(h - l == 0, np.nan, h - l)
        lc = np.log(np.maximum(c, EPS))
        top = {w: roll(np.nanmax, h, w, m) for w, m in ((20, 10), (63, 20))}
        low = {w: roll(np.nanmin, l, w, m) for w, m in ((20, 10), (63, 20))}
        wide = top[63] / low[63] - 1
        start = np.take_along_axis(b, np.isfinite(b).argmax(axis=1)[:, None], axis=1)
        relative = ret - market
        out = {
            "close_path": lc - lc[:, :1], "return": ret, "overnight": np.log(o / before), "intraday": np.log(c / o), "range_pct": np.log(h / l),
            "body_atr": (c - o) / atr, "upper_wick_atr": (h - np.maximum(o, c)) / atr, "lower_wick_atr": (np.minimum(o, c) - l) / atr, "close_location": (c - l) / spread, "atr_pct": atr / c,
            "volume_robust_z": _robust_z(np.log(np.maximum(v, EPS)), 20), "return_shock_z": _robust_z(ret, 63), "distance_high_63": c / roll(np.nanmax, c, 63, 20) - 1,
            "distance_ma_20": c / roll_mean(c, 20, 10) - 1, "distance_ma_50": c / roll_mean(c, 50, 20) - 1, "compression_ratio": (top[20] / low[20] - 1) / np.where(wide == 0, np.nan, wide),
            "benchmark_close": b, "benchmark_return": market, "benchmark_path": np.log(b / start), "benchmark_volatility": roll(lambda w, axis: np.nanstd(w, axis=axis, ddof=1), market, 20, 10),
            "benchmark_drawdown": b / np.fmax.accumulate(b, axis=1) - 1, "relative_return": relative,
            "relative_path": np.where(np.isfinite(market), np.cumsum(np.nan_to_num(relative), axis=1), np.nan),
        }
    return {k: np.where(np.isfinite(x), x, np.nan) for k, x in out.items()}


# --- representation -------------------------------------------------------------------------------------------------


def resample(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, n) points by linear interpolation over known values, ends held; and how many values each window has."""
    length, known = x.shape[1], np.isfinite(x)
    at = np.arange(length)
    left = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(known, at, length)[:, ::-1], axis=1)[:, ::-1]
    lo, hi = np.where(left < 0, right, left), np.where(right >= length, left, right)
    lo, hi = np.clip(lo, 0, length - 1), np.clip(hi, 0, length - 1)
    a, b = np.take_along_axis(x, lo, 1), np.take_along_axis(x, hi, 1)
    filled = np.where(hi > lo, a + (b - a) * (at - lo) / np.maximum(hi - lo, 1), a)
    place = np.linspace(0, length - 1, n)
    base = np.minimum(place.astype(int), max(0, length - 2))
    out = filled[:, base] + (filled[:, np.minimum(base + 1, length - 1)] - filled[:, base]) * (place - base)
    return out, known.sum(axis=1)


def optional(x: np.ndarray, n: int) -> np.ndarray:
    """resample(), all NaN where too few values are known."""
    out, known = resample(x, n)
    return np.where((known >= max(3, x.shape[1] // 5))[:, None], out, np.nan)


def stages(ch: dict[str, np.ndarray]) -> np.ndarray:
    length = ch["return"].shape[1]
    cuts, parts = [length * i // STAGES for i in range(STAGES + 1)], []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = slice(a, max(b, a + 1))
            path = ch["close_path"][:, s]
            parts += [(path[:, -1] - path[:, 0]) / 0.08, np.nanstd(ch["return"][:, s], axis=1, ddof=1) / 0.02, np.nanmean(ch["volume_robust_z"][:, s], axis=1), np.nansum(ch["relative_return"][:, s], axis=1) / 0.08]
    return np.nan_to_num(np.stack(parts, axis=1), nan=0.0, posinf=0.0, neginf=0.0)


def swings(path: np.ndarray) -> np.ndarray:
    """For each threshold: turns per session, their mean size and mean duration per session, of exp(path).

    All windows step through time together; each carries the direction it follows, its extreme and where that stood.
    """
    price, length = np.exp(np.nan_to_num(path)), path.shape[1]
    parts = []
    for t in THRESHOLDS:
        up = np.ones(len(price), bool)
        extreme, place = price[:, 0].copy(), np.zeros(len(price))
        n, size, time = np.zeros(len(price)), np.zeros(len(price)), np.zeros(len(price))
        for i in range(1, length):
            p = price[:, i]
            further = np.where(up, p >= extreme, p <= extreme)
            turn = ~further & np.where(up, p <= extreme * (1 - t), p >= extreme * (1 + t))
            n += turn
            size += np.where(turn, np.abs(p / extreme - 1), 0)
            time += np.where(turn, i - place, 0)
            moved = further | turn
            extreme, place, up = np.where(moved, p, extreme), np.where(moved, i, place), up ^ turn
        parts += [n / length, size / np.maximum(n, 1), time / np.maximum(n, 1) / length]
    return np.stack(parts, axis=1)


def represent(ch: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Fixed-size arrays of each window: coarse, stage, structural, s48_<channel>, s64_<channel>."""
    coarse = np.concatenate([resample(ch[k], n)[0] for k, n in COARSE.items()], axis=1).astype(np.float32)
    out = {"coarse": np.nan_to_num(coarse), "stage": stages(ch), "structural": swings(ch["close_path"])}
    out |= {f"s48_{k}": optional(ch[k], 48) for k in sorted({k for g in GROUPS.values() for k in g})}
    return out | {f"s64_{k}": optional(ch[k], 64) for k in ELASTIC}


# --- distances ------------------------------------------------------------------------------------------------------


def pair_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One scale for each window: the interquartile range of it and the query together, else their deviation."""
    both = np.concatenate([x, np.broadcast_to(y, x.shape)], axis=1)
    scale = np.percentile(both, 75, axis=1) - np.percentile(both, 25, axis=1)
    return np.maximum(np.where(scale < 1e-8, both.std(axis=1), scale), 1e-6)


def group_distance(rows: dict[str, np.ndarray], query: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """Mean over channels of the scaled root mean square; 2 where one side lacks a channel, skipped where both do."""
    total, n = 0.0, 0.0
    for k in names:
        x, y = rows[f"s48_{k}"], query[f"s48_{k}"]
        has, asks = np.isfinite(x[:, 0]), bool(np.isfinite(y[0, 0]))
        d = np.full(len(x), 2.0)
        if asks and has.any():
            d[has] = np.sqrt((((x[has] - y) / pair_scale(x[has], y)[:, None]) ** 2).mean(axis=1))
        used = has | asks
        total, n = total + np.where(used, d, 0.0), n + used
    return np.where(n > 0, total / np.maximum(n, 1), 0.0)


def elastic(rows: dict[str, np.ndarray], query: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which elastic channels each pair has, and that as a number."""
    have = np.stack([np.isfinite(rows[f"s64_{k}"][:, 0]) & np.isfinite(query[f"s64_{k}"][0, 0]) for k in ELASTIC], axis=1)
    return have, have @ (1 << np.arange(len(ELASTIC)))


def warped(rows: dict[str, np.ndarray], query: dict[str, np.ndarray], measure=None) -> np.ndarray:
    """The elastic part of each pair: by dtw_pairs(), or by another measure of scaled paths, such as lb_keogh()."""
    measure = measure or dtw_pairs
    have, key = elastic(rows, query)
    out = np.zeros(len(key))
    band = max(int(64 * BAND), 1)
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        names = [c for i, c in enumerate(ELASTIC) if k >> i & 1]
        if names:
            scale = [pair_scale(rows[f"s64_{c}"][at], query[f"s64_{c}"])[:, None] for c in names]
            x = np.stack([rows[f"s64_{c}"][at] / s for c, s in zip(names, scale)], axis=2)
            y = np.stack([np.broadcast_to(query[f"s64_{c}"], (len(at), 64)) / s for c, s in zip(names, scale)], axis=2)
            out[at] = measure(x, y, band)
    return out


def dtw_pairs(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Banded warping distance of pairs of (n, channels): cost over path length.

    A row of the table is computed for all pairs at once; of equal predecessors vertical goes before horizontal before
    diagonal, which decides the path's length.
    """
    b, n, m = len(x), x.shape[1], y.shape[1]
    cost, steps = np.full((b, m + 1), np.inf), np.zeros((b, m + 1), np.int32)
    cost[:, 0] = 0.0
    for i in range(n):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        local = np.sqrt(((x[:, i, None, :] - y[:, lo:hi]) ** 2).mean(axis=2))
        new, length = np.full((b, m + 1), np.inf), np.zeros((b, m + 1), np.int32)
        for j in range(lo, hi):
            best, count = cost[:, j + 1], steps[:, j + 1]
            for other, k in ((new[:, j], length[:, j]), (cost[:, j], steps[:, j])):
                better = other < best
                best, count = np.where(better, other, best), np.where(better, k, count)
            new[:, j + 1], length[:, j + 1] = best + local[:, j - lo], count + 1
        cost, steps = new, length
    return cost[:, m] / np.maximum(steps[:, m], 1)


def lb_keogh(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """A lower bound of dtw_pairs(): what each point is outside the band's envelope, either way, over the longest path."""

    def one_way(points: np.ndarray, around: np.ndarray) -> np.ndarray:
        n, total = points.shape[1], 0.0
        for i in range(n):
            near = around[:, max(0, i - band) : i + band + 1]
            off = np.maximum(near.min(axis=1) - points[:, i], 0) + np.maximum(points[:, i] - near.max(axis=1), 0)
            total = total + np.sqrt((off**2).mean(axis=1))
        return total / (2 * n - 1)

    return np.maximum(one_way(x, y), one_way(y, x))


def components(rows: dict[str, np.ndarray], query: dict[str, np.ndarray], names: tuple[str, ...] = tuple(WEIGHTS)) -> dict[str, np.ndarray]:
    """The named parts of the composite but the elastic one; price is the rigid part."""
    out = {}
    for name in names:
        if name == "coarse":
            x, y = rows["coarse"].astype(float), query["coarse"].astype(float)
            scale = np.maximum(np.concatenate([x, np.broadcast_to(y, x.shape)], axis=1).std(axis=1), 1e-6)
            out[name] = np.sqrt((((x - y) / scale[:, None]) ** 2).mean(axis=1))
        elif name in GROUPS:
            out[name] = group_distance(rows, query, GROUPS[name])
        else:
            out[name] = np.sqrt(((rows[name] - query[name]) ** 2).mean(axis=1))
    return out


def lower_bound(parts: dict[str, np.ndarray], weights: dict[str, float] = WEIGHTS) -> np.ndarray:
    """The composite with nothing for the elastic part."""
    return sum(w * (parts[k] * RIGID if k == "price" else parts[k]) for k, w in weights.items())


def composite(parts: dict[str, np.ndarray], elastic_part: np.ndarray, weights: dict[str, float] = WEIGHTS) -> np.ndarray:
    return lower_bound(parts, weights) + weights["price"] * (1 - RIGID) * elastic_part


# --- cheap views of windows ------------------------------------------------------------------------------------------


def _nearest(x: np.ndarray, n: int) -> np.ndarray:
    return x[:, np.rint(np.linspace(0, x.shape[1] - 1, min(n, x.shape[1]))).astype(int)]


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(norm > 1e-12, (a * b).sum(axis=1) / np.where(norm > 1e-12, norm, 1), -1.0)


def path_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shape and size of two paths, each from its own start."""
    x, y = x - x[:, :1], y - y[:, :1]
    return 0.65 * (1 - correlation(x, y)) + 0.35 * np.sqrt(((x - y) ** 2).mean(axis=1))


def _centred(x: np.ndarray) -> np.ndarray:
    scale = np.percentile(x, 75, axis=1) - np.percentile(x, 25, axis=1)
    scale = np.where(scale > 1e-8, scale, x.std(axis=1))
    return (x - np.median(x, axis=1, keepdims=True)) / np.where(scale > 1e-8, scale, 1.0)[:, None]


def window_views(rows: dict[str, np.ndarray], query: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The cheap distances of windows of bars (open, high, low, close, volume, bench) to one query window."""
    ready = []
    for w in (rows, query):
        c, b = np.log(np.maximum(w["close"], EPS)), np.log(np.maximum(w["bench"], EPS))
        shock = np.abs(np.diff(c, axis=1, prepend=c[:, :1]))
        ready.append((c, b, np.log(w["high"] / w["low"]) / 0.02, np.log(w["close"] / w["open"]) / 0.02, np.log(np.maximum(w["volume"], EPS)), shock))
    (c, b, rng, body, v, shock), (qc, qb, qrng, qbody, qv, qshock) = ready
    rms = lambda x, y: np.sqrt(((x - y) ** 2).mean(axis=1))
    s = lambda x, n=16: _nearest(x, n)
    known = np.isfinite(b).all(axis=1) & np.isfinite(qb).all()
    rows_cut, query_cut = s(c) - s(c)[:, :1], s(qc) - s(qc)[:, :1]
    fall = lambda p: p - np.maximum.accumulate(p, axis=1)
    turn = lambda p: np.sign(np.diff(p, axis=1))
    cuts = [c.shape[1] * i // STAGES for i in range(STAGES + 1)]

    def steps(c: np.ndarray, v: np.ndarray, b: np.ndarray) -> np.ndarray:
        r, z, m = np.diff(c, axis=1, prepend=c[:, :1]), _centred(v), np.nan_to_num(np.diff(b, axis=1, prepend=b[:, :1]))
        parts = [(c[:, y - 1] - c[:, x]) / 0.08 if k == 0 else r[:, x:y].std(axis=1) / 0.02 if k == 1 else z[:, x:y].mean(axis=1) if k == 2 else (r - m)[:, x:y].sum(axis=1) / 0.08 for x, y in zip(cuts[:-1], cuts[1:]) for k in range(4)]
        return np.stack(parts, axis=1)

    coarse = [np.concatenate([s(x, 64) - s(x, 64)[:, :1], s(g), _centred(s(w)), np.nan_to_num(s(x) - s(x)[:, :1] - (s(k) - s(k)[:, :1])), np.nan_to_num(s(k) - s(k)[:, :1])], axis=1) for x, g, w, k in ((c, rng, v, b), (qc, qrng, qv, qb))]
    joint = np.concatenate([coarse[0], np.broadcast_to(coarse[1], coarse[0].shape)], axis=1).std(axis=1)
    market = 0.5 * path_distance(s(b), s(qb)) + 0.5 * path_distance(s(c) - s(b), s(qc) - s(qb))
    return {
        "price_shape": path_distance(c, np.broadcast_to(qc, c.shape)), "stage": rms(steps(c, v, b), steps(qc, qv, qb)),
        "candle_volatility": rms(np.concatenate([s(rng), s(body)], axis=1), np.concatenate([s(qrng), s(qbody)], axis=1)),
        "volume_shock": rms(np.concatenate([_centred(s(v)), _centred(s(shock))], axis=1), np.concatenate([_centred(s(qv)), _centred(s(qshock))], axis=1)),
        "structural": 0.6 * rms(fall(rows_cut), fall(query_cut)) + 0.4 * (turn(rows_cut) != turn(query_cut)).mean(axis=1),
        "market_context": np.where(known, np.nan_to_num(market, nan=1.0), 1.0), "coarse": rms(*coarse) / np.maximum(joint, 1e-6),
    }
