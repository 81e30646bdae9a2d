"""Modes of what followed: weighted medoids of future paths, their quality, and partitions of episodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairwise_l1(paths: DataFrame, key: str, member: str) -> DataFrame:
    """Mean absolute difference of members' paths within a key (at most 20 members of a key)."""
    a = paths.select(key, "step", F.col(member).alias("a"), F.col("close_return").alias("x"))
    b = paths.select(key, "step", F.col(member).alias("b"), F.col("close_return").alias("y"))
    return a.join(b, [key, "step"]).where("a < b").groupBy(key, "a", "b").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def distances(x: np.ndarray) -> np.ndarray:
    return np.abs(x[:, None, :] - x[None, :, :]).mean(axis=2)


def assignment(d: np.ndarray, medoids: list[int]) -> np.ndarray:
    """The place of each row's nearest medoid, the first of equals."""
    return d[:, medoids].argmin(axis=1)


def pam(d: np.ndarray, k: int, w: np.ndarray) -> list[int]:
    """Weighted medoids: greedy build, then the best swap while one lowers the cost; the lowest indexes of equals."""
    cost = lambda m: float((w * d[:, m].min(axis=1)).sum())
    medoids: list[int] = []
    for _ in range(k):
        medoids.append(min((i for i in range(len(d)) if i not in medoids), key=lambda i: (round(cost([*medoids, i]), 12), i)))
    while True:
        now = cost(medoids)
        options = [(round(cost(new), 12), tuple(sorted(new))) for j in range(k) for i in range(len(d)) if i not in medoids for new in [[*medoids[:j], i, *medoids[j + 1 :]]]]
        best = min(options, default=(now, ()))
        if best[0] >= round(now, 12) - 1e-12:
            return sorted(medoids)
        medoids = list(best[1])


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    out = []
    for i in range(len(d)):
        own = (labels == labels[i]) & (np.arange(len(d)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, labels == k].mean() for k in set(labels.tolist()) - {int(labels[i])})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def rand_index(x: np.ndarray, y: np.ndarray) -> float:
    """Adjusted for chance."""
    pairs = lambda n: n * (n - 1) / 2
    table = np.array([[((x == a) & (y == b)).sum() for b in np.unique(y)] for a in np.unique(x)])
    both, rows, cols, n = pairs(table).sum(), pairs(table.sum(axis=1)).sum(), pairs(table.sum(axis=0)).sum(), pairs(len(x))
    expected, most = rows * cols / n if n else 0, (rows + cols) / 2
    return float((both - expected) / (most - expected)) if most != expected else 1.0


def modes(d: np.ndarray, w: np.ndarray, least: int = 3, separation: float = 0.25, stability: float = 0.8, draws: int = 20, seed: int = 5) -> tuple[int, np.ndarray, float, float]:
    """The largest number of modes (up to 4 and a third of the members) that are big, separate and stable enough, else 1."""
    n, random = len(d), np.random.default_rng(seed)
    for k in range(min(4, n // 3), 1, -1):
        labels = assignment(d, pam(d, k, w))
        if np.bincount(labels, minlength=k).min() < least or (s := silhouette(d, labels)) < separation:
            continue
        agree = []
        for _ in range(draws):
            pick = np.unique(random.integers(0, n, n))
            if len(pick) > k:
                agree.append(rand_index(labels[pick], assignment(d[np.ix_(pick, pick)], pam(d[np.ix_(pick, pick)], k, w[pick]))))
        if agree and (a := float(np.mean(agree))) >= stability:
            return k, labels, s, a
    return 1, np.zeros(n, int), 0.0, 1.0


def future_modes(paths: DataFrame) -> DataFrame:
    """query_id, member, mode, modes, silhouette, stability. paths: query_id, member, weight, path (array); 20 members at most."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("member").reset_index(drop=True)
        k, labels, s, a = modes(distances(np.stack(frame["path"].to_numpy())), frame["weight"].to_numpy())
        return pd.DataFrame({"query_id": frame["query_id"], "member": frame["member"], "mode": labels.astype("int32"), "modes": np.int32(k), "silhouette": s, "stability": a})

    return paths.groupBy("query_id").applyInPandas(one, "query_id string, member string, mode int, modes int, silhouette double, stability double")


def primary_members(links: DataFrame) -> DataFrame:
    """links with why a row is left out: the query's own symbol, or a symbol seen at a better rank; null if it stays."""
    first = F.row_number().over(Window.partitionBy("query_id", "symbol").orderBy("match_rank"))
    return links.withColumn("reason", F.when(F.col("symbol") == F.col("query_symbol"), "query_symbol").when(first > 1, "repeated_symbol"))


def midranks(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x, float)
    for c in range(x.shape[1]):
        _, at, n = np.unique(x[:, c], return_inverse=True, return_counts=True)
        out[:, c] = (np.cumsum(n) - (n - 1) / 2 - 0.5)[at] / len(x)
    return out


def balanced_partition(x: np.ndarray, leaf: int) -> np.ndarray:
    """Cells of near equal count: halves along the first principal direction of the midranks, until a cell is small."""
    ranks, labels, todo, cells = midranks(x), np.zeros(len(x), int), [np.arange(len(x))], 0
    while todo:
        at = todo.pop()
        if len(at) < 2 * leaf:
            labels[at] = cells
            cells += 1
            continue
        centred = ranks[at] - ranks[at].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        order = np.lexsort((at, np.round(centred @ axis, 12)))
        todo += [np.sort(at[order[len(at) // 2 :]]), np.sort(at[order[: len(at) // 2]])]
    return labels


def farthest_first(x: np.ndarray, k: int, least: int) -> np.ndarray:
    """Cells around k rows, each the farthest from those before; cells under `least` go to the nearest larger one."""
    centres = [0]
    d = np.linalg.norm(x - x[0], axis=1)
    while len(centres) < min(k, len(x)):
        centres.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[centres[-1]], axis=1))
    to = np.linalg.norm(x[:, None, :] - x[centres][None, :, :], axis=2)
    labels = to.argmin(axis=1)
    big = [c for c in range(len(centres)) if (labels == c).sum() >= least] or [int(np.bincount(labels).argmax())]
    return np.array(big)[to[:, big].argmin(axis=1)]


def partitions(features: DataFrame, columns: list[str], leaf: int) -> DataFrame:
    """ts, symbol, cell: balanced_partition() of each date's symbols."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("symbol").reset_index(drop=True)
        return pd.DataFrame({"ts": frame["ts"], "symbol": frame["symbol"], "cell": balanced_partition(frame[columns].to_numpy(float), leaf).astype("int32")})

    return features.select("ts", "symbol", *columns).groupBy("ts").applyInPandas(one, "ts timestamp, symbol string, cell int")


def support_count(sizes: list[tuple[int, int]], cap: int = 10**12) -> int:
    """Product of n over k for cells of n members with k taken, no more than the cap."""
    out = 1
    for n, k in sizes:
        value = 1
        for i in range(k):
            value = value * (n - i) // (i + 1)
        out = min(cap, out * value)
    return out


def supports(cells: DataFrame) -> DataFrame:
    """query_id, support from rows (query_id, n, k)."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "support": [support_count(list(zip(n, k))) for n, k in zip(f["n"], f["k"])]})

    return cells.groupBy("query_id").agg(F.collect_list("n").alias("n"), F.collect_list("k").alias("k")).mapInPandas(one, "query_id string, support long")
