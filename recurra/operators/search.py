"""Similar earlier windows: scans, fused rankings, exact search by bounds, and selections that keep matches apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions import kernels as K
from recurra.functions import signature

BARS = ("open", "high", "low", "close", "volume", "bench_close")


@dataclass(frozen=True)
class Request:
    """What to look for: windows of `lookback` bars at a stride, at least `gap` of the query's sessions earlier."""

    symbol: str
    lookback: int = 63
    stride: int = 5
    gap: int = 20
    top_k: int = 20
    per_symbol: int = 3
    local: int = 5


def query_window(bars: DataFrame, request: Request) -> pd.DataFrame:
    """The query's last window, in order. bars: with pos and bench_close."""
    own = bars.where(F.col("symbol") == request.symbol).orderBy(F.col("ts").desc()).limit(request.lookback)
    return own.select("ts", "pos", *BARS).toPandas().sort_values("pos").reset_index(drop=True)


def _arrays(frame: pd.DataFrame, at: np.ndarray, lookback: int) -> dict[str, np.ndarray]:
    """(windows, lookback) of each bar column, for windows that end at the rows `at`."""
    rows = at[:, None] - np.arange(lookback - 1, -1, -1)[None, :]
    return {("bench" if c == "bench_close" else c): frame[c].to_numpy(float)[rows] for c in BARS}


def _ends(frame: pd.DataFrame, request: Request, latest: pd.Timestamp, first_pos: int) -> np.ndarray:
    """Rows at which eligible windows end: at the stride, early enough, and clear of the query's own window."""
    ends = np.arange(request.lookback - 1, len(frame), request.stride)
    ends = ends[frame["ts"].to_numpy()[ends] <= np.datetime64(latest)]
    return ends[frame["pos"].to_numpy()[ends] < first_pos] if frame["symbol"].iloc[0] == request.symbol and len(ends) else ends


def scan(bars: DataFrame, request: Request, views: tuple[str, ...] = ("price_shape",)) -> DataFrame:
    """symbol, cutoff, pos and a distance for each view, of each symbol's eligible windows: one task for each symbol."""
    query = query_window(bars, request)
    latest = query["ts"].iloc[-request.gap - 1]
    asked = {k: v for k, v in _arrays(query, np.array([request.lookback - 1]), request.lookback).items()}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        ends = _ends(frame, request, latest, int(query["pos"].iloc[0]))
        out = pd.DataFrame({"symbol": frame["symbol"].iloc[0], "cutoff": frame["ts"].to_numpy()[ends], "pos": frame["pos"].to_numpy()[ends]})
        blocks = [np.empty((0, len(views)))]
        for i in range(0, len(ends), 4096):
            rows = _arrays(frame, ends[i : i + 4096], request.lookback)
            if views == ("price_shape",):
                d = {"price_shape": K.path_distance(np.log(rows["close"]), np.broadcast_to(np.log(asked["close"]), rows["close"].shape))}
            else:
                d = K.window_views(rows, asked)
            blocks.append(np.stack([d[v] for v in views], axis=1))
        return pd.concat([out, pd.DataFrame(np.concatenate(blocks), columns=list(views))], axis=1)

    schema = "symbol string, cutoff timestamp, pos int, " + ", ".join(f"{v} double" for v in views)
    return bars.select("symbol", "ts", "pos", *BARS).groupBy("symbol").applyInPandas(one, schema)


def local_top(rows: DataFrame, distance: str, n: int) -> DataFrame:
    """The n nearest of each symbol."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(distance, "cutoff"))
    return rows.withColumn("local_rank", place).where(F.col("local_rank") <= n)


def global_top(rows: DataFrame, distance: str, n: int) -> DataFrame:
    return rows.orderBy(distance, "symbol", "cutoff").limit(n)


def union_of_views(rows: DataFrame, views: tuple[str, ...], n: int) -> DataFrame:
    """Windows among the n nearest of their symbol in any view."""
    for v in views:
        rows = rows.withColumn(f"_{v}", F.row_number().over(Window.partitionBy("symbol").orderBy(v, "cutoff")))
    return rows.where(F.least(*[F.col(f"_{v}") for v in views]) <= n).drop(*[f"_{v}" for v in views])


def fused(pool: DataFrame, views: tuple[str, ...], size: int, constant: int = 60, forced: int = 1) -> DataFrame:
    """Reciprocal-rank fusion of a pool: the best `forced` of each view first, then by score. pool: episode_id and views.

    The pool is what local selection left (symbols times views times n), so ranks over all of it are taken in one task.
    """
    every = Window.partitionBy(F.lit(0))
    for v in views:
        pool = pool.withColumn(f"rank_{v}", F.row_number().over(every.orderBy(v, "episode_id")))
    score = sum((1 / (constant + F.col(f"rank_{v}")) for v in views), F.lit(0.0))
    first = F.least(*[F.col(f"rank_{v}") for v in views]) <= forced
    pool = pool.withColumns({"fusion_score": F.round(score, 12), "forced": first})
    pool = pool.withColumn("fusion_rank", F.row_number().over(every.orderBy(F.col("fusion_score").desc(), "episode_id")))
    pool = pool.withColumn("pool_rank", F.row_number().over(every.orderBy(F.col("forced").desc(), F.col("fusion_score").desc(), "episode_id")))
    return pool.where(F.col("pool_rank") <= size)


def greedy(rows: list[tuple], k: int, per_symbol: int, lookback: int) -> list[tuple]:
    """In order of (distance, id): skip a symbol that has per_symbol, and windows that share bars with one taken.

    rows: (distance, id, symbol, pos, ...).
    """
    taken: list[tuple] = []
    count: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        own = count.setdefault(row[2], [])
        if len(own) < per_symbol and all(abs(row[3] - p) >= lookback for p in own):
            own.append(row[3])
            taken.append(row)
            if len(taken) == k:
                break
    return taken


def greedy_by_query(scored: DataFrame, k: int, per_symbol: int, lookback: int) -> DataFrame:
    """greedy() for each query_id. Only the nearest per_symbol * lookback windows of a symbol can matter, so only those go in."""
    near = F.row_number().over(Window.partitionBy("query_id", "symbol").orderBy("distance", "episode_id"))
    bounded = scored.withColumn("near", near).where(F.col("near") <= per_symbol * 2 * lookback)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame[["distance", "episode_id", "symbol", "pos", "query_id", "cutoff"]].itertuples(index=False, name=None))
        out = greedy(rows, k, per_symbol, lookback)
        return pd.DataFrame([(r[4], i + 1, r[1], r[2], r[5], r[0], r[3]) for i, r in enumerate(out)], columns=["query_id", "rank", "episode_id", "symbol", "cutoff", "distance", "pos"])

    return bounded.groupBy("query_id").applyInPandas(one, "query_id string, rank int, episode_id string, symbol string, cutoff timestamp, distance double, pos int")


def eligible_pairs(queries: DataFrame, episodes: DataFrame, per_dataset: bool = True) -> DataFrame:
    """queries (query_id, q_symbol, q_cutoff, latest, q_pos) with the episodes each may use; queries are few and broadcast."""
    ok = (F.col("cutoff") <= F.col("latest")) & (F.col("cutoff") < F.col("q_cutoff")) & (F.col("tier").isin("A", "B"))
    apart = (F.col("symbol") != F.col("q_symbol")) | (F.abs(F.col("pos") - F.col("q_pos")) >= F.col("lookback"))
    return episodes.join(F.broadcast(queries), ok & apart)


# --- exact composite search --------------------------------------------------------------------------------------------

PARTS = ("coarse", "stage", "structural", *[f"s48_{k}" for k in sorted({k for g in K.GROUPS.values() for k in g})], *[f"s64_{k}" for k in K.ELASTIC])


def representations(bars: DataFrame, request: Request) -> DataFrame:
    """symbol, cutoff, pos, episode_id and the fixed-size arrays of each window at the stride: one task for each symbol."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        ends = np.arange(request.lookback - 1, len(frame), request.stride)
        parts = []
        for i in range(0, len(ends), 1024):
            at = ends[i : i + 1024]
            a = _arrays(frame, at, request.lookback)
            rep = K.represent(K.channels(a["open"], a["high"], a["low"], a["close"], a["volume"], a["bench"]))
            parts.append(pd.DataFrame({"symbol": frame["symbol"].iloc[0], "cutoff": frame["ts"].to_numpy()[at], "pos": frame["pos"].to_numpy()[at], **{p: list(rep[p].astype(float)) for p in PARTS}}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["symbol", "cutoff", "pos", *PARTS])

    schema = "symbol string, cutoff timestamp, pos int, " + ", ".join(f"`{p}` array<double>" for p in PARTS)
    out = bars.select("symbol", "ts", "pos", *BARS).groupBy("symbol").applyInPandas(one, schema)
    return out.withColumn("episode_id", F.substring(F.sha2(F.concat_ws("|", "symbol", F.date_format("cutoff", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(str(request.lookback))), 256), 1, 24))


#: The price component alone, for searches of one component.
PRICE = {"price": 1.0}


def parts_of(weights: dict[str, float]) -> tuple[str, ...]:
    """The arrays that a distance of these weights needs."""
    own = {f"s48_{k}" for g in weights if g in K.GROUPS for k in K.GROUPS[g]} | {f"s64_{k}" for k in K.ELASTIC} | set(weights)
    return tuple(p for p in PARTS if p in own)


def _matrix(frame: pd.DataFrame, parts: tuple[str, ...] = PARTS) -> dict[str, np.ndarray]:
    return {p: np.stack(frame[p].to_numpy()).astype(float) for p in parts}


def query_representation(bars: DataFrame, request: Request) -> dict[str, np.ndarray]:
    a = _arrays(query_window(bars, request), np.array([request.lookback - 1]), request.lookback)
    rep = K.represent(K.channels(a["open"], a["high"], a["low"], a["close"], a["volume"], a["bench"]))
    return {p: rep[p].astype(float) for p in PARTS}


NAMES = ("coarse", "stage", "structural", *K.GROUPS)


def _measured(rows: dict[str, np.ndarray], query: dict[str, np.ndarray], exact: bool, weights: dict[str, float] = K.WEIGHTS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The parts of the distance, and its lower bound or, if exact, the distance."""
    parts = K.components(rows, query, tuple(weights))
    if not exact:
        return parts, K.lower_bound(parts, weights)
    parts["price"] = K.RIGID * parts["price"] + (1 - K.RIGID) * K.warped(rows, query)
    return parts, sum(w * parts[k] for k, w in weights.items())


def scored(store: DataFrame, query: dict[str, np.ndarray], exact: bool, weights: dict[str, float] = K.WEIGHTS) -> DataFrame:
    """episode_id, symbol, cutoff, pos, the parts of the distance, and its lower bound or, if exact, the distance."""
    names, needed = [n for n in NAMES if n in weights], parts_of(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                parts, distance = _measured(_matrix(frame, needed), query, exact, weights)
                yield frame[["episode_id", "symbol", "cutoff", "pos"]].assign(**{f"d_{n}": parts[n] for n in names}, distance=distance)

    schema = "episode_id string, symbol string, cutoff timestamp, pos int, " + ", ".join(f"d_{n} double" for n in names) + ", distance double"
    return store.select("episode_id", "symbol", "cutoff", "pos", *needed).mapInPandas(run, schema)


def scored_many(store: DataFrame, queries: dict[str, dict[str, np.ndarray]], exact: bool = True) -> DataFrame:
    """query_id, episode_id, symbol, pos, distance (or bound) of every window to each of a stated set of queries, in one scan of the store."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = _matrix(frame)
                for name, query in queries.items():
                    yield frame[["episode_id", "symbol", "pos"]].assign(query_id=name, distance=_measured(rows, query, exact)[1])[["query_id", "episode_id", "symbol", "pos", "distance"]]

    return store.select("episode_id", "symbol", "pos", *PARTS).mapInPandas(run, "query_id string, episode_id string, symbol string, pos int, distance double")


def between(store: DataFrame, query: dict[str, np.ndarray], low: float, high: float, weights: dict[str, float] = K.WEIGHTS) -> DataFrame:
    """episode_id, symbol, cutoff, pos, bound, distance: the distance of windows with low < bound <= high, null for others.

    The bound is the rigid one; where that is at most `high`, the envelope of the elastic channels raises it first, and
    only what is still at most `high` is warped.
    """
    needed = parts_of(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = _matrix(frame, needed)
                parts = K.components(rows, query, tuple(weights))
                bound, distance = K.lower_bound(parts, weights), np.full(len(frame), np.nan)
                some = lambda at: {p: x[at] for p, x in rows.items()}
                if len(at := np.flatnonzero(bound <= high)):
                    tighter = K.composite({k: x[at] for k, x in parts.items()}, K.warped(some(at), query, K.lb_keogh), weights) - 1e-9
                    bound[at] = np.maximum(bound[at], tighter)
                if len(at := np.flatnonzero((bound > low) & (bound <= high))):
                    distance[at] = K.composite({k: x[at] for k, x in parts.items()}, K.warped(some(at), query), weights)
                yield frame[["episode_id", "symbol", "cutoff", "pos"]].assign(bound=bound, distance=distance)

    out = store.select("episode_id", "symbol", "cutoff", "pos", *needed).mapInPandas(run, "episode_id string, symbol string, cutoff timestamp, pos int, bound double, distance double")
    return out.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


@dataclass
class Certificate:
    """Why the result is exact: how many windows there were, how many were measured, and the next bound."""

    candidates: int
    measured: int
    threshold: float
    next_bound: float
    complete: bool


def exact_search(store: DataFrame, query: dict[str, np.ndarray], request: Request, eligible: Column, seed: int = 256, weights: dict[str, float] = K.WEIGHTS) -> tuple[list[tuple], Certificate]:
    """The diversified top k by exact distance (the composite, or the price component alone), measuring only windows whose lower bound could matter.

    The windows up to the seed-th least bound are measured; the distance of the last of the k selected among them is the
    next limit, until no unmeasured window's bound is at or under it. Bounds and distances stay on the executors: a limit,
    two counts and the k selected rows are all that the driver sees, and each round is one pass over the store.
    """
    pool = store.where(eligible)
    least = scored(pool, query, False, weights).select(F.col("distance").alias("bound"))
    low, high, n, parts = -np.inf, least.orderBy("bound").limit(seed).agg(F.max("bound")).first()[0], seed, []
    if high is None:
        return [], Certificate(0, 0, np.inf, np.inf, True)
    while True:
        part = between(pool, query, low, high, weights).persist()
        stats = part.agg(F.count("*").alias("n"), F.min(F.when(F.col("bound") > high, F.col("bound"))).alias("next")).first()
        parts.append(part.where("distance is not null"))
        rows = reduce(DataFrame.unionByName, parts).withColumn("query_id", F.lit("query"))
        chosen = [(r["distance"], r["episode_id"], r["symbol"], r["pos"], r["cutoff"]) for r in greedy_by_query(rows, request.top_k, request.per_symbol, request.lookback).orderBy("rank").collect()]
        threshold = chosen[-1][0] if len(chosen) == request.top_k else np.inf
        following = stats["next"] if stats["next"] is not None else np.inf
        if following > threshold or following == np.inf:
            proof = Certificate(stats["n"], rows.count(), float(threshold), float(following), True)
            for p in parts:
                p.unpersist()
            return chosen, proof
        n *= 4
        low, high = high, threshold if np.isfinite(threshold) else max(following, least.orderBy("bound").limit(n).agg(F.max("bound")).first()[0])


# --- persisted signatures ----------------------------------------------------------------------------------------------


def signatures(bars: DataFrame, request: Request) -> DataFrame:
    """lookback, symbol, cutoff, pos, episode_id and the signature of each window at the stride: what a store of views keeps."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        ends, blocks = np.arange(request.lookback - 1, len(frame), request.stride), []
        for i in range(0, len(ends), 2048):
            blocks.extend(signature.signed(_arrays(frame, ends[i : i + 2048], request.lookback)).astype(np.float32))
        return pd.DataFrame({"lookback": request.lookback, "symbol": frame["symbol"].iloc[0], "cutoff": frame["ts"].to_numpy()[ends], "pos": frame["pos"].to_numpy()[ends], "signature": blocks})

    out = bars.select("symbol", "ts", "pos", *BARS).groupBy("symbol").applyInPandas(one, "lookback int, symbol string, cutoff timestamp, pos int, signature array<float>")
    return out.withColumn("episode_id", F.concat_ws("@", "symbol", F.col("pos").cast("string")))


def query_signature(bars: DataFrame, request: Request) -> np.ndarray:
    return signature.signed(_arrays(query_window(bars, request), np.array([request.lookback - 1]), request.lookback)).astype(np.float32)[0]


def signature_scan(store: DataFrame, asked: np.ndarray) -> DataFrame:
    """The seven view distances of every stored signature to one: arrays in batches, no bars are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = signature.distances(np.stack(frame["signature"].to_numpy()), asked)
                yield frame[["episode_id", "symbol", "cutoff", "pos"]].assign(**{v: d[v] for v in K.VIEWS})

    return store.select("episode_id", "symbol", "cutoff", "pos", "signature").mapInPandas(run, "episode_id string, symbol string, cutoff timestamp, pos int, " + ", ".join(f"{v} double" for v in K.VIEWS))


def store_search(store: DataFrame, asked: np.ndarray, request: Request, eligible: Column, size: int) -> DataFrame:
    """Shards of the lookback, each symbol's nearest in any view, and their fusion."""
    near = signature_scan(store.where(F.col("lookback") == request.lookback).where(eligible), asked)
    return fused(union_of_views(near, K.VIEWS, request.local), K.VIEWS, size)


# --- baselines and lists ----------------------------------------------------------------------------------------------


def random_neighbours(queries: DataFrame, episodes: DataFrame, seed: str, k: int) -> DataFrame:
    """For each query the first episode (by hash) of each symbol, symbols in the order of a hash. queries: few."""
    pairs = episodes.join(F.broadcast(queries), F.col("cutoff") < F.col("q_cutoff")).where("symbol != q_symbol")
    h = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), "query_id", c), 256)
    one = pairs.withColumns({"hs": h("symbol"), "he": h("episode_id")}).withColumn("e", F.row_number().over(Window.partitionBy("query_id", "symbol").orderBy("he"))).where("e = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hs", "symbol"))).where(F.col("rank") <= k).select("query_id", "rank", "episode_id", "symbol")


def null_selections(windows: DataFrame, replicates: int, seed: str, k: int, per_symbol: int, lookback: int) -> DataFrame:
    """For each replicate the diversified selection of windows in the order of a hash: what distances without information select."""
    each = windows.withColumn("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: r.cast("string"))))
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "query_id", "episode_id"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return greedy_by_query(each.withColumn("distance", draw), k, per_symbol, lookback).withColumnRenamed("query_id", "replicate")


#: Values in each part of a representation.
LENGTHS = {p: 128 if p == "coarse" else 4 * K.STAGES if p == "stage" else 3 * len(K.THRESHOLDS) if p == "structural" else int(p[1:3]) for p in PARTS}


def flattened(store: DataFrame) -> DataFrame:
    """episode_id, vector (all parts one after another, zeros for what is missing) and present (for each part, whether it is known)."""
    known = lambda p: ~F.isnan(F.get(p, F.lit(0)))
    vector = F.flatten(F.array(*[F.transform(p, lambda x: F.nanvl(x, F.lit(0.0))) for p in PARTS]))
    return store.select("episode_id", vector.alias("vector"), F.array(*[known(p) for p in PARTS]).alias("present"))


def unflattened(flat: DataFrame) -> DataFrame:
    """episode_id and the parts, NaN throughout for those that are not present."""
    at, parts = 1, []
    for i, p in enumerate(PARTS):
        part = F.slice("vector", at, LENGTHS[p])
        parts.append(F.when(F.col("present")[i], part).otherwise(F.transform(part, lambda _: F.lit(float("nan")))).alias(p))
        at += LENGTHS[p]
    return flat.select("episode_id", *parts)


def halved(store: DataFrame) -> DataFrame:
    """The store with every part rounded to 16-bit floats."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{p: [np.asarray(x, np.float16).astype(float) for x in frame[p]] for p in PARTS})

    return store.mapInPandas(run, store.schema)


def rank_neighbours(pairs: DataFrame, features: list[str], k: int) -> DataFrame:
    """For each query: windows by the sum over features of |their rank - the query's| / n, one for each symbol.

    pairs: query_id, episode_id, symbol, each feature f and the query's own q_<f>.
    """
    w = Window.partitionBy("query_id")
    total = F.lit(0.0)
    for f in features:
        pairs = pairs.withColumn(f"r_{f}", F.row_number().over(w.orderBy(f, "episode_id")))
        total = total + F.abs(F.col(f"r_{f}") - (F.count_if(F.col(f) < F.col(f"q_{f}")).over(w) + 1))
    pairs = pairs.withColumn("score", F.round(total / F.count("*").over(w), 12))
    first = F.row_number().over(Window.partitionBy("query_id", "symbol").orderBy("score", "episode_id"))
    one = pairs.withColumn("e", first).where("e = 1")
    return one.withColumn("rank", F.row_number().over(w.orderBy("score", "episode_id"))).where(F.col("rank") <= k).select("query_id", "rank", "episode_id", "symbol", "score")


def quotas(bounds: DataFrame, routes: dict[str, int]) -> DataFrame:
    """Windows within the quota of any route, with the routes that took them."""
    parts = None
    for route, n in routes.items():
        p = bounds.orderBy(route, "episode_id").limit(n).select("episode_id", F.lit(route).alias("route"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))


def band(bounds: DataFrame, column: str, low: float, high: float, excluded: DataFrame) -> DataFrame:
    """Windows with low < bound <= high that aren't excluded, and the least bound above."""
    rest = bounds.join(excluded, "episode_id", "left_anti")
    above = rest.where(F.col(column) > high).agg(F.min(column).alias("next_bound"))
    return rest.where((F.col(column) > low) & (F.col(column) <= high)).select("episode_id", column).crossJoin(F.broadcast(above))  # one row


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """query_id, vec_id, rank, distance: exact nearest of all vectors for a stated set of queries, in blocks of queries."""
    asked = queries.select("vec_id", "embedding").orderBy("vec_id").toPandas()
    out = None
    for at in range(0, len(asked), block):
        ids, q = asked["vec_id"].to_numpy()[at : at + block], np.stack(asked["embedding"].to_numpy()[at : at + block]).astype(np.float64)

        def run(frames: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x, own = np.stack(f["embedding"].to_numpy()).astype(np.float64), f["vec_id"].to_numpy()
                    size = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :]
                    square, error = size - 2 * q @ x.T, size * (4 * (q.shape[1] + 4) * np.finfo(float).eps)
                    far = np.sqrt(np.maximum(0, square + error))
                    far[ids[:, None] == own[None, :]] = np.inf
                    last = np.partition(far, k - 1, axis=1)[:, k - 1] if len(own) >= k else np.full(len(ids), np.inf)
                    # no row beyond the k-th, not even one that rounding makes its equal, can be nearer than this
                    open_ = (np.sqrt(np.maximum(0, square - error)) <= last[:, None] + 2e-6) & (ids[:, None] != own[None, :])
                    for i in range(len(ids)):
                        near = np.flatnonzero(open_[i])
                        exact = np.sqrt(((q[i] - x[near]) ** 2).sum(1))
                        order = np.lexsort((own[near], exact))
                        near, exact = near[order], exact[order]
                        place = np.arange(len(near)) - np.searchsorted(exact, exact)  # among equals, by vec_id
                        keep = place < k
                        if len(near) >= k:
                            keep &= exact <= exact[k - 1] + 2e-6
                        yield pd.DataFrame({"query_id": ids[i], "vec_id": own[near[keep]], "distance": exact[keep]})

        part = vectors.mapInPandas(run, "query_id long, vec_id long, distance double")
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 6), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, recall: share of the truth's rows that were found."""
    hit = truth.join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg of rows (query_id, rank, gain)."""
    dcg = lambda r: F.sum(F.when(r <= k, F.col("gain") / F.log2(r + 1)).otherwise(0.0))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "rank"))
    return ranked.withColumn("ideal", best).groupBy("query_id").agg(F.coalesce(F.try_divide(dcg(F.col("rank")), F.nullif(dcg(F.col("ideal")), F.lit(0.0))), F.lit(0.0)).alias("ndcg"))
