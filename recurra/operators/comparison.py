"""Distances compared with one another, and distances of rows by the places of their values among queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions import kernels as K
from recurra.operators import search as S

METHODS = ("euclidean_path", "correlation_path", "bounded_dtw", "composite")


def by_method(store: DataFrame, queries: dict[str, dict[str, np.ndarray]]) -> DataFrame:
    """query_id, symbol, method, distance of each stored window to a stated set of queries, in one scan of the store."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            rows = {p: np.stack(frame[p].to_numpy()).astype(float) for p in S.PARTS}
            path = rows["s64_close_path"]
            for name, query in queries.items():
                other = np.broadcast_to(query["s64_close_path"], path.shape)
                parts = K.components(rows, query)
                found = {
                    "euclidean_path": np.sqrt(((path - other) ** 2).sum(axis=1)), "correlation_path": 1 - K.correlation(path, other),
                    "bounded_dtw": K.dtw_pairs(path[:, :, None], other[:, :, None], max(int(64 * K.BAND), 1)), "composite": K.composite(parts, K.warped(rows, query)),
                }
                for m in METHODS:
                    yield pd.DataFrame({"query_id": name, "symbol": frame["symbol"].to_numpy(), "method": m, "distance": found[m]})

    return store.select("symbol", *S.PARTS).mapInPandas(run, "query_id string, symbol string, method string, distance double")


def method_metrics(rows: DataFrame, seeds: int, k: int = 10) -> DataFrame:
    """Per method: how often the case itself is nearest to its copy, how often it is nearer than its reverse, recall and gain of the family.

    rows: method, query_id, family, case, kind (`` or `reverse`), own (the query's case), same (of its family), distance.
    """
    pair = rows.where("own").groupBy("method", "query_id").agg(F.max(F.when(F.col("kind") == "", F.col("distance"))).alias("near"), F.max(F.when(F.col("kind") == "reverse", F.col("distance"))).alias("far"))
    w = Window.partitionBy("method", "query_id").orderBy("distance", "case")
    best = rows.where("kind = ''").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    gain = 1 / F.log2(F.col("rank") + 1)
    ideal = sum(1 / np.log2(r + 2) for r in range(min(seeds, k)))
    each = best.groupBy("method", "query_id").agg(F.max(((F.col("rank") == 1) & F.col("own")).cast("int")).alias("first"), (F.count_if("same") / seeds).alias("recall"), (F.sum(F.when(F.col("same"), gain).otherwise(0.0)) / ideal).alias("ndcg"))
    out = each.join(pair, ["method", "query_id"])
    return out.groupBy("method").agg(
        F.count("*").alias("queries"), F.avg("first").alias("clone_first"), F.avg((F.col("near") < F.col("far")).cast("int")).alias("pair_ordering"), F.avg((F.col("far") <= F.col("near")).cast("int")).alias("negative_rate"),
        F.avg("recall").alias("family_recall"), F.avg("ndcg").alias("ndcg"),
    )


def midranks(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Per column the place of each value among the queries', from -1 to 1, ties in the middle; by sign where queries are all equal."""
    out = np.empty(values.shape)
    for j in range(values.shape[1]):
        sorted_ = np.sort(among[:, j])
        if sorted_[0] == sorted_[-1]:
            out[:, j] = np.sign(values[:, j] - sorted_[0])
        else:
            twice = np.searchsorted(sorted_, values[:, j], "left") + np.searchsorted(sorted_, values[:, j], "right")
            out[:, j] = np.clip((twice - len(sorted_)) / (len(sorted_) - 1), -1, 1)
    return out


def chart_distances(rows: DataFrame, key: str, columns: list[str], names: list[str], queries: np.ndarray) -> DataFrame:
    """query_id, key, distance: root mean square over the columns of the differences of places. queries: a row for each of a stated few names."""
    if len(names) < 2 or not np.isfinite(queries).all():
        raise ValueError("at least two queries of finite values are needed")
    asked = midranks(queries, queries)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                placed = midranks(frame[columns].to_numpy(float), queries)
                for name, q in zip(names, asked):
                    yield pd.DataFrame({"query_id": name, key: frame[key].to_numpy(), "distance": np.sqrt(((placed - q) ** 2).mean(axis=1))})

    return rows.select(key, *columns).mapInPandas(run, f"query_id string, {key} string, distance double")
