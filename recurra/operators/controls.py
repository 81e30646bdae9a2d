"""Joins that check themselves, null draws, paired tests and mixtures of forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must have each key once: a second row of a key fails the job where it is met."""
    n = F.count("*").over(Window.partitionBy(*keys))
    one = right.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key occurs twice"))).otherwise(F.lit(True))).where("_ok").drop("_n", "_ok")
    return left.join(one, keys, how)


def two_roles(pairs: DataFrame, panel: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (ts, event, control) with both sides' columns of one panel."""
    side = lambda role: panel.select("ts", F.col("symbol").alias(role), *[F.col(c).alias(f"{role}_{c}") for c in columns])
    return pairs.join(side("event"), ["ts", "event"], "left").join(side("control"), ["ts", "control"], "left")


def conflicts(requests: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys asked for with different values."""
    return requests.groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.count("*").alias("requests")).where("values > 1")


def bind_prefixes(queries: DataFrame, digests: DataFrame, benchmark: DataFrame) -> DataFrame:
    """queries with the digest of their symbol's prefix and of the benchmark's."""
    own = digests.select("symbol", F.col("digest").alias("stock_digest"))
    return queries.join(own, "symbol", "left").crossJoin(F.broadcast(benchmark.select(F.col("digest").alias("bench_digest"))))  # one row


def draws(cells: DataFrame, replicates: int, seed: str) -> DataFrame:
    """For each replicate and cell the first `take` members in the order of a hash. cells: cell, member, take."""
    each = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.withColumn("priority", F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), "member"), 256))
    place = F.row_number().over(Window.partitionBy("replicate", "cell").orderBy("priority", "member"))
    return each.withColumn("place", place).where(F.col("place") <= F.col("take"))


def plus_one(draws: DataFrame, observed: float, value: str) -> DataFrame:
    """One row: mean of the draws, and shares at or beyond the observed value either way, the observed one counted in."""
    return draws.agg(F.count("*").alias("draws"), F.avg(value).alias("mean"), ((F.count_if(F.col(value) <= observed) + 1) / (F.count("*") + 1)).alias("lower_p"), ((F.count_if(F.col(value) >= observed) + 1) / (F.count("*") + 1)).alias("upper_p"))


def mixture(parts: list[tuple[float, str]], classes: tuple[str, ...]) -> dict[str, Column]:
    """Convex mixture of forecasts: each part's columns are <part>_<class>."""
    total = sum(w for w, _ in parts)
    if not math.isclose(total, 1.0):
        raise ValueError(f"weights sum to {total}")
    return {f"p_{c}": sum((w * F.col(f"{p}_{c}") for w, p in parts), F.lit(0.0)) for c in classes}


def entry_report(rows: DataFrame, score: str, keep: float = 0.5) -> DataFrame:
    """Per year: outcomes of the entries whose score is in the year's upper share, less those of all, and profit factors."""
    year = Window.partitionBy("year")
    r = rows.withColumn("year", F.year("ts")).withColumn("pct", F.rank().over(year.orderBy(score)) / F.count("*").over(year))
    kept = F.when(F.col("pct") > 1 - keep, F.col("outcome"))
    factor = lambda x: F.try_divide(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x)))
    return r.groupBy("year").agg(F.count("*").alias("n"), F.avg("outcome").alias("all_mean"), F.avg(kept).alias("kept_mean"), (F.avg(kept) - F.avg("outcome")).alias("lift"), factor(kept).alias("profit_factor"))


def causal_order(predictions: DataFrame) -> DataFrame:
    """Rows whose prediction used an outcome that was not complete at the cutoff: there should be none."""
    return predictions.where(F.col("completion") > F.col("cutoff"))
