"""Proper scores, calibration, and tests of paired losses."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("favorable_first", "adverse_first", "no_touch")


def brier(classes: tuple[str, ...] = CLASSES, label: str = "label") -> Column:
    return sum(((F.col(f"p_{c}") - (F.col(label) == c).cast("double")) * (F.col(f"p_{c}") - (F.col(label) == c).cast("double")) for c in classes), F.lit(0.0))


def log_loss(classes: tuple[str, ...] = CLASSES, label: str = "label") -> Column:
    p = F.coalesce(*[F.when(F.col(label) == c, F.col(f"p_{c}")) for c in classes])
    return -F.log(F.greatest(p, F.lit(1e-15)))


def skill(rows: DataFrame, keys: list[str], loss: str, reference: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(loss).alias("loss"), F.avg(reference).alias("reference"), (1 - F.avg(loss) / F.avg(reference)).alias("skill"))


def pinball(actual: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (actual - q), (level - 1) * (actual - q))


def interval_score(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    return (high - low) + 2 / alpha * F.greatest(low - actual, F.lit(0.0)) + 2 / alpha * F.greatest(actual - high, F.lit(0.0))


def ranked(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with their place `k` from 1 in a total order, the number `n` of all, and running sums: {name: column}.

    Rows are dealt by ranges of the order, numbered within each range, and the ranges' counts and sums (one row each) put before them.
    """
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).persist()  # ranges are drawn from samples: one drawing for both uses
    own = Window.partitionBy("part").orderBy(*order)
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{x}") for x, c in sums.items()])
    first = first.select("part", F.sum("n").over(every).alias("n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k0"), *[F.coalesce(F.sum(f"s_{x}").over(before), F.lit(0)).alias(f"s_{x}") for x in sums])
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({"k": F.row_number().over(own), **{x: F.sum(c).over(upto) for x, c in sums.items()}}).join(F.broadcast(first), "part")
    return out.withColumns({"k": F.col("k") + F.col("k0"), **{x: F.col(x) + F.col(f"s_{x}") for x in sums}}).drop("part", "k0", *[f"s_{x}" for x in sums])


def calibration(rows: DataFrame, p: str, hit: str, bins: int, key: str) -> DataFrame:
    """Bins of equal count, the first ones a row larger: mean probability and frequency. A bin is a range of ranks."""
    r = ranked(rows.select(F.col(p).alias("p"), F.col(hit).alias("hit"), F.col(key).alias("key")), [F.col("p"), F.col("key")], {})
    size, more = F.floor(F.col("n") / bins), F.col("n") % bins
    edge = more * (size + 1)
    number = F.when(F.col("k") <= edge, F.floor((F.col("k") - 1) / (size + 1))).otherwise(more + F.floor((F.col("k") - 1 - edge) / F.greatest(size, F.lit(1))))
    return r.withColumn("bin", (number + 1).cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("frequency"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frequency"))) / F.sum("n")).alias("ece"))


def murphy(rows: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """One row: reliability, resolution and uncertainty of probabilities in bins of equal width."""
    b = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("f"), F.avg(hit).alias("o"))
    every = Window.partitionBy(F.lit(0))  # ten rows
    b = b.withColumns({"all": F.sum("n").over(every), "base": F.sum(F.col("n") * F.col("o")).over(every) / F.sum("n").over(every)})
    sq = lambda x: x * x
    return b.agg((F.sum(F.col("n") * sq(F.col("f") - F.col("o"))) / F.max("all")).alias("reliability"), (F.sum(F.col("n") * sq(F.col("o") - F.col("base"))) / F.max("all")).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def month_means(rows: DataFrame, loss: str, reference: str) -> DataFrame:
    return rows.groupBy(F.date_trunc("month", "cutoff").alias("month")).agg(F.avg(loss).alias("loss"), F.avg(reference).alias("reference"), (F.avg(loss) - F.avg(reference)).alias("difference"), F.count("*").alias("n"))


def risk_coverage(rows: DataFrame, confidence: str, loss: str, key: str) -> DataFrame:
    """Mean loss of the most confident share, at each tenth of coverage."""
    r = ranked(rows.select(F.col(confidence).alias("c"), F.col(loss).alias("loss"), F.col(key).alias("key")), [F.col("c").desc(), F.col("key")], {"total": "loss"})
    tenth = F.ceil(F.col("k") * 10 / F.col("n")).cast("int")
    return r.withColumns({"tenth": tenth, "risk": F.col("total") / F.col("k")}).groupBy("tenth").agg(F.max_by("risk", "k").alias("risk"), F.max("k").alias("covered"))


def dm_test(months: DataFrame, lags: int) -> DataFrame:
    """One row: mean of monthly differences, its Newey-West standard error, t, and the lower p value."""
    w = Window.partitionBy(F.lit(0)).orderBy("month")  # a row for each month
    every = Window.partitionBy(F.lit(0))
    d = months.withColumn("d", F.col("difference") - F.avg("difference").over(every))
    d = d.withColumns({f"g{k}": F.col("d") * F.lag("d", k).over(w) for k in range(1, lags + 1)})
    out = d.agg(F.avg("difference").alias("mean"), F.count("*").alias("n"), (F.sum(F.col("d") * F.col("d")) + sum((2 * (1 - k / (lags + 1)) * F.sum(f"g{k}") for k in range(1, lags + 1)), F.lit(0.0))).alias("s"))
    out = out.withColumn("se", F.sqrt(F.greatest(F.col("s"), F.lit(0.0))) / F.col("n"))
    return out.select("mean", "n", "se", F.try_divide("mean", F.nullif("se", F.lit(0.0))).alias("t"))


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    every = Window.partitionBy(F.lit(0))  # a row for each test
    w = every.orderBy(p, key)
    raw = (F.count("*").over(every) - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("_raw", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def abstentions(rows: DataFrame) -> DataFrame:
    """reasons: a sorted list of why a forecast is withheld. rows: ess, novelty, prior_novelty (95 % of earlier ones), priors, spread."""
    reasons = F.array_compact(F.array(
        F.when(F.col("ess") < 10, "low_effective_sample"), F.when((F.col("priors") >= 250) & (F.col("novelty") > F.col("prior_novelty")), "novel_query"), F.when(F.col("spread") > 0.2, "unstable_prefixes"),
    ))
    return rows.withColumn("reasons", F.concat_ws(",", reasons))


def rps(cumulative: list[tuple[Column, Column]]) -> Column:
    """Ranked probability score from pairs of forecast and actual cumulative probabilities."""
    return sum(((a - b) * (a - b) for a, b in cumulative), F.lit(0.0))


def rank_ic(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """Per date: rank correlation of score and outcome (ties at their mean)."""
    from recurra.operators.events import average_rank

    r = rows.withColumns({"_s": average_rank(["ts"], score), "_o": average_rank(["ts"], outcome)})
    return r.groupBy("ts").agg(F.corr("_s", "_o").alias("ic"), F.count("*").alias("n"))


def simplex(parts: int, tenths: int = 10) -> list[tuple[float, ...]]:
    """All weights in steps of 1 / tenths that sum to 1."""
    if parts == 1:
        return [(tenths / tenths,)] if tenths else [(0.0,)]
    out: list[tuple[float, ...]] = []

    def fill(left: int, more: int, sofar: tuple[int, ...]) -> None:
        if more == 1:
            out.append(tuple(x / tenths for x in (*sofar, left)))
            return
        for x in range(left + 1):
            fill(left - x, more - 1, (*sofar, x))

    fill(tenths, parts, ())
    return out


def months_needed(mean: float, sd: float, power: float = 0.8, level: float = 0.05) -> int:
    """Months for a one-sided test of a mean difference to have the power."""
    z = lambda p: math.sqrt(2) * _inverse_erf(2 * p - 1)
    return math.ceil(((z(1 - level) + z(power)) * sd / abs(mean)) ** 2) if mean else 0


def _inverse_erf(y: float) -> float:
    low, high = -6.0, 6.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid) < y else (low, mid)
    return (low + high) / 2


# --- on series of a few hundred months: the driver's NumPy ---------------------------------------------------------------


def moving_block_means(values: np.ndarray, block: int, draws: int, seed: int) -> np.ndarray:
    """Means of so many draws of whole blocks, cut to the series' length."""
    x, n = np.asarray(values, float), len(values)
    starts = np.random.default_rng(seed).integers(0, max(1, n - block + 1), (draws, -(-n // block)))
    return x[np.minimum((starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n], n - 1)].mean(axis=1)


def block_bootstrap(values: np.ndarray, block: int, draws: int = 2000, seed: int = 7, comparisons: int = 2) -> dict[str, float]:
    """Moving blocks: mean, its 95 % interval, the simultaneous upper bound of so many comparisons, and the shares of draws,
    centred on the mean, at or beyond it either way (plus one)."""
    mean, means = float(np.mean(values)), moving_block_means(values, block, draws, seed)
    low, high, upper = np.quantile(means, [0.025, 0.975, 1 - 0.05 / comparisons])
    centred = means - mean
    return {"mean": mean, "low": float(low), "high": float(high), "upper": float(upper), "lower_p": (1 + int((centred <= mean).sum())) / (draws + 1), "upper_p": (1 + int((centred >= mean).sum())) / (draws + 1)}


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square for 1 or 2 degrees of freedom."""
    return math.erfc(math.sqrt(max(x, 0) / 2)) if df == 1 else math.exp(-max(x, 0) / 2)


def binomial_two_sided(k: int, n: int, p: float) -> float:
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0) + ((n - i) * math.log(1 - p) if n - i else 0) for i in range(n + 1)]
    return min(1.0, sum(math.exp(v) for v in logs if v <= logs[k] + 1e-9))


def coverage_tests(hits: list[bool], level: float) -> dict[str, float]:
    """Exact binomial of the coverage, and a likelihood ratio of independence of one hit from the next."""
    n, k = len(hits), sum(hits)
    t = np.zeros((2, 2))
    for a, b in zip(hits[:-1], hits[1:]):
        t[int(a), int(b)] += 1
    ll = lambda a, b: (a * math.log(a / (a + b)) if a else 0) + (b * math.log(b / (a + b)) if b else 0)
    ratio = 2 * (ll(t[0, 0], t[0, 1]) + ll(t[1, 0], t[1, 1]) - ll(t[:, 0].sum(), t[:, 1].sum()))
    return {"coverage": k / n, "binomial_p": binomial_two_sided(k, n, level), "independence_p": chi2_sf(ratio, 1)}
