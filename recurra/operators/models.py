"""Models refitted on what had matured: monthly class probabilities, ordinal heads with monotone repair, daily ranks."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly_probabilities(rows: DataFrame, features: list[str], classes: tuple[str, ...], months: list[datetime.datetime], most_rows: int = 400_000, together: int = 6) -> DataFrame:
    """For each month's rows: probabilities from a logistic model of rows completed before the month. rows: ts, symbol, label, completion.

    A fit takes at most about `most_rows` rows, chosen by hash, and `together` fits run at a time; a month without 50 such
    rows of two classes has no forecasts. Forecasts are for all rows: a missing feature counts as 0 and sets a flag that is
    a feature too. The models are a row of weights for each month and class, so one join forecasts all months. Probabilities
    are floored and made to sum to 1.
    """
    inputs = [x for f in features for x in (F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f), F.col(f).isNull().cast("double").alias(f"no_{f}"))]
    names = [x for f in features for x in (f, f"no_{f}")]
    named = rows.select("symbol", "ts", "label", "completion", F.coalesce(*[F.when(F.col("label") == c, float(i)) for i, c in enumerate(classes)]).alias("__class"), *inputs)
    ready = VectorAssembler(inputCols=names, outputCol="__inputs").transform(named)
    spark = rows.sparkSession

    def fit(month: datetime.datetime) -> list[tuple]:
        past = ready.where((F.col("completion") < F.lit(month)) & F.col("__class").isNotNull())
        seen = {int(r["__class"]): r["count"] for r in past.groupBy("__class").count().collect()}
        n = sum(seen.values())
        if n < 50 or len(seen) < 2:
            return []
        chosen = past if n <= most_rows else past.where(F.pmod(F.xxhash64("symbol", "ts"), F.lit(1 << 20)) < int(most_rows / n * (1 << 20)))
        model = LogisticRegression(featuresCol="__inputs", labelCol="__class", maxIter=25, family="multinomial").fit(chosen)
        weights = model.coefficientMatrix.toArray()
        return [(month, i, float(model.interceptVector[i]), weights[i].tolist()) for i in range(len(weights))]

    with ThreadPoolExecutor(together) as pool:
        fitted = [row for rows_ in pool.map(fit, months) for row in rows_]
    wide = spark.createDataFrame(fitted, "month timestamp, class int, intercept double, weight array<double>").groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("intercept", "weight")))).alias("model"))
    placed = named.withColumn("month", F.date_trunc("month", "ts")).join(F.broadcast(wide), "month")  # a row for each month
    linear = []
    for i in range(len(classes)):
        own = F.col("model")[i]
        linear.append(sum((own["weight"][j] * F.col(x) for j, x in enumerate(names)), own["intercept"]))
    top = F.greatest(*linear)
    e = [F.coalesce(F.exp(x - top), F.lit(0.0)) for x in linear]
    floored = [F.greatest(x / sum(e, F.lit(0.0)), F.lit(1e-6)) for x in e]
    return placed.select("symbol", "ts", "label", *[(f / sum(floored, F.lit(0.0))).alias(f"p_{c}") for f, c in zip(floored, classes)])


def ordinal_to_classes(exceed: list[Column]) -> list[Column]:
    """Class probabilities from P(Y >= 1), P(Y >= 2), ..., made to fall first."""
    held, low = [], None
    for e in exceed:
        low = e if low is None else F.least(low, e)
        held.append(low)
    edges = [F.lit(1.0), *held, F.lit(0.0)]
    return [a - b for a, b in zip(edges[:-1], edges[1:])]


def daily_percentiles(rows: DataFrame, score: str) -> DataFrame:
    w = Window.partitionBy("ts")
    return rows.withColumn("percentile", F.rank().over(w.orderBy(score)) / F.count("*").over(w))


def portfolio_metrics(returns: DataFrame) -> DataFrame:
    """One row from daily (ts, ret): growth a year, largest fall, their ratio, and return over risk."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # a row for each session
    rows = returns.withColumn("log_equity", F.sum(F.log1p("ret")).over(w))
    rows = rows.withColumn("fall", F.exp(F.col("log_equity") - F.greatest(F.lit(0.0), F.max("log_equity").over(w))) - 1)
    out = rows.agg(F.exp(F.max_by("log_equity", "ts") * 252 / F.count("*")) .alias("g"), F.min("fall").alias("max_drawdown"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return out.select((F.col("g") - 1).alias("cagr"), "max_drawdown", F.try_divide(F.col("g") - 1, F.nullif(-F.col("max_drawdown"), F.lit(0.0))).alias("calmar"), "sharpe")
