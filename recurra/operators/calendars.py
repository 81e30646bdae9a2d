"""Session calendars: month ends, completed months, maturities, purges between folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(bars: DataFrame) -> DataFrame:
    """ts and its number from 0, of the sessions of a calendar (one row for each session)."""
    every = Window.partitionBy(F.lit(0)).orderBy("ts")
    return bars.select("ts").distinct().withColumn("pos", F.row_number().over(every) - 1)


def month_ends(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.max("ts").alias("cutoff"))


def missing_months(calendar: DataFrame) -> DataFrame:
    """Months between the first and the last without a session."""
    months = month_ends(calendar).select("month")
    span = months.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month")).join(months, "month", "left_anti")


def completed_month_ends(calendar: DataFrame, as_of: str) -> DataFrame:
    """Month ends of the months that were over at as_of."""
    return month_ends(calendar).where(F.last_day("month") < F.lit(as_of).cast("date"))


def next_batch(calendar: DataFrame, done: DataFrame, as_of: str, total: int) -> DataFrame:
    """One row: complete, run (with the next month) or wait. done: (month) of batches that ran, a prefix of the months."""
    ends = completed_month_ends(calendar, as_of)
    todo = ends.join(done, "month", "left_anti").agg(F.min("month").alias("month"), F.count("*").alias("open"))
    state = todo.crossJoin(F.broadcast(done.agg(F.count("*").alias("done"))))  # one row each
    return state.select(F.when(F.col("done") >= total, "complete").when(F.col("open") > 0, "run").otherwise("wait").alias("action"), "month", "done", "open")


def maturities(bars: DataFrame, horizon: int) -> DataFrame:
    """symbol, ts, and the session `horizon` later, where there is one."""
    later = F.lead("ts", horizon).over(Window.partitionBy("symbol").orderBy("ts"))
    return bars.select("symbol", "ts", later.alias("maturity")).where("maturity is not null")


def purge_cutoffs(calendar: DataFrame, folds: DataFrame, purge: int) -> DataFrame:
    """fold and the session `purge` + 1 before the next fold's start; none for the last. folds: (fold, start)."""
    following = F.lead("start").over(Window.partitionBy(F.lit(0)).orderBy("fold"))
    bounds = folds.withColumn("next_start", following).where("next_start is not null")
    before = calendar.join(F.broadcast(bounds), F.col("ts") < F.col("next_start"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("ts").desc()))
    return before.withColumn("back", place).where(F.col("back") == purge + 1).select("fold", F.col("ts").alias("purge_cutoff"))
