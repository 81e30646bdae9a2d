"""Episodes: fixed-length windows of bars that end at a cutoff, and their identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "v1"


def episode_id(dataset: Column, symbol: Column, cutoff: Column, lookback: Column) -> Column:
    """24 hex digits of a digest of the key as compact JSON with sorted names."""
    text = F.concat(
        F.lit('{"cutoff":"'), F.date_format(cutoff, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","instrument":{"dataset_id":"'), dataset, F.lit('","source_symbol":"'), symbol,
        F.lit('"},"lookback":'), lookback.cast("string"), F.lit(f',"representation_version":"{VERSION}"}}'),
    )
    return F.substring(F.sha2(text, 256), 1, 24)


def manifest(bars: DataFrame, tiers: DataFrame, lookbacks: tuple[int, ...], stride: int, dataset: str = "bars") -> DataFrame:
    """Positions at a stride, for each lookback that fits, of the symbols that aren't quarantined. bars: with pos."""
    rows = bars.join(F.broadcast(tiers.where("tier != 'QUARANTINED'").select("symbol", "tier")), "symbol")
    least = min(lookbacks)
    rows = rows.where((F.col("pos") >= least - 1) & ((F.col("pos") - (least - 1)) % stride == 0))
    rows = rows.withColumn("lookback", F.explode(F.array(*[F.lit(x) for x in lookbacks]))).where("pos + 1 >= lookback")
    return rows.select(episode_id(F.lit(dataset), F.col("symbol"), F.col("ts"), F.col("lookback")).alias("episode_id"), "symbol", F.col("ts").alias("cutoff"), "lookback", (F.col("pos") + 1).alias("available_bars"), "tier")


def windows(bars: DataFrame, lookback: int, stride: int, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """One row for each window: symbol, cutoff, pos and an array of each column, the oldest bar first. bars: with pos."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(lookback - 1), 0)
    lists = bars.select("symbol", F.col("ts").alias("cutoff"), "pos", *[F.collect_list(c).over(w).alias(c) for c in columns])
    return lists.where((F.col("pos") >= lookback - 1) & ((F.col("pos") - (lookback - 1)) % stride == 0))


def last_bars(bars: DataFrame, cutoff: str, lookback: int) -> DataFrame:
    """The last `lookback` bars up to a cutoff, numbered from the oldest; symbols with too few are left out."""
    w = Window.partitionBy("symbol")
    rows = bars.where(F.col("ts") <= F.lit(cutoff).cast("timestamp")).withColumn("back", F.row_number().over(w.orderBy(F.col("ts").desc()))).where(F.col("back") <= lookback)
    return rows.withColumn("n", F.count("*").over(w)).where(F.col("n") >= min(lookback, 126)).withColumn("step", F.col("n") - F.col("back")).drop("back", "n")
