"""Quality of bars: audit records, tiers, liquidity strata, hash-ordered samples, ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.rolling import by, lag
from recurra.sources.bars import PRICES

#: Rows a symbol must have, rows for the first tier, a jump that counts as extreme, sessions of liquidity.
LEAST_ROWS, FULL_ROWS, EXTREME, LIQUID = 126, 252, math.log(3), 252


def audit(bars: DataFrame) -> DataFrame:
    """One record of defects for each symbol, with its tier and issues."""
    p = {c: F.col(c) for c in PRICES}
    close = F.when(F.col("close") > 0, F.log(F.when(F.col("close") > 0, F.col("close"))))
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(lag("ts"))).cast("double")
    rows = bars.withColumns({"jump": F.abs(close - F.lag(close).over(by())), "gap": F.when(gap > 0, gap)})
    missing = F.lit(False)
    for c in ("ts", *PRICES, "volume"):
        missing = missing | F.col(c).isNull()
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False))).cast("long")
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        (F.count("*") - F.count_distinct("ts")).alias("duplicate_timestamps"),
        count(missing).alias("missing_required"),
        count((p["low"] > F.least(p["open"], p["close"], p["high"])) | (p["high"] < F.greatest(p["open"], p["close"], p["low"]))).alias("invalid_ohlc"),
        count(F.least(*p.values()) <= 0).alias("nonpositive_prices"),
        count(F.col("volume") < 0).alias("negative_volume"),
        count(F.col("volume") == 0).alias("zero_volume"),
        count(F.col("jump") > EXTREME).alias("extreme_discontinuities"),
        F.try_divide(F.max("gap"), F.percentile("gap", F.lit(0.5))).alias("max_gap_multiple"),
    )
    return out.withColumns({"tier": tier(), "issues": issues()})


CRITICAL = ("duplicate_timestamps", "missing_required", "invalid_ohlc", "nonpositive_prices", "negative_volume")


def tier() -> Column:
    critical = sum((F.col(c) for c in CRITICAL), F.lit(0))
    worse = (F.col("rows") < FULL_ROWS) | (F.col("extreme_discontinuities") > 0) | (F.col("zero_volume") > F.greatest(F.lit(5), F.floor(F.col("rows") * 0.02)))
    return F.when((F.col("rows") < LEAST_ROWS) | (critical > 0), "QUARANTINED").when(worse, "B").otherwise("A")


def issues() -> Column:
    return F.concat_ws(";", *[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in (*CRITICAL, "zero_volume", "extreme_discontinuities")])


def ledger(source: DataFrame, quality: DataFrame, as_of: str) -> DataFrame:
    """Full reconciliation of the symbols that a source lists with those that were audited."""
    s = source.select("symbol", F.lit(True).alias("listed"))
    q = quality.select("symbol", "tier", "rows", "last_ts", F.lit(True).alias("audited"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_ts").cast("date"))
    return s.join(q, "symbol", "full").select(
        "symbol",
        F.when(F.col("listed") & F.col("audited"), "matched").when(F.col("listed"), "not_audited").otherwise("not_listed").alias("accounting"),
        F.coalesce("tier", F.lit("NONE")).alias("tier"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(age.isNull(), "unknown").when(age <= 7, "7d").when(age <= 31, "31d").otherwise("older").alias("freshness"),
    )


def liquidity(bars: DataFrame) -> DataFrame:
    """symbol, median turnover of its last sessions, and its third of all symbols."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    recent = bars.withColumn("back", back).where(F.col("back") <= LIQUID)
    median = recent.groupBy("symbol").agg(F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("median_turnover"))
    every = Window.partitionBy(F.lit(0))  # one row for each symbol
    share = F.row_number().over(every.orderBy("median_turnover", "symbol")) / F.count("*").over(every)
    return median.withColumn("stratum", stratum(share))


def stratum(share: Column) -> Column:
    return F.when(share <= 1 / 3, "low").when(share <= 2 / 3, "middle").otherwise("high")


def stratified(symbols: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n of each (tier, stratum) in the order of a hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), "tier", "stratum", "symbol"), 256)
    place = F.row_number().over(Window.partitionBy("tier", "stratum").orderBy("digest", "symbol"))
    return symbols.withColumn("digest", digest).withColumn("place", place).where(F.col("place") <= n)


def nested_prefixes(symbols: DataFrame, fractions: tuple[float, ...], seed: int) -> DataFrame:
    """fraction, symbol: each fraction's symbols contain those of the smaller ones."""
    every = Window.partitionBy(F.lit(0))  # one row for each symbol
    placed = symbols.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}\x00"), "symbol"), 256))
    placed = placed.withColumns({"place": F.row_number().over(every.orderBy("digest", "symbol")), "n": F.count("*").over(every)})
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    return placed.withColumn("fraction", wanted).where(F.col("place") <= F.ceil(F.col("n") * F.col("fraction"))).select("fraction", "symbol", "place")
