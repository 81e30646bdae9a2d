"""Registries of queries: causal measures at cutoffs, strata, hash-ordered selection, folds, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.features import median
from recurra.functions.rolling import by, last
from recurra.operators.quality import stratum

SESSIONS = 252


def measure(bars: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """At each cutoff that is a symbol's session with a year behind it: what its bars so far say, and their tier."""
    sofar = by().rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumns({
        "pos": F.row_number().over(by()) - 1, "zero_volume": F.sum((F.col("volume") == 0).cast("long")).over(sofar),
        "turnover": median(F.col("close") * F.col("volume")).over(last(SESSIONS)),
    })
    at = rows.join(F.broadcast(cutoffs), F.col("ts") == F.col("cutoff")).where(F.col("pos") >= SESSIONS - 1)  # a row for each month
    tier = F.when(F.col("zero_volume") > F.greatest(F.lit(5), F.floor((F.col("pos") + 1) * 0.02)), "B").otherwise("A")
    return at.select("symbol", "cutoff", (F.col("pos") + 1).alias("rows"), "zero_volume", "turnover", tier.alias("tier"))


def stratify(measured: DataFrame) -> DataFrame:
    w = Window.partitionBy("cutoff")
    share = F.row_number().over(w.orderBy(F.round("turnover", 6), "symbol")) / F.count("*").over(w)
    return measured.withColumn("stratum", stratum(share))


def select(rows: DataFrame, target: int, version: str) -> DataFrame:
    """The first of each (cutoff, tier, stratum) by digest; cells with fewer stay short."""
    text = F.to_json(F.array(F.lit(version), F.date_format("cutoff", "yyyy-MM-dd"), "tier", "stratum", "symbol"))
    placed = rows.withColumn("digest", F.sha2(text, 256))
    place = F.row_number().over(Window.partitionBy("cutoff", "tier", "stratum").orderBy("digest", "symbol"))
    return placed.withColumn("place", place).where(F.col("place") <= target)


def shortfall(selected: DataFrame, target: int, tiers: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """cutoff, tier, stratum, shortfall for the full grid of cells."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(s).alias("stratum")) for t in tiers for s in ("low", "middle", "high")]))
    grid = selected.select("cutoff").distinct().select("cutoff", cells.alias("c")).select("cutoff", "c.*")
    n = selected.groupBy("cutoff", "tier", "stratum").agg(F.count("*").alias("n"))
    return grid.join(n, ["cutoff", "tier", "stratum"], "left").select("cutoff", "tier", "stratum", (target - F.coalesce("n", F.lit(0))).alias("shortfall"))


def assign_folds(rows: DataFrame, at: str, folds: list[tuple[str, str, str]]) -> DataFrame:
    """The first fold whose dates hold the time, else warmup."""
    fold = F.coalesce(*[F.when(F.col(at).between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")), name) for name, a, b in folds], F.lit("warmup"))
    return rows.withColumn("fold", fold)


def regimes(benchmark: DataFrame, lookback: int) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("ts")  # a row for each session
    rows = benchmark.select("ts", (F.col("close") / F.lag("close", lookback - 1).over(w) - 1).alias("trend")).where("trend is not null")
    regime = F.when(F.col("trend") > 0.1, "up").when(F.col("trend") < -0.1, "down").otherwise("sideways")
    era = F.when(F.year("ts") < 2010, "pre-2010").when(F.year("ts") < 2020, "2010s").otherwise("2020s")
    return rows.withColumns({"regime": regime, "era": era})


def expanding_regimes(benchmark: DataFrame) -> DataFrame:
    """Per month: the sign of a half year's return, and the third of volatility among the months before."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts")  # a row for each session, then for each month
    rows = benchmark.select("ts", (F.col("close") / F.lag("close", 126).over(w) - 1).alias("trend"), F.log(F.col("close") / F.lag("close").over(w)).alias("r"))
    span = w.rowsBetween(-19, 0)
    rows = rows.withColumn("vol", F.when(F.count("r").over(span) >= 20, F.stddev_pop("r").over(span))).where("trend is not null")
    months = rows.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.max_by("trend", "ts").alias("trend"), F.max_by("vol", "ts").alias("vol"))
    before = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    q = lambda p: F.percentile("vol", F.lit(p)).over(before)
    months = months.withColumns({"k": F.count("vol").over(before), "lo": q(1 / 3), "hi": q(2 / 3)})
    trend = F.when(F.col("trend") > 0, "up").when(F.col("trend") < 0, "down").otherwise("flat")
    vol = F.when(F.col("k") < 2, "insufficient").when(F.col("vol") <= F.col("lo"), "low").when(F.col("vol") <= F.col("hi"), "middle").otherwise("high")
    return months.select("month", trend.alias("trend"), vol.alias("volatility"))


def without_used(rows: DataFrame, used: list[DataFrame]) -> DataFrame:
    """rows of symbols that none of the earlier uses has."""
    ledger = used[0]
    for u in used[1:]:
        ledger = ledger.unionByName(u)
    return rows.join(ledger.distinct(), "symbol", "left_anti")
