"""Features of each session from bars up to it, and the dense channels of an episode; window functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.rolling import by, lag, last, ln, prior, ratio, rolling

HISTORY = 252
mean, std, top, low, total = F.avg, F.stddev_samp, F.max, F.min, F.sum


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def true_range(*keys: str, order: str = "ts") -> Column:
    """High less low, or the distance of either from the close before; the first row has high less low."""
    before = F.lag("close").over(by(*keys, order=order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def benchmark_on(bars: DataFrame, benchmark: DataFrame, *columns: str) -> DataFrame:
    """bars with the benchmark's columns of the very same session, as bench_<name>; of equal times the last counts."""
    names = columns or ("close",)
    one = benchmark.groupBy("ts").agg(*[F.max_by(c, "ts").alias(f"bench_{c}") for c in names])
    return bars.join(F.broadcast(one), "ts", "left")  # a session each: thousands at most


def benchmark_features(benchmark: DataFrame) -> DataFrame:
    b = benchmark.withColumn("r", F.log(F.col("close") / lag("close")))
    close = F.col("close")
    return b.select(
        "ts",
        F.log(close / lag("close", 20)).alias("bench_ret_20"),
        F.log(close / lag("close", 63)).alias("bench_ret_63"),
        (close / rolling(mean(close), close, 200) - 1).alias("bench_dist_sma_200"),
        rolling(std("r"), F.col("r"), 20).alias("bench_vol_20"),
    )


def stock_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 22 features of each session; those of a symbol's first HISTORY sessions are left out. bars: with pos."""
    close, volume = F.col("close"), F.col("volume")
    rows = bars.withColumns({"before": lag("close"), "tr": true_range()})
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    rows = rows.withColumns({
        "r": F.log(close / F.col("before")), "turnover": close * volume, "rel": spread / close, "loc": (close - F.col("low")) / spread,
        "up": F.when(close > F.col("before"), volume).otherwise(0.0),
    })
    c = F.col
    rows = rows.select(
        "symbol", "ts", "pos",
        *[F.log(close / lag("close", n)).alias(f"ret_{n}") for n in (5, 20, 63, 126, 252)],
        rolling(std("r"), c("r"), 20).alias("vol_20"), rolling(std("r"), c("r"), 63).alias("vol_63"),
        (rolling(mean("tr"), c("tr"), 20) / close).alias("atr_pct_20"),
        (close / rolling(top("high"), c("high"), HISTORY) - 1).alias("dist_high_252"), (close / rolling(low("low"), c("low"), HISTORY) - 1).alias("dist_low_252"),
        (close / rolling(mean(close), close, 50) - 1).alias("dist_sma_50"), (close / rolling(mean(close), close, 200) - 1).alias("dist_sma_200"),
        (F.log1p(rolling(mean(volume), volume, 20)) - F.log1p(rolling(median(volume), volume, HISTORY))).alias("volume_ratio_20_252"),
        F.log1p(rolling(median("turnover"), c("turnover"), 20)).alias("log_dollar_volume_20"),
        ratio(rolling(mean("rel"), c("rel"), 10), rolling(mean("rel"), c("rel"), 63)).alias("range_contraction_10_63"),
        rolling(mean("loc"), c("loc"), 20).alias("close_location_20"),
        ratio(rolling(total("up"), c("up"), 50), rolling(total(volume), volume, 50)).alias("up_volume_share_50"),
    )
    rows = rows.join(F.broadcast(benchmark_features(benchmark)), "ts", "left").withColumn("rs_63", c("ret_63") - c("bench_ret_63"))
    return rows.where(c("pos") >= HISTORY)


def event_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Trend, gap, burst, stage and relative-strength features of each session. bars: with pos."""
    c, close = F.col, F.col("close")
    rows = benchmark_on(bars, benchmark).withColumns({"lp": F.log("close"), "t": c("pos").cast("double"), "before": lag("close")})
    rows = rows.withColumns({"r": c("lp") - lag("lp"), "rs": close / c("bench_close")})
    rows = rows.withColumns({
        "sigma": rolling(std("r"), c("r"), 252), "sma": rolling(mean(close), close, 150),
        "high50": F.when(F.count("high").over(prior(50)) >= 50, top("high").over(prior(50))), "vol50": F.when(F.count("volume").over(prior(50)) >= 50, mean("volume").over(prior(50))),
        "burst": F.when(close / c("before") >= 1.04, 1).otherwise(0), "new_high": F.when(close >= rolling(top(close), close, 252), 1.0).otherwise(0.0),
        "mrs": c("rs") / rolling(mean("rs"), c("rs"), 250) - 1,
    })
    rows = rows.withColumns({
        "gap": ratio(F.log(c("open") / c("before")), c("sigma")), "slope": c("sma") / lag("sma", 20) - 1, "dist": close / c("sma") - 1,
        "burst_vol": F.when(close > c("high50"), ratio(c("volume"), c("vol50"))).otherwise(0.0),
    })
    since = lambda flag: F.least(F.lit(252), F.coalesce(c("pos") - F.last(F.when(flag, c("pos")), True).over(by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(252)))
    corr = lambda n: rolling(F.corr("lp", "t"), c("lp"), n)
    loc = lambda n: ratio(close - rolling(low("low"), c("low"), n), rolling(top("high"), c("high"), n) - rolling(low("low"), c("low"), n))
    stage = F.when(c("slope").isNull(), None).when((c("dist") > 0) & (c("slope") > 0.01), 2).when(c("dist") > 0, 3).when(c("slope") < -0.01, 4).otherwise(1)
    return rows.select(
        "symbol", "ts", "pos",
        *[(F.sign(corr(n)) * corr(n) * corr(n)).alias(f"trend_r2_{n}") for n in (63, 252)],
        (F.sign(c("lp") - lag("lp", 252)) * rolling(mean(-F.sign("r")), c("r"), 252)).alias("info_discreteness_252"),
        loc(5).alias("close_loc_5"), loc(60).alias("close_loc_60"),
        c("gap").alias("gap_sigma_0"), rolling(top("gap"), c("gap"), 20).alias("gap_sigma_max_20"),
        since(c("gap") > 2).cast("long").alias("days_since_gap2"), rolling(top("burst_vol"), c("burst_vol"), 10).alias("breakout_vol_max_10"),
        since(c("burst") == 1).cast("long").alias("days_since_burst4"), rolling(total("burst"), c("burst"), 20).cast("long").alias("burst4_count_20"),
        rolling(total("new_high"), c("new_high"), 63).cast("long").alias("new_high_count_63"),
        c("dist").alias("dist_sma150"), c("slope").alias("sma150_slope_20"), stage.alias("stage"),
        c("mrs").alias("mansfield_rs"), (c("mrs") - lag("mrs", 20)).alias("mansfield_rs_chg_20"),
    )


def breadth(bars: DataFrame, least: int = 50) -> DataFrame:
    """Share of symbols above their 50-session mean on each date with at least `least` of them, and its change over 20."""
    sma = rolling(mean("close"), F.col("close"), 50)
    days = bars.select("ts", "symbol", (F.col("close") > sma).cast("int").alias("above")).where("above is not null").groupBy("ts").agg(F.avg("above").alias("breadth_50"), F.count("*").alias("n")).where(F.col("n") >= least)
    every = Window.partitionBy(F.lit(0)).orderBy("ts")  # one row for each session
    return days.withColumn("breadth_50_chg_20", F.col("breadth_50") - F.lag("breadth_50", 20).over(every))


def baseline_features(bars: DataFrame) -> DataFrame:
    """Two returns and a volatility, or nothing unless the last 64 closes are there."""
    close = F.col("close")
    rows = bars.withColumn("r", F.log(close / lag("close")))
    full = F.count("close").over(last(64)) >= 64
    return rows.select("symbol", "ts", (close / lag("close", 20) - 1).alias("ret_20"), (close / lag("close", 63) - 1).alias("ret_63"), F.stddev_samp("r").over(last(20)).alias("vol_20"), full.alias("full")).where("full").drop("full")


def prior_rolling(bars: DataFrame, width: int) -> DataFrame:
    """Median turnover and standard deviation of returns (population) of the sessions before."""
    rows = bars.withColumns({"turnover": F.col("close") * F.col("volume"), "r": F.log(F.col("close") / lag("close"))})
    guard = lambda x, agg: F.when(F.count(x).over(prior(width)) >= width, agg.over(prior(width)))
    return rows.select("symbol", "ts", guard("turnover", median("turnover")).alias("prior_turnover"), guard("r", F.stddev_pop("r")).alias("prior_vol"))


def window_counts(bars: DataFrame, flag: Column, width: int) -> DataFrame:
    """How many of the next `width` sessions, this one included, have the flag; null where they run out."""
    w = by().rowsBetween(0, width - 1)
    return bars.withColumn("flag", flag.cast("int")).select("symbol", "ts", F.when(F.count("*").over(w) == width, F.sum("flag").over(w)).alias("n"))


def valid_rows(bars: DataFrame) -> DataFrame:
    p = [F.col(c) for c in ("open", "high", "low", "close")]
    good = (F.least(*p) > 0) & (F.col("high") >= F.greatest(*p)) & (F.col("low") <= F.least(*p)) & (F.col("volume") >= 0)
    for x in (*p, F.col("volume")):
        good = good & x.isNotNull()
    return bars.select("symbol", "ts", F.coalesce(good, F.lit(False)).alias("valid"))


def flat_bar_features(bars: DataFrame) -> DataFrame:
    """Range contraction and close location for instruments with bars that don't move: those have no location, and five of twenty do."""
    c, spread = F.col, F.col("high") - F.col("low")
    rows = bars.withColumns({"rng": spread / c("close"), "loc": F.when(spread > 0, (c("close") - c("low")) / spread)})
    full = lambda x, n, least: F.when(F.count(x).over(last(n)) >= least, F.avg(x).over(last(n)))
    return rows.select("symbol", "ts", "pos", F.try_divide(full("rng", 10, 10), F.nullif(full("rng", 63, 63), F.lit(0.0))).alias("range_contraction_10_63"), full("loc", 20, 5).alias("close_location_20"))


# --- dense channels of episodes -------------------------------------------------------------------------------------

CHANNELS = (
    "close_path", "return", "overnight", "intraday", "range_pct", "body_atr", "upper_wick_atr", "lower_wick_atr", "close_location", "atr_pct", "volume_robust_z",
    "return_shock_z", "distance_high_63", "distance_ma_20", "distance_ma_50", "compression_ratio", "benchmark_close", "benchmark_return", "benchmark_path",
    "benchmark_volatility", "benchmark_drawdown", "relative_return", "relative_path",
)


def dense_channels(rows: DataFrame, key: str = "episode") -> DataFrame:
    """The 23 channels of each step of each episode. rows: key, step, bars, bench_close (null where there is no session).

    All of it stays inside the episode: the first step has no return, and windows begin there.
    """
    c = F.col
    w = by(key, order="step")
    before = lambda x: F.lag(x).over(w)
    roll = lambda agg, x, n, least: F.when(F.count(x).over(last(n, key, order="step")) >= least, agg.over(last(n, key, order="step")))
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    b = rows.withColumns({"before": before("close"), "tr": true_range(key, order="step"), "lv": ln(c("volume"))})
    b = b.withColumns({
        "atr": F.nullif(roll(mean("tr"), c("tr"), 14, 5), F.lit(0.0)), "return": F.log(c("close") / c("before")),
        "benchmark_return": F.log(c("bench_close") / before("bench_close")), "bench_first": F.first("bench_close", True).over(sofar),
    })
    b = b.withColumns({"vm": roll(median("lv"), c("lv"), 20, 10), "rm": roll(median("return"), c("return"), 63, 31), "relative_return": c("return") - c("benchmark_return")})
    b = b.withColumns({"vd": F.abs(c("lv") - c("vm")), "rd": F.abs(c("return") - c("rm"))})
    b = b.withColumns({"vmad": roll(median("vd"), c("vd"), 20, 10), "rmad": roll(median("rd"), c("rd"), 63, 31)})
    wide = lambda n, least: roll(top("high"), c("high"), n, least) / roll(low("low"), c("low"), n, least) - 1
    return b.select(
        key, "step", ln(c("close")).alias("_"), (ln(c("close")) - F.first(ln(c("close"))).over(sofar)).alias("close_path"), "return",
        F.log(c("open") / c("before")).alias("overnight"), F.log(c("close") / c("open")).alias("intraday"), F.log(c("high") / c("low")).alias("range_pct"),
        ((c("close") - c("open")) / c("atr")).alias("body_atr"), ((c("high") - F.greatest("open", "close")) / c("atr")).alias("upper_wick_atr"),
        ((F.least("open", "close") - c("low")) / c("atr")).alias("lower_wick_atr"), ratio(c("close") - c("low"), c("high") - c("low")).alias("close_location"),
        (c("atr") / c("close")).alias("atr_pct"), ratio(c("lv") - c("vm"), 1.4826 * c("vmad")).alias("volume_robust_z"),
        ratio(c("return") - c("rm"), 1.4826 * c("rmad")).alias("return_shock_z"), (c("close") / roll(top("close"), c("close"), 63, 20) - 1).alias("distance_high_63"),
        (c("close") / roll(mean("close"), c("close"), 20, 10) - 1).alias("distance_ma_20"), (c("close") / roll(mean("close"), c("close"), 50, 20) - 1).alias("distance_ma_50"),
        ratio(wide(20, 10), wide(63, 20)).alias("compression_ratio"), c("bench_close").alias("benchmark_close"), "benchmark_return",
        F.log(c("bench_close") / c("bench_first")).alias("benchmark_path"), roll(std("benchmark_return"), c("benchmark_return"), 20, 10).alias("benchmark_volatility"),
        (c("bench_close") / F.max("bench_close").over(sofar) - 1).alias("benchmark_drawdown"), "relative_return",
        F.when(c("benchmark_return").isNotNull(), F.sum(F.coalesce("relative_return", F.lit(0.0))).over(sofar)).alias("relative_path"),
    ).drop("_")


def stage_signature(channels: DataFrame, lookback: int, key: str = "episode", stages: int = 12) -> DataFrame:
    """key, stage, and four scaled sums of each of 12 stretches of an episode."""
    bounds = [lookback * i // stages for i in range(stages + 1)]
    stage = F.coalesce(*[F.when(F.col("step") < bounds[i + 1], F.lit(i)) for i in range(stages)])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return channels.withColumn("stage", stage).groupBy(key, "stage").agg(
        (zero(F.max_by("close_path", "step") - F.min_by("close_path", "step")) / 0.08).alias("net"), (zero(F.stddev_samp("return")) / 0.02).alias("volatility"),
        zero(F.avg("volume_robust_z")).alias("volume_z"), (zero(F.sum("relative_return")) / 0.08).alias("relative"),
    )
