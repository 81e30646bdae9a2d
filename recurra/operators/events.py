"""Event studies: signal panels, risk rows, clusters of winners, deciles, matched controls, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.features import median, true_range
from recurra.functions.rolling import ahead, by, lag, prior

MOVE, EXPANSION, REFRACTORY = 0.04, 1.5, 20


def signals(bars: DataFrame, move: float = MOVE) -> DataFrame:
    """bars with pos, prior medians, and the flags up (close up by `move`) and expansion (a wide bar that closes up)."""
    rows = bars.withColumns({"before": lag("close"), "pos": F.row_number().over(by()) - 1})
    rows = rows.withColumns({"ret": F.col("close") / F.col("before") - 1, "trf": F.when(F.col("before").isNotNull(), true_range() / F.col("before")), "turnover": F.col("close") * F.col("volume"), "r": F.log(F.col("close") / F.col("before"))})
    guard = lambda x, agg: F.when(F.count(x).over(prior(20)) >= 20, agg.over(prior(20)))
    rows = rows.withColumns({"prior_range": guard("trf", median("trf")), "prior_turnover": guard("turnover", median("turnover")), "prior_vol": guard("r", F.stddev_pop("r"))})
    no = F.lit(False)
    up = F.coalesce(F.col("ret") >= move, no)
    wide = F.coalesce((F.col("trf") >= move) & (F.col("close") > F.col("open")) & (F.col("trf") >= EXPANSION * F.col("prior_range")), no)
    return rows.withColumns({"up": up, "range_day": F.coalesce(F.col("trf") >= move, no), "expansion": wide})


def panel(bars: DataFrame, benchmark: DataFrame, prior_sessions: int = 64, move: float = MOVE, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Daily eligibility with outcomes from the next open. benchmark: its own sessions."""
    rows = signals(bars, move)
    bench = benchmark.select("ts", F.col("close").alias("bc"), F.col("open").alias("bo"))
    every = Window.partitionBy(F.lit(0)).orderBy("ts")  # a row for each session of the calendar
    bench = bench.withColumns({"session": F.row_number().over(every) - 1, **{f"bc_{h}": F.lead("bc", h).over(every) for h in horizons}, "bo_1": F.lead("bo", 1).over(every)})
    rows = rows.join(F.broadcast(bench), "ts", "left")
    recent = prior(REFRACTORY)
    rows = rows.withColumns({
        "up_at_risk": F.coalesce(F.sum(F.col("up").cast("int")).over(recent), F.lit(0)) == 0, "expansion_at_risk": F.coalesce(F.sum(F.col("expansion").cast("int")).over(recent), F.lit(0)) == 0,
        "entry": F.lead("open", 1).over(by()), "investable": (F.col("before") >= 5) & (F.col("prior_turnover") >= 1000),
    })
    for h in horizons:
        done = F.lead("session", h).over(by()) - F.col("session") == h
        ends = F.lead("close", h).over(by())
        rows = rows.withColumns({
            f"complete_{h}": F.coalesce(done, F.lit(False)), f"return_{h}": F.when(done, ends / F.col("entry") - 1),
            f"relative_{h}": F.when(done, F.log(ends / F.col("entry")) - F.log(F.col(f"bc_{h}") / F.col("bo_1"))),
            f"mfe_{h}": F.when(done, F.max("high").over(ahead(h)) / F.col("entry") - 1), f"mae_{h}": F.when(done, F.min("low").over(ahead(h)) / F.col("entry") - 1),
        })
    keep = ["symbol", "ts", "pos", "up", "up_at_risk", "expansion", "expansion_at_risk", "investable", "prior_turnover", "prior_vol"]
    return rows.where((F.col("pos") >= prior_sessions) & F.col("session").isNotNull()).select(*keep, *[f"{n}_{h}" for h in horizons for n in ("complete", "return", "relative", "mfe", "mae")])


def risk_rows(bars: DataFrame, horizons: tuple[int, ...] = (21, 63), prior_sessions: int = 64, win: float = 0.25, move: float = MOVE) -> DataFrame:
    """Starts of moves with their forward return and how often each signal came at, in and before them."""
    rows = signals(bars, move)
    parts = []
    for h in horizons:
        span = by().rowsBetween(0, h - 1)
        flags = {}
        for f in ("up", "range_day", "expansion"):
            x = F.col(f).cast("int")
            flags |= {f"{f}_first5": F.sum(x).over(by().rowsBetween(0, 4)), f"{f}_full": F.sum(x).over(span), f"{f}_pre20": F.sum(x).over(prior(20)), f"{f}_start": x}
        part = rows.withColumns({**flags, "n": F.count("*").over(span), "forward": F.lead("close", h - 1).over(by()) / F.col("before") - 1})
        parts.append(part.where((F.col("pos") >= prior_sessions) & (F.col("n") == h)).select("symbol", F.lit(h).alias("horizon"), F.col("pos").alias("start"), "ts", F.col("forward"), (F.col("forward") >= win).alias("winner"), *flags))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def winner_clusters(rows: DataFrame) -> DataFrame:
    """Runs of winners at consecutive starts: the first start, the run's length and best return."""
    w = Window.partitionBy("symbol", "horizon").orderBy("start")
    win = rows.where("winner").withColumn("new", (F.coalesce(F.col("start") - F.lag("start").over(w), F.lit(2)) != 1).cast("int"))
    return win.withColumn("run", F.sum("new").over(w)).groupBy("symbol", "horizon", "run").agg(F.min("start").alias("start"), F.count("*").alias("run_length"), F.max("forward").alias("peak_return"))


def average_rank(keys: list[str], x: str) -> Column:
    """Rank from 1, ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def deciles(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumns({f"{c}_decile": F.ceil(10 * average_rank(keys, c) / n).cast("int") for c in columns})


def percentile_ranks(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumns({f"{c}_rank": average_rank(keys, c) / n for c in columns})


def nearest_controls(events: DataFrame, pool: DataFrame, weights: dict[str, float], k: int = 5) -> DataFrame:
    """The k nearest of a date's pool for each event by weighted squared distance, ties by hash and symbol.

    events and pool: ts, symbol and the columns of `weights`. A date's events meet that date's pool only.
    """
    e = events.select("ts", F.col("symbol").alias("event"), *[F.col(c).alias(f"e_{c}") for c in weights])
    p = pool.select("ts", F.col("symbol").alias("control"), *weights)
    d2 = sum((w * (F.col(c) - F.col(f"e_{c}")) * (F.col(c) - F.col(f"e_{c}")) for c, w in weights.items()), F.lit(0.0))
    pairs = e.join(p, "ts").where("control != event").withColumns({"d2": F.round(d2, 12), "digest": F.sha2(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), "event", "control"), 256)})
    place = F.row_number().over(Window.partitionBy("ts", "event").orderBy("d2", "digest", "control"))
    return pairs.withColumn("match_rank", place).where(F.col("match_rank") <= k).select("ts", "event", "control", "match_rank", "d2")


def ladder_controls(events: DataFrame, pool: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Controls from the event's own cell of deciles, else from within one decile in all, else from its date.

    The level is chosen before the event's own symbol is taken out, so there can be fewer than k. Ties by hash.
    """
    e = events.select("ts", F.col("symbol").alias("event"), *[F.col(c).alias(f"e_{c}") for c in columns])
    p = pool.select("ts", F.col("symbol").alias("control"), *columns)
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"e_{c}")) for c in columns]) if len(columns) > 1 else F.abs(F.col(columns[0]) - F.col(f"e_{columns[0]}"))
    w = Window.partitionBy("ts", "event")
    pairs = e.join(p, "ts").withColumns({"far": far, "digest": F.sha2(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), "event", "control"), 256)})
    pairs = pairs.withColumns({"same": F.count_if(F.col("far") == 0).over(w), "near": F.count_if(F.col("far") <= 1).over(w)})
    level = F.when(F.col("same") >= k, 0).when(F.col("near") >= k, 1).otherwise(2)
    pairs = pairs.withColumn("level", level).where(((F.col("level") == 2) | (F.col("far") <= F.col("level"))) & (F.col("control") != F.col("event")))
    return pairs.withColumn("match_rank", F.row_number().over(w.orderBy("digest", "control"))).where(F.col("match_rank") <= k).select("ts", "event", "control", "level", "match_rank")


def paired_outcomes(matches: DataFrame, outcomes: DataFrame, column: str) -> DataFrame:
    """An event's outcome less the mean of its controls', with their number."""
    o = outcomes.select("ts", "symbol", F.col(column).alias("v")).where("v is not null")
    own = o.select("ts", F.col("symbol").alias("event"), F.col("v").alias("event_value"))
    theirs = matches.join(o.withColumnRenamed("symbol", "control"), ["ts", "control"]).groupBy("ts", "event").agg(F.avg("v").alias("control_mean"), F.count("*").alias("controls"))
    return own.join(theirs, ["ts", "event"]).withColumn("difference", F.col("event_value") - F.col("control_mean"))


def balance(matches: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """feature, standardised mean difference of events and controls; and the effective number of controls in use."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns]))
    values = features.select("ts", "symbol", long.alias("x")).select("ts", "symbol", "x.feature", "x.v").where("v is not null")
    e = matches.select("ts", F.col("event").alias("symbol")).distinct().join(values, ["ts", "symbol"]).groupBy("feature").agg(F.avg("v").alias("em"), F.var_samp("v").alias("ev"))
    c = matches.select("ts", F.col("control").alias("symbol")).join(values, ["ts", "symbol"]).groupBy("feature").agg(F.avg("v").alias("cm"), F.var_samp("v").alias("cv"))
    use = matches.groupBy("control").count().agg((F.sum("count") * F.sum("count") / F.sum(F.col("count") * F.col("count"))).alias("control_ess"))
    return e.join(c, "feature").crossJoin(F.broadcast(use)).select("feature", F.try_divide(F.col("em") - F.col("cm"), F.nullif(F.sqrt((F.col("ev") + F.col("cv")) / 2), F.lit(0.0))).alias("smd"), "control_ess")  # one row


def survivorship(bars: DataFrame, market_end: str) -> DataFrame:
    """symbol, first and last session, number of bars, whether it ended more than 31 days early."""
    rows = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"))
    return rows.withColumn("ended_early", F.datediff(F.lit(market_end).cast("date"), F.col("last_ts").cast("date")) > 31)
