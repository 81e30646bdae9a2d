"""What happened after a session: forward returns and excursions, barriers, path tables, ladders, embargo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.functions.features import true_range
from recurra.functions.rolling import ahead, by, last

HORIZONS = (5, 10, 20, 40, 60, 126)
BARRIER, FAVORABLE, ADVERSE, ATR = 20, 2.0, 1.0, 20


def full(h: int, value: Column, x: str = "close") -> Column:
    """value where all h later sessions are there."""
    return F.when(F.count(x).over(ahead(h)) == h, value)


def forward(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """symbol, cutoff, horizon: return, largest rise and fall; null and censored where the sessions run out."""
    each = [
        F.struct(
            F.lit(h).alias("horizon"),
            full(h, F.lead("close", h).over(by()) / F.col("close") - 1).alias("close_return"),
            full(h, F.max("high").over(ahead(h)) / F.col("close") - 1).alias("mfe"),
            full(h, F.min("low").over(ahead(h)) / F.col("close") - 1).alias("mae"),
        )
        for h in horizons
    ]
    rows = bars.select("symbol", F.col("ts").alias("cutoff"), *[e.alias(f"h{h}") for e, h in zip(each, horizons)])
    return rows.select("symbol", "cutoff", F.explode(F.array(*[f"h{h}" for h in horizons])).alias("o")).select("symbol", "cutoff", "o.*", F.col("o.close_return").isNull().alias("censored"))


def summary(outcomes: DataFrame) -> DataFrame:
    """Per horizon, over what isn't censored."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return outcomes.where("not censored").groupBy("horizon").agg(
        F.count("*").alias("n"), q("close_return", 0.5).alias("median_return"), q("close_return", 0.25).alias("q25"), q("close_return", 0.75).alias("q75"),
        F.avg((F.col("close_return") > 0).cast("int")).alias("positive_rate"), q("mfe", 0.5).alias("median_mfe"), q("mae", 0.5).alias("median_mae"),
    )


def origins(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """bars with pos, the ATR of the last 20 sessions (20 earlier ones needed) and the session's number in a calendar."""
    rows = bars.withColumns({"pos": F.row_number().over(by()) - 1, "tr": F.when(F.lag("close").over(by()).isNotNull(), true_range())})
    rows = rows.withColumn("atr", F.when(F.count("tr").over(last(ATR)) >= ATR, F.avg("tr").over(last(ATR))))
    return rows.join(F.broadcast(calendar.select("ts", F.col("pos").alias("session"))), "ts", "left")  # a row for each session


def paths(starts: DataFrame, bars: DataFrame, steps: int = 126) -> DataFrame:
    """A row for each of the next sessions of each start. starts: symbol, cutoff, pos, close, atr, session, bench_close."""
    later = bars.select("symbol", F.col("ts").alias("at"), F.col("pos").alias("at_pos"), *[F.col(c).alias(f"at_{c}") for c in ("open", "high", "low", "close", "session", "bench_close")])
    wanted = starts.withColumn("at_pos", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + steps)))
    rel = lambda c: F.col(f"at_{c}") / F.col("close") - 1
    return wanted.join(later, ["symbol", "at_pos"]).select(
        "symbol", "cutoff", (F.col("at_pos") - F.col("pos")).alias("step"), "at", rel("close").alias("close_return"), rel("high").alias("high_return"), rel("low").alias("low_return"),
        ((F.col("at_close") / F.col("close")) / (F.col("at_bench_close") / F.col("bench_close")) - 1).alias("relative_return"),
        F.try_divide(F.col("at_close") - F.col("close"), F.nullif("atr", F.lit(0.0))).alias("atr_move"), F.col("at_close"), F.col("at_high"), F.col("at_low"), F.col("at_open"),
        F.coalesce(F.col("at_session") - F.col("session") == F.col("at_pos") - F.col("pos"), F.lit(False)).alias("expected_session"),
        "close", "atr",
    )


def causal(paths: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """symbol, cutoff, horizon: returns, excursions, times to them and status, from path rows."""
    rows = paths.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).where("step <= horizon")
    out = rows.groupBy("symbol", "cutoff", "horizon").agg(
        F.count("*").alias("available_sessions"), F.bool_and("expected_session").alias("continuous"),
        F.max_by("close_return", "step").alias("close_return"), F.max_by("relative_return", "step").alias("relative_return"),
        F.max("high_return").alias("mfe"), F.min("low_return").alias("mae"), F.max("at").alias("completion"),
        F.min_by("step", F.struct(-F.col("high_return"), F.col("step"))).alias("time_to_mfe"), F.min_by("step", F.struct("low_return", "step")).alias("time_to_mae"),
    )
    complete = F.col("available_sessions") == F.col("horizon")
    only = lambda c: F.when(complete, F.col(c)).alias(c)
    status = F.when(~complete, "censored").when(~F.col("continuous"), "calendar_mismatch").otherwise("complete")
    return out.select("symbol", "cutoff", "horizon", "available_sessions", status.alias("status"), *[only(c) for c in ("close_return", "relative_return", "mfe", "mae", "completion", "time_to_mfe", "time_to_mae")])


def barriers(paths: DataFrame, horizon: int = BARRIER, favorable: float = FAVORABLE, adverse: float = ADVERSE) -> DataFrame:
    """Which of close + favorable ATR and close - adverse ATR is touched first."""
    up = F.when(F.col("at_high") >= F.col("close") + favorable * F.col("atr"), F.col("step"))
    down = F.when(F.col("at_low") <= F.col("close") - adverse * F.col("atr"), F.col("step"))
    out = paths.where((F.col("step") <= horizon) & F.col("atr").isNotNull()).groupBy("symbol", "cutoff").agg(F.min(up).alias("up"), F.min(down).alias("down"), F.count("*").alias("n"), F.bool_and("expected_session").alias("continuous"))
    label = (
        F.when(F.col("up") < F.coalesce("down", F.lit(1 << 30)), "favorable_first")
        .when(F.col("down") < F.coalesce("up", F.lit(1 << 30)), "adverse_first")
        .when(F.col("up") == F.col("down"), "ambiguous_same_first_touch_bar")
        .when(F.col("n") < horizon, "censored")
        .otherwise("no_touch")
    )
    return out.select("symbol", "cutoff", label.alias("label"), F.least("up", "down").alias("touch"), "n", "continuous")


def embargo(outcomes: DataFrame, query_cutoff: str) -> DataFrame:
    """outcomes with whether they were known at the query's cutoff."""
    at = F.lit(query_cutoff).cast("timestamp")
    state = F.when(F.col("status") != "complete", F.col("status")).when(F.col("completion") <= at, "eligible").otherwise("embargoed")
    return outcomes.withColumn("eligibility", state)


def ladder(starts: DataFrame, horizon: int = 20, risk_atr: float = 1.25, levels: tuple[float, ...] = (1.0, 2.0, 3.0, 5.0)) -> DataFrame:
    """R ladder from path rows: entry at the next open, stop a risk below it, class by the best high before the stop."""
    first = starts.where("step = 1").select("symbol", "cutoff", F.col("at_open").alias("entry"))
    rows = starts.where((F.col("step") <= horizon) & (F.col("atr") > 0)).join(first, ["symbol", "cutoff"]).withColumn("risk", risk_atr * F.col("atr"))
    rows = rows.withColumn("stop", F.col("entry") - F.col("risk"))
    hit = rows.groupBy("symbol", "cutoff").agg(F.min(F.when(F.col("at_low") <= F.col("stop"), F.col("step"))).alias("hit"))
    rows = rows.join(hit, ["symbol", "cutoff"])
    before = F.when(F.col("step") < F.coalesce("hit", F.lit(horizon + 1)), F.col("at_high"))
    out = rows.groupBy("symbol", "cutoff", "entry", "risk", "stop", "hit").agg(
        F.count("*").alias("n"), F.max(before).alias("best"), F.max(F.when(F.col("step") == F.col("hit"), F.least("at_open", "stop"))).alias("exit"),
        F.max_by("at_close", "step").alias("last"), F.max("at_high").alias("high"), F.min("at_low").alias("low"),
    ).where(F.col("n") == horizon)
    reach = (F.col("best") - F.col("entry")) / F.col("risk")
    level = sum((F.when(reach >= x, 1).otherwise(0) for x in levels), F.lit(0))
    r = lambda x: (x - F.col("entry")) / F.col("risk")
    return out.select(
        "symbol", "cutoff", F.when(level == 0, F.when(F.col("hit").isNotNull(), 0).otherwise(1)).otherwise(level + 1).alias("cls"),
        r(F.coalesce("exit", "last")).alias("realized_r"), r(F.col("high")).alias("mfe_r"), r(F.col("low")).alias("mae_r"), (F.col("risk") / F.col("entry")).alias("r_pct"),
    )


def clean(labels: DataFrame) -> DataFrame:
    """Labels with a risk worth taking, realized R held between -10 and 20."""
    return labels.where("r_pct >= 0.002").withColumn("realized_r", F.greatest(F.lit(-10.0), F.least(F.lit(20.0), F.col("realized_r"))))
