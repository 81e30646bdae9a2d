"""Queries on joins, outcomes and event studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import features as X
from recurra.functions.rolling import by
from recurra.operators import calendars, events, outcomes
from recurra.plans.features import TR, W, rnd, roll, rounded
from recurra.plans.registry import query
from recurra.sources.bars import positions

PAIR = dict(bars="brand_week", bench="market_week")


@query("joi_1_benchmark_align", "SELECT bars.symbol, bars.ts, round(bars.close, 6) AS close, round(bench.close, 6) AS bench_close FROM bars LEFT JOIN bench ON bars.ts = bench.ts", **PAIR)
def align(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(X.benchmark_on(bars, bench).select("symbol", "ts", "close", "bench_close"), "symbol", "ts")


@query(
    "joi_2_as_of",
    """m AS (SELECT date_trunc('month', ts)::TIMESTAMP + INTERVAL 15 DAY AS asked FROM bars GROUP BY ALL), s AS (SELECT DISTINCT symbol FROM bars)
    SELECT s.symbol, asked, max(b.ts) AS found, round(arg_max(close, b.ts), 6) AS close FROM s CROSS JOIN m JOIN bars AS b ON b.symbol = s.symbol AND b.ts <= asked GROUP BY ALL""",
    bars="brand_week",
)
def as_of(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """The latest bar at or before each time, by one ordered pass over the union of times and bars."""
    times = bars.select(F.date_trunc("month", "ts").alias("m")).distinct().select((F.col("m") + F.expr("interval 15 days")).alias("ts"))
    asks = bars.select("symbol").distinct().crossJoin(F.broadcast(times)).withColumns({"kind": F.lit(1), "at": F.lit(None).cast("timestamp"), "close": F.lit(None).cast("double")})  # months: tens
    rows = bars.select("symbol", "ts", F.lit(0).alias("kind"), F.col("ts").alias("at"), "close").unionByName(asks)
    w = Window.partitionBy("symbol").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({"found": F.last("at", True).over(w), "found_close": F.last("close", True).over(w)})
    return found.where("kind = 1 and found is not null").select("symbol", F.col("ts").alias("asked"), "found", F.round("found_close", 6).alias("close"))


@query(
    "joi_3_range_join",
    f"""p AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM bars), o AS (SELECT * FROM p WHERE pos >= 63 AND pos % 21 = 0)
    SELECT o.symbol, o.ts AS cutoff, count(*) AS n, round(max(b.high), 6) AS high FROM o JOIN p AS b ON o.symbol = b.symbol AND b.pos BETWEEN o.pos + 1 AND o.pos + 20 GROUP BY ALL""",
    bars="brand_week",
)
def range_join(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    p = positions(bars)
    o = p.where("pos >= 63 and pos % 21 = 0").select("symbol", F.col("ts").alias("cutoff"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 20)).alias("pos"))
    return o.join(p.select("symbol", "pos", "high"), ["symbol", "pos"]).groupBy("symbol", "cutoff").agg(F.count("*").alias("n"), F.round(F.max("high"), 6).alias("high"))


OUT1 = ", ".join(
    f"CASE WHEN count(close) OVER a{h} = {h} THEN lead(close, {h}) OVER w / close - 1 END AS r{h}, CASE WHEN count(close) OVER a{h} = {h} THEN max(high) OVER a{h} / close - 1 END AS u{h}, CASE WHEN count(close) OVER a{h} = {h} THEN min(low) OVER a{h} / close - 1 END AS d{h}"
    for h in (5, 10, 20, 60)
)
OUT1_SQL = (
    f"f AS (SELECT symbol, ts, {OUT1} FROM bars WINDOW w AS ({W}), " + ", ".join(f"a{h} AS ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (5, 10, 20, 60)) + "), "
    "o AS (" + " UNION ALL ".join(f"SELECT symbol, ts AS cutoff, {h} AS horizon, r{h} AS close_return, u{h} AS mfe, d{h} AS mae FROM f" for h in (5, 10, 20, 60)) + ")"
)


@query("out_1_forward_outcomes", OUT1_SQL + f" SELECT symbol, cutoff, horizon, {rnd(close_return='close_return', mfe='mfe', mae='mae')}, close_return IS NULL AS censored FROM o", bars="brand_week")
def forward(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(outcomes.forward(bars), "symbol", "cutoff")


@query(
    "out_2_outcome_summary",
    OUT1_SQL + " SELECT horizon, count(*) AS n, " + rnd(median_return="quantile_cont(close_return, 0.5)", q25="quantile_cont(close_return, 0.25)", q75="quantile_cont(close_return, 0.75)", positive_rate="avg((close_return > 0)::INT)", median_mfe="quantile_cont(mfe, 0.5)", median_mae="quantile_cont(mae, 0.5)") + " FROM o WHERE close_return IS NOT NULL GROUP BY horizon",
    bars="brand_week",
)
def summary(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(outcomes.summary(outcomes.forward(bars)), "horizon")


def _paths(bars: DataFrame, bench: DataFrame, steps: int = 126) -> DataFrame:
    rows = outcomes.origins(X.benchmark_on(bars, bench), calendars.sessions(bench))
    starts = rows.where("pos >= 63 and pos % 21 = 0 and atr is not null").withColumnRenamed("ts", "cutoff")
    return outcomes.paths(starts, rows, steps)


PATH_SQL = f"""cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS session, close AS bc FROM bench),
    t0 AS (SELECT bars.*, session, bc, row_number() OVER w - 1 AS pos, CASE WHEN lag(close) OVER w IS NOT NULL THEN {TR} END AS tr FROM bars LEFT JOIN cal ON bars.ts = cal.ts WINDOW w AS (PARTITION BY bars.symbol ORDER BY bars.ts)),
    p AS (SELECT *, {roll('avg', 'tr', 20)} AS atr FROM t0),
    x AS (SELECT o.symbol, o.ts AS cutoff, b.pos - o.pos AS step, b.ts AS t, b.close / o.close - 1 AS close_return, b.high / o.close - 1 AS high_return, b.low / o.close - 1 AS low_return,
              (b.close / o.close) / (b.bc / o.bc) - 1 AS relative_return, (b.close - o.close) / nullif(o.atr, 0) AS atr_move, coalesce(b.session - o.session = b.pos - o.pos, false) AS expected_session,
              o.close, o.atr, b.high AS h, b.low AS l, b.open AS op, b.close AS c
          FROM p AS o JOIN p AS b ON o.symbol = b.symbol AND b.pos BETWEEN o.pos + 1 AND o.pos + 126 WHERE o.pos >= 63 AND o.pos % 21 = 0 AND o.atr IS NOT NULL)"""


@query(
    "out_6_path_table",
    PATH_SQL + f" SELECT symbol, cutoff, step, t AS ts, {rnd(close_return='close_return', high_return='high_return', low_return='low_return', relative_return='relative_return', atr_move='atr_move')}, expected_session FROM x WHERE step <= 60",
    **PAIR,
)
def path_table(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(_paths(bars, bench, 60).select("symbol", "cutoff", "step", F.col("at").alias("ts"), "close_return", "high_return", "low_return", "relative_return", "atr_move", "expected_session"), "symbol", "cutoff", "step")


CAUSAL_SQL = PATH_SQL + """, g AS (SELECT symbol, cutoff, horizon, count(*) AS available_sessions, bool_and(expected_session) AS ok, arg_max(close_return, step) AS r, arg_max(relative_return, step) AS rr, max(high_return) AS u,
        min(low_return) AS d, max(t) AS done FROM x, (VALUES (5), (10), (20), (40), (60), (126)) AS v(horizon) WHERE step <= horizon GROUP BY ALL),
    tm AS (SELECT g.symbol, g.cutoff, horizon, min(step) FILTER (high_return = u) AS tu, min(step) FILTER (low_return = d) AS td FROM g JOIN x ON g.symbol = x.symbol AND g.cutoff = x.cutoff AND step <= horizon GROUP BY ALL),
    o AS (SELECT g.*, tu, td, available_sessions = horizon AS whole, CASE WHEN available_sessions < horizon THEN 'censored' WHEN NOT ok THEN 'calendar_mismatch' ELSE 'complete' END AS status FROM g JOIN tm USING (symbol, cutoff, horizon))"""
CAUSAL_COLS = "symbol, cutoff, horizon, available_sessions, status, " + rnd(close_return="CASE WHEN whole THEN r END", relative_return="CASE WHEN whole THEN rr END", mfe="CASE WHEN whole THEN u END", mae="CASE WHEN whole THEN d END") + ", CASE WHEN whole THEN done END AS completion, CASE WHEN whole THEN tu END AS time_to_mfe, CASE WHEN whole THEN td END AS time_to_mae"


@query("out_3_5_causal_outcomes", CAUSAL_SQL + f" SELECT {CAUSAL_COLS} FROM o", **PAIR)
def causal(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(outcomes.causal(_paths(bars, bench)), "symbol", "cutoff", "horizon")


@query(
    "out_7_embargo",
    CAUSAL_SQL + " SELECT horizon, CASE WHEN status <> 'complete' THEN status WHEN done <= TIMESTAMP '1996-06-01' THEN 'eligible' ELSE 'embargoed' END AS eligibility, count(*) AS n FROM o GROUP BY ALL",
    **PAIR,
)
def embargo(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return outcomes.embargo(outcomes.causal(_paths(bars, bench)), "1996-06-01").groupBy("horizon", "eligibility").agg(F.count("*").alias("n"))


BARRIER_SQL = PATH_SQL + """, k AS (SELECT symbol, cutoff, min(step) FILTER (h >= close + 2.0 * atr) AS up, min(step) FILTER (l <= close - 1.0 * atr) AS down, count(*) AS n, bool_and(expected_session) AS continuous FROM x WHERE step <= 20 GROUP BY ALL),
    z AS (SELECT *, CASE WHEN up < coalesce(down, 999) THEN 'favorable_first' WHEN down < coalesce(up, 999) THEN 'adverse_first' WHEN up = down THEN 'ambiguous_same_first_touch_bar' WHEN n < 20 THEN 'censored' ELSE 'no_touch' END AS label FROM k)"""


@query("out_4_first_touch_barrier", BARRIER_SQL + " SELECT symbol, cutoff, label, least(up, down) AS touch, n, continuous FROM z", **PAIR)
def barriers(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return outcomes.barriers(_paths(bars, bench, 20))


@query("out_10_barrier_labels", BARRIER_SQL + " SELECT symbol, cutoff, label FROM z WHERE n = 20 AND continuous AND label <> 'ambiguous_same_first_touch_bar'", **PAIR)
def barrier_labels(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = outcomes.barriers(_paths(bars, bench, 20))
    return rows.where("n = 20 and continuous and label != 'ambiguous_same_first_touch_bar'").select("symbol", "cutoff", "label")


@query("sec_13_barrier_routes", BARRIER_SQL + " SELECT count(*) FILTER (label IN ('favorable_first', 'adverse_first', 'no_touch')) AS eligible, count(*) FILTER (label NOT IN ('favorable_first', 'adverse_first', 'no_touch')) AS excluded FROM z", **PAIR)
def routes(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    good = F.col("label").isin("favorable_first", "adverse_first", "no_touch")
    return outcomes.barriers(_paths(bars, bench, 20)).agg(F.count_if(good).alias("eligible"), F.count_if(~good).alias("excluded"))


LADDER_SQL = PATH_SQL + """, e AS (SELECT symbol, cutoff, op AS entry FROM x WHERE step = 1),
    q AS (SELECT x.*, entry, 1.25 * atr AS risk, entry - 1.25 * atr AS stop FROM x JOIN e USING (symbol, cutoff) WHERE step <= 20 AND atr > 0),
    hh AS (SELECT symbol, cutoff, min(step) FILTER (l <= stop) AS hit FROM q GROUP BY ALL),
    g AS (SELECT symbol, cutoff, any_value(entry) AS entry, any_value(risk) AS risk, any_value(hit) AS hit, count(*) AS n, max(q.h) FILTER (step < coalesce(hit, 21)) AS best, max(least(op, stop)) FILTER (step = hit) AS ex, arg_max(c, step) AS last, max(q.h) AS high, min(l) AS low
          FROM q JOIN hh USING (symbol, cutoff) GROUP BY symbol, cutoff),
    v AS (SELECT *, coalesce(((best - entry) / risk >= 1)::INT + ((best - entry) / risk >= 2)::INT + ((best - entry) / risk >= 3)::INT + ((best - entry) / risk >= 5)::INT, 0) AS level FROM g WHERE n = 20),
    y AS (SELECT symbol, cutoff, CASE WHEN level = 0 THEN CASE WHEN hit IS NOT NULL THEN 0 ELSE 1 END ELSE level + 1 END AS cls, (coalesce(ex, last) - entry) / risk AS realized_r, (high - entry) / risk AS mfe_r, (low - entry) / risk AS mae_r, risk / entry AS r_pct FROM v)"""


@query("out_11_r_ladder", LADDER_SQL + f" SELECT symbol, cutoff, cls, {rnd(realized_r='realized_r', mfe_r='mfe_r', mae_r='mae_r', r_pct='r_pct')} FROM y", **PAIR)
def ladder(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(outcomes.ladder(_paths(bars, bench, 20)), "symbol", "cutoff")


@query("out_13_clean_store", LADDER_SQL + f" SELECT symbol, cutoff, cls, {rnd(realized_r='greatest(-10, least(20, realized_r))', mfe_r='mfe_r', mae_r='mae_r', r_pct='r_pct')} FROM y WHERE r_pct >= 0.002", **PAIR)
def clean(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(outcomes.clean(outcomes.ladder(_paths(bars, bench, 20))), "symbol", "cutoff")


@query(
    "out_12_label_store",
    f"""cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS session, lead(close, 5) OVER (ORDER BY ts) / close - 1 AS b5, lead(close, 20) OVER (ORDER BY ts) / close - 1 AS b20 FROM bench),
    p AS (SELECT symbol, bars.ts, session, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 20) OVER w / close - 1 AS r20 FROM bars JOIN cal ON bars.ts = cal.ts WINDOW w AS (PARTITION BY symbol ORDER BY bars.ts))
    SELECT symbol, p.ts, {rnd(excess_5='r5 - b5', excess_20='r20 - b20', delisting_20='coalesce(r20, -0.3) - b20')} FROM p JOIN cal ON p.ts = cal.ts WHERE p.session % 10 = 0""",
    **PAIR,
)
def label_store(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    every = Window.partitionBy(F.lit(0)).orderBy("ts")  # a row for each session
    cal = bench.select("ts", (F.row_number().over(every) - 1).alias("session"), *[(F.lead("close", h).over(every) / F.col("close") - 1).alias(f"b{h}") for h in (5, 20)])
    rows = bars.join(F.broadcast(cal), "ts").withColumns({f"r{h}": F.lead("close", h).over(by()) / F.col("close") - 1 for h in (5, 20)})
    out = rows.where("session % 10 = 0").select("symbol", "ts", (F.col("r5") - F.col("b5")).alias("excess_5"), (F.col("r20") - F.col("b20")).alias("excess_20"), (F.coalesce("r20", F.lit(-0.3)) - F.col("b20")).alias("delisting_20"))
    return rounded(out, "symbol", "ts")


SIGNAL_SQL = f"""s0 AS (SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS before, close / lag(close) OVER w - 1 AS ret, CASE WHEN lag(close) OVER w IS NOT NULL THEN {TR} / lag(close) OVER w END AS trf, close * volume AS turnover, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS ({W})),
    s1 AS (SELECT *, CASE WHEN count(trf) OVER p >= 20 THEN quantile_cont(trf, 0.5) OVER p END AS prange, CASE WHEN count(turnover) OVER p >= 20 THEN quantile_cont(turnover, 0.5) OVER p END AS prior_turnover, CASE WHEN count(r) OVER p >= 20 THEN stddev_pop(r) OVER p END AS prior_vol FROM s0 WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, coalesce(ret >= 0.04, false) AS up, coalesce(trf >= 0.04, false) AS range_day, coalesce(trf >= 0.04 AND close > open AND trf >= 1.5 * prange, false) AS expansion FROM s1)"""


@query(
    "evt_1_signal_panel",
    SIGNAL_SQL + f""", cal AS (SELECT ts, close AS bc, row_number() OVER o - 1 AS session, lead(close, 5) OVER o AS bc5, lead(close, 20) OVER o AS bc20, lead(open) OVER o AS bo1 FROM bench WINDOW o AS (ORDER BY ts)),
    q AS (SELECT s.*, session, bc5, bc20, bo1, coalesce(sum(up::INT) OVER p, 0) = 0 AS up_at_risk, coalesce(sum(expansion::INT) OVER p, 0) = 0 AS expansion_at_risk, lead(open) OVER w AS entry, before >= 5 AND prior_turnover >= 1000 AS investable,
              coalesce(lead(session, 5) OVER w - session = 5, false) AS complete_5, coalesce(lead(session, 20) OVER w - session = 20, false) AS complete_20, lead(close, 5) OVER w AS c5, lead(close, 20) OVER w AS c20,
              max(high) OVER a5 AS h5, max(high) OVER a20 AS h20, min(low) OVER a5 AS l5, min(low) OVER a20 AS l20
          FROM s LEFT JOIN cal ON s.ts = cal.ts WINDOW w AS (PARTITION BY symbol ORDER BY s.ts), p AS (PARTITION BY symbol ORDER BY s.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a5 AS (PARTITION BY symbol ORDER BY s.ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), a20 AS (PARTITION BY symbol ORDER BY s.ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
    SELECT symbol, ts, pos, up, up_at_risk, expansion, expansion_at_risk, investable, {rnd(prior_turnover='prior_turnover', prior_vol='prior_vol')}, complete_5, complete_20, """
    + ", ".join(rnd(**{f"return_{h}": f"CASE WHEN complete_{h} THEN c{h} / entry - 1 END", f"relative_{h}": f"CASE WHEN complete_{h} THEN ln(c{h} / entry) - ln(bc{h} / bo1) END", f"mfe_{h}": f"CASE WHEN complete_{h} THEN h{h} / entry - 1 END", f"mae_{h}": f"CASE WHEN complete_{h} THEN l{h} / entry - 1 END"}) for h in (5, 20))
    + " FROM q WHERE pos >= 64 AND session IS NOT NULL",
    **PAIR,
)
def panel(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(events.panel(bars, bench), "symbol", "ts")


RISK_SQL = SIGNAL_SQL + ", " + ", ".join(
    f"r{h} AS (SELECT symbol, {h} AS horizon, pos AS start, ts, lead(close, {h - 1}) OVER w / before - 1 AS forward, count(*) OVER n AS n, "
    + ", ".join(f"CAST(sum({f}::INT) OVER f5 AS BIGINT) AS {f}_first5, CAST(sum({f}::INT) OVER n AS BIGINT) AS {f}_full, CAST(sum({f}::INT) OVER p AS BIGINT) AS {f}_pre20, {f}::INT AS {f}_start" for f in ("up", "range_day", "expansion"))
    + f" FROM s WINDOW w AS ({W}), f5 AS ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), n AS ({W} ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING), p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"
    for h in (21, 63)
) + ", rr AS (SELECT * FROM r21 WHERE n = 21 AND start >= 64 UNION ALL SELECT * FROM r63 WHERE n = 63 AND start >= 64)"


@query("evt_2_risk_rows", RISK_SQL + " SELECT symbol, horizon, start, ts, round(forward, 6) + 0.0::DOUBLE AS forward, forward >= 0.25 AS winner, " + ", ".join(f"{f}_{k}" for f in ("up", "range_day", "expansion") for k in ("first5", "full", "pre20", "start")) + " FROM rr", bars="brand_week")
def risk_rows(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(events.risk_rows(bars), "symbol", "horizon", "start", "ts")


@query(
    "evt_3_winner_clusters",
    RISK_SQL + """, k AS (SELECT *, CASE WHEN coalesce(start - lag(start) OVER w, 2) <> 1 THEN 1 ELSE 0 END AS new FROM rr WHERE forward >= 0.05 WINDOW w AS (PARTITION BY symbol, horizon ORDER BY start)),
    g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY symbol, horizon ORDER BY start) AS BIGINT) AS run FROM k)
    SELECT symbol, horizon, run, min(start) AS start, count(*) AS run_length, round(max(forward), 6) AS peak_return FROM g GROUP BY symbol, horizon, run""",
    bars="brand_week",
)
def clusters(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(events.winner_clusters(events.risk_rows(bars, win=0.05)), "symbol", "horizon", "run")


FEATS_SQL = f"""a AS (SELECT *, ln(close / lag(close) OVER w) AS r, lag(close, 20) OVER w AS c20, lag(close, 63) OVER w AS c63, row_number() OVER w AS n FROM bars WINDOW w AS ({W})),
    f AS (SELECT symbol, ts, round(close / c20 - 1, 9) AS ret_20, round(close / c63 - 1, 9) AS ret_63, round(stddev_samp(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS vol_20, n FROM a),
    b AS (SELECT * FROM f WHERE n >= 64)"""
COLS = ["ret_20", "ret_63", "vol_20"]


def _feats(bars: DataFrame) -> DataFrame:
    return X.baseline_features(bars).select("symbol", "ts", *[(F.round(c, 9) + 0.0).alias(c) for c in COLS])


def avg_rank(x: str, keys: str = "ts") -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE"


DECILES_SQL = FEATS_SQL + ", dd AS (SELECT symbol, ts, ret_20, ret_63, vol_20, " + ", ".join(f"CAST(ceil(10 * ({avg_rank(c)}) / count(*) OVER (PARTITION BY ts)) AS INT) AS {c}_decile" for c in COLS) + " FROM b)"


@query("evt_4_deciles", DECILES_SQL + " SELECT symbol, ts, ret_20_decile, ret_63_decile, vol_20_decile FROM dd", bars="brand_week")
def deciles(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return events.deciles(_feats(bars), ["ts"], COLS).select("symbol", "ts", *[f"{c}_decile" for c in COLS])


RANKS_SQL = FEATS_SQL + ", rk AS (SELECT symbol, ts, " + ", ".join(f"({avg_rank(c)}) / count(*) OVER (PARTITION BY ts) AS {c}_rank" for c in COLS) + " FROM b)"


@query("evt_5_percentile_ranks", RANKS_SQL + f" SELECT symbol, ts, {rnd(**{f'{c}_rank': f'{c}_rank' for c in COLS})} FROM rk", bars="brand_week")
def ranks(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(events.percentile_ranks(_feats(bars), ["ts"], COLS).select("symbol", "ts", *[f"{c}_rank" for c in COLS]), "symbol", "ts")


MATCH_SQL = RANKS_SQL + """, ev AS (SELECT * FROM rk),
    pr AS (SELECT e.ts, e.symbol AS event, p.symbol AS control, round(0.5 * (p.ret_20_rank - e.ret_20_rank) * (p.ret_20_rank - e.ret_20_rank) + 0.3 * (p.ret_63_rank - e.ret_63_rank) * (p.ret_63_rank - e.ret_63_rank) + 0.2 * (p.vol_20_rank - e.vol_20_rank) * (p.vol_20_rank - e.vol_20_rank), 12) AS d2,
               sha256(strftime(e.ts, '%Y-%m-%d') || '|' || e.symbol || '|' || p.symbol) AS g FROM ev AS e JOIN rk AS p ON e.ts = p.ts AND e.symbol <> p.symbol),
    mm AS (SELECT *, row_number() OVER (PARTITION BY ts, event ORDER BY d2, g, control) AS match_rank FROM pr), m AS (SELECT ts, event, control, match_rank, d2 FROM mm WHERE match_rank <= 5)"""


def _matches(bars: DataFrame) -> DataFrame:
    rk = events.percentile_ranks(_feats(bars), ["ts"], COLS).select("symbol", "ts", *[f"{c}_rank" for c in COLS])
    return events.nearest_controls(rk, rk, {"ret_20_rank": 0.5, "ret_63_rank": 0.3, "vol_20_rank": 0.2})


@query("joi_11_knn_join", MATCH_SQL + " SELECT ts, event, control, match_rank, round(d2, 9) + 0.0::DOUBLE AS d2 FROM m", bars="brand_week")
def knn(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return _matches(bars).withColumn("d2", F.round("d2", 9))


@query(
    "joi_12_decile_ladder",
    DECILES_SQL + """, pr AS (SELECT e.ts, e.symbol AS event, p.symbol AS control, greatest(abs(p.ret_20_decile - e.ret_20_decile), abs(p.vol_20_decile - e.vol_20_decile)) AS far, sha256(strftime(e.ts, '%Y-%m-%d') || '|' || e.symbol || '|' || p.symbol) AS g
        FROM dd AS e JOIN dd AS p ON e.ts = p.ts),
    c AS (SELECT *, count(*) FILTER (far = 0) OVER w AS same, count(*) FILTER (far <= 1) OVER w AS near FROM pr WINDOW w AS (PARTITION BY ts, event)),
    l AS (SELECT *, CASE WHEN same >= 3 THEN 0 WHEN near >= 3 THEN 1 ELSE 2 END AS level FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY ts, event ORDER BY g, control) AS match_rank FROM l WHERE (level = 2 OR far <= level) AND control <> event)
    SELECT ts, event, control, level, match_rank FROM k WHERE match_rank <= 3""",
    bars="brand_week",
)
def decile_ladder(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    d = events.deciles(_feats(bars), ["ts"], COLS)
    return events.ladder_controls(d, d, ["ret_20_decile", "vol_20_decile"], 3)


PAIRED_SQL = MATCH_SQL + f", o AS (SELECT symbol, ts, lead(close, 20) OVER ({W}) / close - 1 AS v FROM bars)"


@query(
    "evt_7_paired_outcomes",
    PAIRED_SQL + f" SELECT m.ts, m.event, {rnd(event_value='any_value(e.v)', control_mean='avg(c.v)', difference='any_value(e.v) - avg(c.v)')}, count(*) AS controls FROM m JOIN o AS e ON e.ts = m.ts AND e.symbol = m.event JOIN o AS c ON c.ts = m.ts AND c.symbol = m.control WHERE e.v IS NOT NULL AND c.v IS NOT NULL GROUP BY m.ts, m.event",
    bars="brand_week",
)
def paired(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    out = outcomes.forward(bars, (20,)).select("symbol", F.col("cutoff").alias("ts"), F.col("close_return").alias("v"))
    return rounded(events.paired_outcomes(_matches(bars), out, "v"), "ts", "event")


@query(
    "evt_8_balance",
    MATCH_SQL + """, l AS (SELECT ts, symbol, 'ret_20' AS feature, ret_20 AS v FROM b UNION ALL SELECT ts, symbol, 'vol_20', vol_20 FROM b),
    e AS (SELECT feature, avg(v) AS em, var_samp(v) AS ev FROM (SELECT DISTINCT ts, event FROM m) AS x JOIN l ON l.ts = x.ts AND l.symbol = x.event GROUP BY feature),
    c AS (SELECT feature, avg(v) AS cm, var_samp(v) AS cv FROM m JOIN l ON l.ts = m.ts AND l.symbol = m.control GROUP BY feature), u AS (SELECT control, count(*) AS n FROM m GROUP BY control)
    SELECT feature, round((em - cm) / nullif(sqrt((ev + cv) / 2), 0), 6) + 0.0::DOUBLE AS smd, round((SELECT sum(n) * sum(n) / sum(n * n) FROM u), 6) AS control_ess FROM e JOIN c USING (feature)""",
    bars="brand_week",
)
def balance(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(events.balance(_matches(bars), _feats(bars), ["ret_20", "vol_20"]), "feature")


@query("evt_9_survivorship", "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars, DATE '1999-01-15' - max(ts)::DATE > 31 AS ended_early FROM bars GROUP BY symbol", bars="brand_day")
def survivorship(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return events.survivorship(bars, "1999-01-15")
