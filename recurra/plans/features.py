"""Queries on features and dense channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.functions import features as X
from recurra.plans.base import DEFECTS_SQL, with_defects
from recurra.plans.registry import query
from recurra.sources.bars import positions

W = "PARTITION BY symbol ORDER BY ts"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(f"`{c}`"), 6).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes if c not in keys])


def roll(agg: str, x: str, n: int, least: int | None = None, w: str = W) -> str:
    call = f"quantile_cont({x}, 0.5)" if agg == "median" else f"{agg}({x})"
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {least or n} THEN {call} OVER {frame} END"


def rnd(**cols: str) -> str:
    return ", ".join(f"round({e}, 6) + 0.0::DOUBLE AS {k}" for k, e in cols.items())


TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"
FEA1 = dict(
    **{f"ret_{n}": f"ln(close / lag(close, {n}) OVER w)" for n in (5, 20, 63, 126, 252)},
    vol_20=roll("stddev_samp", "r", 20), vol_63=roll("stddev_samp", "r", 63), atr_pct_20=f"({roll('avg', 'tr', 20)}) / close",
    dist_high_252=f"close / ({roll('max', 'high', 252)}) - 1", dist_low_252=f"close / ({roll('min', 'low', 252)}) - 1",
    dist_sma_50=f"close / ({roll('avg', 'close', 50)}) - 1", dist_sma_200=f"close / ({roll('avg', 'close', 200)}) - 1",
    volume_ratio_20_252=f"ln(1 + ({roll('avg', 'volume', 20)})) - ln(1 + ({roll('median', 'volume', 252)}))", log_dollar_volume_20=f"ln(1 + ({roll('median', 'turnover', 20)}))",
    range_contraction_10_63=f"({roll('avg', 'rel', 10)}) / ({roll('avg', 'rel', 63)})", close_location_20=roll("avg", "loc", 20),
    up_volume_share_50=f"({roll('sum', 'up', 50)}) / nullif(({roll('sum', 'volume', 50)}), 0)",
)


@query(
    "fea_1_stock_features",
    f"""b AS (SELECT ts, close, ln(close / lag(close) OVER w) AS r, lag(close, 20) OVER w AS c20, lag(close, 63) OVER w AS c63 FROM bench WINDOW w AS (ORDER BY ts)),
    bf AS (SELECT ts, ln(close / c20) AS bench_ret_20, ln(close / c63) AS bench_ret_63, close / ({roll('avg', 'close', 200, w='ORDER BY ts')}) - 1 AS bench_dist_sma_200, {roll('stddev_samp', 'r', 20, w='ORDER BY ts')} AS bench_vol_20 FROM b),
    a AS (SELECT *, row_number() OVER w - 1 AS pos, ln(close / lag(close) OVER w) AS r, {TR} AS tr, close * volume AS turnover, nullif(high - low, 0) / close AS rel,
                 (close - low) / nullif(high - low, 0) AS loc, CASE WHEN close > lag(close) OVER w THEN volume ELSE 0 END AS up FROM bars WINDOW w AS ({W})),
    f AS (SELECT symbol, ts, pos, {', '.join(f'{e} AS {k}' for k, e in FEA1.items())} FROM a WINDOW w AS ({W}))
    SELECT symbol, f.ts, pos, {rnd(**{k: k for k in FEA1})}, {rnd(**{k: k for k in ('bench_ret_20', 'bench_ret_63', 'bench_dist_sma_200', 'bench_vol_20')})}, round(ret_63 - bench_ret_63, 6) + 0.0::DOUBLE AS rs_63
    FROM f LEFT JOIN bf ON f.ts = bf.ts WHERE pos >= 252""",
    bars="type_day", bench="market_day",
)
def stock_features(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(X.stock_features(positions(bars), bench), "symbol", "ts")


@query(
    "fea_3_event_features",
    f"""a AS (SELECT bars.*, ln(bars.close) AS lp, row_number() OVER w - 1 AS pos, lag(bars.close) OVER w AS before, ln(bars.close) - ln(lag(bars.close) OVER w) AS r, bars.close / bench.close AS rs
              FROM bars LEFT JOIN bench ON bars.ts = bench.ts WINDOW w AS (PARTITION BY bars.symbol ORDER BY bars.ts)),
    b AS (SELECT *, {roll('stddev_samp', 'r', 252)} AS sigma, {roll('avg', 'close', 150)} AS sma,
              CASE WHEN pos >= 50 THEN max(high) OVER p END AS high50, CASE WHEN pos >= 50 THEN avg(volume) OVER p END AS vol50,
              CASE WHEN close / before >= 1.04 THEN 1 ELSE 0 END AS burst, CASE WHEN close >= ({roll('max', 'close', 252)}) THEN 1 ELSE 0 END AS new_high,
              rs / ({roll('avg', 'rs', 250)}) - 1 AS mrs FROM a WINDOW p AS ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, ln(open / before) / nullif(sigma, 0) AS gap, sma / lag(sma, 20) OVER w - 1 AS slope, close / sma - 1 AS dist,
              CASE WHEN close > high50 THEN volume / nullif(vol50, 0) ELSE 0 END AS bv FROM b WINDOW w AS ({W})),
    k AS (SELECT *, CASE WHEN count(lp) OVER w63 >= 63 THEN corr(lp, pos) OVER w63 END AS c63, CASE WHEN count(lp) OVER w252 >= 252 THEN corr(lp, pos) OVER w252 END AS c252,
              {roll('avg', '-sign(r)', 252)} AS neg, lp - lag(lp, 252) OVER w AS lp252, mrs - lag(mrs, 20) OVER w AS mrs20,
              pos - last_value(CASE WHEN gap > 2 THEN pos END IGNORE NULLS) OVER s AS since_gap, pos - last_value(CASE WHEN burst = 1 THEN pos END IGNORE NULLS) OVER s AS since_burst,
              {roll('min', 'low', 5)} AS l5, {roll('max', 'high', 5)} AS h5, {roll('min', 'low', 60)} AS l60, {roll('max', 'high', 60)} AS h60, {roll('max', 'gap', 20)} AS g20,
              {roll('max', 'bv', 10)} AS bv10, {roll('sum', 'burst', 20)} AS b20, {roll('sum', 'new_high', 63)} AS nh
          FROM g WINDOW w AS ({W}), s AS ({W} ROWS UNBOUNDED PRECEDING), w63 AS ({W} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), w252 AS ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, pos, {rnd(trend_r2_63='sign(c63) * c63 * c63', trend_r2_252='sign(c252) * c252 * c252', info_discreteness_252='sign(lp252) * neg', close_loc_5='(close - l5) / nullif(h5 - l5, 0)',
        close_loc_60='(close - l60) / nullif(h60 - l60, 0)', gap_sigma_0='gap', gap_sigma_max_20='g20', breakout_vol_max_10='bv10', dist_sma150='dist', sma150_slope_20='slope', mansfield_rs='mrs', mansfield_rs_chg_20='mrs20')},
        least(252, coalesce(since_gap, 252)) AS days_since_gap2, least(252, coalesce(since_burst, 252)) AS days_since_burst4, CAST(b20 AS BIGINT) AS burst4_count_20, CAST(nh AS BIGINT) AS new_high_count_63,
        CASE WHEN slope IS NULL THEN NULL WHEN dist > 0 AND slope > 0.01 THEN 2 WHEN dist > 0 THEN 3 WHEN slope < -0.01 THEN 4 ELSE 1 END AS stage FROM k WHERE pos >= 300""",
    bars="type_day", bench="market_day",
)
def event_features(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(X.event_features(positions(bars), bench).where("pos >= 300"), "symbol", "ts")


@query(
    "fea_5_breadth",
    f"""a AS (SELECT ts, close > ({roll('avg', 'close', 50)}) AS above FROM bars), d AS (SELECT ts, avg(above::INT) AS b, count(*) AS n FROM a WHERE above IS NOT NULL GROUP BY ts HAVING count(*) >= 20)
    SELECT ts, round(b, 6) + 0.0::DOUBLE AS breadth_50, n, round(b - lag(b, 20) OVER (ORDER BY ts), 6) AS breadth_50_chg_20 FROM d""",
    bars="brand_week",
)
def breadth(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(X.breadth(bars, 20), "ts")


@query(
    "fea_6_baseline_features",
    f"""a AS (SELECT *, ln(close / lag(close) OVER w) AS r, lag(close, 20) OVER w AS c20, lag(close, 63) OVER w AS c63, row_number() OVER w AS n FROM bars WINDOW w AS ({W})),
    f AS (SELECT *, stddev_samp(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM a) SELECT symbol, ts, {rnd(ret_20='close / c20 - 1', ret_63='close / c63 - 1', vol_20='s')} FROM f WHERE n >= 64""",
    bars="brand_week",
)
def baseline(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(X.baseline_features(bars), "symbol", "ts")


@query(
    "fea_7_prior_rolling",
    f"""a AS (SELECT *, close * volume AS turnover, ln(close / lag(close) OVER ({W})) AS r FROM bars)
    SELECT symbol, ts, round(CASE WHEN count(turnover) OVER p >= 20 THEN quantile_cont(turnover, 0.5) OVER p END, 6) AS prior_turnover, round(CASE WHEN count(r) OVER p >= 20 THEN stddev_pop(r) OVER p END, 6) AS prior_vol
    FROM a WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    bars="brand_week",
)
def prior_rolling(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(X.prior_rolling(bars, 20), "symbol", "ts")


@query(
    "fea_8_window_counts",
    f"SELECT symbol, ts, CASE WHEN count(*) OVER n = 5 THEN CAST(sum((close > open)::INT) OVER n AS BIGINT) END AS n FROM bars WINDOW n AS ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)",
    bars="brand_week",
)
def window_counts(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return X.window_counts(bars, F.col("close") > F.col("open"), 5)


@query(
    "fea_9_valid_rows",
    DEFECTS_SQL + """, v AS (SELECT symbol, coalesce(least(open, high, low, close) > 0 AND high >= greatest(open, high, low, close) AND low <= least(open, high, low, close) AND volume >= 0
        AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL, false) AS valid FROM d)
    SELECT symbol, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM v GROUP BY symbol""",
    bars="brand_week",
)
def valid_rows(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return X.valid_rows(with_defects(spark, bars)).groupBy("symbol").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


LOOKBACK = 63


def episode_rows(bars: DataFrame, bench: DataFrame, lookback: int = LOOKBACK, stride: int = 63) -> DataFrame:
    """episode, step, bars and bench_close: windows of `lookback` bars that end at every `stride`-th position."""
    own = positions(X.benchmark_on(bars, bench))
    ends = own.select("symbol", F.col("ts").alias("cutoff"), F.col("pos").alias("end")).where((F.col("end") >= lookback - 1) & ((F.col("end") - (lookback - 1)) % stride == 0))
    steps = ends.withColumn("pos", F.explode(F.sequence(F.col("end") - (lookback - 1), F.col("end"))))
    return steps.join(own, ["symbol", "pos"]).withColumns({"episode": F.concat_ws("@", "symbol", F.col("end").cast("string")), "step": F.col("pos") - F.col("end") + lookback - 1})


E = "PARTITION BY episode ORDER BY step"
EPISODES_SQL = f"""p AS (SELECT bars.*, bench.close AS bench_close, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.ts) - 1 AS pos FROM bars LEFT JOIN bench ON bars.ts = bench.ts),
    e AS (SELECT x.symbol || '@' || y.pos AS episode, x.pos - y.pos + 62 AS step, x.* FROM p AS x JOIN p AS y ON x.symbol = y.symbol AND y.pos >= 62 AND (y.pos - 62) % 63 = 0 AND x.pos BETWEEN y.pos - 62 AND y.pos),
    a AS (SELECT *, lag(close) OVER w AS before, {TR} AS tr, ln(greatest(volume, 1e-12)) AS lv, ln(close / lag(close) OVER w) AS ret, ln(bench_close / lag(bench_close) OVER w) AS bret,
              ln(bench_close / first_value(bench_close IGNORE NULLS) OVER s) AS bpath, bench_close / max(bench_close) OVER s - 1 AS bdd, ln(close) - ln(first_value(close) OVER s) AS path
          FROM e WINDOW w AS ({E}), s AS ({E} ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, nullif({roll('avg', 'tr', 14, 5, E)}, 0) AS atr, {roll('median', 'lv', 20, 10, E)} AS vm, {roll('median', 'ret', 63, 31, E)} AS rm, ret - bret AS rret FROM a),
    c AS (SELECT *, abs(lv - vm) AS vd, abs(ret - rm) AS rd FROM b),
    d AS (SELECT *, {roll('median', 'vd', 20, 10, E)} AS vmad, {roll('median', 'rd', 63, 31, E)} AS rmad, {roll('max', 'high', 63, 20, E)} AS h63, {roll('max', 'close', 63, 20, E)} AS c63, {roll('min', 'low', 63, 20, E)} AS l63,
              {roll('max', 'high', 20, 10, E)} AS h20, {roll('min', 'low', 20, 10, E)} AS l20, {roll('avg', 'close', 20, 10, E)} AS ma20, {roll('avg', 'close', 50, 20, E)} AS ma50,
              {roll('stddev_samp', 'bret', 20, 10, E)} AS bvol, CASE WHEN bret IS NOT NULL THEN sum(coalesce(rret, 0)) OVER ({E} ROWS UNBOUNDED PRECEDING) END AS rpath FROM c)"""
CHANNEL_SQL = dict(
    close_path="path", overnight="ln(open / before)", intraday="ln(close / open)", range_pct="ln(high / low)", body_atr="(close - open) / atr", upper_wick_atr="(high - greatest(open, close)) / atr",
    lower_wick_atr="(least(open, close) - low) / atr", close_location="(close - low) / nullif(high - low, 0)", atr_pct="atr / close", volume_robust_z="(lv - vm) / nullif(1.4826 * vmad, 0)",
    return_shock_z="(ret - rm) / nullif(1.4826 * rmad, 0)", distance_high_63="close / c63 - 1", distance_ma_20="close / ma20 - 1", distance_ma_50="close / ma50 - 1",
    compression_ratio="(h20 / l20 - 1) / nullif(h63 / l63 - 1, 0)", benchmark_close="bench_close", benchmark_return="bret", benchmark_path="bpath", benchmark_volatility="bvol", benchmark_drawdown="bdd",
    relative_return="rret", relative_path="rpath",
)


@query("chn_1_to_11_dense_channels", f'{EPISODES_SQL} SELECT episode, step, round(ret, 6) + 0.0::DOUBLE AS "return", {rnd(**CHANNEL_SQL)} FROM d', bars="brand_week", bench="market_week")
def dense_channels(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(X.dense_channels(episode_rows(bars, bench)), "episode", "step")


@query(
    "chn_16_stage_signature",
    EPISODES_SQL + """, s AS (SELECT *, (SELECT count(*) FROM range(1, 12) AS r(i) WHERE step >= (63 * i) // 12) AS stage, (lv - vm) / nullif(1.4826 * vmad, 0) AS vz FROM d)
    SELECT episode, stage, round((arg_max(path, step) - arg_min(path, step)) / 0.08, 6) + 0.0::DOUBLE AS net, round(coalesce(stddev_samp(ret), 0) / 0.02, 6) AS volatility, round(coalesce(avg(vz), 0), 6) + 0.0::DOUBLE AS volume_z, round(coalesce(sum(rret), 0) / 0.08, 6) + 0.0::DOUBLE AS relative
    FROM s GROUP BY ALL""",
    bars="brand_week", bench="market_week",
)
def stages(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(X.stage_signature(X.dense_channels(episode_rows(bars, bench)), LOOKBACK), "episode", "stage").withColumn("stage", F.col("stage").cast("long"))
