"""Queries on sources, quality, calendars and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.operators import calendars, episodes, quality
from recurra.plans.registry import query
from recurra.sources import bars as B

R = lambda *cs: [F.round(F.col(c), 6).alias(c) for c in cs]


def R_sql(*cs: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cs)


@query("src_4_canonical_bars", f"SELECT symbol, ts, {R_sql('open', 'high', 'low', 'close', 'volume')} FROM bars", bars="type_day")
def canonical_bars(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    theirs = bars.select("symbol", F.col("ts").cast("string").alias("date"), *[F.col(c).cast("string").alias(c.upper()) for c in (*B.PRICES, "volume")])
    return B.canonical(theirs, {c.upper(): c for c in (*B.PRICES, "volume")}).select("symbol", "ts", *R(*B.PRICES, "volume"))


@query("src_2_long_table_scan", "SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE symbol = 'Brand#1'", bars="brand_week")
def long_table(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return bars.where("symbol = 'Brand#1'").select("symbol", "ts", *R("close"))


@query("src_5_instruments", "SELECT DISTINCT symbol FROM bars", bars="brand_week")
def instruments(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return B.instruments(bars)


@query("src_6_prefix_lock", "SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM bars WHERE ts <= TIMESTAMP '1996-06-30' GROUP BY symbol", bars="brand_week")
def prefix_lock(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return B.until(bars, "1996-06-30").groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query(
    "src_9_prefix_digest",
    """r AS (SELECT symbol, date_trunc('month', ts) AS month, sha256(CAST(epoch(ts) AS BIGINT) || '|' || printf('%.6f|%.6f|%.6f|%.6f|%.6f', open, high, low, close, volume)) AS h FROM bars WHERE ts <= TIMESTAMP '1996-06-30'),
    m AS (SELECT symbol, month, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY ALL)
    SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY month)) AS digest FROM m GROUP BY symbol""",
    bars="brand_week",
)
def prefix_digest(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return B.prefix_digest(bars, "1996-06-30")


@query("src_8_file_fingerprint")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.file_fingerprints(spark, f"{sf_dir}/nation.parquet")


@query("src_10_date_metadata", "SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol", bars="brand_week")
def date_metadata(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return B.date_metadata(bars)


@query(
    "src_11_counts_at_cutoffs",
    """s AS (SELECT symbol, count(*) AS n, max(ts) AS l FROM bars GROUP BY symbol), c AS (SELECT date_trunc('month', ts) AS month, max(ts) AS cutoff FROM bars GROUP BY ALL)
    SELECT cutoff, count(symbol) AS eligible FROM c LEFT JOIN s ON l >= cutoff AND n >= 300 GROUP BY cutoff""",
    bars="brand_week",
)
def counts_at(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return B.counts_at(bars, calendars.month_ends(bars).select("cutoff"), 300)


#: Bars with one defect of each kind.
DEFECTS = (
    ("Brand#1", "1993-01-04", 1.0, 0.5, 2.0, 1.0, 5.0), ("Brand#2", "1993-01-05", 1.0, 2.0, 0.5, None, 5.0), ("Brand#3", "1993-01-06", -1.0, 2.0, -1.0, 1.0, 5.0),
    ("Brand#4", "1993-01-07", 1.0, 2.0, 0.5, 1.0, -5.0), ("Brand#5", "1993-01-08", 1000.0, 1000.0, 1000.0, 1000.0, 0.0),
)


def with_defects(spark: SparkSession, bars: DataFrame) -> DataFrame:
    rows = spark.createDataFrame(DEFECTS, "symbol string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = bars.where("symbol = 'Brand#6' and ts = timestamp'1993-02-01'")
    return bars.unionByName(rows.select(*bars.columns)).unionByName(twice)


DEFECTS_SQL = "d AS (SELECT symbol, ts, open, high, low, close, volume FROM bars UNION ALL SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', TIMESTAMP '{t}', {', '.join('NULL' if v is None else f'{v}::DOUBLE' for v in vs)})" for s, t, *vs in DEFECTS
) + ") UNION ALL SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE symbol = 'Brand#6' AND ts = TIMESTAMP '1993-02-01')"

AUDIT_SQL = DEFECTS_SQL + """,
    j AS (SELECT *, abs(CASE WHEN close > 0 THEN ln(close) END - lag(CASE WHEN close > 0 THEN ln(close) END) OVER w) AS jump,
                 nullif(greatest(epoch(ts) - epoch(lag(ts) OVER w), 0), 0) AS gap FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    a AS (SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(DISTINCT ts) AS duplicate_timestamps,
        count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS missing_required,
        count(*) FILTER (low > least(open, close, high) OR high < greatest(open, close, low)) AS invalid_ohlc,
        count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_prices, count(*) FILTER (volume < 0) AS negative_volume,
        count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (jump > ln(3)) AS extreme_discontinuities, round(max(gap) / quantile_cont(gap, 0.5), 6) AS max_gap_multiple
        FROM j GROUP BY symbol),
    t AS (SELECT *, CASE WHEN rows < 126 OR duplicate_timestamps + missing_required + invalid_ohlc + nonpositive_prices + negative_volume > 0 THEN 'QUARANTINED'
                         WHEN rows < 252 OR extreme_discontinuities > 0 OR zero_volume > greatest(5, floor(rows * 0.02)) THEN 'B' ELSE 'A' END AS tier FROM a)"""
ISSUES_SQL = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} > 0 THEN '{c}:' || {c} END" for c in (*quality.CRITICAL, "zero_volume", "extreme_discontinuities")) + ") AS issues"


@query("qua_1_2_3_audit", AUDIT_SQL + f" SELECT *, {ISSUES_SQL} FROM t", bars="brand_week")
def audit(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    out = quality.audit(with_defects(spark, bars))
    return out.withColumn("max_gap_multiple", F.round("max_gap_multiple", 6))


@query(
    "qua_4_ledger",
    AUDIT_SQL + """, s AS (SELECT symbol FROM bars WHERE symbol <> 'Brand#7' GROUP BY symbol UNION ALL SELECT 'Brand#999'), q AS (SELECT * FROM t WHERE symbol <> 'Brand#8')
    SELECT coalesce(s.symbol, q.symbol) AS symbol, CASE WHEN s.symbol IS NOT NULL AND q.symbol IS NOT NULL THEN 'matched' WHEN s.symbol IS NOT NULL THEN 'not_audited' ELSE 'not_listed' END AS accounting,
        coalesce(tier, 'NONE') AS tier, coalesce(rows, 0) AS rows,
        CASE WHEN last_ts IS NULL THEN 'unknown' WHEN DATE '1998-12-05' - last_ts::DATE <= 7 THEN '7d' WHEN DATE '1998-12-05' - last_ts::DATE <= 31 THEN '31d' ELSE 'older' END AS freshness
    FROM s FULL JOIN q ON s.symbol = q.symbol""",
    bars="brand_week",
)
def ledger(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    listed = B.instruments(bars).where("symbol != 'Brand#7'").union(spark.createDataFrame([("Brand#999",)], "symbol string"))
    return quality.ledger(listed, quality.audit(with_defects(spark, bars)).where("symbol != 'Brand#8'"), "1998-12-05")


LIQUID_SQL = """q AS (SELECT symbol, quantile_cont(close * volume, 0.5) AS m FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM bars) WHERE b <= 252 GROUP BY symbol),
    l AS (SELECT symbol, m, CASE WHEN 3 * row_number() OVER (ORDER BY m, symbol) <= count(*) OVER () THEN 'low' WHEN 3 * row_number() OVER (ORDER BY m, symbol) <= 2 * count(*) OVER () THEN 'middle' ELSE 'high' END AS stratum FROM q)"""


@query("qua_5_liquidity", LIQUID_SQL + " SELECT symbol, round(m, 4) AS median_turnover, stratum FROM l", bars="brand_week")
def liquidity(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return quality.liquidity(bars).withColumn("median_turnover", F.round("median_turnover", 4))


@query(
    "qua_6_stratified_sample",
    AUDIT_SQL + ", " + LIQUID_SQL + """, s AS (SELECT symbol, tier, stratum, sha256('7:' || tier || ':' || stratum || ':' || symbol) AS digest FROM t JOIN l USING (symbol)),
    p AS (SELECT *, row_number() OVER (PARTITION BY tier, stratum ORDER BY digest, symbol) AS place FROM s) SELECT symbol, tier, stratum, digest, place FROM p WHERE place <= 2""",
    bars="brand_week",
)
def stratified(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    symbols = quality.audit(with_defects(spark, bars)).select("symbol", "tier").join(quality.liquidity(bars).select("symbol", "stratum"), "symbol")
    return quality.stratified(symbols, 2, 7)


@query(
    "qua_7_nested_prefixes",
    """s AS (SELECT symbol, row_number() OVER (ORDER BY sha256('7' || chr(0) || symbol), symbol) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT symbol FROM bars))
    SELECT CAST(f AS DOUBLE) AS fraction, symbol, place FROM s, (VALUES (0.1), (0.25), (1.0)) AS f(f) WHERE place <= ceil(n * f)""",
    bars="brand_week",
)
def nested(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return quality.nested_prefixes(B.instruments(bars), (0.1, 0.25, 1.0), 7)


@query("cal_1_month_ends", "SELECT date_trunc('month', ts)::TIMESTAMP AS month, max(ts) AS cutoff FROM bars GROUP BY ALL", bars="market_day")
def month_ends(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return calendars.month_ends(bars)


@query(
    "cal_2_completed_months",
    "SELECT date_trunc('month', ts)::TIMESTAMP AS month, max(ts) AS cutoff FROM bars GROUP BY ALL HAVING last_day(max(ts)) < DATE '1996-05-31'",
    bars="market_day",
)
def completed(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return calendars.completed_month_ends(bars, "1996-05-31")


@query(
    "cal_2_next_batch",
    """e AS (SELECT DISTINCT date_trunc('month', ts)::TIMESTAMP AS month FROM bars WHERE last_day(ts) < DATE '1996-05-31')
    SELECT 'run' AS action, min(month) AS month, 12 AS done, count(*) AS open FROM e WHERE month >= (SELECT min(month) FROM e) + INTERVAL 12 MONTH""",
    bars="market_day",
)
def next_batch(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    first = calendars.month_ends(bars).agg(F.min("month").alias("m"))
    done = first.select(F.explode(F.expr("sequence(m, m + interval 11 month, interval 1 month)")).alias("month"))
    return calendars.next_batch(bars, done, "1996-05-31", 60)


@query(
    "cal_3_maturities",
    "m AS (SELECT symbol, ts, lead(ts, 20) OVER (PARTITION BY symbol ORDER BY ts) AS maturity FROM bars) SELECT * FROM m WHERE maturity IS NOT NULL",
    bars="brand_week",
)
def maturities(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return calendars.maturities(bars, 20)


@query(
    "cal_4_fold_purges",
    """f AS (SELECT * FROM (VALUES (1, TIMESTAMP '1993-01-01', TIMESTAMP '1995-01-01'), (2, TIMESTAMP '1995-01-01', TIMESTAMP '1997-01-01')) AS f(fold, start, next_start)),
    b AS (SELECT fold, ts, row_number() OVER (PARTITION BY fold ORDER BY ts DESC) AS back FROM bars JOIN f ON ts < next_start) SELECT fold, ts AS purge_cutoff FROM b WHERE back = 21""",
    bars="market_day",
)
def purges(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    folds = spark.createDataFrame([(1, "1993-01-01"), (2, "1995-01-01"), (3, "1997-01-01")], "fold int, start string").withColumn("start", F.col("start").cast("timestamp"))
    return calendars.purge_cutoffs(calendars.sessions(bars).select("ts"), folds, 20)


EPISODE_ID = """substr(sha256('{"cutoff":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","instrument":{"dataset_id":"bars","source_symbol":"' || symbol || '"},"lookback":' || lookback || ',"representation_version":"v1"}'), 1, 24)"""
MANIFEST_SQL = (
    "p AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars), "
    "m AS (SELECT * FROM p, (VALUES (63), (126)) AS l(lookback) WHERE n >= 126 AND pos >= 62 AND (pos - 62) % 21 = 0 AND pos + 1 >= lookback)"
)


@query("ep_1_2_manifest", MANIFEST_SQL + f" SELECT {EPISODE_ID} AS episode_id, symbol, ts AS cutoff, lookback, pos + 1 AS available_bars FROM m", bars="brand_week")
def manifest(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    tiers = quality.audit(bars)
    return episodes.manifest(B.positions(bars), tiers, (63, 126), 21).drop("tier")


@query(
    "ep_3_last_bars",
    """r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars WHERE ts <= TIMESTAMP '1997-01-01'),
    n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE back <= 63) SELECT symbol, ts, n - back AS step, round(close, 6) AS close FROM n WHERE n >= 63""",
    bars="brand_week",
)
def last_bars(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return episodes.last_bars(bars, "1997-01-01", 63).select("symbol", "ts", "step", *R("close"))


@query(
    "ep_windows_sliding",
    """w AS (SELECT symbol, ts, row_number() OVER o - 1 AS pos, avg(close) OVER f AS m, first_value(close) OVER f AS first_close, close FROM bars
              WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts AS cutoff, pos, round(m, 6) AS mean_close, round(first_close, 6) AS first_close, round(close, 6) AS last_close FROM w WHERE pos >= 62 AND (pos - 62) % 21 = 0""",
    bars="brand_week",
)
def sliding(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    w = episodes.windows(B.positions(bars), 63, 21)
    mean = F.aggregate("close", F.lit(0.0), lambda a, x: a + x) / F.size("close")
    return w.select("symbol", "cutoff", "pos", F.round(mean, 6).alias("mean_close"), F.round(F.col("close")[0], 6).alias("first_close"), F.round(F.element_at("close", -1), 6).alias("last_close"))


@query("set_1_union_distinct", "SELECT symbol FROM bars WHERE close > 150 UNION SELECT symbol FROM bars WHERE close < 60", bars="brand_week")
def union_distinct(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return bars.where("close > 150").select("symbol").union(bars.where("close < 60").select("symbol")).distinct()


@query("set_2_intersect", "SELECT symbol FROM bars WHERE close > 120 INTERSECT SELECT symbol FROM bars WHERE close < 80", bars="brand_week")
def intersect(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return bars.where("close > 120").select("symbol").intersect(bars.where("close < 80").select("symbol"))


@query("set_3_except", "SELECT symbol FROM bars EXCEPT SELECT symbol FROM bars WHERE close < 70", bars="brand_week")
def except_(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return bars.select("symbol").subtract(bars.where("close < 70").select("symbol"))


@query(
    "set_4_drop_all_copies",
    "d AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE symbol < 'Brand#2') SELECT symbol, count(*) AS n FROM (SELECT symbol, ts FROM d GROUP BY ALL HAVING count(*) = 1) GROUP BY symbol",
    bars="brand_week",
)
def drop_all_copies(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    twice = bars.unionByName(bars.where("symbol < 'Brand#2'"))
    return twice.withColumn("n", F.count("*").over(Window.partitionBy("symbol", "ts"))).where("n = 1").groupBy("symbol").agg(F.count("*").alias("n"))
