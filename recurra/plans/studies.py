"""Queries on states, clusters, models, streams and synthetic cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import features as X
from recurra.functions import states
from recurra.operators import clustering, models, scoring, weighted
from recurra.operators import search as S
from recurra.plans.features import EPISODES_SQL, W, rnd, rounded
from recurra.plans.forecasts import LINK_SQL, _labels, _links, _scored
from recurra.plans.outcomes import FEATS_SQL, PAIR, _feats
from recurra.plans.registry import query
from recurra.sources import synthetic
from recurra.sources.bars import positions
from recurra.streaming import bars as stream


@query("chn_17_directional_events", bars="brand_week")
def directional(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return states.directional_events(bars)


@query("fea_4_swing_legs", bars="brand_week")
def legs(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return states.legs(bars)


STATE_SQL = (
    EPISODES_SQL.replace("x.pos - y.pos + 62 AS step", "x.pos - y.pos + 251 AS step").replace("y.pos >= 62 AND (y.pos - 62) % 63 = 0 AND x.pos BETWEEN y.pos - 62 AND y.pos", "y.pos >= 251 AND (y.pos - 251) % 50 = 0 AND x.pos BETWEEN y.pos - 251 AND y.pos")
    + """, z AS (SELECT episode, step, 251 - step AS back, close, ret, rret, bret, bench_close, ln(high / low) AS rg, ln(open / before) AS ov, (close - low) / nullif(high - low, 0) AS cl, atr / close AS ap, (h20 / l20 - 1) / nullif(h63 / l63 - 1, 0) AS cr, (lv - vm) / nullif(1.4826 * vmad, 0) AS vz FROM d),
    y AS (SELECT *, greatest(horizon // 3, 1) AS third, close / max(close) OVER w - 1 AS dd, ln(close / lag(close) OVER w) AS hr FROM z, (VALUES (252), (126), (63), (21), (10), (5)) AS v(horizon) WHERE back < horizon WINDOW w AS (PARTITION BY episode, horizon ORDER BY step)),
    h AS (SELECT episode, horizon, ln(arg_max(close, step) / arg_min(close, step)) AS net_log_return, min(dd) AS maximum_drawdown, arg_max(close, step) / max(close) - 1 AS distance_from_window_high, stddev_samp(hr) AS realized_volatility, quantile_cont(rg, 0.5) AS median_range_pct,
              quantile_cont(rg, 0.5) FILTER (back < third) / nullif(quantile_cont(rg, 0.5) FILTER (back >= horizon - third), 0) AS range_contraction, max(ov) FILTER (back = 0) AS latest_overnight, max(cl) FILTER (back = 0) AS latest_close_location, max(ap) FILTER (back = 0) AS latest_atr_pct,
              max(cr) FILTER (back = 0) AS latest_compression_ratio, avg(vz) AS mean_volume_robust_z, max(vz) FILTER (back = 0) AS latest_volume_robust_z, avg(vz) FILTER (ret > 0) - avg(vz) FILTER (ret < 0) AS up_down_volume_z_spread, sum(rret) AS relative_log_return, sum(bret) AS benchmark_log_return,
              avg((bench_close IS NOT NULL)::INT) AS benchmark_context_fraction FROM y GROUP BY ALL)"""
)


def _states(bars: DataFrame, bench: DataFrame) -> DataFrame:
    return states.multiresolution(positions(X.benchmark_on(bars, bench)))


SQL_SUMMARIES = list(states.SUMMARY)[:16]


@query("chn_21_multiresolution_state", STATE_SQL + " SELECT episode, horizon, " + rnd(**{k: k for k in SQL_SUMMARIES}) + " FROM h", **PAIR)
def summaries(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    values = [F.nanvl(F.col("summary")[i], F.lit(None).cast("double")).alias(k) for i, k in enumerate(SQL_SUMMARIES)]
    return rounded(_states(bars, bench).select("episode", "horizon", *values), "episode", "horizon")


@query("chn_21_samples", **PAIR)
def samples(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return _states(bars, bench)


@query("dst_15_16_state_distance", **PAIR)
def state_distance(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Each twentieth state against all, by both versions of the distance."""
    store = _states(bars, bench)
    asked = store.where("pmod(pos - 251, 1000) = 0").select("episode", "horizon", "samples", "summary").collect()  # every twentieth window
    return state_distances_of(store, asked)


def state_distances_of(store: DataFrame, asked: list) -> DataFrame:
    return rounded(states.state_distances(store, [tuple(r) for r in asked]).where("a != b"), "a", "b")


PATHS_SQL = LINK_SQL + f""", sp AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM bars), st AS (SELECT lk.query_id, lk.symbol AS member, sp.pos, sp.close, match_rank FROM lk JOIN nb ON nb.query_id = lk.query_id AND nb.symbol = lk.symbol JOIN sp ON sp.symbol = lk.symbol AND sp.ts = CAST(split_part(nb.episode_id, '@', 2) AS TIMESTAMP) WHERE eligible AND match_rank <= 20),
    pt AS (SELECT query_id, member, n.pos - st.pos AS step, n.close / st.close - 1 AS r FROM st JOIN sp AS n ON n.symbol = st.member AND n.pos BETWEEN st.pos + 1 AND st.pos + 20)"""


def _future(bars: DataFrame) -> DataFrame:
    p = positions(bars).select("symbol", "ts", "pos", "close")
    links = _links(bars).where("eligible").select("query_id", "match_rank", F.col("symbol"), "completion")
    done = p.select("symbol", F.col("ts").alias("completion"), (F.col("pos") - 20).alias("start"))
    base = p.select("symbol", F.col("pos").alias("start"), F.col("close").alias("base"))
    starts = links.join(done, ["symbol", "completion"]).join(base, ["symbol", "start"])
    steps = starts.withColumn("pos", F.explode(F.sequence(F.col("start") + 1, F.col("start") + 20)))
    return steps.join(p, ["symbol", "pos"]).select("query_id", "match_rank", F.col("symbol").alias("member"), (F.col("pos") - F.col("start")).alias("step"), (F.col("close") / F.col("base") - 1).alias("close_return"))


@query("dst_23_pairwise_paths", PATHS_SQL + " SELECT x.query_id, x.member AS a, y.member AS b, round(avg(abs(x.r - y.r)), 6) AS distance FROM pt AS x JOIN pt AS y ON x.query_id = y.query_id AND x.step = y.step AND x.member < y.member GROUP BY ALL", bars="brand_week")
def pairwise(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(clustering.pairwise_l1(_future(bars), "query_id", "member"), "query_id", "a", "b")


@query(
    "agg_8_median_path",
    PATHS_SQL.replace("query_id, member, n.pos", "query_id, member, match_rank, n.pos") + """, pw AS (SELECT query_id, step, r, pow(2.0, -(match_rank - 1) / 10.0) AS w, match_rank FROM pt), pc AS (SELECT *, sum(w) OVER (PARTITION BY query_id, step ORDER BY r, match_rank) AS cw, sum(w) OVER (PARTITION BY query_id, step) AS tw FROM pw)
    SELECT query_id, step, round(min(r) FILTER (cw >= 0.5 * tw - 1e-12), 6) + 0.0::DOUBLE AS median FROM pc GROUP BY ALL""",
    bars="brand_week",
)
def median_path(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _future(bars).withColumn("w", weighted.rank_weight("match_rank"))
    return rounded(weighted.weighted_quantiles(rows, ["query_id", "step"], "close_return", "w", (0.5,)).select("query_id", "step", F.col("q").alias("median")), "query_id", "step")


@query("clu_3_4_5_future_modes", bars="brand_week")
def future_modes(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", "close_return"))), lambda x: x["close_return"])
    paths = _future(bars).groupBy("query_id", "member").agg(ordered.alias("path"), F.pow(F.lit(2.0), -(F.min("match_rank") - 1) / 10).alias("weight"))
    return clustering.future_modes(paths.where("size(path) = 20"))


@query("clu_1_primary_members", LINK_SQL + " SELECT query_id, match_rank, symbol, CASE WHEN symbol = query_symbol THEN 'query_symbol' WHEN row_number() OVER (PARTITION BY query_id, symbol ORDER BY match_rank) > 1 THEN 'repeated_symbol' END AS reason FROM lk", bars="brand_week")
def members(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return clustering.primary_members(_links(bars)).select("query_id", "match_rank", "symbol", "reason")


@query("clu_6_balanced_partition", bars="brand_week")
def partition(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return clustering.partitions(_feats(bars), ["ret_20", "ret_63", "vol_20"], 4)


@query("agg_14_support", "d AS (SELECT symbol AS query_id, count(*) AS n FROM bars GROUP BY symbol) SELECT query_id, CAST(least(1000000000000, n * (n - 1) / 2) AS BIGINT) AS support FROM d", bars="brand_week")
def support(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return clustering.supports(bars.groupBy(F.col("symbol").alias("query_id")).agg(F.count("*").alias("n")).withColumn("k", F.lit(2)))


@query("sco_7_8_block_bootstrap", **PAIR)
def bootstrap(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    months = scoring.month_means(_scored(spark, sf_dir, bars, bench), "brier", "reference").orderBy("month").select("difference").toPandas()["difference"]
    return spark.createDataFrame([scoring.block_bootstrap(months.to_numpy(), 3)], "mean double, low double, high double, upper double, lower_p double, upper_p double")


@query("sco_11_coverage_tests", **PAIR)
def coverage(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _labels(spark, sf_dir, bars, bench).groupBy("cutoff").agg((F.avg((F.col("label") == "no_touch").cast("int")) < 0.5).alias("hit")).orderBy("cutoff").toPandas()
    return spark.createDataFrame([scoring.coverage_tests(rows["hit"].tolist(), 0.8)], "coverage double, binomial_p double, independence_p double")


@query("sco_17_forward_selection", **PAIR)
def selection(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Mean loss of every convex mixture of two forecasts and the uniform one."""
    rows = _scored(spark, sf_dir, bars, bench).withColumn("hit", (F.col("label") == "no_touch").cast("double"))
    base = rows.groupBy(F.lit(0).alias("_")).agg(F.avg("hit").alias("base")).drop("_")
    grid = spark.createDataFrame(scoring.simplex(3), "w0 double, w1 double, w2 double")
    mixed = F.col("w0") * F.col("p_no_touch") + F.col("w1") * F.col("base") + F.col("w2") / 3
    return rows.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(grid)).groupBy("w0", "w1", "w2").agg(F.avg((mixed - F.col("hit")) * (mixed - F.col("hit"))).alias("loss"))  # 1 and 66 rows


@query("mod_1_monthly_refit", **PAIR)
def monthly(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    labels = _labels(spark, sf_dir, bars, bench).withColumnRenamed("cutoff", "ts").withColumn("completion", F.col("ts") + F.expr("interval 140 days"))
    rows = labels.join(_feats(bars), ["symbol", "ts"], "left").persist()
    months = [r["m"] for r in rows.select(F.date_trunc("month", "ts").alias("m")).distinct().orderBy("m").collect()]
    return models.monthly_probabilities(rows, ["ret_20", "ret_63", "vol_20"], scoring.CLASSES, months)


@query("mod_2_ordinal_repair", FEATS_SQL + ", g AS (SELECT symbol, ts, 0.9 - abs(ret_20) AS a, 0.7 - abs(ret_63) AS b, 0.5 AS c FROM b), h AS (SELECT *, least(a, b) AS b2, least(a, b, c) AS c2 FROM g) SELECT symbol, ts, round(1 - a, 6) AS c0, round(a - b2, 6) AS c1, round(b2 - c2, 6) AS c2, round(c2, 6) AS c3 FROM h", bars="brand_week")
def ordinal(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    heads = models.ordinal_to_classes([0.9 - F.abs("ret_20"), 0.7 - F.abs("ret_63"), F.lit(0.5)])
    return rounded(_feats(bars).select("symbol", "ts", *[h.alias(f"c{i}") for i, h in enumerate(heads)]), "symbol", "ts")


@query("mod_3_daily_percentiles", FEATS_SQL + " SELECT symbol, ts, round(rank() OVER (PARTITION BY ts ORDER BY ret_20) / count(*) OVER (PARTITION BY ts), 6) AS percentile FROM b", bars="brand_week")
def percentiles(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(models.daily_percentiles(_feats(bars), "ret_20").select("symbol", "ts", "percentile"), "symbol", "ts")


@query(
    "mod_4_portfolio_metrics",
    """r AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS ret FROM bars), e AS (SELECT *, sum(ln(1 + ret)) OVER (ORDER BY ts) AS q FROM r WHERE ret IS NOT NULL), f AS (SELECT *, exp(q - greatest(0, max(q) OVER (ORDER BY ts))) - 1 AS fall FROM e),
    g AS (SELECT exp(arg_max(q, ts) * 252 / count(*)) AS g, min(fall) AS dd, avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) AS sharpe FROM f) SELECT round(g - 1, 6) AS cagr, round(dd, 6) AS max_drawdown, round((g - 1) / -dd, 6) AS calmar, round(sharpe, 6) AS sharpe FROM g""",
    bars="market_day",
)
def portfolio(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    returns = bars.select("ts", (F.col("close") / F.lag("close").over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1).alias("ret")).where("ret is not null")
    return rounded(models.portfolio_metrics(returns))


@query("str_1_stream_bars", "SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS volume FROM events GROUP BY ALL")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stream.drained(stream.bars(stream.event_stream(spark, sf_dir))), "symbol", "ts")


@query(
    "str_2_sessions",
    """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.drained(stream.sessions(stream.event_stream(spark, sf_dir))).withColumn("value", F.round("value", 4))


@query("syn_1_corpus")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.corpus(spark, 3)


@query("syn_4_acceptance")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each synthetic case: rank of its clone in other units, how far its distances to all move in those units, whether
    its noisy copy is nearer than it run backwards, and recall and gain of its family among the nearest."""
    seeds, k = 5, 4
    base = synthetic.corpus(spark, seeds)
    bars = base.unionByName(synthetic.variants(base, ("unit", "noise", "reverse")))
    rows = positions(bars).withColumn("bench_close", F.lit(None).cast("double"))
    store = S.representations(rows, S.Request("", lookback=252, stride=1))
    asked = store.where("not contains(symbol, '/') or symbol like '%/unit'").select("symbol", *S.PARTS).collect()  # 2 rows for each case
    found = S.scored_many(store, {r["symbol"]: {p: np.array([r[p]], float) for p in S.PARTS} for r in asked})
    case = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    kind = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(2))
    family = lambda c: F.regexp_replace(case(c), "-[0-9]+$", "")
    d = found.withColumns({"q": case("query_id"), "q_kind": kind("query_id"), "c": case("symbol"), "c_kind": kind("symbol"), "same": (family("query_id") == family("symbol")).cast("int")})
    own = d.where("q_kind = '' and not (c = q and c_kind = '')")
    order = Window.partitionBy("q").orderBy("distance", "symbol")
    clone = own.withColumn("rank", F.row_number().over(order)).where("c = q and c_kind = 'unit'").select("q", F.col("rank").alias("clone_rank"))
    moved = d.where("c_kind = '' and c != q").groupBy("q", "c").agg((F.max("distance") - F.min("distance")).alias("m")).groupBy("q").agg(F.max("m").alias("invariance"))
    pairs = own.where("c = q").groupBy("q").agg((F.max(F.when(F.col("c_kind") == "noise", F.col("distance"))) < F.max(F.when(F.col("c_kind") == "reverse", F.col("distance")))).cast("int").alias("ordered"))
    near = own.where("c_kind = ''").withColumn("rank", F.row_number().over(order))
    gain = S.ndcg(near.select(F.col("q").alias("query_id"), "rank", F.col("same").alias("gain")), k).withColumnRenamed("query_id", "q")
    recall = near.where(F.col("rank") <= k).groupBy("q").agg((F.sum("same") / (seeds - 1)).alias("recall"))
    return clone.join(moved, "q").join(pairs, "q").join(gain, "q").join(recall, "q").withColumnRenamed("q", "symbol")


@query("top_12_batched_scan", **PAIR)
def batched(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Composite lower bounds of every twentieth window against all windows, in one scan of the store."""
    store = S.representations(positions(X.benchmark_on(bars, bench)), S.Request("Brand#1"))
    asked = store.where("pmod(pos - 62, 100) = 0 and symbol like 'Brand#1%'").select("episode_id", *S.PARTS).collect()
    queries = {r["episode_id"]: {p: np.array([r[p]], float) for p in S.PARTS} for r in asked}
    near = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "episode_id"))
    return S.scored_many(store, queries, exact=False).where("episode_id != query_id").withColumn("rank", near).where("rank <= 20").select("query_id", "rank", "episode_id", "symbol", "pos", "distance")
