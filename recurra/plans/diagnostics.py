"""Queries on search evidence, neighbour predictions, diagnostics, flat vectors, layouts and joined streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import features as X
from recurra.functions import kernels as K
from recurra.functions.rolling import by
from recurra.operators import clustering, diagnostics, outcomes
from recurra.operators import search as S
from recurra.plans.features import EPISODES_SQL, W, episode_rows, rnd, roll, rounded
from recurra.plans.forecasts import LINK_SQL, PROB_SQL, _links, _scored
from recurra.plans.outcomes import OUT1, PAIR
from recurra.plans.registry import query
from recurra.plans.search import RANK_SQL, REQUEST, _bars, _queries, rank_neighbours
from recurra.plans.studies import PATHS_SQL, _future
from recurra.sources import bars as B
from recurra.sources import stores
from recurra.sources.bars import positions
from recurra.streaming import bars as stream


@query("src_1_directory_scan", "SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CAST(round(close * 1000000) AS BIGINT)) AS BIGINT) AS close_sum, 'dir' AS dataset_id FROM bars WHERE symbol <> 'Brand#3' GROUP BY symbol", bars="brand_week")
def directory_scan(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """One file for each symbol, named by it; one of them is the benchmark and is left out."""
    root = stream.folder_of(spark, "directory")
    stores.write_directory(bars.withColumnRenamed("ts", "date"), root, "symbol")
    rows = B.read(spark, B.DatasetSpec("dir", root, "directory", "parquet", benchmark="Brand#3"))
    return rows.groupBy("symbol", "dataset_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.round(F.col("close") * 1e6).cast("long")).alias("close_sum"))


@query(
    "fea_2_flat_bar_features",
    f"""a AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, (high - low) / close AS rng, CASE WHEN high > low THEN (close - low) / (high - low) END AS loc FROM bars)
    SELECT * FROM (SELECT symbol, ts, pos, {rnd(range_contraction_10_63='(' + roll('avg', 'rng', 10) + ') / nullif(' + roll('avg', 'rng', 63) + ', 0)', close_location_20=roll('avg', 'loc', 20, 5))} FROM a) WHERE pos >= 252""",
    bars="type_day",
)
def flat_bars(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(X.flat_bar_features(positions(bars)).where("pos >= 252"), "symbol", "ts")


QUERY_PATH_SQL = EPISODES_SQL + """, ec AS (SELECT episode, step, path FROM a), fq AS (SELECT max(episode) AS q FROM ec), qp AS (SELECT step, path AS y FROM ec, fq WHERE episode = q)"""


def _paths_of_episodes(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """episode, path (63 values) and the path q of the last episode by name."""
    paths = X.dense_channels(episode_rows(bars, bench)).groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "close_path"))), lambda x: x["close_path"]).alias("path"))
    last = paths.orderBy(F.col("episode").desc()).limit(1).select(F.col("path").alias("q"))
    return paths.crossJoin(F.broadcast(last))  # one row


@query("dst_12_joined_iqr", QUERY_PATH_SQL + ", u AS (SELECT episode, path AS v FROM ec UNION ALL SELECT e.episode, y FROM (SELECT DISTINCT episode FROM ec) AS e, qp) SELECT episode, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM u GROUP BY episode", **PAIR)
def joined_iqr(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(_paths_of_episodes(bars, bench).select("episode", diagnostics.joined_iqr(F.col("path"), F.col("q")).alias("iqr")), "episode")


@query("dst_22_comparison_baselines", QUERY_PATH_SQL + " SELECT episode, round(sqrt(sum((path - y) * (path - y))), 6) + 0.0::DOUBLE AS euclidean, round(1 - corr(path, y), 6) + 0.0::DOUBLE AS correlation FROM ec JOIN qp USING (step) GROUP BY episode", **PAIR)
def baselines(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    pairs = _paths_of_episodes(bars, bench).select("episode", F.explode(F.arrays_zip("path", "q")).alias("x")).select("episode", "x.path", "x.q")
    d = F.col("path") - F.col("q")
    return rounded(pairs.groupBy("episode").agg(F.sqrt(F.sum(d * d)).alias("euclidean"), (1 - F.corr("path", "q") + 0.0).alias("correlation")), "episode")


EVIDENCE_SQL = RANK_SQL + f""", f9 AS (SELECT symbol, ts, {OUT1}, """ + ", ".join(f"CASE WHEN count(close) OVER a{h} = {h} THEN lead(ts, {h}) OVER w END AS t{h}" for h in (5, 10, 20, 60)) + f" FROM bars WINDOW w AS ({W}), " + ", ".join(f"a{h} AS ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (5, 10, 20, 60)) + "), o9 AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts AS cutoff, {h} AS horizon, t{h} AS completion, r{h} AS close_return, u{h} AS mfe, d{h} AS mae, CASE WHEN r{h} >= 0.02 THEN 'favorable_first' WHEN r{h} <= -0.02 THEN 'adverse_first' WHEN r{h} IS NOT NULL THEN 'no_touch' END AS label FROM f9" for h in (5, 10, 20, 60)
) + """), ev9 AS (SELECT nb.query_id, nb.rank, nb.symbol, o9.cutoff, horizon, completion, close_return, mfe, mae, label, completion IS NOT NULL AS complete,
        CASE WHEN completion IS NULL THEN 'incomplete_outcome' WHEN completion > q_cutoff THEN 'outcome_not_yet_observable' ELSE 'eligible' END AS reason
    FROM nb JOIN qs USING (query_id) JOIN o9 ON o9.symbol = nb.symbol AND o9.cutoff = CAST(split_part(nb.episode_id, '@', 2) AS TIMESTAMP) WHERE nb.rank <= 20)"""


def _evidence(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    nb = rank_neighbours(spark, sf_dir, bars).select("query_id", "rank", "symbol", F.element_at(F.split("episode_id", "@"), 2).cast("timestamp").alias("cutoff"))
    horizons = (5, 10, 20, 60)
    ends = bars.select("symbol", F.col("ts").alias("cutoff"), *[F.lead("ts", h).over(by()).alias(f"t{h}") for h in horizons])
    ends = ends.select("symbol", "cutoff", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"t{h}").alias("completion")) for h in horizons])).alias("e")).select("symbol", "cutoff", "e.*")
    r = F.col("close_return")
    label = F.when(r >= 0.02, "favorable_first").when(r <= -0.02, "adverse_first").when(r.isNotNull(), "no_touch")
    done = outcomes.forward(bars, horizons).drop("censored").join(ends, ["symbol", "cutoff", "horizon"]).withColumn("label", label)
    q, _ = _queries(bars)
    return diagnostics.search_evidence(nb, done, q.select("query_id", "q_cutoff"))


@query("out_9_search_evidence_rows", EVIDENCE_SQL + " SELECT query_id, rank, symbol, cutoff, horizon, completion, complete, reason, label, " + rnd(close_return="close_return", mfe="mfe", mae="mae") + " FROM ev9", bars="brand_week")
def evidence_rows(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(_evidence(spark, sf_dir, bars), "query_id", "rank", "horizon")


@query(
    "out_9_search_evidence_summary",
    EVIDENCE_SQL + """ SELECT query_id, horizon, count(*) AS retrieved, count(*) FILTER (complete) AS complete, count(*) FILTER (reason = 'eligible') AS eligible, count(*) FILTER (reason = 'outcome_not_yet_observable') AS not_yet_observable, """
    + ", ".join(f"round({e} FILTER (reason = 'eligible'), 6) + 0.0::DOUBLE AS {k}" for k, e in dict(
        median_return="quantile_cont(close_return, 0.5)", return_q25="quantile_cont(close_return, 0.25)", return_q75="quantile_cont(close_return, 0.75)", positive_rate="avg((close_return > 0)::INT)", gain_25pct_rate="avg((close_return >= 0.25)::INT)",
        median_mfe="quantile_cont(mfe, 0.5)", median_mae="quantile_cont(mae, 0.5)", favorable_first_rate="avg((label = 'favorable_first')::INT)", adverse_first_rate="avg((label = 'adverse_first')::INT)",
    ).items()) + ", count(*) FILTER (reason = 'eligible') >= 5 AS enough FROM ev9 GROUP BY ALL",
    bars="brand_week",
)
def evidence_summary(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(diagnostics.evidence_summary(_evidence(spark, sf_dir, bars)), "query_id", "horizon")


LANE_SQL = LINK_SQL + """, rt AS (SELECT query_id, match_rank, close_return, CASE WHEN close_return IS NULL THEN NULL WHEN NOT eligible THEN 'censored' WHEN close_return >= 0.02 THEN 'favorable_first' WHEN close_return <= -0.02 THEN 'adverse_first' ELSE 'no_touch' END AS route FROM lk),
    la AS (SELECT rt.*, prefix, weighted, CASE WHEN weighted THEN pow(2.0::DOUBLE, -(match_rank - 1) / 10.0::DOUBLE) ELSE 1.0 END AS w FROM rt, (VALUES (5), (10), (20)) AS p(prefix), (VALUES (true), (false)) AS x(weighted) WHERE match_rank <= prefix)"""


def _routes(bars: DataFrame) -> DataFrame:
    r = F.col("close_return")
    route = F.when(r.isNull(), None).when(~F.col("eligible"), "censored").when(r >= 0.02, "favorable_first").when(r <= -0.02, "adverse_first").otherwise("no_touch")
    return _links(bars).select("query_id", "match_rank", "close_return", route.alias("route"))


MASS = "coalesce(sum(w) FILTER (route = '{0}'), 0)"
THREE = "coalesce(sum(w) FILTER (route IN ('favorable_first', 'adverse_first', 'no_touch')), 0)"


@query(
    "agg_7_route_predictions",
    LANE_SQL + " SELECT query_id, prefix, weighted, count(*) FILTER (route IN ('favorable_first', 'adverse_first', 'no_touch')) AS eligible, "
    + rnd(
        ess=f"coalesce({THREE} * {THREE} / nullif(sum(w * w) FILTER (route IN ('favorable_first', 'adverse_first', 'no_touch')), 0), 0)", **{f"p_{c}": f"({MASS.format(c)} + 0.5) / ({THREE} + 1.5)" for c in diagnostics.CLASSES},
        d_favorable_first=f"({MASS.format('favorable_first')} + 0.5) / ({MASS.format('favorable_first')} + {MASS.format('adverse_first')} + 1)",
    )
    + ", " + ", ".join(f"count(*) FILTER (route = '{c}') AS {k}" for k, c in dict(n_favorable="favorable_first", n_adverse="adverse_first", n_no_touch="no_touch", n_ambiguous="ambiguous_same_first_touch_bar", n_censored="censored").items())
    + ", count(*) FILTER (route IS NULL) AS n_unavailable FROM la GROUP BY ALL",
    bars="brand_week",
)
def route_predictions(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(diagnostics.route_predictions(_routes(bars)), "query_id", "prefix", "weighted")


@query(
    "agg_7_continuous_predictions",
    LANE_SQL + """, cq AS (SELECT *, sum(w) OVER (PARTITION BY query_id, prefix, weighted ORDER BY close_return RANGE UNBOUNDED PRECEDING) AS sofar, sum(w) OVER (PARTITION BY query_id, prefix, weighted) AS total FROM la WHERE close_return IS NOT NULL),
    qq AS (SELECT query_id, prefix, weighted, min(close_return) FILTER (sofar >= 0.1 * total - 1e-12) AS q10, min(close_return) FILTER (sofar >= 0.5 * total - 1e-12) AS q50, min(close_return) FILTER (sofar >= 0.9 * total - 1e-12) AS q90 FROM cq GROUP BY ALL),
    nn AS (SELECT query_id, prefix, weighted, count(close_return) AS n FROM la GROUP BY ALL) SELECT query_id, prefix, weighted, n, """ + rnd(q10="q10", q50="q50", q90="q90") + " FROM nn LEFT JOIN qq USING (query_id, prefix, weighted)",
    bars="brand_week",
)
def continuous_predictions(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(diagnostics.continuous_predictions(_routes(bars), "close_return"), "query_id", "prefix", "weighted")


SEGMENT_SQL = PROB_SQL + """, sg AS (SELECT *, CAST(year(cutoff) AS INT) AS fold, symbol || '/' || strftime(cutoff, '%Y-%m-%d') AS key FROM sl), qn AS (SELECT *, 'Q' || least(5, CAST(ceil(row_number() OVER (PARTITION BY fold ORDER BY round(p_no_touch, 9), key) / count(*) OVER (PARTITION BY fold) * 5) AS INT)) AS quintile FROM sg)"""


def _folded(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _scored(spark, sf_dir, bars, bench)
    return rows.withColumns({"fold": F.year("cutoff"), "key": F.concat_ws("/", "symbol", F.date_format("cutoff", "yyyy-MM-dd")), "risk": F.round("p_no_touch", 9)})


@query("evt_10_quintile_segments", SEGMENT_SQL + " SELECT fold, quintile AS value, count(*) AS n, " + rnd(loss="avg(brier)", reference="avg(reference)", improved="avg((brier < reference)::INT)", difference="avg(brier) - avg(reference)", skill="1 - avg(brier) / nullif(avg(reference), 0)") + " FROM qn GROUP BY ALL", **PAIR)
def quintile_segments(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _folded(spark, sf_dir, bars, bench)
    return rounded(diagnostics.segments(rows.withColumn("quintile", diagnostics.quintiles(rows, ["fold"], "risk", "key")), "fold", "quintile", "brier", "reference"), "fold", "value")


@query(
    "evt_10_probability_behavior",
    SEGMENT_SQL + ", lo AS (" + " UNION ALL ".join(f"SELECT fold, '{c}' AS class, round(p_{c}, 9) AS p, (label = '{c}')::INT AS hit FROM sg" for c in diagnostics.CLASSES) + """),
    rk2 AS (SELECT *, rank() OVER (PARTITION BY fold, class ORDER BY p) + (count(*) OVER (PARTITION BY fold, class, p) - 1) / 2.0::DOUBLE AS rank FROM lo)
    SELECT fold, class, count(*) AS n, """ + rnd(frequency="avg(hit)", mean_p="avg(p)", brier_part="avg((p - hit) * (p - hit))", deviation="stddev_pop(p)", auc="(sum(rank * hit) - sum(hit) * (sum(hit) + 1) / 2.0) / nullif(sum(hit) * (count(*) - sum(hit)), 0)", bias="avg(p) - avg(hit)") + " FROM rk2 GROUP BY ALL",
    **PAIR,
)
def probability_behavior(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _folded(spark, sf_dir, bars, bench).withColumns({f"p_{c}": F.round(f"p_{c}", 9) for c in diagnostics.CLASSES})
    return rounded(diagnostics.probability_behavior(rows, "fold", "label"), "fold", "class")


@query("agg_17_cohesion", PATHS_SQL + ", pd AS (SELECT x.query_id, x.member AS a, y.member AS b, avg(abs(x.r - y.r)) AS distance FROM pt AS x JOIN pt AS y ON x.query_id = y.query_id AND x.step = y.step AND x.member < y.member GROUP BY ALL) SELECT query_id, round(avg(distance), 6) AS cohesion, count(*) AS pairs FROM pd GROUP BY query_id", bars="brand_week")
def cohesion(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(diagnostics.cohesion(clustering.pairwise_l1(_future(bars), "query_id", "member"), "query_id", "distance"), "query_id")


@query("agg_17_specificity", RANK_SQL + ", sp9 AS (SELECT symbol, (rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY query_id) AS pct FROM nb WHERE rank <= 20) SELECT symbol, round(avg(pct), 6) AS specificity, count(*) AS queries FROM sp9 GROUP BY symbol", bars="brand_week")
def specificity(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = S.rank_neighbours(_pairs(bars), ["ret_20", "ret_63", "vol_20"], 20)
    return rounded(diagnostics.specificity(rows, "query_id", "symbol", "score"), "symbol")


def _pairs(bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    return e.join(F.broadcast(q), F.col("cutoff") < F.col("q_cutoff")).where("symbol != q_symbol")  # a stated query set


@query("top_21_null_selections", **PAIR)
def null_selections(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The diversified selection under random distances: windows in the order of a hash, for each of 20 replicates."""
    rows = _bars(bars, bench).where(f"pos >= {REQUEST.lookback - 1} and pmod(pos - {REQUEST.lookback - 1}, {REQUEST.stride}) = 0")
    rows = rows.select("symbol", F.col("ts").alias("cutoff"), "pos", F.concat_ws("@", "symbol", "pos").alias("episode_id"))
    return S.null_selections(rows, 20, "n1", REQUEST.top_k, REQUEST.per_symbol, REQUEST.lookback)


@query("chn_20_flat_vectors", **PAIR)
def flat_vectors(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Representations as one vector each, with the presence of their parts, and back: the largest difference."""
    store = S.representations(_bars(bars, bench), REQUEST)
    back = S.unflattened(S.flattened(store)).select("episode_id", *[F.col(p).alias(f"back_{p}") for p in S.PARTS])
    same = lambda p: F.coalesce(F.array_max(F.zip_with(p, f"back_{p}", lambda a, b: F.when(F.isnan(a) & F.isnan(b), 0.0).otherwise(F.abs(a - b)))), F.lit(0.0))
    n = sum((F.size(p) for p in S.PARTS), F.lit(0))
    return store.join(back, "episode_id").select("episode_id", n.alias("n"), F.greatest(*[same(p) for p in S.PARTS]).alias("difference"))


@query("sec_14_identity_projection", "SELECT CAST(0 AS BIGINT) AS changes, count(*) AS n FROM bars", bars="brand_week")
def identity(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Changed outcomes leave the columns that say what was matched as they were."""
    rows = outcomes.forward(bars, (20,))
    changed = outcomes.forward(bars.withColumn("close", F.col("close") * 2), (20,))
    return diagnostics.identity_changes(rows, changed, ["symbol", "cutoff", "horizon"]).agg(F.count("*").alias("changes")).crossJoin(rows.agg(F.count("*").alias("n")))  # one row each


@query(
    "str_3_predictions_meet_outcomes",
    "SELECT p.event_id AS prediction_id, o.event_id AS outcome_id, p.user_id, p.ts AS predicted, o.ts AS happened, round(p.value, 4) AS predicted_value, round(o.value, 4) AS value FROM events AS p JOIN events AS o ON p.user_id = o.user_id AND p.event_type = 'view' AND o.event_type = 'purchase' AND o.ts > p.ts AND o.ts <= p.ts + INTERVAL 6 HOUR",
)
def predictions_meet_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream.event_stream(spark, sf_dir)
    out = stream.matured(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), "6 hours")
    return stream.drained(out, "append").withColumns({"predicted_value": F.round("predicted_value", 4), "value": F.round("value", 4)})


@query("str_4_incremental_returns", "SELECT symbol, ts, round(close / lag(close) OVER w - 1, 6) + 0.0::DOUBLE AS ret, round((SELECT count(*) FROM bars AS b WHERE b.symbol = a.symbol AND b.ts <= a.ts AND b.close <= a.close) / least(252, row_number() OVER w), 6) AS place FROM bars AS a WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY row_number() OVER w <= 200", bars="brand_week")
def incremental(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """The first 200 bars of each symbol as a stream: the state is the last 252 closes."""
    at = stream.folder_of(spark, "bar-stream")
    first = bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).where("n <= 200").select("symbol", "ts", "close")
    first.write.parquet(at)
    rows = spark.readStream.schema(first.schema).parquet(at)
    return rounded(stream.drained(stream.incremental_returns(rows), "append"), "symbol", "ts")
