"""Queries on distances, scans, fusion and exact search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import features as X
from recurra.functions import kernels as K
from recurra.operators import search as S
from recurra.plans.features import W, rnd, rounded
from recurra.plans.outcomes import FEATS_SQL, _feats
from recurra.plans.registry import query
from recurra.sources import stores
from recurra.sources.bars import positions
from recurra.streaming.bars import folder_of

PAIR = dict(bars="brand_week", bench="market_week")
REQUEST = S.Request("Brand#1")


def _bars(bars: DataFrame, bench: DataFrame) -> DataFrame:
    return positions(X.benchmark_on(bars, bench))


SCAN_SQL = f"""p AS (SELECT symbol, ts, close, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    q AS (SELECT ts, ln(close) - ln(first_value(close) OVER (ORDER BY pos)) AS y, pos - n + 63 AS step, pos FROM p WHERE symbol = 'Brand#1' AND pos >= n - 63),
    e AS (SELECT symbol, ts AS cutoff, pos AS last_pos FROM p WHERE pos >= 62 AND (pos - 62) % 5 = 0 AND ts <= (SELECT ts FROM q WHERE step = 42) AND (symbol <> 'Brand#1' OR pos < (SELECT min(pos) FROM q))),
    x AS (SELECT e.symbol, cutoff, last_pos, p.pos - last_pos + 62 AS step, ln(close) AS c FROM e JOIN p ON e.symbol = p.symbol AND p.pos BETWEEN last_pos - 62 AND last_pos),
    d AS (SELECT symbol, cutoff, last_pos AS pos, 0.65 * (1 - coalesce(corr(c - c0, y), -1)) + 0.35 * sqrt(avg((c - c0 - y) * (c - c0 - y))) AS price_shape
          FROM (SELECT *, first_value(c) OVER (PARTITION BY symbol, cutoff ORDER BY step) AS c0 FROM x) JOIN q USING (step) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price_shape, cutoff) AS local_rank FROM d)"""


@query("dst_20_price_shape_scan", SCAN_SQL + " SELECT symbol, cutoff, pos, round(price_shape, 6) AS price_shape FROM d", **PAIR)
def scan(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(S.scan(_bars(bars, bench), REQUEST), "symbol", "cutoff", "pos")


@query("top_1_local_top", SCAN_SQL + " SELECT symbol, cutoff, local_rank, round(price_shape, 6) AS price_shape FROM r WHERE local_rank <= 5", **PAIR)
def local_top(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(S.local_top(S.scan(_bars(bars, bench), REQUEST), "price_shape", 5).select("symbol", "cutoff", "local_rank", "price_shape"), "symbol", "cutoff")


@query("top_3_universe_scan", SCAN_SQL + " SELECT symbol, cutoff, round(price_shape, 6) AS price_shape FROM r WHERE local_rank <= 5 ORDER BY r.price_shape, symbol, cutoff LIMIT 20", **PAIR)
def universe(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = S.local_top(S.scan(_bars(bars, bench), REQUEST), "price_shape", REQUEST.local)
    return S.global_top(rows, "price_shape", REQUEST.top_k).select("symbol", "cutoff", F.round("price_shape", 6).alias("price_shape"))


@query("dst_17_seven_views", **PAIR)
def views(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return S.scan(_bars(bars, bench), REQUEST, K.VIEWS)


def _view_store(spark: SparkSession, bars: DataFrame, bench: DataFrame, request: S.Request) -> tuple[DataFrame, np.ndarray, Column]:
    """Signatures written in shards of a lookback, the query's own, and which windows it may be shown."""
    rows, at = _bars(bars, bench), folder_of(spark, "signatures")
    window = S.query_window(rows, request)
    stores.write_partitions(S.signatures(rows, request), at, ["lookback"])
    eligible = (F.col("cutoff") <= F.lit(window["ts"].iloc[-request.gap - 1])) & ((F.col("symbol") != request.symbol) | (F.col("pos") < int(window["pos"].iloc[0])))
    return spark.read.parquet(at), S.query_signature(rows, request), eligible


@query("dst_18_signature_views", **PAIR)
def signature_views(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    store, asked, eligible = _view_store(spark, bars, bench, REQUEST)
    return S.signature_scan(store.where(eligible), asked)


@query("top_17_multiview_search", **PAIR)
def multiview(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Over the persisted signatures: bars are read for the query's own window only."""
    store, asked, eligible = _view_store(spark, bars, bench, REQUEST)
    return S.store_search(store, asked, REQUEST, eligible, 175)


#: Three plain views for the SQL checks: distances of features to the query symbol's latest.
VIEW_SQL = FEATS_SQL + """, lq AS (SELECT ret_20, ret_63, vol_20 FROM b WHERE symbol = 'Brand#1' ORDER BY ts DESC LIMIT 1),
    vw AS (SELECT symbol, ts AS cutoff, symbol || '@' || strftime(ts, '%Y-%m-%d') AS episode_id, round(abs(b.ret_20 - lq.ret_20), 9) AS a, round(abs(b.ret_63 - lq.ret_63), 9) AS c, round(abs(b.vol_20 - lq.vol_20), 9) AS e FROM b, lq WHERE symbol <> 'Brand#1'),
    un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a, cutoff) AS ra, row_number() OVER (PARTITION BY symbol ORDER BY c, cutoff) AS rc, row_number() OVER (PARTITION BY symbol ORDER BY e, cutoff) AS re FROM vw) WHERE least(ra, rc, re) <= 5)"""
VIEWS = ("a", "c", "e")


def _views(bars: DataFrame) -> DataFrame:
    f = _feats(bars)
    q = f.where("symbol = 'Brand#1'").orderBy(F.col("ts").desc()).limit(1).select(*[F.col(c).alias(f"q_{c}") for c in ("ret_20", "ret_63", "vol_20")])
    d = [F.round(F.abs(F.col(c) - F.col(f"q_{c}")), 9).alias(v) for c, v in zip(("ret_20", "ret_63", "vol_20"), VIEWS)]
    rows = f.where("symbol != 'Brand#1'").crossJoin(F.broadcast(q))  # one row
    return rows.select("symbol", F.col("ts").alias("cutoff"), F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd")).alias("episode_id"), *d)


@query("top_2_union_of_views", VIEW_SQL + " SELECT symbol, cutoff, episode_id, a, c, e FROM un", bars="brand_week")
def union_of_views(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return S.union_of_views(_views(bars), VIEWS, 5)


@query(
    "top_4_reciprocal_rank_fusion",
    VIEW_SQL + """, rk AS (SELECT *, row_number() OVER (ORDER BY a, episode_id) AS rank_a, row_number() OVER (ORDER BY c, episode_id) AS rank_c, row_number() OVER (ORDER BY e, episode_id) AS rank_e FROM un),
    fs AS (SELECT *, round(1.0::DOUBLE / (60 + rank_a) + 1.0::DOUBLE / (60 + rank_c) + 1.0::DOUBLE / (60 + rank_e), 12) AS fusion_score, least(rank_a, rank_c, rank_e) <= 1 AS forced FROM rk),
    fr AS (SELECT *, row_number() OVER (ORDER BY fusion_score DESC, episode_id) AS fusion_rank, row_number() OVER (ORDER BY forced DESC, fusion_score DESC, episode_id) AS pool_rank FROM fs)
    SELECT episode_id, rank_a, rank_c, rank_e, round(fusion_score, 9) AS fusion_score, forced, fusion_rank, pool_rank FROM fr WHERE pool_rank <= 60""",
    bars="brand_week",
)
def rrf(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    out = S.fused(S.union_of_views(_views(bars), VIEWS, 5), VIEWS, 60)
    return out.select("episode_id", *[f"rank_{v}" for v in VIEWS], F.round("fusion_score", 9).alias("fusion_score"), "forced", "fusion_rank", "pool_rank")


@query(
    "top_5_exact_vector_index",
    """SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance
       FROM embeddings AS q JOIN embeddings AS e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""",
)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return S.nearest_vectors(e, e.where("vec_id % 20 = 0"), 10).withColumn("distance", F.round("distance", 6))


@query(
    "top_6_recall_ndcg",
    VIEW_SQL + """, t AS (SELECT symbol AS query_id, cutoff, row_number() OVER (PARTITION BY symbol ORDER BY a, cutoff) AS rt, row_number() OVER (PARTITION BY symbol ORDER BY c, cutoff) AS rank, 1 / (1 + a) AS gain FROM vw),
    rc AS (SELECT query_id, count(*) FILTER (rank <= 10) / 10.0::DOUBLE AS recall FROM t WHERE rt <= 10 GROUP BY query_id),
    nd AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN gain / log2(ideal + 1) ELSE 0 END) AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS ideal FROM t) GROUP BY query_id)
    SELECT query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM rc JOIN nd USING (query_id)""",
    bars="brand_week",
)
def recall(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    v = _views(bars).withColumnRenamed("symbol", "query_id").withColumns({"rt": F.row_number().over(w.orderBy("a", "cutoff")), "rank": F.row_number().over(w.orderBy("c", "cutoff")), "gain": 1 / (1 + F.col("a"))})
    out = S.recall(v.where("rank <= 10"), v.where("rt <= 10"), ["query_id", "cutoff"]).join(S.ndcg(v, 10), "query_id")
    return rounded(out, "query_id")


@query(
    "top_11_route_quotas",
    VIEW_SQL + """, rt AS ((SELECT episode_id, 'a' AS route FROM vw ORDER BY a, episode_id LIMIT 100) UNION ALL (SELECT episode_id, 'c' FROM vw ORDER BY c, episode_id LIMIT 64) UNION ALL (SELECT episode_id, 'e' FROM vw ORDER BY e, episode_id LIMIT 64))
    SELECT episode_id, string_agg(route, ',' ORDER BY route) AS routes FROM rt GROUP BY episode_id""",
    bars="brand_week",
)
def quotas(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return S.quotas(_views(bars), {"a": 100, "c": 64, "e": 64})


@query(
    "top_13_threshold_band",
    VIEW_SQL + ", re AS (SELECT * FROM vw WHERE symbol <> 'Brand#2') SELECT episode_id, a, (SELECT min(a) FROM re WHERE a > 0.05) AS next_bound FROM re WHERE a > 0.01 AND a <= 0.05",
    bars="brand_week",
)
def threshold_band(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    v = _views(bars)
    return S.band(v, "a", 0.01, 0.05, v.where("symbol = 'Brand#2'").select("episode_id"))


QUERY_SQL = FEATS_SQL + """, ep AS (SELECT symbol, ts AS cutoff, symbol || '@' || strftime(ts, '%Y-%m-%d') AS episode_id, ret_20, ret_63, vol_20 FROM b), nu AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS id FROM b),
    qs AS (SELECT symbol || '/' || strftime(ts, '%Y-%m-%d') AS query_id, symbol AS q_symbol, ts AS q_cutoff, ret_20 AS q_ret_20, ret_63 AS q_ret_63, vol_20 AS q_vol_20 FROM nu WHERE id % 20 = 0),
    pp AS (SELECT * FROM ep JOIN qs ON cutoff < q_cutoff AND symbol <> q_symbol)"""


def _queries(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    f = _feats(bars)
    name = lambda sep: F.concat_ws(sep, "symbol", F.date_format("ts", "yyyy-MM-dd"))
    episodes = f.select("symbol", F.col("ts").alias("cutoff"), name("@").alias("episode_id"), "ret_20", "ret_63", "vol_20")
    order = Window.partitionBy(F.lit(0)).orderBy("ts", "symbol")  # a row for each session of each symbol, to number the queries: every twentieth
    asked = f.withColumn("id", F.row_number().over(order) - 1).where("id % 20 = 0")
    return asked.select(name("/").alias("query_id"), F.col("symbol").alias("q_symbol"), F.col("ts").alias("q_cutoff"), *[F.col(c).alias(f"q_{c}") for c in ("ret_20", "ret_63", "vol_20")]), episodes


@query(
    "top_18_random_neighbours",
    QUERY_SQL + """, h AS (SELECT *, sha256('s1|' || query_id || '|' || symbol) AS hs, row_number() OVER (PARTITION BY query_id, symbol ORDER BY sha256('s1|' || query_id || '|' || episode_id)) AS k FROM pp),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hs, symbol) AS rank FROM h WHERE k = 1) SELECT query_id, rank, episode_id, symbol FROM o WHERE rank <= 20""",
    bars="brand_week",
)
def random_neighbours(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    return S.random_neighbours(q, e, "s1", 20)


RANK_SQL = QUERY_SQL + ", rn AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY query_id ORDER BY {f}, episode_id) AS r_{f}, count(*) FILTER ({f} < q_{f}) OVER (PARTITION BY query_id) + 1 AS k_{f}" for f in ("ret_20", "ret_63", "vol_20")) + """, count(*) OVER (PARTITION BY query_id) AS n FROM pp),
    sc AS (SELECT *, round((abs(r_ret_20 - k_ret_20) + abs(r_ret_63 - k_ret_63) + abs(r_vol_20 - k_vol_20)) / n::DOUBLE, 12) AS score FROM rn), f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, symbol ORDER BY score, episode_id) AS k1 FROM sc),
    nb AS (SELECT query_id, episode_id, symbol, score, row_number() OVER (PARTITION BY query_id ORDER BY score, episode_id) AS rank FROM f1 WHERE k1 = 1)"""


@query("top_19_rank_neighbours", RANK_SQL + " SELECT query_id, rank, episode_id, symbol, round(score, 9) AS score FROM nb WHERE rank <= 20", bars="brand_week")
def rank_neighbours(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    pairs = e.join(F.broadcast(q), F.col("cutoff") < F.col("q_cutoff")).where("symbol != q_symbol")
    return S.rank_neighbours(pairs, ["ret_20", "ret_63", "vol_20"], 20).withColumn("score", F.round("score", 9))


@query("top_20_prefix_without_query", RANK_SQL + ", k AS (SELECT query_id, episode_id, symbol, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM nb WHERE rank <= 11 AND symbol <> 'Brand#3') SELECT * FROM k WHERE rank <= 10", bars="brand_week")
def prefix(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """The first k of a proven k + 1 after one symbol is taken out."""
    nb = rank_neighbours(spark, sf_dir, bars).where("rank <= 11 and symbol != 'Brand#3'")
    return nb.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10").select("query_id", "episode_id", "symbol", "rank")


@query("joi_4_eligibility", QUERY_SQL + ", n AS (SELECT query_id, count(*) AS candidates FROM qs JOIN ep ON cutoff < q_cutoff AND cutoff <= q_cutoff - INTERVAL 140 DAY AND (symbol <> q_symbol OR datediff('day', cutoff, q_cutoff) >= 441) GROUP BY query_id) SELECT * FROM n", bars="brand_week")
def eligibility(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    queries = q.select("query_id", "q_symbol", "q_cutoff", (F.col("q_cutoff") - F.expr("interval 140 days")).alias("latest"), F.lit(0).alias("q_pos"))
    day = F.datediff("cutoff", F.lit("1990-01-01"))
    queries = queries.withColumn("q_pos", F.datediff("q_cutoff", F.lit("1990-01-01")))
    rows = e.select("symbol", "cutoff", "episode_id", day.alias("pos"), F.lit(441).alias("lookback"), F.lit("A").alias("tier"))
    return S.eligible_pairs(queries, rows).groupBy("query_id").agg(F.count("*").alias("candidates"))


@query("joi_5_overlaps", QUERY_SQL + ", p5 AS (SELECT query_id, count(*) AS overlaps FROM qs JOIN ep ON symbol = q_symbol AND cutoff - INTERVAL 62 WEEK <= q_cutoff AND q_cutoff - INTERVAL 62 WEEK <= cutoff GROUP BY query_id) SELECT * FROM p5", bars="brand_week")
def overlaps(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    span = F.expr("interval 434 days")
    touch = (F.col("symbol") == F.col("q_symbol")) & (F.col("cutoff") - span <= F.col("q_cutoff")) & (F.col("q_cutoff") - span <= F.col("cutoff"))
    return e.join(F.broadcast(q), touch).groupBy("query_id").agg(F.count("*").alias("overlaps"))


def _store(bars: DataFrame, bench: DataFrame, request: S.Request = REQUEST) -> tuple[DataFrame, DataFrame, dict, F.Column]:
    rows = _bars(bars, bench)
    window = S.query_window(rows, request)
    latest, first = window["ts"].iloc[-request.gap - 1], int(window["pos"].iloc[0])
    eligible = (F.col("cutoff") <= F.lit(latest)) & ((F.col("symbol") != request.symbol) | (F.col("pos") < first))
    return rows, S.representations(rows, request), S.query_representation(rows, request), eligible


@query("chn_19_representations", **PAIR)
def representations(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return S.representations(_bars(bars, bench), REQUEST).select("episode_id", "symbol", "cutoff", "pos", *S.PARTS)


@query("top_7_score_all", **PAIR)
def score_all(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    _, store, q, eligible = _store(bars, bench)
    return S.scored(store.where(eligible), q, exact=True)


@query("top_8_greedy_selection", **PAIR)
def greedy(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    _, store, q, eligible = _store(bars, bench)
    return S.greedy_by_query(S.scored(store.where(eligible), q, exact=True).withColumn("query_id", F.lit("Brand#1")), REQUEST.top_k, REQUEST.per_symbol, REQUEST.lookback)


@query("top_9_10_14_certified_search", **PAIR)
def certified(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    _, store, q, eligible = _store(bars, bench)
    kept = folder_of(spark, "view-store")
    store.write.parquet(kept)
    chosen, proof = S.exact_search(spark.read.parquet(kept), q, REQUEST, eligible)
    rows = [(i + 1, r[1], r[2], r[3], float(r[0]), proof.candidates, proof.measured, proof.complete) for i, r in enumerate(chosen)]
    return spark.createDataFrame(rows, "rank int, episode_id string, symbol string, pos int, distance double, candidates long, measured long, complete boolean")


@query("top_15_16_component_search", **PAIR)
def component(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The nearest windows by the price component alone, one of each symbol, in stages: rigid bounds, envelopes, warping."""
    request = S.Request("Brand#1", per_symbol=1)
    _, store, q, eligible = _store(bars, bench, request)
    kept = folder_of(spark, "component-store")
    store.write.parquet(kept)
    chosen, proof = S.exact_search(spark.read.parquet(kept), q, request, eligible, weights=S.PRICE)
    rows = [(i + 1, r[1], r[2], r[3], float(r[0]), proof.candidates, proof.measured, proof.complete) for i, r in enumerate(chosen)]
    return spark.createDataFrame(rows, "rank int, episode_id string, symbol string, pos int, distance double, candidates long, measured long, complete boolean")
