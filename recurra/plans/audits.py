"""Queries on coverage, calibration, labels of neighbours, recall, losses on the way, ladders and stores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions.rolling import by
from recurra.operators import audits, comparison, quality, scoring
from recurra.operators import search as S
from recurra.plans.diagnostics import SEGMENT_SQL, _folded, _pairs
from recurra.plans.features import W, rnd, rounded
from recurra.plans.forecasts import LINK_SQL, _links, _scored
from recurra.plans.outcomes import FEATS_SQL, PAIR, _feats
from recurra.plans.registry import query
from recurra.plans.search import QUERY_SQL, RANK_SQL, VIEW_SQL, VIEWS, _queries, _store, _views, rank_neighbours
from recurra.plans.studies import PATHS_SQL, _future
from recurra.sources import bars as B
from recurra.sources import stores, synthetic
from recurra.sources.bars import positions
from recurra.streaming.bars import folder_of


@query(
    "sco_12_coverage_gate",
    LINK_SQL + """, cg AS (SELECT CAST(year(q_cutoff) AS INT) AS fold, count(*) AS registered, count(*) FILTER (eligible) AS evaluable, count(*) FILTER (eligible AND close_return IS NOT NULL) AS forecasted FROM lk GROUP BY ALL)
    SELECT fold, registered, evaluable, forecasted, round(evaluable / registered, 6) AS fraction, round(sum(evaluable) OVER () / sum(registered) OVER (), 6) AS overall,
        sum(forecasted) OVER () = sum(evaluable) OVER () AND count(*) OVER () >= 4 AND sum(evaluable) OVER () / sum(registered) OVER () >= 0.9 AND min(evaluable / registered) OVER () >= 0.9 AS passed FROM cg""",
    bars="brand_week",
)
def coverage(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _links(bars).select(F.year("q_cutoff").alias("fold"), "eligible", F.col("close_return").isNotNull().alias("known"))
    return rounded(audits.coverage_gate(rows, "fold", "eligible", "known"), "fold")


@query(
    "sco_12_monthly_residuals",
    SEGMENT_SQL + ", lo AS (" + " UNION ALL ".join(f"SELECT '{c}' AS class, date_trunc('month', cutoff)::TIMESTAMP AS month, p_{c} - (label = '{c}')::INT AS r FROM sg" for c in scoring.CLASSES) + ") SELECT class, month, round(avg(r), 6) + 0.0::DOUBLE AS residual FROM lo GROUP BY ALL",
    **PAIR,
)
def residuals(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(audits.monthly_residuals(_scored(spark, sf_dir, bars, bench), scoring.CLASSES), "class", "month")


def _gate(rows: DataFrame) -> list[dict]:
    months = audits.monthly_residuals(rows, scoring.CLASSES).orderBy("month").toPandas()  # a row for each class and month
    return audits.calibration_gate({c: months.loc[months["class"] == c, "residual"].to_numpy() for c in scoring.CLASSES})


@query("sco_12_calibration_gate", **PAIR)
def calibration(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return spark.createDataFrame(_gate(_scored(spark, sf_dir, bars, bench)), "class string, mean double, low double, high double, p double, adjusted double, rejected boolean")


@query("sco_12_decision", **PAIR)
def decision(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The symbols' probabilities against all symbols' frequencies and against thirds: each gate, and whether all pass."""
    rows = _folded(spark, sf_dir, bars, bench)
    total = rows.agg(*[F.avg((F.col("label") == c).cast("int")).alias(f"f_{c}") for c in scoring.CLASSES])
    rows = rows.crossJoin(F.broadcast(total))  # one row
    f = {c: F.col(f"f_{c}") for c in scoring.CLASSES}
    rows = rows.withColumns({
        "base": sum(((f[c] - (F.col("label") == c).cast("int")) ** 2 for c in scoring.CLASSES), F.lit(0.0)), "base_log": -F.log(F.coalesce(*[F.when(F.col("label") == c, f[c]) for c in scoring.CLASSES])),
        "third_log": F.lit(float(np.log(3))),
    })
    against = {"base_rate": ("base", "base_log"), "thirds": ("reference", "third_log")}
    means = [F.avg(c).alias(c) for c in ("brier", "log_loss", "base", "base_log", "reference", "third_log")]
    folds = rows.groupBy(F.col("fold").cast("string").alias("scope")).agg(*means).unionByName(rows.agg(F.lit("all").alias("scope"), *means)).collect()  # a row for each fold
    skills = {r["scope"]: {k: 1 - r["brier"] / r[b] if r[b] else 0.0 for k, (b, _) in against.items()} for r in folds}
    whole = next(r for r in folds if r["scope"] == "all")
    inference = {}
    for i, (k, (b, _)) in enumerate(against.items()):
        months = scoring.month_means(rows, "brier", b).orderBy("month").select("difference").toPandas()["difference"].to_numpy()  # a row for each month
        inference[k] = scoring.block_bootstrap(months, 6, 10_000, 20_260_911 + i)
    low, high = sorted(inference, key=lambda k: inference[k]["lower_p"])
    adjusted = {low: min(1.0, 2 * inference[low]["lower_p"])}
    adjusted[high] = max(adjusted[low], inference[high]["lower_p"])
    judged = dict.fromkeys(audits.JUDGED, True) | {"calibration": not any(r["rejected"] for r in _gate(rows))}
    gates = audits.improvement_gates(skills, {k: whole["log_loss"] - whole[x] for k, (_, x) in against.items()}, inference, adjusted, judged)
    return spark.createDataFrame([(k, v, all(gates.values())) for k, v in gates.items()], "gate string, passed boolean, decision boolean")


LABEL_SQL = RANK_SQL + f""", fo AS (SELECT symbol, ts, lead(close, 20) OVER ({W}) / close - 1 AS close_return FROM bars),
    lb AS (SELECT ep.symbol, ep.cutoff, ep.episode_id, CASE WHEN close_return > 0 THEN 'rise' ELSE 'fall' END AS label, row_number() OVER (PARTITION BY ep.symbol ORDER BY ep.cutoff) AS number FROM ep JOIN fo ON fo.symbol = ep.symbol AND fo.ts = ep.cutoff WHERE close_return IS NOT NULL),
    ql AS (SELECT query_id, q_symbol, q_cutoff, label AS q_label FROM qs JOIN lb ON lb.symbol = q_symbol AND lb.cutoff = q_cutoff),
    ag AS (SELECT query_id, q_label, max((rank = 1 AND label = q_label)::INT) AS top1, count(*) FILTER (label = q_label) AS same FROM (SELECT nb.query_id, nb.rank, ql.q_label, lb.label FROM nb JOIN ql USING (query_id) JOIN lb USING (episode_id) WHERE rank <= 10) GROUP BY ALL HAVING count(*) = 10),
    su AS (SELECT query_id, q_label, symbol, count(*) AS n, count(*) FILTER (label = q_label) AS same FROM ql JOIN lb ON cutoff < q_cutoff AND symbol <> q_symbol JOIN (SELECT query_id FROM ag) USING (query_id) GROUP BY ALL),
    dr AS (SELECT replicate, su.*, ('0x' || substr(sha256('p1|' || replicate || '|' || query_id || '|' || symbol), 1, 12))::BIGINT AS h, 1 + ('0x' || substr(sha256('p1|' || replicate || '|' || query_id || '|' || symbol || '|c'), 1, 12))::BIGINT % n AS number FROM su, range(99) AS r(replicate)),
    dk AS (SELECT *, row_number() OVER (PARTITION BY replicate, query_id ORDER BY h, symbol) AS rank FROM dr QUALIFY rank <= 10),
    nd AS (SELECT replicate, query_id, max((rank = 1 AND label = q_label)::INT) AS top1, count(*) FILTER (label = q_label) AS same FROM dk JOIN lb ON lb.symbol = dk.symbol AND lb.number = dk.number GROUP BY ALL),
    rt AS (SELECT replicate, sum(top1) AS top1, sum(same) AS same, count(*) AS queries FROM nd GROUP BY ALL)"""


def _labelled(bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled episodes, labelled queries' neighbours, and each query's candidates by symbol."""
    q, e = _queries(bars)
    ahead = bars.select("symbol", F.col("ts").alias("cutoff"), (F.lead("close", 20).over(by()) / F.col("close") - 1).alias("r")).where("r is not null")
    lb = e.select("symbol", "cutoff", "episode_id").join(ahead, ["symbol", "cutoff"]).withColumn("label", F.when(F.col("r") > 0, "rise").otherwise("fall")).drop("r")
    lb = lb.withColumn("number", F.row_number().over(Window.partitionBy("symbol").orderBy("cutoff")).cast("long"))
    ql = q.select("query_id", "q_symbol", "q_cutoff").join(lb.select(F.col("symbol").alias("q_symbol"), F.col("cutoff").alias("q_cutoff"), F.col("label").alias("q_label")), ["q_symbol", "q_cutoff"])
    near = S.rank_neighbours(_pairs(bars), ["ret_20", "ret_63", "vol_20"], 20)
    ag = audits.label_agreement(near.join(ql, "query_id").join(lb.select("episode_id", "label"), "episode_id"), 10)
    asked = ql.join(ag.select("query_id"), "query_id", "left_semi")
    su = lb.join(F.broadcast(asked), F.col("cutoff") < F.col("q_cutoff")).where("symbol != q_symbol")  # a stated query set
    return lb, ag, su.groupBy("query_id", "q_label", "symbol").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("q_label")).alias("same"))


@query("sec_5_label_agreement", LABEL_SQL + """, ex AS (SELECT query_id, avg(same / n) AS expected FROM su GROUP BY query_id)
    SELECT q_label, count(*) AS queries, """ + rnd(top1="avg(top1)", purity="avg(same / 10.0::DOUBLE)", expected="avg(expected)", share="count(*) / sum(count(*)) OVER ()") + " FROM ag JOIN ex USING (query_id) GROUP BY q_label", bars="brand_week")
def agreement(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Per label: how often the first neighbour has it, the share of ten, what candidates' frequencies would give, and the label's share."""
    _, ag, su = _labelled(bars)
    expected = su.groupBy("query_id").agg(F.avg(F.col("same") / F.col("n")).alias("expected"))
    out = ag.join(expected, "query_id").groupBy("q_label").agg(F.count("*").alias("queries"), F.avg("top1").alias("top1"), F.avg(F.col("same") / 10).alias("purity"), F.avg("expected").alias("expected"))
    return rounded(out.withColumn("share", F.col("queries") / F.sum("queries").over(Window.partitionBy(F.lit(0)))), "q_label")  # a row for each label


def _draws(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    lb, ag, su = _labelled(bars)
    return ag, audits.label_draws(su.drop("same"), lb, 10, 99, "p1")


@query("sco_18_label_permutation", LABEL_SQL + """, ob AS (SELECT sum(top1) AS o1, sum(same) AS o2, count(*) AS queries FROM ag)
    SELECT ob.queries AS queries, """ + rnd(top1="any_value(o1) / ob.queries", purity="any_value(o2) / ob.queries / 10.0::DOUBLE", top1_p="(1 + count(*) FILTER (rt.top1 >= o1)) / 100.0::DOUBLE", purity_p="(1 + count(*) FILTER (rt.same >= o2)) / 100.0::DOUBLE") + " FROM rt, ob GROUP BY ob.queries", bars="brand_week")
def permutation(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Do neighbours share the query's label more often than random candidates of random symbols do?"""
    ag, draws = _draws(bars)
    seen = ag.agg(F.sum("top1").alias("o1"), F.sum("same").alias("o2"), F.count("*").alias("queries"))
    rt = audits.replicate_totals(draws).drop("queries").crossJoin(F.broadcast(seen))  # one row
    out = rt.groupBy("queries", "o1", "o2").agg(((1 + F.count_if(F.col("top1") >= F.col("o1"))) / 100).alias("top1_p"), ((1 + F.count_if(F.col("same") >= F.col("o2"))) / 100).alias("purity_p"))
    return rounded(out.select("queries", (F.col("o1") / F.col("queries")).alias("top1"), (F.col("o2") / F.col("queries") / 10).alias("purity"), "top1_p", "purity_p"))


@query("sec_12_replicate_means", LABEL_SQL + " SELECT 'replicate' AS kind, replicate::VARCHAR AS key, round(avg(same / 10.0::DOUBLE), 6) AS mean, count(*) AS n FROM nd GROUP BY replicate UNION ALL SELECT 'query', query_id, round(avg(same / 10.0::DOUBLE), 6), count(*) FROM nd GROUP BY query_id", bars="brand_week")
def replicate_means(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    _, draws = _draws(bars)
    one = lambda k, kind: draws.groupBy(F.col(k).cast("string").alias("key")).agg(F.avg(F.col("same") / 10).alias("mean"), F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return rounded(one("replicate", "replicate").unionByName(one("query_id", "query")), "kind", "key")


@query("sec_12_chunk_faults", "SELECT CAST(r AS INT) AS replicate, count(s) AS covered FROM range(120) AS x(r) LEFT JOIN (SELECT o_custkey % 113 AS s, 1 + o_orderkey % 2 AS n FROM orders WHERE o_orderkey % 20 = 0) AS c ON r >= s AND r < s + n GROUP BY r HAVING count(s) <> 1")
def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes and overlaps of chunks that orders divisible by 20 stand for."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 20 = 0")
    return audits.chunk_faults(orders.select((F.col("o_custkey") % 113).cast("int").alias("start"), (1 + F.col("o_orderkey") % 2).cast("int").alias("n")), 120)


POOL_SQL = QUERY_SQL + """, co AS (SELECT query_id, episode_id, cutoff, q_cutoff, round(abs(ret_20 - q_ret_20), 9) AS coarse, round(abs(ret_20 - q_ret_20) + abs(ret_63 - q_ret_63) + abs(vol_20 - q_vol_20), 9) AS exact FROM pp),
    po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse, episode_id) AS place FROM co QUALIFY place <= 200)"""


def _pool(bars: DataFrame) -> DataFrame:
    gap = lambda c: F.abs(F.col(c) - F.col(f"q_{c}"))
    rows = _pairs(bars).select("query_id", "episode_id", "cutoff", "q_cutoff", F.round(gap("ret_20"), 9).alias("coarse"), F.round(gap("ret_20") + gap("ret_63") + gap("vol_20"), 9).alias("exact"))
    return audits.coarse_pool(rows, 200)


@query("top_23_pool_saturation", POOL_SQL + """, pz AS (SELECT *, row_number() OVER (PARTITION BY query_id, size ORDER BY exact, episode_id) AS r FROM po, (VALUES (25), (50), (100), (200)) AS s(size) WHERE place <= size QUALIFY r <= 20),
    tr AS (SELECT query_id, episode_id, count(*) OVER (PARTITION BY query_id) AS n FROM pz WHERE size = 200) SELECT pz.query_id, size, round(count(tr.episode_id) / max(max(tr.n)) OVER (PARTITION BY pz.query_id), 6) AS recall FROM pz LEFT JOIN tr USING (query_id, episode_id) GROUP BY pz.query_id, size""", bars="brand_week")
def pool_saturation(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(audits.saturation(_pool(bars), (25, 50, 100, 200), 20), "query_id", "size")


@query("top_23_rank_agreement", POOL_SQL + """, ra AS (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY coarse) + (count(*) OVER (PARTITION BY query_id, coarse) - 1) / 2.0::DOUBLE AS c, rank() OVER (PARTITION BY query_id ORDER BY exact) + (count(*) OVER (PARTITION BY query_id, exact) - 1) / 2.0::DOUBLE AS e FROM po)
    SELECT query_id, count(*) AS pool, CASE WHEN var_pop(c) > 0 AND var_pop(e) > 0 THEN round(corr(c, e), 6) + 0.0::DOUBLE END AS spearman FROM ra GROUP BY query_id""", bars="brand_week")
def pool_agreement(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    out = rounded(audits.rank_agreement(_pool(bars)), "query_id")
    return out.withColumn("spearman", F.when(~F.isnan("spearman"), F.col("spearman") + 0.0))


CASE_SQL = RANK_SQL + POOL_SQL[len(QUERY_SQL):] + """, au AS (SELECT query_id, episode_id FROM nb WHERE rank <= 20), pn AS (SELECT query_id, count(*) AS returned, count(*) - count(DISTINCT episode_id) AS duplicates, count(*) FILTER (cutoff >= q_cutoff) AS violations FROM po GROUP BY query_id),
    ca AS (SELECT au.query_id, any_value(duplicates) AS duplicates, any_value(violations) AS violations, any_value(returned) AS returned, count(po.episode_id) AS retrieved, count(po.episode_id) / 20.0::DOUBLE AS recall FROM au JOIN pn USING (query_id) LEFT JOIN po USING (query_id, episode_id) GROUP BY au.query_id),
    cb AS (SELECT *, recall >= 0.5 AND duplicates = 0 AND violations = 0 AS passed FROM ca)"""


def _cases(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return audits.recall_cases(rank_neighbours(spark, sf_dir, bars).select("query_id", "episode_id"), _pool(bars), 20, 0.5)


@query("sec_2_recall_cases", CASE_SQL + " SELECT query_id, duplicates, violations, returned, retrieved, round(recall, 6) AS recall, passed FROM cb", bars="brand_week")
def cases(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(_cases(spark, sf_dir, bars), "query_id")


@query("sec_2_recall_matrix", CASE_SQL + " SELECT count(*) AS cases, count(*) FILTER (passed) AS passed_cases, min(recall) AS minimum_recall, round(avg(recall), 6) AS mean_recall, CAST(sum(returned) AS BIGINT) AS rows, count(*) FILTER (passed) = count(*) AS passed FROM cb", bars="brand_week")
def matrix(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(audits.recall_matrix(_cases(spark, sf_dir, bars)))


@query(
    "sec_1_loss_attribution",
    VIEW_SQL + """, lt AS (SELECT max(cutoff) - INTERVAL 420 DAY AS latest FROM vw), st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cutoff) AS k FROM vw) WHERE k % 2 = 0),
    tg AS (SELECT episode_id, symbol FROM (SELECT *, round(a + c + e, 9) AS d FROM vw) ORDER BY d, episode_id LIMIT 60),
    el AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a, cutoff) AS local_a, row_number() OVER (PARTITION BY symbol ORDER BY c, cutoff) AS local_c, row_number() OVER (PARTITION BY symbol ORDER BY e, cutoff) AS local_e FROM st, lt WHERE cutoff <= latest),
    u2 AS (SELECT * FROM el WHERE least(local_a, local_c, local_e) <= 3), r2 AS (SELECT *, row_number() OVER (ORDER BY a, episode_id) AS rank_a, row_number() OVER (ORDER BY c, episode_id) AS rank_c, row_number() OVER (ORDER BY e, episode_id) AS rank_e FROM u2),
    s2 AS (SELECT *, round(1.0::DOUBLE / (60 + rank_a) + 1.0::DOUBLE / (60 + rank_c) + 1.0::DOUBLE / (60 + rank_e), 12) AS fusion_score, least(rank_a, rank_c, rank_e) <= 1 AS forced FROM r2),
    f2 AS (SELECT episode_id, row_number() OVER (ORDER BY fusion_score DESC, episode_id) AS fusion_rank, row_number() OVER (ORDER BY forced DESC, fusion_score DESC, episode_id) AS pool_rank FROM s2)
    SELECT tg.episode_id, local_a, local_c, local_e, fusion_rank, CASE WHEN pool_rank <= 30 THEN pool_rank END AS pool_rank,
        CASE WHEN st.episode_id IS NULL THEN 'missing_from_view_store' WHEN el.episode_id IS NULL THEN 'ineligible_in_view_store' WHEN f2.episode_id IS NULL THEN 'local_cap_loss' WHEN pool_rank > 30 THEN 'fusion_pool_loss' ELSE 'in_candidate_pool' END AS reason
    FROM tg LEFT JOIN st USING (episode_id) LEFT JOIN el USING (episode_id) LEFT JOIN f2 USING (episode_id)""",
    bars="brand_week",
)
def losses(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Where the sixty nearest windows by all views are lost: a store of every second window, 3 a symbol and view, 30 after fusion."""
    v = _views(bars)
    latest = v.agg((F.max("cutoff") - F.expr("interval 420 days")).alias("latest"))
    targets = v.withColumn("d", F.round(F.col("a") + F.col("c") + F.col("e"), 9)).orderBy("d", "episode_id").limit(60).select("episode_id", "symbol")
    store = v.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("cutoff"))).where("k % 2 = 0").crossJoin(F.broadcast(latest))  # one row
    ranked = S.fused(S.union_of_views(store.where("cutoff <= latest"), VIEWS, 3), VIEWS, 2**31 - 1)
    return audits.losses(targets, store, F.col("cutoff") <= F.col("latest"), VIEWS, 3, ranked, 30)


@query(
    "sec_3_scale_ladder",
    VIEW_SQL + """, hs AS (SELECT symbol, row_number() OVER (ORDER BY sha256('7' || chr(0) || symbol), symbol) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT symbol FROM bars)), fr AS (SELECT CAST(f AS DOUBLE) AS fraction, symbol FROM hs, (VALUES (0.1), (0.25), (0.5), (1.0)) AS f(f) WHERE place <= ceil(n * f)),
    ro AS (SELECT fraction, vw.* FROM vw JOIN fr USING (symbol)), sz AS (SELECT fraction, count(DISTINCT symbol) AS symbols, count(*) AS candidates, lag(fraction) OVER (ORDER BY fraction) AS below FROM ro GROUP BY fraction),
    be AS (SELECT *, row_number() OVER (PARTITION BY fraction ORDER BY a, episode_id) AS r FROM ro QUALIFY r <= 20)
    SELECT sz.fraction, any_value(symbols) AS symbols, any_value(candidates) AS candidates, round(max(be.a), 6) AS kth, sha256(string_agg(be.episode_id, ',' ORDER BY be.r)) AS digest, CASE WHEN any_value(below) IS NOT NULL THEN round(count(o.episode_id) / 20.0::DOUBLE, 6) END AS overlap
    FROM sz JOIN be USING (fraction) LEFT JOIN be AS o ON o.fraction = sz.below AND o.episode_id = be.episode_id GROUP BY sz.fraction""",
    bars="brand_week",
)
def ladder(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(audits.scale_ladder(_views(bars), quality.nested_prefixes(B.instruments(bars), (0.1, 0.25, 0.5, 1.0), 7), "a", 20), "fraction")


@query("sec_4_float_round_trip", FEATS_SQL + " SELECT symbol, count(*) AS n, round(max(greatest(" + ", ".join(f"abs({c}::FLOAT::DOUBLE - {c})" for c in ("ret_20", "ret_63", "vol_20")) + ")) * 1e9, 3) AS billionths FROM b GROUP BY symbol", bars="brand_week")
def round_trip(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    out = audits.float_error(_feats(bars), ["symbol"], ("ret_20", "ret_63", "vol_20"))
    return out.select("symbol", "n", F.round(F.col("error") * 1e9, 3).alias("billionths"))


@query("sec_4_half_precision", **PAIR)
def half_precision(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Candidates kept as 16-bit floats, the query as it is: recall and gain of the selection, and the largest change of a distance."""
    _, store, q, eligible = _store(bars, bench)
    request = S.Request("Brand#1")
    native, halved = S.scored(store.where(eligible), q, exact=True), S.scored(S.halved(store.where(eligible)), q, exact=True)
    pick = lambda d: S.greedy_by_query(d.withColumn("query_id", F.lit("Brand#1")), request.top_k, request.per_symbol, request.lookback)
    truth, got = pick(native).select("episode_id", F.col("rank").alias("true_rank")), pick(halved).select("episode_id", "rank")
    gain = truth.withColumn("gain", 1 / F.log2(F.col("true_rank") + 1))
    ideal = gain.agg(F.sum(F.col("gain") / F.log2(F.col("true_rank") + 1)).alias("ideal"), F.count("*").alias("n"))
    seen = gain.join(got, "episode_id").agg(F.count("*").alias("found"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("received"))
    moved = native.select("episode_id", "distance").join(halved.select("episode_id", F.col("distance").alias("other")), "episode_id").agg(F.max(F.abs(F.col("distance") - F.col("other"))).alias("largest_change"), F.count("*").alias("candidates"))
    rows = ideal.crossJoin(seen).crossJoin(moved)  # one row each
    return rows.select("candidates", (F.col("found") / F.col("n")).alias("recall"), (F.col("received") / F.col("ideal")).alias("ndcg"), "largest_change")


@query("sec_10_component_scan", VIEW_SQL + " SELECT episode_id, c FROM vw ORDER BY vw.c, episode_id LIMIT 64", bars="brand_week")
def component_scan(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """The proposals of one named route."""
    return S.quotas(_views(bars), {"c": 64}).join(_views(bars).select("episode_id", "c"), "episode_id").select("episode_id", "c")


@query("snk_7_path_index", PATHS_SQL + ", ix AS (SELECT DISTINCT query_id, row_number() OVER (ORDER BY query_id) AS k FROM (SELECT DISTINCT query_id FROM pt)) SELECT query_id, member, step, round(r, 6) + 0.0::DOUBLE AS close_return FROM pt JOIN ix USING (query_id) WHERE k % 20 = 0", bars="brand_week")
def path_index(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Paths stored in order of their episode, and the slices of every twentieth read back."""
    at = folder_of(spark, "paths")
    stores.write_index(_future(bars).select("query_id", "member", "step", "close_return"), at, "query_id")
    paths = spark.read.parquet(at)
    names = paths.select("query_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("query_id")))  # a row for each query
    return rounded(stores.slices(paths, "query_id", [r["query_id"] for r in names.where("k % 20 = 0").collect()]), "query_id", "member", "step")  # the stated names


@query("mod_4_trailing_filter", FEATS_SQL + """, pc AS (SELECT symbol, ts, CASE WHEN ret_63 < 0.5 THEN round(rank() OVER (PARTITION BY ts ORDER BY ret_20) / count(*) OVER (PARTITION BY ts), 6) END AS score FROM b),
    th AS (SELECT d.ts, CASE WHEN count(score) >= 30 THEN quantile_cont(score, 1.0::DOUBLE / 3) END AS threshold FROM (SELECT DISTINCT ts FROM pc) AS d LEFT JOIN pc AS h ON h.ts < d.ts AND h.ts >= d.ts - INTERVAL 362 DAY GROUP BY d.ts)
    SELECT symbol, ts, score, round(threshold, 6) AS threshold, score IS NULL OR threshold IS NULL OR score >= round(threshold, 9) AS kept FROM pc JOIN th USING (ts)""", bars="brand_week")
def trailing(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    f = _feats(bars)
    w = Window.partitionBy("ts")
    scores = f.select("symbol", "ts", F.when(F.col("ret_63") < 0.5, F.round(F.rank().over(w.orderBy("ret_20")) / F.count("*").over(w), 6)).alias("score"))
    return rounded(audits.trailing_filter(scores), "symbol", "ts")


NAMES = {"1-URGENT": "EP", "2-HIGH": "Para Long", "3-MEDIUM": "Bounce off MA", "4-NOT SPECIFIED": " Market Play ", "5-LOW": "High Flag"}


@query("src_12_labelled_examples", "SELECT o_orderdate::TIMESTAMP AS entry, 'S' || o_custkey AS symbol, o_orderstatus AS side, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v.strip()}'" for k, v in NAMES.items()) + " END AS raw_setup, CASE o_orderpriority WHEN '1-URGENT' THEN 'episodic_pivot' WHEN '2-HIGH' THEN 'parabolic' WHEN '3-MEDIUM' THEN 'moving_average_reaction' WHEN '4-NOT SPECIFIED' THEN 'speculation' WHEN '5-LOW' THEN 'high_flag' END AS setup, 'a, b' AS market, 'note' AS note FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 5 <> 0")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of trades: those divisible by 7 lack a field, customers divisible by 5 have a symbol that is none."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.create_map(*[F.lit(x) for p in NAMES.items() for x in p])[F.col("o_orderpriority")]
    symbol = F.concat(F.when(F.col("o_custkey") % 5 == 0, "?").otherwise("S"), F.col("o_custkey").cast("string"))
    start = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("x"), symbol, "o_orderstatus", name, F.lit('"a, b"'), *[F.lit(str(i)) for i in range(6, 15)], F.lit(" note "))
    lines = orders.select(F.when(F.col("o_orderkey") % 7 == 0, start).otherwise(F.concat(start, F.lit(","))).alias("value"))
    return audits.examples(lines)


@query(
    "dst_24_chart_distances",
    FEATS_SQL + """, lq AS (SELECT symbol, ret_20, ret_63, vol_20 FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), va AS (SELECT symbol || '@' || strftime(ts, '%Y-%m-%d') AS episode_id, f, v FROM b UNPIVOT (v FOR f IN (ret_20, ret_63, vol_20))), qv AS (SELECT symbol, f, v FROM lq UNPIVOT (v FOR f IN (ret_20, ret_63, vol_20))),
    pl AS (SELECT f, v, CASE WHEN any_value(lo) = any_value(hi) THEN sign(v - any_value(lo)) ELSE greatest(-1, least(1, (2 * count(*) FILTER (q < v) + count(*) FILTER (q = v) - count(*)) / (count(*) - 1)::DOUBLE)) END AS z
        FROM (SELECT DISTINCT f, v FROM va) JOIN (SELECT f, v AS q, min(v) OVER (PARTITION BY f) AS lo, max(v) OVER (PARTITION BY f) AS hi FROM qv) USING (f) GROUP BY f, v)
    SELECT qv.symbol AS query_id, va.episode_id, round(sqrt(avg((a.z - b.z) * (a.z - b.z))), 6) AS distance FROM qv JOIN pl AS a ON a.f = qv.f AND a.v = qv.v JOIN va ON va.f = qv.f JOIN pl AS b ON b.f = va.f AND b.v = va.v GROUP BY ALL""",
    bars="brand_week",
)
def charts(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Each symbol's last row against all rows."""
    names = ["ret_20", "ret_63", "vol_20"]
    f = _feats(bars)
    last = f.groupBy("symbol").agg(F.max_by(F.struct(*names), "ts").alias("x")).select("symbol", "x.*").orderBy("symbol").toPandas()  # a row for each symbol
    rows = f.withColumn("episode_id", F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd")))
    return rounded(comparison.chart_distances(rows, "episode_id", names, last["symbol"].tolist(), last[names].to_numpy(float)), "query_id", "episode_id")


@query("syn_3_latent_corpus")
def latent_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.latent_corpus(spark)


@query("syn_5_method_comparison")
def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the cases in other units ask for themselves, their family and not their reverse, by each distance."""
    seeds = 5
    base = synthetic.corpus(spark, seeds)
    bars = base.unionByName(synthetic.variants(base, ("unit", "reverse")))
    store = S.representations(positions(bars).withColumn("bench_close", F.lit(None).cast("double")), S.Request("", lookback=252, stride=1))
    names = sorted(f"{f}-{s}" for f in synthetic.FAMILIES for s in range(seeds))[::2]
    asked = store.where(F.col("symbol").isin([f"{n}/unit" for n in names])).select("symbol", *S.PARTS).collect()  # the stated queries
    queries = {r["symbol"].split("/")[0]: {p: np.array([r[p]], float) for p in S.PARTS} for r in asked}
    d = comparison.by_method(store.where("symbol not like '%/unit'"), queries)
    case, family = F.split_part("symbol", F.lit("/"), F.lit(1)), lambda c: F.regexp_replace(c, "-[0-9]+$", "")
    d = d.select("method", "query_id", case.alias("case"), F.split_part("symbol", F.lit("/"), F.lit(2)).alias("kind"), "distance")
    return comparison.method_metrics(d.withColumns({"own": F.col("case") == F.col("query_id"), "same": family("case") == family("query_id")}), seeds)
