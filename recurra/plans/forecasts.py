"""Queries on weighted statistics, forecasts, scores and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions.rolling import by, lag, last
from recurra.operators import calendars, scoring, weighted
from recurra.operators import registry as G
from recurra.plans.features import W, rnd, rounded
from recurra.plans.outcomes import BARRIER_SQL, PAIR, barriers
from recurra.plans.registry import query
from recurra.plans.search import RANK_SQL, _queries
from recurra.operators import search as S
from recurra.sources.bars import positions

LINK_SQL = RANK_SQL + f""", fo AS (SELECT symbol, ts, lead(close, 20) OVER ({W}) / close - 1 AS close_return, lead(ts, 20) OVER ({W}) AS completion FROM bars),
    lk AS (SELECT nb.query_id, rank AS match_rank, nb.symbol, split_part(nb.query_id, '/', 1) AS query_symbol, close_return, completion, q_cutoff, completion IS NOT NULL AND completion <= q_cutoff AS eligible
           FROM nb JOIN qs USING (query_id) JOIN fo ON fo.symbol = nb.symbol AND fo.ts = CAST(split_part(nb.episode_id, '@', 2) AS TIMESTAMP) WHERE rank <= 20),
    wl AS (SELECT *, pow(2.0::DOUBLE, -(match_rank - 1) / 10.0::DOUBLE) AS w FROM lk)"""


def _links(bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    pairs = e.join(F.broadcast(q), F.col("cutoff") < F.col("q_cutoff")).where("symbol != q_symbol")
    nb = S.rank_neighbours(pairs, ["ret_20", "ret_63", "vol_20"], 20)
    ahead = bars.select("symbol", F.col("ts").alias("at"), (F.lead("close", 20).over(by()) / F.col("close") - 1).alias("close_return"), F.lead("ts", 20).over(by()).alias("completion"))
    nb = nb.withColumn("at", F.element_at(F.split("episode_id", "@"), 2).cast("timestamp")).join(ahead, ["symbol", "at"]).join(F.broadcast(q.select("query_id", "q_cutoff", "q_symbol")), "query_id")
    ok = F.col("completion").isNotNull() & (F.col("completion") <= F.col("q_cutoff"))
    return nb.select("query_id", F.col("rank").alias("match_rank"), "symbol", F.col("q_symbol").alias("query_symbol"), F.lit(20).alias("horizon"), ok.alias("eligible"), "close_return", "completion", "q_cutoff", "score")


@query("agg_1_2_effective_size", LINK_SQL + " SELECT query_id, round(sum(w), 6) AS w, round(sum(w) * sum(w) / sum(w * w), 6) AS ess FROM wl GROUP BY query_id", bars="brand_week")
def effective(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _links(bars).withColumn("w", weighted.rank_weight("match_rank"))
    return rounded(rows.groupBy("query_id").agg(F.sum("w").alias("w"), weighted.effective_size("w").alias("ess")), "query_id")


QUANTILE_SQL = """, cw AS (SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY close_return RANGE UNBOUNDED PRECEDING) AS sofar, sum(w) OVER (PARTITION BY query_id) AS total FROM wl WHERE close_return IS NOT NULL),
    wq AS (SELECT query_id, CAST(level AS DOUBLE) AS level, min(close_return) AS q FROM cw, (VALUES (0.1), (0.5), (0.9)) AS v(level) WHERE sofar >= level * total - 1e-12 GROUP BY ALL)"""


@query("agg_3_weighted_quantiles", LINK_SQL + QUANTILE_SQL + " SELECT query_id, level, round(q, 6) + 0.0::DOUBLE AS q FROM wq", bars="brand_week")
def quantiles(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _links(bars).withColumn("w", weighted.rank_weight("match_rank"))
    return rounded(weighted.weighted_quantiles(rows, ["query_id"], "close_return", "w", (0.1, 0.5, 0.9)), "query_id", "level")


@query("agg_4_linear_quantiles", LINK_SQL + " SELECT query_id, " + rnd(q10="quantile_cont(close_return, 0.1)", q50="quantile_cont(close_return, 0.5)", q90="quantile_cont(close_return, 0.9)") + " FROM lk GROUP BY query_id", bars="brand_week")
def linear(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("close_return", F.lit(p))
    return rounded(_links(bars).groupBy("query_id").agg(q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90")), "query_id")


@query(
    "agg_5_evidence_card",
    LINK_SQL + """, pf AS (SELECT *, row_number() OVER (PARTITION BY query_id, symbol ORDER BY match_rank) AS b FROM wl), px AS (SELECT * FROM pf, (VALUES (5), (10), (15), (20)) AS v(prefix) WHERE b = 1 AND match_rank <= prefix),
    st AS (SELECT query_id, prefix, count(*) AS members, count(*) FILTER (eligible) AS n, count(*) FILTER (NOT eligible) AS withheld, sum(w) FILTER (eligible) * sum(w) FILTER (eligible) / sum(w * w) FILTER (eligible) AS ess,
              sum(w * close_return) FILTER (eligible) / sum(w) FILTER (eligible) AS wm, quantile_cont(close_return, 0.5) FILTER (eligible) AS md, avg((close_return > 0)::INT) FILTER (eligible) AS pr FROM px GROUP BY ALL),
    cm AS (SELECT *, sum(w) OVER (PARTITION BY query_id, prefix ORDER BY close_return RANGE UNBOUNDED PRECEDING) AS sofar, sum(w) OVER (PARTITION BY query_id, prefix) AS total FROM px WHERE eligible),
    wm AS (SELECT query_id, prefix, min(close_return) AS q FROM cm WHERE sofar >= 0.5 * total - 1e-12 GROUP BY ALL)
    SELECT st.query_id, 20 AS horizon, st.prefix, members, n, withheld, """ + rnd(ess="ess", weighted_mean="wm.q * 0 + st.wm", median="md", positive_rate="pr", weighted_median="wm.q") + ", n < 5 AS abstain FROM st LEFT JOIN wm ON st.query_id = wm.query_id AND st.prefix = wm.prefix",
    bars="brand_week",
)
def evidence(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(weighted.evidence(_links(bars)), "query_id", "horizon", "prefix")


PROB_SQL = BARRIER_SQL + """, lb AS (SELECT * FROM z WHERE label IN ('favorable_first', 'adverse_first', 'no_touch')), mo AS (SELECT *, date_trunc('month', cutoff)::TIMESTAMP AS month FROM lb),
    pb AS (SELECT symbol, count(*) FILTER (label = 'favorable_first') AS f, count(*) FILTER (label = 'adverse_first') AS a, count(*) FILTER (label = 'no_touch') AS t FROM lb GROUP BY symbol),
    pr AS (SELECT symbol, (f + 0.5::DOUBLE) / (f + a + t + 1.5) AS p_favorable_first, (a + 0.5::DOUBLE) / (f + a + t + 1.5) AS p_adverse_first, (t + 0.5::DOUBLE) / (f + a + t + 1.5) AS p_no_touch FROM pb),
    sl AS (SELECT mo.symbol, cutoff, month, label, p_favorable_first, p_adverse_first, p_no_touch,
               pow(p_favorable_first - (label = 'favorable_first')::INT, 2) + pow(p_adverse_first - (label = 'adverse_first')::INT, 2) + pow(p_no_touch - (label = 'no_touch')::INT, 2) AS brier,
               pow(1.0::DOUBLE / 3 - (label = 'favorable_first')::INT, 2) + pow(1.0::DOUBLE / 3 - (label = 'adverse_first')::INT, 2) + pow(1.0::DOUBLE / 3 - (label = 'no_touch')::INT, 2) AS reference,
               -ln(CASE label WHEN 'favorable_first' THEN p_favorable_first WHEN 'adverse_first' THEN p_adverse_first ELSE p_no_touch END) AS log_loss
           FROM mo JOIN pr USING (symbol))"""


def _labels(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return barriers(spark, sf_dir, bars, bench).where(F.col("label").isin(*scoring.CLASSES)).select("symbol", "cutoff", "label")


def _scored(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _labels(spark, sf_dir, bars, bench)
    p = weighted.smoothed_probabilities(rows.withColumn("w", F.lit(1.0)), ["symbol"], "label", "w", scoring.CLASSES)
    third = sum(((F.lit(1 / 3) - (F.col("label") == c).cast("double")) * (F.lit(1 / 3) - (F.col("label") == c).cast("double")) for c in scoring.CLASSES), F.lit(0.0))
    return rows.join(p, "symbol").withColumns({"brier": scoring.brier(), "log_loss": scoring.log_loss(), "reference": third})


@query("agg_6_smoothed_probabilities", PROB_SQL + " SELECT symbol, " + rnd(p_favorable_first="p_favorable_first", p_adverse_first="p_adverse_first", p_no_touch="p_no_touch") + " FROM pr", **PAIR)
def smoothed(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _labels(spark, sf_dir, bars, bench).withColumn("w", F.lit(1.0))
    return rounded(weighted.smoothed_probabilities(rows, ["symbol"], "label", "w", scoring.CLASSES), "symbol")


@query("sco_1_brier_log_loss", PROB_SQL + " SELECT symbol, cutoff, label, " + rnd(brier="brier", log_loss="log_loss", reference="reference") + " FROM sl", **PAIR)
def brier(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(_scored(spark, sf_dir, bars, bench).select("symbol", "cutoff", "label", "brier", "log_loss", "reference"), "symbol", "cutoff")


@query("sco_1_brier_skill", PROB_SQL + " SELECT symbol, " + rnd(loss="avg(brier)", reference="avg(sl.reference)", skill="1 - avg(brier) / avg(sl.reference)") + " FROM sl GROUP BY symbol", **PAIR)
def skill(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(scoring.skill(_scored(spark, sf_dir, bars, bench), ["symbol"], "brier", "reference"), "symbol")


@query(
    "agg_9_expanding_frequency",
    BARRIER_SQL + """, kn AS (SELECT cutoff + INTERVAL 140 DAY AS completion, label FROM z), ak AS (SELECT DISTINCT cutoff FROM z)
    SELECT strftime(cutoff, '%Y-%m-%d') AS query_id, cutoff, count(completion) AS n, round(count(*) FILTER (label = 'no_touch') / nullif(count(completion), 0), 6) AS frequency FROM ak LEFT JOIN kn ON completion <= cutoff GROUP BY cutoff""",
    **PAIR,
)
def expanding(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = barriers(spark, sf_dir, bars, bench)
    asks = rows.select(F.date_format("cutoff", "yyyy-MM-dd").alias("query_id"), "cutoff").distinct()
    known = rows.select((F.col("cutoff") + F.expr("interval 140 days")).alias("completion"), "label")
    return rounded(weighted.expanding_frequency(known, asks, "no_touch"), "query_id", "cutoff")


@query(
    "agg_10_matched_probability",
    BARRIER_SQL + """, kn AS (SELECT cutoff + INTERVAL 140 DAY AS completion, label, CASE WHEN month(cutoff) <= 6 THEN 'a' ELSE 'b' END AS regime, CASE WHEN symbol < 'Brand#2' THEN 'x' ELSE 'y' END AS liquidity FROM z),
    ak AS (SELECT symbol || '/' || strftime(cutoff, '%Y-%m-%d') AS query_id, cutoff, CASE WHEN month(cutoff) <= 6 THEN 'a' ELSE 'b' END AS regime, CASE WHEN symbol < 'Brand#2' THEN 'x' ELSE 'y' END AS liquidity FROM z),
    cn AS (SELECT query_id, ak.cutoff, count(*) FILTER (k.regime = ak.regime AND k.liquidity = ak.liquidity) AS n1, count(*) FILTER (k.regime = ak.regime AND k.liquidity = ak.liquidity AND label = 'no_touch') AS h1, count(*) FILTER (k.regime = ak.regime) AS n2,
              count(*) FILTER (k.regime = ak.regime AND label = 'no_touch') AS h2, count(completion) AS n3, count(*) FILTER (label = 'no_touch') AS h3 FROM ak LEFT JOIN kn AS k ON completion <= ak.cutoff GROUP BY ALL)
    SELECT query_id, cutoff, CASE WHEN n1 >= 30 THEN 'cell' WHEN n2 >= 30 THEN 'regime' WHEN n3 >= 30 THEN 'all' ELSE 'uniform' END AS level, round(CASE WHEN n1 >= 30 THEN h1 / n1 WHEN n2 >= 30 THEN h2 / n2 WHEN n3 >= 30 THEN h3 / n3 ELSE 1.0::DOUBLE / 3 END, 6) AS p FROM cn""",
    **PAIR,
)
def matched(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    cell = [F.when(F.month("cutoff") <= 6, "a").otherwise("b").alias("regime"), F.when(F.col("symbol") < "Brand#2", "x").otherwise("y").alias("liquidity")]
    rows = barriers(spark, sf_dir, bars, bench)
    known = rows.select((F.col("cutoff") + F.expr("interval 140 days")).alias("completion"), "label", *cell)
    asks = rows.select(F.concat_ws("/", "symbol", F.date_format("cutoff", "yyyy-MM-dd")).alias("query_id"), "cutoff", *cell)
    return rounded(weighted.matched_probability(known, asks, "no_touch"), "query_id", "cutoff")


@query(
    "agg_12_crps",
    LINK_SQL + """, vv AS (SELECT query_id, close_return AS x, w / sum(w) OVER (PARTITION BY query_id) AS w FROM wl WHERE eligible),
    ca AS (SELECT query_id, sum(w * abs(x - 0.01)) AS a FROM vv GROUP BY query_id), cb AS (SELECT p.query_id, sum(p.w * q.w * abs(p.x - q.x)) AS b FROM vv AS p JOIN vv AS q ON p.query_id = q.query_id GROUP BY p.query_id)
    SELECT query_id, round(a - b / 2, 6) AS crps FROM ca JOIN cb USING (query_id)""",
    bars="brand_week",
)
def crps(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _links(bars).where("eligible").withColumns({"w": weighted.rank_weight("match_rank"), "y": F.lit(0.01)})
    return rounded(weighted.crps(rows, ["query_id"], "close_return", "w", "y"), "query_id")


@query(
    "agg_13_concentration",
    RANK_SQL + """, u AS (SELECT symbol, count(*) AS n FROM nb WHERE rank <= 10 GROUP BY symbol), r AS (SELECT *, n / sum(n) OVER () AS s, row_number() OVER (ORDER BY n, symbol) + 25 - count(*) OVER () AS k, sum(n) OVER () AS t FROM u)
    SELECT round(max(s), 6) AS top_share, round(sum(s * s), 6) AS hhi, round(1 / sum(s * s), 6) AS effective, round(2 * sum(k * n) / (25 * max(t)) - 26.0::DOUBLE / 25, 6) AS gini FROM r""",
    bars="brand_week",
)
def concentration(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(weighted.concentration(_links(bars).where("match_rank <= 10"), "symbol", 25))


@query("agg_15_terciles", RANK_SQL + " SELECT query_id, episode_id, CAST(least(2, floor((row_number() OVER (PARTITION BY query_id ORDER BY score, episode_id) - 1) * 3 / count(*) OVER (PARTITION BY query_id))) AS INT) AS tercile FROM nb", bars="brand_week")
def terciles(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q, e = _queries(bars)
    pairs = e.join(F.broadcast(q), F.col("cutoff") < F.col("q_cutoff")).where("symbol != q_symbol")
    return weighted.terciles(S.rank_neighbours(pairs, ["ret_20", "ret_63", "vol_20"], 1000), "score", "episode_id", ["query_id"]).select("query_id", "episode_id", "tercile")


@query("agg_16_entropy_breadth", RANK_SQL + ", u AS (SELECT symbol, count(*) / sum(count(*)) OVER () AS p FROM nb WHERE rank <= 10 GROUP BY symbol) SELECT round(exp(-sum(p * ln(p))), 6) AS breadth FROM u", bars="brand_week")
def breadth(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(weighted.entropy_breadth(_links(bars).where("match_rank <= 10"), "symbol"))


SERIES_SQL = LINK_SQL + """, ac AS (SELECT DISTINCT lk.query_id, fo.close_return AS actual FROM lk JOIN fo ON fo.symbol = lk.query_symbol AND fo.ts = lk.q_cutoff WHERE fo.close_return IS NOT NULL)""" + QUANTILE_SQL + """,
    iv AS (SELECT query_id, any_value(actual) AS y, max(q) FILTER (level = 0.1) AS lo, max(q) FILTER (level = 0.5) AS md, max(q) FILTER (level = 0.9) AS hi FROM wq JOIN ac USING (query_id) GROUP BY query_id)"""


@query(
    "sco_2_pinball_interval",
    SERIES_SQL + " SELECT query_id, " + rnd(pinball_50="greatest(0.5 * (y - md), -0.5 * (y - md))", interval_80="(hi - lo) + 10 * greatest(lo - y, 0) + 10 * greatest(y - hi, 0)") + ", y BETWEEN lo AND hi AS covered FROM iv",
    bars="brand_week",
)
def intervals(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _links(bars).withColumn("w", weighted.rank_weight("match_rank"))
    q = weighted.weighted_quantiles(rows, ["query_id"], "close_return", "w", (0.1, 0.5, 0.9)).groupBy("query_id").agg(*[F.max(F.when(F.col("level") == x, F.col("q"))).alias(n) for x, n in ((0.1, "lo"), (0.5, "md"), (0.9, "hi"))])
    ahead = bars.select(F.col("symbol").alias("query_symbol"), F.col("ts").alias("q_cutoff"), (F.lead("close", 20).over(by()) / F.col("close") - 1).alias("y"))
    actual = rows.select("query_id", "query_symbol", "q_cutoff").distinct().join(ahead, ["query_symbol", "q_cutoff"]).where("y is not null")
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    return rounded(q.join(actual, "query_id").select("query_id", scoring.pinball(y, F.col("md"), 0.5).alias("pinball_50"), scoring.interval_score(y, lo, hi, 0.2).alias("interval_80"), y.between(lo, hi).alias("covered")), "query_id")


CAL_SQL = PROB_SQL + ", ks AS (SELECT *, symbol || '/' || strftime(cutoff, '%Y-%m-%d') AS key, round(p_no_touch, 9) AS p, (label = 'no_touch')::INT AS hit FROM sl)"


def _calibrated(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    rows = _scored(spark, sf_dir, bars, bench)
    return rows.select("*", F.concat_ws("/", "symbol", F.date_format("cutoff", "yyyy-MM-dd")).alias("key"), F.round("p_no_touch", 9).alias("p"), (F.col("label") == "no_touch").cast("int").alias("hit"))


@query("sco_3_calibration_bins", CAL_SQL + ", bn AS (SELECT *, ntile(10) OVER (ORDER BY p, key) AS bin FROM ks) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS frequency FROM bn GROUP BY bin", **PAIR)
def calibration(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(scoring.calibration(_calibrated(spark, sf_dir, bars, bench), "p", "hit", 10, "key"), "bin")


@query("sco_3_calibration_error", CAL_SQL + ", bn AS (SELECT ntile(10) OVER (ORDER BY p, key) AS bin, p, hit FROM ks), b2 AS (SELECT count(*) AS n, avg(p) AS mp, avg(hit) AS f FROM bn GROUP BY bin) SELECT round(sum(n * abs(mp - f)) / sum(n), 6) AS ece FROM b2", **PAIR)
def ece(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(scoring.calibration_error(scoring.calibration(_calibrated(spark, sf_dir, bars, bench), "p", "hit", 10, "key")))


@query(
    "sco_4_murphy",
    CAL_SQL + """, b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS f, avg(hit) AS o FROM ks GROUP BY ALL), t AS (SELECT sum(n) AS a, sum(n * o) / sum(n) AS base FROM b)
    SELECT round(sum(n * (f - o) * (f - o)) / any_value(a), 6) AS reliability, round(sum(n * (o - base) * (o - base)) / any_value(a), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM b, t""",
    **PAIR,
)
def murphy(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(scoring.murphy(_calibrated(spark, sf_dir, bars, bench), "p", "hit"))


MONTH_SQL = PROB_SQL + ", mm AS (SELECT month, avg(brier) AS loss, avg(sl.reference) AS ref, avg(brier) - avg(sl.reference) AS difference, count(*) AS n FROM sl GROUP BY month)"


@query("sco_5_month_means", MONTH_SQL + " SELECT month, " + rnd(loss="loss", reference="ref", difference="difference") + ", n FROM mm", **PAIR)
def months(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(scoring.month_means(_scored(spark, sf_dir, bars, bench), "brier", "reference"), "month")


@query("sco_6_risk_coverage", CAL_SQL + ", rc AS (SELECT row_number() OVER o AS k, count(*) OVER () AS n, avg(brier) OVER (o ROWS UNBOUNDED PRECEDING) AS risk FROM ks WINDOW o AS (ORDER BY p DESC, key)) SELECT CAST(ceil(k * 10 / n) AS INT) AS tenth, round(arg_max(risk, k), 6) AS risk, max(k) AS covered FROM rc GROUP BY ALL", **PAIR)
def risk_coverage(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return rounded(scoring.risk_coverage(_calibrated(spark, sf_dir, bars, bench), "p", "brier", "key"), "tenth")


@query(
    "sco_9_diebold_mariano",
    MONTH_SQL + """, d AS (SELECT month, difference - avg(difference) OVER () AS d, difference FROM mm), g AS (SELECT *, d * lag(d, 1) OVER w AS g1, d * lag(d, 2) OVER w AS g2, d * lag(d, 3) OVER w AS g3 FROM d WINDOW w AS (ORDER BY month)),
    s AS (SELECT avg(difference) AS mean, count(*) AS n, sqrt(greatest(sum(d * d) + 2 * 0.75 * sum(g1) + 2 * 0.5 * sum(g2) + 2 * 0.25 * sum(g3), 0)) / count(*) AS se FROM g)
    SELECT round(mean, 6) AS mean, n, round(se, 6) AS se, round(mean / nullif(se, 0), 4) AS t FROM s""",
    **PAIR,
)
def diebold(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    out = scoring.dm_test(scoring.month_means(_scored(spark, sf_dir, bars, bench), "brier", "reference"), 3)
    return out.select(F.round("mean", 6).alias("mean"), "n", F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query("sco_10_holm", "t AS (SELECT * FROM (VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', 0.2)) AS t(name, p)), r AS (SELECT name, p, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS raw FROM t) SELECT name, CAST(p AS DOUBLE) AS p, CAST(least(1, max(raw) OVER (ORDER BY p, name)) AS DOUBLE) AS adjusted FROM r", bars="market_week")
def holm(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return scoring.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.2)], "name string, p double"), "p", "name")


@query(
    "sco_15_rank_ic",
    f"""f AS (SELECT symbol, ts, round(close / lag(close, 20) OVER w - 1, 9) AS s, round(lead(close, 5) OVER w / close - 1, 9) AS o FROM bars WINDOW w AS ({W})), g AS (SELECT * FROM f WHERE s IS NOT NULL AND o IS NOT NULL),
    r AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY s) + (count(*) OVER (PARTITION BY ts, s) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY ts ORDER BY o) + (count(*) OVER (PARTITION BY ts, o) - 1) / 2.0::DOUBLE AS ro FROM g)
    SELECT ts, round(corr(rs, ro), 6) + 0.0::DOUBLE AS ic, count(*) AS n FROM r GROUP BY ts""",
    bars="brand_week",
)
def rank_ic(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = bars.select("symbol", "ts", F.round(F.col("close") / lag("close", 20) - 1, 9).alias("s"), F.round(F.lead("close", 5).over(by()) / F.col("close") - 1, 9).alias("o")).where("s is not null and o is not null")
    return rounded(scoring.rank_ic(rows, "s", "o"), "ts")


# --- registries ---------------------------------------------------------------------------------------------------------

REG_SQL = f"""cm AS (SELECT max(ts) AS cutoff FROM bench GROUP BY date_trunc('month', ts)),
    rp AS (SELECT symbol, ts, row_number() OVER w - 1 AS pos, CAST(sum((volume = 0)::INT) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS zero_volume, quantile_cont(close * volume, 0.5) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS turnover FROM bars WINDOW w AS ({W})),
    rg AS (SELECT symbol, cutoff, pos + 1 AS rows, zero_volume, turnover, CASE WHEN zero_volume > greatest(5, floor((pos + 1) * 0.02)) THEN 'B' ELSE 'A' END AS tier FROM rp JOIN cm ON ts = cutoff WHERE pos >= 251),
    rs AS (SELECT *, CASE WHEN 3 * row_number() OVER o <= count(*) OVER (PARTITION BY cutoff) THEN 'low' WHEN 3 * row_number() OVER o <= 2 * count(*) OVER (PARTITION BY cutoff) THEN 'middle' ELSE 'high' END AS stratum FROM rg WINDOW o AS (PARTITION BY cutoff ORDER BY round(turnover, 6), symbol)),
    rd AS (SELECT *, sha256('["r1","' || strftime(cutoff, '%Y-%m-%d') || '","' || tier || '","' || stratum || '","' || symbol || '"]') AS digest FROM rs),
    rk AS (SELECT *, row_number() OVER (PARTITION BY cutoff, tier, stratum ORDER BY digest, symbol) AS place FROM rd)"""


def _prefixes(bars: DataFrame, bench: DataFrame) -> DataFrame:
    return G.measure(bars, calendars.month_ends(bench).select("cutoff"))


@query("reg_1_prefix_measures", REG_SQL + " SELECT symbol, cutoff, rows, zero_volume, round(turnover, 4) AS turnover, tier FROM rg", **PAIR)
def prefix_measures(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return _prefixes(bars, bench).select("symbol", "cutoff", "rows", "zero_volume", F.round("turnover", 4).alias("turnover"), "tier")


@query("reg_2_select", REG_SQL + " SELECT symbol, cutoff, tier, stratum, digest, place FROM rk WHERE place <= 2", **PAIR)
def select(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return G.select(G.stratify(_prefixes(bars, bench)), 2, "r1").select("symbol", "cutoff", "tier", "stratum", "digest", "place")


@query("reg_2_shortfall", REG_SQL + ", gr AS (SELECT cutoff, tier, stratum FROM (SELECT DISTINCT cutoff FROM rk), (VALUES ('A'), ('B')) AS t(tier), (VALUES ('low'), ('middle'), ('high')) AS s(stratum)) SELECT gr.cutoff, gr.tier, gr.stratum, 2 - count(place) AS shortfall FROM gr LEFT JOIN rk ON rk.cutoff = gr.cutoff AND rk.tier = gr.tier AND rk.stratum = gr.stratum AND place <= 2 GROUP BY ALL", **PAIR)
def shortfall(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    return G.shortfall(G.select(G.stratify(_prefixes(bars, bench)), 2, "r1"), 2)


@query("reg_3_folds", "SELECT ts, CASE WHEN ts < TIMESTAMP '1995-01-01' THEN 'warmup' WHEN ts <= TIMESTAMP '1996-12-31' THEN 'f1' WHEN ts <= TIMESTAMP '1998-06-30' AND ts >= TIMESTAMP '1997-01-01' THEN 'f2' ELSE 'warmup' END AS fold FROM bars", bars="market_day")
def folds(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return G.assign_folds(bars.select("ts"), "ts", [("f1", "1995-01-01", "1996-12-31"), ("f2", "1997-01-01", "1998-06-30")])


@query(
    "reg_5_regimes",
    "r AS (SELECT ts, close / lag(close, 251) OVER (ORDER BY ts) - 1 AS trend FROM bars) SELECT ts, round(trend, 6) AS trend, CASE WHEN trend > 0.1 THEN 'up' WHEN trend < -0.1 THEN 'down' ELSE 'sideways' END AS regime, CASE WHEN year(ts) < 2010 THEN 'pre-2010' WHEN year(ts) < 2020 THEN '2010s' ELSE '2020s' END AS era FROM r WHERE trend IS NOT NULL",
    bars="market_day",
)
def regimes(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(G.regimes(bars, 252), "ts")


@query(
    "reg_6_expanding_terciles",
    f"""a AS (SELECT ts, close / lag(close, 126) OVER w - 1 AS trend, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (ORDER BY ts)), b AS (SELECT *, CASE WHEN count(r) OVER f >= 20 THEN stddev_pop(r) OVER f END AS vol FROM a WINDOW f AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    m AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, arg_max(trend, ts) AS trend, arg_max(vol, ts) AS vol FROM b WHERE trend IS NOT NULL GROUP BY ALL),
    q AS (SELECT *, count(vol) OVER p AS k, quantile_cont(vol, 0.3333333333333333) OVER p AS lo, quantile_cont(vol, 0.6666666666666666) OVER p AS hi FROM m WINDOW p AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT month, CASE WHEN trend > 0 THEN 'up' WHEN trend < 0 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN k < 2 THEN 'insufficient' WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'middle' ELSE 'high' END AS volatility FROM q""",
    bars="market_day",
)
def expanding_terciles(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return G.expanding_regimes(bars)


@query("reg_7_8_contamination", REG_SQL + ", us AS (SELECT DISTINCT symbol FROM rk WHERE place <= 1 AND cutoff < TIMESTAMP '1996-01-01') SELECT symbol, cutoff FROM rk WHERE place <= 2 AND symbol NOT IN (SELECT symbol FROM us)", **PAIR)
def contamination(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    chosen = G.select(G.stratify(_prefixes(bars, bench)), 2, "r1")
    return G.without_used(chosen, [chosen.where("place <= 1 and cutoff < timestamp'1996-01-01'").select("symbol")]).select("symbol", "cutoff")
