"""Queries on checked joins, null draws, array distances, portability and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions.rolling import by
from recurra.operators import controls, scoring, weighted
from recurra.plans.features import W, rounded
from recurra.plans.forecasts import LINK_SQL, PROB_SQL, _links, _scored
from recurra.plans.outcomes import FEATS_SQL, MATCH_SQL, PAIR, _feats, _matches
from recurra.plans.registry import query
from recurra.sources import bars as B
from recurra.sources import stores


@query("joi_6_checked_join", MATCH_SQL + " SELECT m.ts, event, control, round(ret_20, 6) + 0.0::DOUBLE AS ret_20 FROM m LEFT JOIN b ON b.ts = m.ts AND b.symbol = m.control", bars="brand_week")
def checked(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    right = _feats(bars).select("ts", F.col("symbol").alias("control"), F.round("ret_20", 6).alias("ret_20"))
    return controls.checked_join(_matches(bars), right, ["ts", "control"]).select("ts", "event", "control", "ret_20")


@query("joi_8_semi_anti", FEATS_SQL + ", u AS (SELECT symbol FROM b WHERE ret_20 > 0.3) SELECT symbol, 'used' AS side, count(*) AS n FROM b WHERE symbol IN (SELECT symbol FROM u) GROUP BY symbol UNION ALL SELECT symbol, 'free', count(*) FROM b WHERE symbol NOT IN (SELECT symbol FROM u) GROUP BY symbol", bars="brand_week")
def semi_anti(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    f = _feats(bars)
    used = f.where("ret_20 > 0.3").select("symbol").distinct()
    count = lambda how, side: f.join(used, "symbol", how).groupBy("symbol").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return count("left_semi", "used").unionByName(count("left_anti", "free")).select("symbol", "side", "n")


@query("joi_10_two_roles", MATCH_SQL + " SELECT m.ts, event, control, round(e.vol_20, 6) AS event_vol_20, round(c.vol_20, 6) AS control_vol_20 FROM m LEFT JOIN b AS e ON e.ts = m.ts AND e.symbol = event LEFT JOIN b AS c ON c.ts = m.ts AND c.symbol = control", bars="brand_week")
def roles(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return rounded(controls.two_roles(_matches(bars).select("ts", "event", "control"), _feats(bars), ["vol_20"]), "ts", "event", "control")


@query("out_8_request_conflicts", "r AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, ts FROM bars) SELECT symbol, month, count(DISTINCT ts) AS values, count(*) AS requests FROM r GROUP BY ALL HAVING count(DISTINCT ts) > 1", bars="brand_week")
def conflicts(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return controls.conflicts(bars.select("symbol", F.date_trunc("month", "ts").alias("month"), "ts"), ["symbol", "month"], "ts")


@query("reg_4_bind_prefixes", bars="brand_week", bench="market_week")
def bind(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    queries = B.instruments(bars).withColumn("cutoff", F.lit("1996-06-30"))
    return controls.bind_prefixes(queries, B.prefix_digest(bars, "1996-06-30"), B.prefix_digest(bench, "1996-06-30"))


ARRAY_SQL = f"""p AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars), a AS (SELECT symbol, list(ln(close) ORDER BY back DESC) AS v FROM p WHERE back <= 32 GROUP BY symbol), q AS (SELECT v AS w FROM a WHERE symbol = 'Brand#1'),
    j AS (SELECT symbol, v, w, list_concat(v, w) AS u FROM a, q), s AS (SELECT symbol, v, w, (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM (SELECT unnest(u) AS x)) AS iqr, (SELECT stddev_pop(x) FROM (SELECT unnest(u) AS x)) AS sd FROM j),
    k AS (SELECT *, greatest(CASE WHEN iqr < 1e-8 THEN sd ELSE iqr END, 1e-6) AS scale, greatest(sd, 1e-6) AS coarse FROM s)"""


def quantile(x: F.Column, level: float) -> F.Column:
    """Linear quantile of an array."""
    s, at = F.sort_array(x), level * (F.size(x) - 1)
    low = F.floor(at).cast("int")
    return F.get(s, low) + (F.get(s, F.least(low + 1, F.size(x) - 1)) - F.get(s, low)) * (at - low)


def array_mean(x: F.Column) -> F.Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def array_rms(x: F.Column, y: F.Column, scale: F.Column) -> F.Column:
    return F.sqrt(array_mean(F.zip_with(x, y, lambda a, b: (a - b) * (a - b) / (scale * scale))))


def deviation(x: F.Column) -> F.Column:
    return F.sqrt(F.greatest(F.lit(0.0), array_mean(F.transform(x, lambda v: v * v)) - array_mean(x) * array_mean(x)))


@query(
    "dst_1_to_4_array_distances",
    ARRAY_SQL + " SELECT symbol, round(scale, 6) AS scale, round(list_distance(v, w) / sqrt(32) / scale, 6) AS channel, round(list_distance(v, w) / sqrt(32) / coarse, 5) AS coarse, round(list_distance(v, w) / sqrt(32), 6) AS plain FROM k WHERE len(v) = 32",
    bars="brand_week",
)
def arrays(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """The scaled, coarse and plain distances of each symbol's last 32 log closes to one symbol's, as array expressions."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    rows = bars.withColumn("back", back).where("back <= 32").groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("back"), F.log("close").alias("v")))), lambda x: x["v"]).alias("v")).where("size(v) = 32")
    asked = rows.where("symbol = 'Brand#1'").select(F.col("v").alias("w"))
    joined = rows.crossJoin(F.broadcast(asked)).withColumn("u", F.concat("v", "w"))  # one row
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    iqr = quantile(u, 0.75) - quantile(u, 0.25)
    joined = joined.withColumns({"scale": F.greatest(F.when(iqr < 1e-8, deviation(u)).otherwise(iqr), F.lit(1e-6)), "cs": F.greatest(deviation(u), F.lit(1e-6))})
    return joined.select("symbol", F.round("scale", 6).alias("scale"), F.round(array_rms(v, w, F.col("scale")), 6).alias("channel"), F.round(array_rms(v, w, F.col("cs")), 5).alias("coarse"), F.round(array_rms(v, w, F.lit(1.0)), 6).alias("plain"))


@query(
    "agg_18_conditional_draws",
    "s AS (SELECT symbol AS member, substr(symbol, 7, 1) AS cell FROM bars GROUP BY symbol), r AS (SELECT *, CAST(i AS INT) AS replicate, sha256('d1|' || i || '|' || member) AS priority FROM s, range(20) AS r(i)), p AS (SELECT *, row_number() OVER (PARTITION BY replicate, cell ORDER BY priority, member) AS place FROM r) SELECT replicate, cell, member, place FROM p WHERE place <= 2",
    bars="brand_week",
)
def conditional(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    cells = B.instruments(bars).select(F.col("symbol").alias("member"), F.substring("symbol", 7, 1).alias("cell"), F.lit(2).alias("take"))
    return controls.draws(cells, 20, "d1").select("replicate", "cell", "member", "place")


@query("agg_11_mixture", PROB_SQL + " SELECT symbol, " + ", ".join(f"round(0.7 * p_{c} + 0.3 / 3, 6) AS p_{c}" for c in scoring.CLASSES) + " FROM pr", **PAIR)
def mixture(spark: SparkSession, sf_dir: str, bars: DataFrame, bench: DataFrame) -> DataFrame:
    p = _scored(spark, sf_dir, bars, bench).select("symbol", *[F.col(f"p_{c}").alias(f"own_{c}") for c in scoring.CLASSES], *[F.lit(1 / 3).alias(f"flat_{c}") for c in scoring.CLASSES]).distinct()
    mixed = controls.mixture([(0.7, "own"), (0.3, "flat")], scoring.CLASSES)
    return rounded(p.withColumns(mixed).select("symbol", *mixed), "symbol")


@query("sco_14_causal_order", LINK_SQL + " SELECT count(*) AS violations FROM lk WHERE eligible AND completion > q_cutoff", bars="brand_week")
def causal_order(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return controls.causal_order(_links(bars).where("eligible").withColumnRenamed("q_cutoff", "cutoff")).agg(F.count("*").alias("violations"))


@query(
    "sco_16_entry_report",
    FEATS_SQL + f""", o AS (SELECT symbol, ts, lead(close, 20) OVER ({W}) / close - 1 AS outcome FROM bars), r AS (SELECT year(b.ts) AS year, ret_20, outcome FROM b JOIN o ON o.symbol = b.symbol AND o.ts = b.ts WHERE outcome IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY ret_20) / count(*) OVER (PARTITION BY year) > 0.5 AS kept FROM r)
    SELECT CAST(year AS INT) AS year, count(*) AS n, round(avg(outcome), 6) + 0.0::DOUBLE AS all_mean, round(avg(outcome) FILTER (kept), 6) + 0.0::DOUBLE AS kept_mean, round(avg(outcome) FILTER (kept) - avg(outcome), 6) + 0.0::DOUBLE AS lift, round(sum(outcome) FILTER (kept AND outcome > 0) / -sum(outcome) FILTER (kept AND outcome < 0), 6) AS profit_factor FROM k GROUP BY year""",
    bars="brand_week",
)
def entry_report(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    ahead = bars.select("symbol", "ts", (F.lead("close", 20).over(by()) / F.col("close") - 1).alias("outcome"))
    return rounded(controls.entry_report(_feats(bars).join(ahead, ["symbol", "ts"]).where("outcome is not null"), "ret_20"), "year")


@query(
    "sco_13_abstention",
    LINK_SQL + """, e AS (SELECT query_id, sum(w) * sum(w) / sum(w * w) AS ess, avg(CASE WHEN match_rank <= 10 THEN close_return END) AS a, avg(close_return) AS c FROM wl GROUP BY query_id),
    v AS (SELECT query_id, any_value(q_cutoff) AS t, min(score) AS novelty FROM nb JOIN qs USING (query_id) GROUP BY query_id), w2 AS (SELECT query_id, novelty, count(*) OVER o AS priors, quantile_cont(novelty, 0.95) OVER o AS q95 FROM v WINDOW o AS (ORDER BY t, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT query_id, concat_ws(',', CASE WHEN ess < 10 THEN 'low_effective_sample' END, CASE WHEN priors >= 250 AND novelty > q95 THEN 'novel_query' END, CASE WHEN abs(a - c) > 0.2 THEN 'unstable_prefixes' END) AS reasons FROM e JOIN w2 USING (query_id)""",
    bars="brand_week",
)
def abstention(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    rows = _links(bars).withColumn("w", weighted.rank_weight("match_rank")).groupBy("query_id", "q_cutoff").agg(
        weighted.effective_size("w").alias("ess"), F.abs(F.avg(F.when(F.col("match_rank") <= 10, F.col("close_return"))) - F.avg("close_return")).alias("spread"), F.min("score").alias("novelty")
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("q_cutoff", "query_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each query
    known = rows.withColumns({"priors": F.count("*").over(earlier), "prior_novelty": F.percentile("novelty", F.lit(0.95)).over(earlier)})
    return scoring.abstentions(known).select("query_id", "reasons")


@query("src_1_3_portability", "SELECT symbol, count(*) * 4 AS n, 4 AS variants, 1 AS distinct_sums FROM bars GROUP BY symbol", bars="brand_week")
def portability(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """The same bars written as CSV and Parquet, as one file for each symbol and as a long table, and read back."""
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file:///tmp/checkpoints').rstrip('/')}/portability-{uuid.uuid4().hex}"
    text = bars.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), *[F.col(c).alias(c.upper()) for c in (*B.PRICES, "volume")])
    names, out = {c.upper(): c for c in (*B.PRICES, "volume")}, None
    for form in ("csv", "parquet"):
        text.write.format(form).option("header", True).save(f"{root}/long-{form}")
        text.write.format(form).option("header", True).partitionBy("symbol").save(f"{root}/parts-{form}")
        for layout in ("long", "parts"):
            spec = B.DatasetSpec(f"{layout}-{form}", f"{root}/{layout}-{form}", "long_table", form, names)
            part = B.read(spark, spec)
            out = part if out is None else out.unionByName(part)
    sums = out.groupBy("symbol", "dataset_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("close") * 1e6).cast("long")).alias("s"))
    return sums.groupBy("symbol").agg(F.sum("n").alias("n"), F.count("*").alias("variants"), F.count_distinct("s").alias("distinct_sums"))


@query("snk_3_generation", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol", bars="brand_week")
def generation(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file:///tmp/checkpoints').rstrip('/')}/generation-{uuid.uuid4().hex}"
    stores.write_generation(bars, root, "symbol")
    return stores.read_active(spark, root).groupBy("symbol").agg(F.count("*").alias("n"))
