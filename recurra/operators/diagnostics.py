"""Evidence of a search, predictions from neighbours, and diagnostics of forecasts and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.operators.events import average_rank
from recurra.operators.weighted import effective_size, rank_weight, smoothed_probabilities, weighted_quantiles

CLASSES = ("favorable_first", "adverse_first", "no_touch")
#: Eligible outcomes from which a summary is taken for a description.
LEAST = 5


def search_evidence(matches: DataFrame, outcomes: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per query, match and horizon: the outcome, and why it counts or doesn't.

    matches: query_id, rank, symbol, cutoff. outcomes: symbol, cutoff, horizon, completion, close_return, mfe, mae, label
    (null where the sessions run out). cutoffs: query_id, q_cutoff. An outcome counts once it was complete at the query's cutoff.
    """
    rows = matches.join(outcomes, ["symbol", "cutoff"]).join(F.broadcast(cutoffs), "query_id")  # a row for each query
    complete = F.col("completion").isNotNull()
    reason = F.when(~complete, "incomplete_outcome").when(F.col("completion") > F.col("q_cutoff"), "outcome_not_yet_observable").otherwise("eligible")
    return rows.withColumns({"complete": complete, "reason": reason}).drop("q_cutoff")


def evidence_summary(rows: DataFrame) -> DataFrame:
    """Per query and horizon, over eligible outcomes."""
    ok = F.col("reason") == "eligible"
    own = lambda c: F.when(ok, F.col(c))
    q = lambda c, p: F.percentile(own(c), F.lit(p))
    share = lambda x: F.avg(x.cast("int"))
    return rows.groupBy("query_id", "horizon").agg(
        F.count("*").alias("retrieved"), F.count_if("complete").alias("complete"), F.count_if(ok).alias("eligible"), F.count_if(F.col("reason") == "outcome_not_yet_observable").alias("not_yet_observable"),
        q("close_return", 0.5).alias("median_return"), q("close_return", 0.25).alias("return_q25"), q("close_return", 0.75).alias("return_q75"), share(own("close_return") > 0).alias("positive_rate"),
        share(own("close_return") >= 0.25).alias("gain_25pct_rate"), q("mfe", 0.5).alias("median_mfe"), q("mae", 0.5).alias("median_mae"),
        share(own("label") == "favorable_first").alias("favorable_first_rate"), share(own("label") == "adverse_first").alias("adverse_first_rate"), (F.count_if(ok) >= LEAST).alias("enough"),
    )


def lanes(rows: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """rows (match_rank, ...) for each prefix of ranks, with rank weights and with equal ones: prefix, weighted, w."""
    each = rows.withColumn("prefix", F.explode(F.array(*[F.lit(p) for p in prefixes]))).where("match_rank <= prefix")
    each = each.withColumn("weighted", F.explode(F.array(F.lit(True), F.lit(False))))
    return each.withColumn("w", F.when(F.col("weighted"), rank_weight("match_rank")).otherwise(1.0))


def route_predictions(rows: DataFrame, prefixes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per query, prefix and weighting: smoothed probabilities of the three routes and of the two directions, and what was left out.

    rows: query_id, match_rank, route (null: unavailable; other names than the three are counted and left out).
    """
    keys = ["query_id", "prefix", "weighted"]
    each = lanes(rows, prefixes)
    three, two = each.where(F.col("route").isin(*CLASSES)), each.where(F.col("route").isin(*CLASSES[:2]))
    n = lambda c: F.count_if(F.col("route") == c)
    counts = each.groupBy(*keys).agg(
        F.count_if(F.col("route").isin(*CLASSES)).alias("eligible"), effective_size(F.when(F.col("route").isin(*CLASSES), F.col("w"))).alias("ess"), n("favorable_first").alias("n_favorable"), n("adverse_first").alias("n_adverse"),
        n("no_touch").alias("n_no_touch"), n("ambiguous_same_first_touch_bar").alias("n_ambiguous"), n("censored").alias("n_censored"), F.count_if(F.col("route").isNull()).alias("n_unavailable"),
    )
    out = counts.join(smoothed_probabilities(three, keys, "route", "w", CLASSES), keys, "left")
    directions = smoothed_probabilities(two, keys, "route", "w", CLASSES[:2]).select(*keys, F.col("p_favorable_first").alias("d_favorable_first"))
    uniform = {**{f"p_{c}": F.coalesce(f"p_{c}", F.lit(1 / 3)) for c in CLASSES}, "d_favorable_first": F.coalesce("d_favorable_first", F.lit(0.5)), "ess": F.coalesce("ess", F.lit(0.0))}
    return out.join(directions, keys, "left").withColumns(uniform)


def continuous_predictions(rows: DataFrame, value: str, levels: tuple[float, ...] = (0.1, 0.5, 0.9), prefixes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per query, prefix and weighting: first values whose running weight reaches each level; null without values."""
    keys = ["query_id", "prefix", "weighted"]
    each = lanes(rows, prefixes)
    q = weighted_quantiles(each, keys, value, "w", levels)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("level") == x, F.col("q"))).alias(f"q{round(100 * x)}") for x in levels])
    return each.groupBy(*keys).agg(F.count(value).alias("n")).join(wide, keys, "left")


def quintiles(rows: DataFrame, group: list[str], value: str, key: str) -> Column:
    """Q1 to Q5 by place in the group, `unavailable` for null."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*group, known)
    place = F.row_number().over(w.orderBy(value, key)) / F.count("*").over(w)
    return F.when(known, F.concat(F.lit("Q"), F.least(F.lit(5), F.ceil(place * 5)).cast("string"))).otherwise("unavailable")


def segments(rows: DataFrame, scope: str, dimension: str, loss: str, reference: str, least: int = 1) -> DataFrame:
    """Per scope and value of a dimension: both mean losses, their difference, skill and the share of rows that improve."""
    out = rows.groupBy(scope, F.col(dimension).cast("string").alias("value")).agg(
        F.count("*").alias("n"), F.avg(loss).alias("loss"), F.avg(reference).alias("reference"), F.avg((F.col(loss) < F.col(reference)).cast("int")).alias("improved"),
    )
    return out.where(F.col("n") >= least).withColumns({"difference": F.col("loss") - F.col("reference"), "skill": 1 - F.try_divide("loss", F.nullif("reference", F.lit(0.0)))})


def probability_behavior(rows: DataFrame, scope: str, label: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Per scope and class: frequency, mean probability, bias, Brier part, deviation, and the area under the curve against the rest."""
    each = rows.select(scope, F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p")) for c in classes])).alias("x")).select(scope, "label", "x.class", "x.p")
    each = each.withColumn("hit", (F.col("label") == F.col("class")).cast("int")).withColumn("rank", average_rank([scope, "class"], "p"))
    hits = F.sum("hit")
    out = each.groupBy(scope, "class").agg(
        F.count("*").alias("n"), F.avg("hit").alias("frequency"), F.avg("p").alias("mean_p"), F.avg((F.col("p") - F.col("hit")) * (F.col("p") - F.col("hit"))).alias("brier_part"), F.stddev_pop("p").alias("deviation"),
        F.try_divide(F.sum(F.col("rank") * F.col("hit")) - hits * (hits + 1) / 2, F.nullif((hits * (F.count("*") - hits)).cast("double"), F.lit(0.0))).alias("auc"),
    )
    return out.withColumn("bias", F.col("mean_p") - F.col("frequency"))


def cohesion(pairs: DataFrame, key: str, distance: str) -> DataFrame:
    """Mean distance of the pairs of each key."""
    return pairs.groupBy(key).agg(F.avg(distance).alias("cohesion"), F.count("*").alias("pairs"))


def specificity(rows: DataFrame, query: str, member: str, distance: str) -> DataFrame:
    """Per member: mean over queries of its midrank percentile, (rank - 0.5) / n with ties at their mean, among the query's members."""
    pct = (average_rank([query], distance) - 0.5) / F.count("*").over(Window.partitionBy(query))
    return rows.withColumn("pct", pct).groupBy(member).agg(F.avg("pct").alias("specificity"), F.count("*").alias("queries"))


def joined_iqr(left: Column, right: Column) -> Column:
    """Interquartile range, by linear interpolation, of two arrays together."""
    both = F.sort_array(F.concat(left, right))
    place = lambda p: (F.size(both) - 1) * p

    def at(p: float) -> Column:
        low = F.floor(place(p)).cast("int")
        a, b = F.get(both, low), F.get(both, F.least(low + 1, F.size(both) - 1))
        return a + (b - a) * (place(p) - low)

    return at(0.75) - at(0.25)


def identity_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the identity columns that one side has and the other doesn't, copies counted."""
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).unionAll(b.exceptAll(a))
