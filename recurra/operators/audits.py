"""Checks of searches and forecasts: coverage, calibration, labels of neighbours, recall, losses on the way, stores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.operators import scoring
from recurra.operators.events import average_rank


def coverage_gate(rows: DataFrame, fold: str, evaluable: str, forecasted: str, least: float = 0.9, folds: int = 4) -> DataFrame:
    """Per fold: rows, those whose outcome can be judged, those of them with a forecast, the share; and overall, whether it passes.

    Passes with enough folds, every judged row forecast, and the share at the floor in each fold and overall.
    """
    own = rows.groupBy(fold).agg(F.count("*").alias("registered"), F.count_if(evaluable).alias("evaluable"), F.count_if(F.col(evaluable) & F.col(forecasted)).alias("forecasted"))
    every = Window.partitionBy(F.lit(0))  # a row for each fold
    own = own.withColumns({"fraction": F.col("evaluable") / F.col("registered"), "overall": F.sum("evaluable").over(every) / F.sum("registered").over(every)})
    whole = (F.sum("forecasted").over(every) == F.sum("evaluable").over(every)) & (F.count("*").over(every) >= folds)
    return own.withColumn("passed", whole & (F.col("overall") >= least) & (F.min("fraction").over(every) >= least))


def monthly_residuals(rows: DataFrame, classes: Sequence[str], time: str = "cutoff", label: str = "label") -> DataFrame:
    """Per month and class: the mean of probability less outcome."""
    each = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(f"p_{c}") - (F.col(label) == c).cast("int")).alias("residual")) for c in classes])
    flat = rows.select(F.date_trunc("month", time).alias("month"), F.explode(each).alias("x")).select("month", "x.*")
    return flat.groupBy("class", "month").agg(F.avg("residual").alias("residual"))


def calibration_gate(months: dict[str, np.ndarray], block: int = 6, draws: int = 10_000, seed: int = 20_260_931) -> list[dict]:
    """Per class: mean monthly residual, its simultaneous interval, p of a moving-block test, Holm's p, whether it is rejected.

    months: for each class the residuals in order of months. The gate passes when no class is rejected.
    """
    out, tail = [], 0.05 / (2 * len(months))
    for i, (c, x) in enumerate(months.items()):
        if len(x) < block:
            raise ValueError(f"{len(x)} months of {c}, fewer than a block of {block}")
        means, mean = scoring.moving_block_means(x, block, draws, seed + i), float(np.mean(x))
        mean = 0.0 if abs(mean) <= 16 * np.finfo(float).eps else mean
        low, high = np.quantile(means, [tail, 1 - tail])
        out.append({"class": c, "mean": mean, "low": float(low), "high": float(high), "p": (1 + int((np.abs(means - mean) >= abs(mean)).sum())) / (draws + 1)})
    worst = 0.0
    for i, row in enumerate(sorted(out, key=lambda r: (r["p"], r["class"]))):
        worst = max(worst, min(1.0, row["p"] * (len(out) - i)))
        row |= {"adjusted": worst, "rejected": worst < 0.05}
    return out


#: Gates of the decision that the caller has judged elsewhere.
JUDGED = ("coverage", "calibration", "leakage", "determinism", "performance")


def improvement_gates(skills: dict[str, dict[str, float]], logs: dict[str, float], inference: dict[str, dict[str, float]], adjusted: dict[str, float], judged: dict[str, bool]) -> dict[str, bool]:
    """Each gate of the final decision, which is their conjunction.

    skills: per scope (`all` and each fold) the Brier skill against each comparator; logs: log loss less each comparator's;
    inference: per comparator `upper` of the paired monthly difference; adjusted: Holm's p per comparator.
    """
    folds = [s for scope, s in skills.items() if scope != "all"]
    if len(folds) < 4:
        raise ValueError("at least four folds are needed")
    return {
        "positive_skill": all(v > 0 for v in skills["all"].values()), "holm_below_5_percent": all(p < 0.05 for p in adjusted.values()),
        "upper_bounds_below_zero": all(v["upper"] < 0 for v in inference.values()), "no_negative_fold": all(v > 0 for s in folds for v in s.values()),
        "log_loss_not_worse": all(v <= 0 for v in logs.values()), **{k: bool(judged[k]) for k in JUDGED},
    }


# --- labels of neighbours ------------------------------------------------------------------------------------------------


def label_agreement(neighbours: DataFrame, k: int) -> DataFrame:
    """Per query with k neighbours: whether the first has its label, how many of k do. neighbours: query_id, rank, q_label, label."""
    near = neighbours.where(F.col("rank") <= k)
    out = near.groupBy("query_id", "q_label").agg(F.count("*").alias("n"), F.max(((F.col("rank") == 1) & (F.col("label") == F.col("q_label"))).cast("int")).alias("top1"), F.count_if(F.col("label") == F.col("q_label")).alias("same"))
    return out.where(F.col("n") == k).drop("n")


def hashed_fraction(*parts: str | Column) -> Column:
    """48 bits of a hash of the parts, as an integer."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long")


def label_draws(support: DataFrame, labelled: DataFrame, k: int, replicates: int, seed: str) -> DataFrame:
    """For each replicate and query the agreement of k random symbols' random candidates: replicate, query_id, top1, same.

    support: query_id, q_label, symbol, n (a query's candidates of a symbol are its first n by number). labelled: symbol,
    number, label. A draw picks symbols in the order of a hash and a candidate's number by another, so nothing but the k
    drawn rows of each replicate is ever expanded.
    """
    each = support.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    parts = (F.lit(seed), F.col("replicate").cast("string"), F.col("query_id"), F.col("symbol"))
    w = Window.partitionBy("replicate", "query_id").orderBy("h", "symbol")
    drawn = each.withColumn("h", hashed_fraction(*parts)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    drawn = drawn.withColumn("number", hashed_fraction(*parts, F.lit("c")) % F.col("n") + 1)
    got = drawn.join(labelled.select("symbol", "number", "label"), ["symbol", "number"])
    hit = F.col("label") == F.col("q_label")
    return got.groupBy("replicate", "query_id").agg(F.max(((F.col("rank") == 1) & hit).cast("int")).alias("top1"), F.count_if(hit).alias("same"))


def replicate_totals(draws: DataFrame) -> DataFrame:
    """Per replicate: sums over queries."""
    return draws.groupBy("replicate").agg(F.sum("top1").alias("top1"), F.sum("same").alias("same"), F.count("*").alias("queries"))


def chunk_faults(chunks: DataFrame, replicates: int) -> DataFrame:
    """Replicates that no chunk covers or that more than one does: replicate, covered. chunks: start, n."""
    spread = chunks.select(F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("replicate"))
    wanted = chunks.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    covered = spread.groupBy("replicate").agg(F.count("*").alias("covered"))
    both = wanted.withColumn("wanted", F.lit(True)).join(covered, "replicate", "full")
    return both.where(F.col("wanted").isNull() | (F.coalesce("covered", F.lit(0)) != 1)).select("replicate", F.coalesce("covered", F.lit(0)).alias("covered"))


# --- how much of an exact result a cheaper search keeps -----------------------------------------------------------------


def coarse_pool(rows: DataFrame, size: int) -> DataFrame:
    """The nearest of each query by the coarse distance, with their place. rows: query_id, episode_id, coarse, ..."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("coarse", "episode_id"))).where(F.col("place") <= size)


def saturation(pool: DataFrame, sizes: Sequence[int], k: int) -> DataFrame:
    """Per query and pool size: the share of the largest pool's k nearest by the exact distance that the smaller pool has too."""
    w = Window.partitionBy("query_id", "size").orderBy("exact", "episode_id")
    each = pool.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("place <= size")
    best = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    truth = best.where(F.col("size") == max(sizes)).select("query_id", "episode_id", F.lit(1).alias("hit"))
    n = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    return best.join(truth, ["query_id", "episode_id"], "left").groupBy("query_id", "size").agg(F.count("hit").alias("found")).join(n, "query_id").select("query_id", "size", (F.col("found") / F.col("n")).alias("recall"))


def rank_agreement(pool: DataFrame) -> DataFrame:
    """Per query: Spearman's correlation of coarse and exact distances in its pool, and the pool's size."""
    r = pool.withColumns({"_c": average_rank(["query_id"], "coarse"), "_e": average_rank(["query_id"], "exact")})
    return r.groupBy("query_id").agg(F.count("*").alias("pool"), F.corr("_c", "_e").alias("spearman"))


def recall_cases(authority: DataFrame, pool: DataFrame, k: int, least: float) -> DataFrame:
    """Per query: neighbours of the authority in the pool, recall, repeated pool rows, rows past the cutoff, and whether all is well.

    authority: query_id, episode_id. pool: query_id, episode_id, cutoff, q_cutoff.
    """
    own = pool.groupBy("query_id").agg((F.count("*") - F.count_distinct("episode_id")).alias("duplicates"), F.count_if(F.col("cutoff") >= F.col("q_cutoff")).alias("violations"), F.count("*").alias("returned"))
    found = authority.join(pool.select("query_id", "episode_id").distinct(), ["query_id", "episode_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("retrieved"))
    out = authority.select("query_id").distinct().join(own, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["duplicates", "violations", "returned", "retrieved"])
    out = out.withColumn("recall", F.col("retrieved") / k)
    return out.withColumn("passed", (F.col("recall") >= least) & (F.col("duplicates") == 0) & (F.col("violations") == 0))


def recall_matrix(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed_cases"), F.min("recall").alias("minimum_recall"), F.avg("recall").alias("mean_recall"), F.sum("returned").alias("rows"), (F.count_if("passed") == F.count("*")).alias("passed"))


def losses(targets: DataFrame, store: DataFrame, eligible: Column, views: Sequence[str], local: int, ranked: DataFrame, size: int) -> DataFrame:
    """Per target: its local rank in each view, its place in the fused list, and the stage that lost it.

    store: episode_id, symbol, cutoff and views. ranked: episode_id, fusion_rank, pool_rank of the fused list, uncut.
    """
    here = store.join(targets.select("symbol").distinct(), "symbol", "left_semi").withColumn("eligible", eligible)
    for v in views:
        here = here.withColumn(f"local_{v}", F.when(F.col("eligible"), F.row_number().over(Window.partitionBy("symbol", "eligible").orderBy(v, "cutoff"))))
    out = targets.select("episode_id").join(here.select("episode_id", "eligible", *[f"local_{v}" for v in views]), "episode_id", "left").join(ranked.select("episode_id", "fusion_rank", "pool_rank"), "episode_id", "left")
    best = F.least(*[F.col(f"local_{v}") for v in views])
    reason = (
        F.when(F.col("eligible").isNull(), "missing_from_view_store").when(~F.col("eligible"), "ineligible_in_view_store").when(best > local, "local_cap_loss")
        .when(F.col("pool_rank") > size, "fusion_pool_loss").otherwise("in_candidate_pool")
    )
    return out.withColumn("reason", reason).withColumn("pool_rank", F.when(F.col("pool_rank") <= size, F.col("pool_rank"))).drop("eligible")


def scale_ladder(rows: DataFrame, universes: DataFrame, distance: str, k: int) -> DataFrame:
    """Per fraction of the universe: symbols, candidates, the k-th distance, a digest of the k nearest, and the share also in the rung below.

    rows: symbol, episode_id, distance. universes: fraction, symbol (nested).
    """
    each = rows.join(F.broadcast(universes.select("fraction", "symbol")), "symbol")  # some rows for each symbol
    size = each.groupBy("fraction").agg(F.count_distinct("symbol").alias("symbols"), F.count("*").alias("candidates"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("fraction").orderBy(distance, "episode_id"))).where(F.col("r") <= k)
    rungs = Window.orderBy("fraction")
    below = size.select("fraction", F.lag("fraction").over(rungs).alias("below"))  # a row for each rung
    last = best.select(F.col("fraction").alias("below"), "episode_id", F.lit(1).alias("again"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "episode_id"))), lambda x: x["episode_id"]), ",")
    out = best.join(below, "fraction").join(last, ["below", "episode_id"], "left").groupBy("fraction", "below").agg(F.max(distance).alias("kth"), F.sha2(ids, 256).alias("digest"), (F.count("again") / k).alias("shared"))
    return size.join(out, "fraction").withColumn("overlap", F.when(F.col("below").isNotNull(), F.col("shared"))).drop("below", "shared")


def float_error(rows: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    """Per key: rows and the largest difference of any column after a round trip through 32-bit floats."""
    gap = F.greatest(*[F.abs(F.col(c).cast("float").cast("double") - F.col(c)) for c in columns], F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(gap).alias("error"))


def trailing_filter(signals: DataFrame, days: int = 362, quantile: float = 1 / 3, least: int = 30) -> DataFrame:
    """Signals (symbol, ts, score) with the threshold of their day and whether they are kept.

    The threshold is a quantile of the scores of the `days` days before; with fewer than `least` of them all is kept, and a
    signal without a score always is. Distinct scores of a day are counted first, so a day's history is counts, not rows.
    """
    day = signals.select(F.to_date("ts").alias("day")).distinct()
    scores = signals.where("score is not null").groupBy(F.to_date("ts").alias("at"), "score").agg(F.count("*").alias("n"))
    known = scores.select("score", "n", F.explode(F.sequence(F.date_add("at", 1), F.date_add("at", days))).alias("day")).join(day, "day", "left_semi")
    limits = known.groupBy("day").agg(F.sum("n").alias("history"), F.percentile("score", F.lit(quantile), F.col("n")).alias("q"))
    out = signals.withColumn("day", F.to_date("ts")).join(limits, "day", "left").drop("day")
    out = out.withColumn("threshold", F.when(F.col("history") >= least, F.col("q"))).drop("history", "q")
    return out.withColumn("kept", F.col("score").isNull() | F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")))


# --- labelled examples ---------------------------------------------------------------------------------------------------

#: Names of set-ups that mean the same; others are lower-cased with _ for a space.
SETUPS = {
    "EP": "episodic_pivot", "Episodic Pivot": "episodic_pivot", "EP - Sector": "episodic_pivot", "Para": "parabolic", "Parabolic Short": "parabolic", "Para Long": "parabolic",
    "Bounce off MA": "moving_average_reaction", "Bounce of MA": "moving_average_reaction", "Short off MA": "moving_average_reaction",
    "Speculation": "speculation", "Market  Speculation": "speculation", "Market Play": "speculation",
}


def setup_name(raw: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SETUPS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.trim(raw)), F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_")))


def examples(lines: DataFrame) -> DataFrame:
    """Trades from lines of CSV text (value) with 17 or more fields: the date first, then symbol, side, set-up and source at their places.

    Lines without a date, and symbols that don't begin with a letter or hold more than letters, digits, `.`, `-` and `/`, are left out.
    """
    schema = ", ".join(f"c{i} string" for i in range(17))
    fields = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), ","))
    c = lines.where(fields >= 17).select(F.from_csv("value", schema).alias("c")).select("c.*")
    text = lambda i: F.coalesce(F.trim(f"c{i}"), F.lit(""))
    at = F.try_to_timestamp(F.trim("c0"), F.lit("yyyy-MM-dd"))
    rows = c.select(at.alias("entry"), text(2).alias("symbol"), text(3).alias("side"), text(4).alias("raw_setup"), setup_name(text(4)).alias("setup"), text(5).alias("market"), text(15).alias("note"))
    return rows.where("entry is not null").where(F.col("symbol").rlike("^[A-Za-z][A-Za-z0-9.\\-/]*$"))
