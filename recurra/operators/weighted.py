"""Weighted statistics and forecasts from ranked matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_weight(rank: Column | str) -> Column:
    return F.pow(F.lit(2.0), -(F.col(rank) - 1) / 10) if isinstance(rank, str) else F.pow(F.lit(2.0), -(rank - 1) / 10)


def effective_size(w: Column | str) -> Column:
    w = F.col(w) if isinstance(w, str) else w
    return F.try_divide(F.sum(w) * F.sum(w), F.nullif(F.sum(w * w), F.lit(0.0)))


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, levels: tuple[float, ...]) -> DataFrame:
    """keys, level, q: the first value whose running weight reaches the level's share of all weight."""
    w = Window.partitionBy(*keys)
    sofar = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    placed = rows.where(F.col(value).isNotNull()).withColumns({"_sofar": sofar, "_all": F.sum(weight).over(w)})
    each = placed.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return each.where(F.col("_sofar") >= F.col("level") * F.col("_all") - 1e-12).groupBy(*keys, "level").agg(F.min(value).alias("q"))


def smoothed_probabilities(rows: DataFrame, keys: list[str], label: str, weight: str, classes: tuple[str, ...], alpha: float = 0.5) -> DataFrame:
    """keys and p_<class>: weight of the class plus alpha, over all; no rows at all would be uniform."""
    mass = {c: F.sum(F.when(F.col(label) == c, F.col(weight)).otherwise(0.0)) for c in classes}
    total = sum((F.col(f"_{c}") for c in classes), F.lit(alpha * len(classes)))
    out = rows.groupBy(*keys).agg(*[m.alias(f"_{c}") for c, m in mass.items()])
    return out.select(*keys, *[((F.col(f"_{c}") + alpha) / total).alias(f"p_{c}") for c in classes])


def evidence(links: DataFrame, prefixes: tuple[int, ...] = (5, 10, 15, 20), least: int = 5) -> DataFrame:
    """Per query, horizon and prefix of ranks: weighted and plain statistics of eligible outcomes, what is withheld, and whether to abstain.

    links: query_id, match_rank, symbol, query_symbol, horizon, eligible, close_return. One best rank for each symbol.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "horizon", "symbol").orderBy("match_rank"))
    own = links.where("symbol != query_symbol").withColumn("_b", best).where("_b = 1")
    rows = own.withColumn("prefix", F.explode(F.array(*[F.lit(p) for p in prefixes]))).where("match_rank <= prefix").withColumn("w", rank_weight("match_rank"))
    keys = ["query_id", "horizon", "prefix"]
    ok = F.col("eligible")
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("members"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("withheld"),
        effective_size(F.when(ok, F.col("w"))).alias("ess"), F.try_divide(F.sum(F.when(ok, F.col("w") * F.col("close_return"))), F.sum(F.when(ok, F.col("w")))).alias("weighted_mean"),
        F.percentile(F.when(ok, F.col("close_return")), F.lit(0.5)).alias("median"), F.avg(F.when(ok, (F.col("close_return") > 0).cast("int"))).alias("positive_rate"),
    )
    median = weighted_quantiles(rows.where("eligible"), keys, "close_return", "w", (0.5,)).select(*keys, F.col("q").alias("weighted_median"))
    return plain.join(median, keys, "left").withColumn("abstain", F.col("n") < least)


def expanding_frequency(known: DataFrame, asks: DataFrame, label: str) -> DataFrame:
    """Share of `label` among outcomes completed at or before each asking time: one running pass over both.

    known: completion, label. asks: query_id, cutoff. Times are summed first, so the pass is over distinct times only.
    """
    k = known.groupBy(F.col("completion").alias("t")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == label).alias("hits"))
    times = k.unionByName(asks.select(F.col("cutoff").alias("t")).distinct().withColumns({"n": F.lit(0), "hits": F.lit(0)})).groupBy("t").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    w = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a row for each session
    upto = times.select("t", F.sum("n").over(w).alias("n"), F.sum("hits").over(w).alias("hits"))
    return asks.join(upto, F.col("cutoff") == F.col("t")).select("query_id", "cutoff", "n", F.try_divide("hits", F.nullif("n", F.lit(0))).alias("frequency"))


def _running(known: DataFrame, asks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """asks' (keys, t) with the numbers of known outcomes and hits of their cell up to t: one ordered pass over the cell's distinct times."""
    zero = asks.select(*keys, "t").distinct().withColumns({"n": F.lit(0), "h": F.lit(0)})
    times = known.groupBy(*keys, "t").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).unionByName(zero).groupBy(*keys, "t").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a row for each session of a cell
    return times.select(*keys, "t", F.sum("n").over(w).alias(f"n_{name}"), F.sum("h").over(w).alias(f"h_{name}"))


def matched_probability(known: DataFrame, asks: DataFrame, label: str, least: int = 30) -> DataFrame:
    """Share of the label among earlier outcomes of the ask's cell, or of the widest cell needed to have `least` of them.

    Levels: regime and liquidity, regime, all. known: completion, label, regime, liquidity. asks: query_id, cutoff and both.
    Outcomes are counted by cell and time first; running sums up to each asked time replace a join by order.
    """
    counts = known.groupBy(F.col("completion").alias("t"), "regime", "liquidity").agg(F.count("*").alias("n"), F.count_if(F.col("label") == label).alias("h"))
    out = asked = asks.select("query_id", F.col("cutoff").alias("t"), "regime", "liquidity")
    cells = {"cell": ["regime", "liquidity"], "regime": ["regime"], "all": []}
    for name, keys in cells.items():
        out = out.join(_running(counts, asked, keys, name), [*keys, "t"], "left")
    level = F.when(F.col("n_cell") >= least, "cell").when(F.col("n_regime") >= least, "regime").when(F.col("n_all") >= least, "all").otherwise("uniform")
    p = F.when(level == "uniform", 1 / 3)
    for name in cells:
        p = p.when(level == name, F.col(f"h_{name}") / F.col(f"n_{name}"))
    return out.select("query_id", F.col("t").alias("cutoff"), level.alias("level"), p.alias("p"))


def crps(rows: DataFrame, keys: list[str], value: str, weight: str, actual: str) -> DataFrame:
    """Weighted empirical continuous ranked probability score: E|X - y| - E|X - X'| / 2, by running sums."""
    w = Window.partitionBy(*keys)
    before = w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumns({"_w": F.col(weight) / F.sum(weight).over(w)})
    r = r.withColumns({"_cw": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_cx": F.coalesce(F.sum(F.col("_w") * F.col(value)).over(before), F.lit(0.0))})
    return r.groupBy(*keys).agg((F.sum(F.col("_w") * F.abs(F.col(value) - F.col(actual))) - F.sum(F.col("_w") * (F.col(value) * F.col("_cw") - F.col("_cx")))).alias("crps"))


def concentration(uses: DataFrame, key: str, universe: int) -> DataFrame:
    """One row: largest share, HHI, effective number and Gini (with zeros for what isn't used) of the uses of a key."""
    n = uses.groupBy(key).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row for each key in use
    n = n.withColumns({"share": F.col("n") / F.sum("n").over(every), "r": F.row_number().over(every.orderBy("n", key)) + universe - F.count("*").over(every)})
    gini = 2 * F.sum(F.col("r") * F.col("n")) / (universe * F.sum("n")) - (universe + 1) / universe
    return n.agg(F.max("share").alias("top_share"), F.sum(F.col("share") * F.col("share")).alias("hhi"), (1 / F.sum(F.col("share") * F.col("share"))).alias("effective"), gini.alias("gini"))


def terciles(rows: DataFrame, value: str, key: str, groups: list[str]) -> DataFrame:
    w = Window.partitionBy(*groups)
    return rows.withColumn("tercile", F.least(F.lit(2), F.floor((F.row_number().over(w.orderBy(value, key)) - 1) * 3 / F.count("*").over(w))).cast("int"))


def entropy_breadth(uses: DataFrame, key: str) -> DataFrame:
    """One row: exp of the entropy of a key's uses."""
    n = uses.groupBy(key).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return n.agg(F.exp(-F.sum(F.col("p") * F.log("p"))).alias("breadth"))
