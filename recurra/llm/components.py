"""Connected components by alternating large-star and small-star steps; no vertex's edges meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.storage import forget, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node, itself included) for each end of a link (a, b); self links are left out."""
    edges = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "components")
    mark = _mark(edges)
    while mark[0]:
        # large star: larger neighbours go to the smallest neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: each vertex and its smaller neighbours go to the smallest of them
        low = large.select(F.col("b").alias("v"), F.col("a").alias("w"))
        least = low.groupBy("v").agg(F.min("w").alias("m"))
        small = low.join(least, "v").select(F.col("m").alias("a"), F.explode(F.array("v", "w")).alias("b")).where("a != b").distinct()
        new = written(small, "components")
        forget(edges)
        edges, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    tops = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return written(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(tops), "components")
