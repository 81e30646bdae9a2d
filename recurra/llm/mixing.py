"""Mixing sources to target weights: Efraimidis-Spirakis sampling within each source, by DataFrame operations only.

Each source has a token target. Whole epochs come first: a source whose target is e times its size and some more takes
every document e times. The rest of the target is filled by weighted sampling without replacement: a document's key
is -ln(u) / w, with u a uniform hash of its identity and w its quality weight, and documents enter in the order of
their keys until the prefix sum of their sizes reaches the rest.

The prefix sums need no sort of a whole source. Keys fall into BUCKETS ranges; the ranges' sums, by (source, range),
tell the one range in which a source's rest ends; only that range's documents are ordered.

Defined results: a null or empty text has size 0 and takes 0 words; the null source is a source of its own, last in
order; a row without a doc_id is hashed by its text; rows that share a key
enter by doc_id, size and text, so that reruns take the same texts; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.storage import aside, written

#: Ranges of keys within a source. One range's documents of a source are ordered together.
BUCKETS = 4096
#: Largest number of times that a document may be taken, and the weights that sources get in turn.
MOST_EPOCHS = 3
CYCLE = (1, 2, 3)
#: Weights of documents by labelled quality 1 and 0, and of those without a label.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}


def words(text: Column) -> Column:
    """Number of runs of other characters than white space, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1): 48 bits of an md5 of the identity, or of the text of a row without one."""
    identity = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), identity)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size): one row for each source.

    Shares by weight, held at MOST_EPOCHS times the size. The level at which shares stand when all excess has been dealt
    out again is found in closed form: sources in order of cap / weight fill up one after another.
    """
    every, order = Window.partitionBy(F.lit(0)), F.col("source").asc_nulls_last()
    rank = (F.row_number().over(every.orderBy(order)) - 1) % len(CYCLE)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in CYCLE]), (rank + 1).cast("int"))
    filling = every.orderBy("fill", order)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumns({"weight": weight, "cap": F.col("source_size").cast("double") * MOST_EPOCHS})
        .withColumns({"total": F.sum("source_size").over(every).cast("double"), "fill": F.col("cap") / F.col("weight")})
        .withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(every)["level"])
        .select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, row: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row. quality: (doc_id, quality), one of a doc_id.

    row: a column that numbers the rows, if there is one; it settles ties and is returned.
    """
    rows = docs.select("doc_id", "source", *row, words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("draw"), F.xxhash64("text").alias("tie"))
    if quality is not None:
        marks = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(marks, "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    weight = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(QUALITY[None])
    key = -F.log("draw") / weight
    rows = written(rows.select("doc_id", "source", *row, "size", "tie", F.round(key, 12).alias("key")).withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int")), "mix-rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = written(sums, "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    ranges = sums.withColumn("upto", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")))
    p, r = plan.alias("p"), ranges.alias("r")
    ranges = r.join(p, F.expr("r.source <=> p.source")).select("r.source", "r.bucket", "p.source_size", "p.target", "p.epochs", "p.rest", (F.col("r.upto") - F.col("r.bucket_size")).alias("before"), "r.upto")
    d, g = rows.alias("d"), ranges.alias("g")
    placed = d.join(g, F.expr("d.bucket = g.bucket and d.source <=> g.source")).select("d.*", "g.source_size", "g.target", "g.epochs", "g.rest", "g.before", "g.upto")
    whole = placed.where("upto <= rest or before >= rest").withColumn("extra", ((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).cast("long"))
    order = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "tie", *row)
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the document at the border enters if that brings the sum nearer to the rest
    split = placed.where("upto > rest and before < rest").withColumn("extra", (upto - F.col("size") / 2.0 <= F.col("rest")).cast("long"))
    out = whole.unionByName(split).withColumn("copies", F.col("epochs") + F.col("extra"))
    return out.select("doc_id", "source", *row, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """docs' columns: each row as many times as the mix takes it, decided for each row by a number that is written with it."""
    rows, back = aside(docs, "doc_id", "text", "source")
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "mixed-rows")
    copies = mix(rows, quality, ("__row",)).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    return rows.join(copies, "__row").withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*back)
