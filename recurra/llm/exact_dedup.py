"""Exact dedup by DataFrame operations: local combining, salted digest groups, then a global combining of their winners.

Rows of equal texts (all white space deleted) are merged in the first aggregation's map side, then by (digest, salt),
then by digest alone. The full normalised text is a grouping key at each stage, so equal digests of different texts
never merge. Rows find their class by digest; where one digest has several texts, by digest and text.

Defined results: a null text counts as empty and is equal to texts of white space only; of equal texts the longest
original stays (code points), then the smallest doc_id, a null doc_id last; repeated rows each return a row, all of
them kept if their doc_id is the one that stays; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.storage import aside, written

SALTS = 16
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _order() -> Column:
    """Larger is better: code points first, then any doc_id before none, then the smaller doc_id. A decimal, so that hash aggregation can hold it."""
    doc = F.when(F.col("doc_id").isNull(), _wide(F.lit(0))).otherwise(_wide(F.lit(str(1 << 64))) + _wide(F.lit(LAST)) - _wide(F.col("doc_id")))
    return (_wide(F.col("length")) * _wide(F.lit(str(1 << 65))) + doc).cast("decimal(38,0)")


def exact_classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    rows = rows.withColumn("digest", F.sha2("content", 256))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = rows.select("digest", salt.alias("salt"), "content", _order().alias("best"))
    winners = salted.groupBy("digest", "salt", "content").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    classes = winners.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    doc = F.expr(f"best % cast('{1 << 65}' as decimal(38,0))")
    keep = F.when(doc != 0, (_wide(F.lit(str(1 << 64))) + _wide(F.lit(LAST)) - doc).cast("long"))
    classes = classes.select("digest", F.sha2("content", 512).alias("second"), keep.alias("keep_id"), "group_size")
    classes = written(classes, "exact-classes")
    light = written(rows.select("doc_id", "digest"), "exact-rows")
    shared = classes.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        placed = light.join(classes.drop("second"), "digest")
    else:  # one digest, several texts: none is known for sha256, but it costs nothing to be exact
        placed = rows.select("doc_id", "digest", F.sha2("content", 512).alias("second")).join(classes, ["digest", "second"])
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return placed.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of each class of exact_classes(): the longest original, then the smallest doc_id (null last), then the first row."""
    rows, back = aside(docs, "doc_id", "text")
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "exact-docs")
    sized = rows.select("__row", F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    best = F.max(F.struct(_order().alias("best"), (-F.col("__row")).alias("at")))
    kept = sized.groupBy("content").agg(best.alias("best")).select((-F.col("best.at")).alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*back)
