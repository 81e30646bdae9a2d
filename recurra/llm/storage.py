"""Input tables, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one below /tmp only where none is set (a single machine, as in tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, and readable after executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Remove tables made by written() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            _delete(df.sparkSession, path)
            _made.pop(path, None)


@atexit.register
def _forget_all() -> None:
    """Tables that a returned plan may still read go when the driver's program ends."""
    for path, spark in _made.items():
        if spark.sparkContext._jsc is None:
            break
        _delete(spark, path)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but those named out of the way of columns that an operator adds; and the columns that bring docs back."""
    own = [c if c in names else f"_own{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*own), [F.col(a).alias(b) for a, b in zip(own, docs.columns)]
