"""Bar tables: readers, canonical form, prefix locks, fingerprints, and bars made from the driver's tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PRICES = ("open", "high", "low", "close")
BAR = ("symbol", "ts", *PRICES, "volume")


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset is and how its columns are called."""

    dataset_id: str
    path: str
    layout: str = "directory"  # one file for each symbol, or long_table
    format: str = "parquet"
    columns: dict[str, str] = field(default_factory=dict)
    benchmark: str | None = None


def read(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Bars of a dataset with their symbol; a directory's symbols are its files' stems."""
    reader = spark.read.option("header", True) if spec.format == "csv" else spark.read
    frame = reader.format(spec.format).load(spec.path)
    if spec.layout == "directory":
        stem = F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1), F.lit("+"), F.lit("%2B")))  # the name comes as in a URL
        frame = frame.withColumn("symbol", stem)
        if spec.benchmark:
            frame = frame.where(F.col("symbol") != spec.benchmark)
    return canonical(frame, spec.columns).withColumn("dataset_id", F.lit(spec.dataset_id))


def canonical(frame: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Renamed, checked and coerced: what isn't a number, or is not finite, becomes null."""
    frame = frame.withColumnsRenamed({theirs: ours for theirs, ours in (columns or {}).items()})
    if "ts" not in frame.columns and "date" in frame.columns:
        frame = frame.withColumnRenamed("date", "ts")
    if missing := [c for c in BAR if c not in frame.columns]:
        raise ValueError(f"bars lack {', '.join(missing)}")
    number = {c: finite(F.expr(f"try_cast(`{c}` as double)")) for c in (*PRICES, "volume")}
    return frame.withColumns({"ts": F.expr("try_cast(ts as timestamp)"), **number}).select(*BAR)


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def instruments(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def until(bars: DataFrame, cutoff: str) -> DataFrame:
    """Only rows that were there at the cutoff."""
    return bars.where(F.col("ts") <= F.lit(cutoff).cast("timestamp"))


def row_text() -> Column:
    """A bar as text: its time in seconds and its numbers to 6 places."""
    number = [F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("")) for c in (*PRICES, "volume")]
    return F.concat_ws("|", F.unix_timestamp("ts").cast("string"), *number)


def prefix_digest(bars: DataFrame, cutoff: str) -> DataFrame:
    """symbol, rows, digest of the bars up to the cutoff: rewriting or appending later bars changes nothing.

    Rows are digested one by one and the digests of a month once more, so that no list grows with the history.
    """
    rows = until(bars, cutoff).select("symbol", F.date_trunc("month", "ts").alias("month"), F.sha2(row_text(), 256).alias("h"))
    months = rows.groupBy("symbol", "month").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("month", "h")))
    return months.groupBy("symbol").agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("digest"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def date_metadata(bars: DataFrame) -> DataFrame:
    """symbol, rows, first and last time: columns and pages that a reader can answer from statistics where it has them."""
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def counts_at(bars: DataFrame, cutoffs: DataFrame, least_rows: int) -> DataFrame:
    """cutoff, eligible: symbols with at least so many rows whose last is at or after the cutoff."""
    return cutoffs.join(date_metadata(bars).where(F.col("rows") >= least_rows), F.col("last_ts") >= F.col("cutoff"), "left").groupBy("cutoff").agg(F.count("symbol").alias("eligible"))


def positions(bars: DataFrame) -> DataFrame:
    """bars with pos, the number of a symbol's session from 0."""
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


# --- bars from the driver's tables ---------------------------------------------------------------------------------

#: universe: (symbol, bucket of time)
UNIVERSES = {"type_day": ("p_type", "day"), "brand_week": ("p_brand", "week"), "brand_day": ("p_brand", "day"), "market_day": ("'MARKET'", "day"), "market_week": ("'MARKET'", "week")}
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")

_kept: dict[tuple[str, str, str], DataFrame] = {}


def prices() -> Callable[[Column], Column]:
    """The price after a walk of n, to the last bit as DuckDB has it: 0.002 is a decimal there, and its exp is the C library's.

    Spark's exp is another one, a place off in the last digit for every seventh price; sums of large prices in millionths
    show it. The function is a local one, so that it goes to workers by value: they need not find this package.
    """

    def exp(x: float) -> float:
        try:
            return math.exp(x)
        except OverflowError:
            return math.inf

    def price(n: pa.Array) -> pa.Array:
        return pa.array([None if x is None else 100 * exp(x * 2 / 1000) for x in n.to_pylist()], pa.float64())

    return F.arrow_udf(price, DoubleType())


def driver_bars(spark: SparkSession, sf_dir: str, universe: str) -> DataFrame:
    """An integer walk over the line items of each symbol, as bars; kept for the session.

    The walk's running sum is split: sums of a bucket, then within it, so that no task orders a symbol's whole history.
    """
    key = (spark.sparkContext.applicationId, sf_dir, universe)
    if key not in _kept:
        symbol, bucket = UNIVERSES[universe]
        item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        if symbol.startswith("'"):
            item = item.withColumn("symbol", F.lit(symbol.strip("'")))
        else:
            part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(symbol).alias("symbol"))
            item = item.join(part, F.col("l_partkey") == F.col("p_partkey"))
        ticks = item.select("symbol", F.date_trunc(bucket, "l_shipdate").alias("ts"), (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("step"), "l_quantity", *ORDER[:5], *ORDER[6:])
        walk = F.sum("step").over(Window.partitionBy("symbol", "ts").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
        number = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*ORDER))
        ticks = ticks.withColumns({"walk": walk, "n": number})
        days = ticks.groupBy("symbol", "ts").agg(F.min_by("step", "n").alias("first"), F.max("walk").alias("top"), F.min("walk").alias("low"), F.sum("step").alias("net"), F.sum("l_quantity").alias("volume"))
        base = F.sum("net").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
        days = days.withColumn("base", F.coalesce(base, F.lit(0)))
        price_of = prices()
        price = lambda c: price_of(F.col("base") + F.col(c)).alias({"first": "open", "top": "high", "low": "low", "net": "close"}[c])
        _kept[key] = days.select("symbol", "ts", price("first"), price("top"), price("low"), price("net"), "volume").persist()
    return _kept[key]


def bars_sql(universe: str) -> str:
    """The same bars in DuckDB's SQL."""
    symbol, bucket = UNIVERSES[universe]
    return f"""SELECT symbol, ts, arg_min(price, n) AS open, max(price) AS high, min(price) AS low, arg_max(price, n) AS close, sum(l_quantity) AS volume
        FROM (SELECT symbol, date_trunc('{bucket}', l_shipdate)::TIMESTAMP AS ts, l_quantity, row_number() OVER o AS n,
                     100 * exp(0.002 * sum(step) OVER (o ROWS UNBOUNDED PRECEDING)) AS price
              FROM (SELECT {symbol} AS symbol, CAST(round(l_discount * 100) AS INT) - 5 AS step, l.* FROM lineitem AS l JOIN part ON l_partkey = p_partkey)
              WINDOW o AS (PARTITION BY symbol ORDER BY {", ".join(ORDER)}))
        GROUP BY symbol, ts"""
