"""Bars of the driver's tables at prices so large that the last bit of a double counts."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb

import __spark_entry__
from recurra.sources import bars as B

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]


def test_large_prices_are_the_sql_to_the_bit(spark, tmp_path):
    """Every step is 25 higher, so walks end near 100 * exp(20): closes in millionths fill a double's 53 bits."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (l_discount + 0.25 as l_discount) from '{FOLDER}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"copy (from '{FOLDER}/part.parquet') to '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    columns = ", ".join(B.BAR)
    want = con.sql(f"select {columns} from ({B.bars_sql('brand_week')}) order by symbol, ts").fetchall()
    got = [tuple(r) for r in B.driver_bars(spark, str(tmp_path), "brand_week").select(*B.BAR).orderBy("symbol", "ts").collect()]
    assert max(r[5] for r in want) > 1e9 and got == want

    name = "src_1_directory_scan"
    columns = "symbol, n, first_ts, last_ts, close_sum, dataset_id"
    want = con.sql(f"select {columns} from ({__spark_entry__.oracle_sql()[name]}) order by symbol").fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("symbol").collect()] == want


def test_prices_at_the_ends(spark):
    rows = spark.createDataFrame([(0, None), (1, 0), (2, 10**6), (3, -(10**6))], "i int, n long")
    assert [r[0] for r in rows.orderBy("i").select(B.prices()("n")).collect()] == [None, 100, math.inf, 0]


def test_workers_need_not_find_the_package(tmp_path):
    """A driver that has the package on its own path only, started elsewhere."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); from pyspark.sql import SparkSession; import __spark_entry__ as e; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); assert e.queries()['src_5_instruments'](s, {FOLDER!r}).count() == 25"
    clean = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME") and not k.startswith("PYSPARK_")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, check=True)
