"""The entry module with and without the training-data subpackage, and queries against their SQL."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).parents[1]


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in sorted(__spark_entry__.oracle_sql()) if not n.startswith("op")])
def test_query_is_its_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, FOLDER).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_flagship(spark):
    out = __spark_entry__.entry(spark).collect()
    assert len(out) == 20 and all(math.isfinite(r["price_shape"]) for r in out)


def test_without_the_subpackage(tmp_path):
    """As after the driver has deleted its folders and the pipeline."""
    for f in ROOT.iterdir():
        if f.name not in ("recurra", "corpus_pipeline.py", "tests", ".git"):
            (tmp_path / f.name).symlink_to(f)
    (tmp_path / "recurra").mkdir()
    for f in (ROOT / "recurra").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (tmp_path / "recurra" / f.name).symlink_to(f)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
