"""Queries by name, with the SQL that says the same where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recurra.sources.bars import bars_sql, driver_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **universes: str) -> Callable:
    """Register f(spark, sf_dir, **bars): each keyword names a universe whose bars f gets, and the SQL as a table.
    The SQL goes on after those tables: with more of them (`x AS (...), ... SELECT`), or with SELECT.
    """

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir, **{k: driver_bars(spark, sf_dir, u) for k, u in universes.items()})

        QUERIES[name] = run
        if sql:
            tables = [f"{k} AS ({bars_sql(u)})" for k, u in universes.items()]
            text = sql.strip()
            ORACLES[name] = f"WITH {', '.join(tables)}{' ' if text.upper().startswith('SELECT') else ', '}{text}" if tables else text
        return f

    return register
