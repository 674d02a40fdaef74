"""The given tables, and the registers of queries on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry():
    """Queries by name, their SQL twins, and the decorator that adds to both."""
    queries, oracles = {}, {}

    def registered(sql=None):
        def add(run):
            queries[run.__name__] = run
            if sql:
                oracles[run.__name__] = sql
            return run

        return add

    return queries, oracles, registered
