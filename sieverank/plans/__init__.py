"""Registered queries: every operator on the given tables, with its SQL twin."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from sieverank.plans import batches, evaluation, intake, requests, vectors

MODULES = (intake, vectors, batches, requests, evaluation)


def queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="sieverank-"), "sieverank.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)
