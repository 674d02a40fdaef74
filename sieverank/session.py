"""Session defaults and the shared folder jobs may write intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def get_session(app_name: str = "sieverank", **overrides: str) -> SparkSession:
    """The running session, or a new one with this package's defaults.

    ``overrides`` use ``__`` for the dots of a setting name, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = {**SESSION_DEFAULTS, **{k.replace("__", "."): v for k, v in overrides.items()}}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    All folders of an application lie in one folder named after it, to be removed when the
    application is over. A machine-local folder is taken only on a local master without that
    setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.gettempdir()
    application = f"sieverank-{spark.sparkContext.applicationId}"
    path = os.path.join(base, application, f"{purpose}-{uuid.uuid4().hex}")
    if (folders := _scratch.get()) is not None:
        folders.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the shared folders that were named inside: for steps that repeat, as in streams."""
    token = _scratch.set(folders := [])
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to a new shared folder and read back, so later steps do not redo them."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
