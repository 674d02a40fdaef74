"""Rebuilds that replace a set of tables as a whole, or not at all.

A root folder holds one folder per version and a small file that names the current one. A rebuild writes a
new version, proves the keys while it writes, and then replaces that file by renaming. Whatever
happens before, a repeated key or a lost job, leaves the current version as it is; readers see one or the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

CURRENT = "current.txt"


class KeyViolation(ValueError):
    """A table whose key is not unique or is missing somewhere: ``rows`` counts the rows at fault, per table."""

    def __init__(self, rows: dict[str, int]):
        self.rows = rows
        super().__init__(f"rows that repeat or lack their key: {rows}")


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the current version, None before the first one."""
    place, files = _at(spark, f"{root}/{CURRENT}")
    if not files.exists(place):
        return None
    return spark.read.text(f"{root}/{CURRENT}").first()["value"]


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version. A plan made before a switch goes on reading its own version."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version at {root}")
    return spark.read.parquet(f"{root}/{version}/{table}")


def rebuild(tables: Mapping[str, DataFrame], root: str, keys: Mapping[str, str]) -> str:
    """Writes all tables as a new version and makes it current; returns its name.

    Raises ``KeyViolation`` if a key is null or occurs twice. Rows are dealt and sorted by the key for
    writing anyway, so a repeat stands next to its first and is counted in the same pass. A hot key, which is
    an error, fills its own task only. The version that failed is removed.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    wrong = {}
    try:
        for name, table in tables.items():
            key, seen = keys[name], Observation()
            nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
            at_fault = F.col("__sieverank_nth").isNull() | (F.col("__sieverank_nth") > 1)
            numbered = table.withColumn("__sieverank_nth", F.when(F.col(key).isNotNull(), nth))
            observed = numbered.observe(seen, F.count_if(at_fault).alias("n")).drop("__sieverank_nth")
            observed.write.parquet(f"{root}/{version}/{name}")
            if seen.get["n"]:
                wrong[name] = seen.get["n"]
        if wrong:
            raise KeyViolation(wrong)
    except Exception:
        _remove(spark, f"{root}/{version}")
        raise
    _switch(spark, root, version)
    return version


def _switch(spark: SparkSession, root: str, version: str) -> None:
    """Names the current version, by writing a file aside and renaming it over the old one."""
    aside, files = _at(spark, f"{root}/{CURRENT}-{uuid.uuid4().hex}")
    target, _ = _at(spark, f"{root}/{CURRENT}")
    stream = files.create(aside, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), options)
    except Py4JJavaError:
        files.delete(aside, False)
        raise


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)


def remove_old_versions(spark: SparkSession, root: str) -> list[str]:
    """Deletes all versions but the current one, for when no job reads them any more; returns their names."""
    now = current_version(spark, root)
    place, files = _at(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    old = [n for n in names if n.startswith("v-") and n != now]
    for name in old:
        _remove(spark, f"{root}/{name}")
    return old
