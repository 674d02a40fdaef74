"""Catalog files: records in, tables and collections out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_catalog(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "json"
) -> DataFrame:
    """Records with a fixed schema.

    ``json`` is a JSON array per file (one file is one task), ``jsonl`` one record per line
    and ``parquet`` the form for large catalogs. A missing path is an error.
    """
    reader = spark.read.schema(schema)
    try:
        if fmt == "json":
            return reader.option("multiLine", True).json(path)
        if fmt == "jsonl":
            return reader.json(path)
        if fmt == "parquet":
            return reader.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no catalog at {path}: {error.getCondition()}") from error
    raise ValueError(f"unknown catalog format {fmt!r}")


def scan_datasheets(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file of a folder: ``path``, ``name`` and the whole ``text``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", F.decode("content", "UTF-8").alias("text"))
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "text")


def sorted_listing(files: DataFrame) -> DataFrame:
    """The file list in name order."""
    return files.select("path", "name").orderBy("name", "path")


def write_catalog(catalog: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the table: the old files go, all rows are written anew."""
    writer = catalog.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_collection(
    collection: DataFrame, path: str, key: str = "id", buckets: int | None = None, table: str | None = None
) -> None:
    """Replace the text and vector collection.

    With ``buckets`` it becomes the table ``table``, bucketed and sorted by key, with its files at
    ``path``: a join on the key with a table of as many buckets then needs no shuffle.
    """
    if buckets and not table:
        raise ValueError("a bucketed collection needs a table name: files alone do not tell their buckets")
    writer = collection.write.mode("overwrite")
    if buckets:
        writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    else:
        writer.parquet(path)


def write_records_json(records: DataFrame, path: str) -> None:
    """Checked records as JSON lines; text is written as it is, without ASCII escapes."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def catalog_listing(catalog: DataFrame, display_names: dict[str, str]) -> DataFrame:
    """The listed columns under their display names, in the order of the mapping."""
    return catalog.select(*[F.col(c).alias(shown) for c, shown in display_names.items()])


def preview(records: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """A look at some columns of the first ``n`` rows; the limit is the point of a preview."""
    return records.select(*columns).limit(n)


def catalog_health(catalog: DataFrame) -> DataFrame:
    """One row with the catalog size."""
    return catalog.agg(F.count("*").alias("catalog_size"))


def catalog_health_at(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    """Catalog size at a path; 0 when there is nothing readable."""
    try:
        return catalog_health(read_catalog(spark, path, schema, fmt))
    except FileNotFoundError:
        return spark.range(1).select(F.lit(0).cast("long").alias("catalog_size"))
