"""Evaluation cases and their rules in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

RULES_TYPE = MapType(StringType(), ArrayType(StringType()))

CASE_SCHEMA = StructType(
    [
        StructField("id", StringType()),
        StructField("query", StringType()),
        StructField("expected_top_3", ArrayType(StringType())),
        StructField("numeric_rules", RULES_TYPE),
        StructField("allow_no_match", BooleanType()),
        StructField("description", StringType()),
    ]
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a JSON array; a case without the optional fields gets their defaults."""
    cases = spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
    return cases.select(
        F.col("id").alias("case_id"),
        "query",
        F.coalesce("expected_top_3", F.array().cast("array<string>")).alias("expected"),
        F.coalesce("numeric_rules", F.create_map().cast(RULES_TYPE)).alias("numeric_rules"),
        F.coalesce("allow_no_match", F.lit(False)).alias("allow_no_match"),
        "description",
    )


def rules_from_json(text: Column) -> Column:
    """``{"field": [op, threshold], ...}`` as a map; both parts of a pair become text."""
    return F.from_json(text, RULES_TYPE)


def rules_long(cases: DataFrame, case_id: str = "case_id", rules: str = "numeric_rules") -> DataFrame:
    """One row per rule, in file order."""
    return cases.select(
        F.col(case_id).alias("case_id"),
        F.posexplode(rules).alias("rule_pos", "field", "rule"),
    ).select(
        "case_id",
        F.col("rule_pos").cast("long").alias("rule_pos"),
        "field",
        F.get("rule", F.lit(0)).alias("op"),
        F.get("rule", F.lit(1)).try_cast("double").alias("threshold"),
    )
