"""Typed records and data-quality checks.

A check is a named boolean column that is true for a good row. Null and NaN fail every
numeric check. All of this is projection and filter work; only the uniqueness check and the
raise mode aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieverank.functions.measures import is_number, total_of


@dataclass(frozen=True)
class Check:
    """A named condition a good row meets."""

    reason: str
    holds: Column


def check_nonneg(columns: Sequence[str]) -> list[Check]:
    return [Check(f"negative:{c}", is_number(F.col(c)) & (F.col(c) >= 0)) for c in columns]


def check_total(columns: Sequence[str], limit: float = 100.0) -> list[Check]:
    return [Check("total_above_limit", total_of(columns) <= limit)]


def check_bounds(low: str, high: str, at_least: float, at_most: float) -> list[Check]:
    return [
        Check(f"below_bound:{low}", is_number(F.col(low)) & (F.col(low) >= at_least)),
        Check(f"above_bound:{high}", is_number(F.col(high)) & (F.col(high) <= at_most)),
    ]


def check_ordered(low: str, high: str) -> list[Check]:
    a, b = F.col(low), F.col(high)
    return [Check(f"not_ordered:{low}", is_number(a) & is_number(b) & (a <= b))]


def check_rating(columns: Sequence[str], low: float = 0.0, high: float = 10.0) -> list[Check]:
    return [
        Check(f"rating_out_of_range:{c}", is_number(F.col(c)) & F.col(c).between(low, high))
        for c in columns
    ]


def quality_reasons(df: DataFrame, checks: Sequence[Check], name: str = "reasons") -> DataFrame:
    """Adds the list of failed checks, empty for a good row."""
    failed = [
        F.when(~F.coalesce(check.holds, F.lit(False)), F.lit(check.reason)) for check in checks
    ]
    return df.withColumn(name, F.array_compact(F.array(*failed)))


class RejectedRows(ValueError):
    """Raised in raise mode: ``counts`` maps each reason to its rows, ``rejects`` is the table of them all."""

    def __init__(self, counts: dict[str, int], rejects: DataFrame):
        self.counts, self.rejects = counts, rejects
        super().__init__(f"rows failed checks: {counts}")


def validate(
    df: DataFrame, checks: Sequence[Check], mode: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their reasons.

    ``quarantine`` sets bad rows aside. ``raise`` fails the batch on the first sight of a bad
    row; the error carries counts per reason and the table of rejects, which names them all.
    """
    marked = quality_reasons(df, checks)
    good = marked.filter(F.size("reasons") == 0).drop("reasons")
    bad = marked.filter(F.size("reasons") > 0)
    if mode == "raise":
        per_reason = reason_counts(df, checks).collect()  # one row per check
        if per_reason:
            raise RejectedRows({r["reason"]: r["n_rows"] for r in per_reason}, bad)
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    return good, bad


def reason_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``(reason, n_rows)`` per failed check, counted in one pass without building lists."""
    counts = df.agg(*[F.count_if(~F.coalesce(c.holds, F.lit(False))).alias(c.reason) for c in checks])
    rows = counts.unpivot([], [c.reason for c in checks], "reason", "n_rows")
    return rows.filter("n_rows > 0")


def all_hold(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row: does every row pass each check. An empty table passes."""
    return df.agg(
        *[
            F.coalesce(F.bool_and(F.coalesce(c.holds, F.lit(False))), F.lit(True)).alias(c.reason)
            for c in checks
        ]
    )


def offenders(df: DataFrame, check: Check, key: str | Sequence[str]) -> DataFrame:
    """Keys of the rows that fail one check, as rows: the list may be long."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.filter(~F.coalesce(check.holds, F.lit(False))).select(*keys)


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their counts (counted before the shuffle)."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def conform(df: DataFrame, text: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """JSON text to strictly typed records.

    Every field of the schema must be there and fit its type, else the whole record is
    rejected and ``bad_fields`` names what was wrong. Text that is not JSON lacks every field.
    """
    raw = F.try_parse_json(F.col(text))
    values, problems = [], []
    for field in schema.fields:
        path = f"$['{field.name}']"
        kind = field.dataType.simpleString()
        value = F.try_variant_get(raw, path, kind)
        fits = value.isNotNull()
        if kind == "string":  # a number is not a text, while a text may hold a number
            fits = fits & (F.schema_of_variant(F.try_variant_get(raw, path, "variant")) == "STRING")
        values.append(value.alias(field.name))
        problems.append(F.when(~F.coalesce(fits, F.lit(False)), F.lit(field.name)))
    marked = df.withColumn("_record", F.struct(*values)).withColumn(
        "bad_fields", F.array_compact(F.array(*problems))
    )
    ok = marked.filter(F.size("bad_fields") == 0).select(*df.columns, "_record.*")
    rejected = marked.filter(F.size("bad_fields") > 0).select(*df.columns, "bad_fields")
    return ok, rejected


def fill_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Missing values replaced column by column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_fallback(primary: DataFrame, fallback: DataFrame, expected_n: Column | int) -> DataFrame:
    """The primary set if it is complete, else the fallback set alone.

    The count is a scalar subquery: the choice is made while the job runs, and the side
    that is not taken has its rows filtered out.
    """
    n = primary.agg(F.count("*")).scalar()
    expected = F.lit(expected_n) if isinstance(expected_n, int) else expected_n
    return primary.filter(n >= expected).unionByName(fallback.filter(n < expected))


def flatten_record(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Nested and renamed source fields to a flat record: ``{"toughness": "ratings.toughness"}``."""
    return df.select(*[F.col(source).alias(target) for target, source in fields.items()])
