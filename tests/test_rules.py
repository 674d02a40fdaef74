"""Rules as a table against the same rules written out, and rebuilds that fail."""

import contextlib
import io
import re

import pytest
from golden import REQUESTS
from pyspark.sql import functions as F

from sieverank.operators.routing import Rule, route
from sieverank.operators.rules import route_by_table
from sieverank.profiles import alloys
from sieverank.sources import versions

RULES = "slot int, priority int, words array<string>, pattern string, not_pattern string, condition string"

#: For every request rule, words of which each match holds one.
WORDS = {
    1: ["cobalt", "35", "29"], 2: ["vanadium"], 3: ["molybdenum"], 4: ["stainless", "corrosion"], 5: ["hrc", "60"],
    6: ["cold", "specialty", "specialties"], 7: ["machinability"],
}


def table_of(spark, rules, words):
    return spark.createDataFrame([(r.slot, r.priority, words(r), r.pattern, r.not_pattern, r.condition) for r in rules], RULES)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_a_table_of_rules_gives_what_written_rules_give(spark, limit):
    texts = spark.createDataFrame([(k, v[0]) for k, v in REQUESTS.items()] + [("x", None), ("y", "nothing of it"), ("z", "ZERO Cobalt, 16% vanadium")], "id string, text string")
    rules = table_of(spark, alloys.REQUEST_RULES, lambda r: WORDS[r.slot])
    got = {r["id"]: r for r in route_by_table(texts, rules, "id", max_rule_bytes=limit).collect()}
    want = {r["id"]: r for r in route(texts, alloys.REQUEST_RULES).collect()}
    assert {k: (r["conditions"], r["semantic_query"]) for k, r in got.items()} == {k: (r["conditions"], r["semantic_query"]) for k, r in want.items()}


def test_ten_thousand_rules(spark):
    rules = [Rule(i % 7, i // 7, rf"\border\s*{i}\b", f"n > {i}", "cancelled" if i % 2 else None) for i in range(10_000)]
    table = table_of(spark, rules, lambda r: [re.search(r"\d+", r.pattern)[0]])
    texts = spark.range(500).select("id", F.expr("'order ' || (id * 19 % 10000) || ' and order ' || (id * 7 % 10000) || if(id % 3 = 0, ' cancelled', '') || ' not 77'").alias("text"))
    routed = route_by_table(texts, table, "id")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        routed.explain()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()
    for row in routed.collect():
        numbers = {row["id"] * 19 % 10000, row["id"] * 7 % 10000}
        slots = {}
        for n in sorted(numbers):
            if not (n % 2 and row["id"] % 3 == 0):
                slots.setdefault(n % 7, f"n > {n}")
        assert row["conditions"] == [slots[s] for s in sorted(slots)]


def test_a_rebuild_is_whole_or_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    part = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    docs = part.select(F.col("k").alias("id"), F.upper("s").alias("d"))
    keys = {"catalog": "k", "collection": "id"}
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, root, "catalog")
    first = versions.rebuild({"catalog": part, "collection": docs}, root, keys)
    old = versions.read_current(spark, root, "catalog")
    for bad in (part.union(part.filter("k = 2")).union(part.filter("k = 2")), part.union(spark.createDataFrame([(None, "x"), (None, "y")], part.schema))):
        with pytest.raises(versions.KeyViolation) as error:
            versions.rebuild({"catalog": bad, "collection": docs}, root, keys)
        assert error.value.rows == {"catalog": 2}
    with pytest.raises(Exception, match="(?i)divi"):  # a job that dies half way
        versions.rebuild({"catalog": part, "collection": docs.withColumn("x", F.lit(1) / F.col("id") / (F.col("id") - 2))}, root, keys)
    assert versions.current_version(spark, root) == first
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.is_dir()) == [first]
    second = versions.rebuild({"catalog": part.withColumn("s", F.lit("new")), "collection": docs}, root, keys)
    assert [r["s"] for r in versions.read_current(spark, root, "catalog").collect()] == ["new", "new"]
    assert sorted(r["s"] for r in old.collect()) == ["a", "b"]  # the old version stays until it is removed
    assert versions.remove_old_versions(spark, root) == [first] and versions.current_version(spark, root) == second
    assert versions.read_current(spark, root, "collection").count() == 2


def test_an_empty_table_is_a_version(spark, tmp_path):
    root = str(tmp_path / "store")
    versions.rebuild({"t": spark.createDataFrame([], "k long")}, root, {"t": "k"})
    assert versions.read_current(spark, root, "t").count() == 0
