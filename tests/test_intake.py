import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sieverank.functions import measures, text
from sieverank.operators import quality, records
from sieverank.plans import intake
from sieverank.profiles import alloys
from sieverank.sources import cases, catalog

NAN = float("nan")


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", expression(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_parsing(spark):
    texts = ["5.0 - 5.5", "1.25 - 1.31", "28.5 - 29.5", "0.0", "7", "none", "", None]
    got = column(spark, texts, "string", text.range_midpoint)
    assert got[:5] == [5.25, pytest.approx(1.28), 29.0, 0.0, 7.0] and got[5:] == [None] * 3
    zeroed = column(spark, texts, "string", lambda c: text.absent_to_zero(text.range_midpoint(c)))
    assert zeroed[5:] == [0.0] * 3
    hard = column(spark, ["64.0 - 66.0 HRC", "70 HRC", "soft", None], "string", text.parse_hardness)
    assert [tuple(h) for h in hard] == [(64.0, 66.0), (70.0, 70.0), (None, None), (None, None)]
    rated = column(spark, ["7.0/10", " 8 / 10 ", "7", "7/100", "good", None], "string", text.parse_rating)
    assert rated == [7.0, 8.0, None, None, None, None]


def test_numbers_as_text(spark):
    got = column(spark, [1.0, 1.25, 66.0, 0.0, -2.04, NAN, float("inf"), None], "double", text.trim_number)
    assert got == ["1", "1.3", "66", "0", "-2.0".replace(".0", ""), "0", "0", "0"]
    assert column(spark, ["4.50", "abc", None], "string", text.trim_number) == ["4.5", "0", "0"]


def test_measures(spark):
    assert column(spark, [0.0, 0.5, 2.0, 3.0], "double", measures.proximity) == [100.0, 75.0, 0.0, 0.0]
    assert column(spark, [-1.0, 7.5, 11.0], "double", measures.rating_pct) == [0.0, 75.0, 100.0]
    df = spark.createDataFrame([(0, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(measures.percent(F.col("a"), F.col("b"))).collect()] == [None, 33.3]


def test_rule_holds(spark):
    rows = [
        (1.0, "==", 1.00005, True), (1.0, "==", 1.1, False), (8.0, ">", 8.0, True), (7.9, ">", 8.0, False),
        (8.0, ">=", 8.00005, True), (8.0, "<", 8.0, True), (8.2, "<", 8.0, False), (8.0, "<=", 7.99995, True),
        (8.0, "!=", 1.0, False), (None, ">", 1.0, False), (NAN, ">", 1.0, False), (1.0, ">", None, False),
        (1.0, None, 1.0, False),
    ]
    df = spark.createDataFrame(rows, "v double, op string, t double, expected boolean")
    held = measures.rule_holds(F.col("v"), F.col("op"), F.col("t"))
    assert df.filter(held != F.col("expected")).count() == 0 and df.filter(held.isNull()).count() == 0


RECORD = {
    **{c: 1.0 for c in alloys.CHEMISTRY},
    "hardness_min": 60.0,
    "hardness_max": 62.0,
    **{r: 5.0 for r in alloys.RATINGS},
}


def records_of(spark, changes):
    rows = [{"name": f"r{i}", **RECORD, **c} for i, c in enumerate(changes)]
    ddl = "name string, " + ", ".join(f"{c} double" for c in RECORD)
    return spark.createDataFrame([tuple(r.values()) for r in rows], ddl)


CHANGES = [
    ({}, []),
    ({"c_pct": -0.1}, ["negative:c_pct"]),
    ({"c_pct": None}, ["negative:c_pct"]),
    ({"c_pct": NAN}, ["negative:c_pct"]),
    ({"c_pct": 95.0}, []),
    ({"c_pct": 95.1}, ["total_above_limit"]),
    ({"hardness_min": 19.9}, ["below_bound:hardness_min"]),
    ({"hardness_max": 80.1}, ["above_bound:hardness_max"]),
    ({"hardness_min": 62.0}, []),
    ({"hardness_min": 62.1}, ["not_ordered:hardness_min"]),
    ({"hardness_max": NAN}, ["above_bound:hardness_max", "not_ordered:hardness_min"]),
    ({"toughness": 10.1}, ["rating_out_of_range:toughness"]),
    ({"toughness": None}, ["rating_out_of_range:toughness"]),
]


def test_quality_checks(spark):
    df = records_of(spark, [c for c, _ in CHANGES])
    checks = alloys.record_checks()
    marked = quality.quality_reasons(df, checks)
    got = {r["name"]: r["reasons"] for r in marked.collect()}
    assert got == {f"r{i}": reasons for i, (_, reasons) in enumerate(CHANGES)}
    good, bad = quality.validate(df, checks)
    assert good.columns == df.columns and good.count() == 3 and bad.count() == len(CHANGES) - 3
    with pytest.raises(quality.RejectedRows) as error:
        quality.validate(df, checks, mode="raise")
    assert error.value.counts["negative:c_pct"] == 3
    assert error.value.rejects.count() == len(CHANGES) - 3
    counts = {r["reason"]: r["n_rows"] for r in quality.reason_counts(df, checks).collect()}
    assert counts == error.value.counts
    held = quality.all_hold(df, checks).first()
    assert held["rating_out_of_range:grindability"] and not held["negative:c_pct"]
    assert all(quality.all_hold(df.filter("false"), checks).first())
    lost = quality.offenders(df, quality.check_total(alloys.CHEMISTRY)[0], "name")
    assert [r["name"] for r in lost.collect()] == ["r5"]
    # wider bounds are a parameter
    assert quality.validate(df, alloys.record_checks(hardness=(10.0, 90.0)))[1].count() == len(CHANGES) - 5


def test_unique_and_fallback(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 2)], "k string, v int")
    assert {(r["k"], r["n_rows"]) for r in quality.check_unique(df, ["k"]).collect()} == {("a", 2), (None, 2)}
    other = spark.createDataFrame([("z", 9)], "k string, v int")
    assert quality.with_fallback(df, other, 6).collect() == other.collect()
    assert quality.with_fallback(df, other, 5).count() == 5
    assert quality.with_fallback(df.filter("false"), other, 0).count() == 0


def test_conform(spark):
    schema = StructType([StructField("name", StringType()), StructField("x", DoubleType())])
    texts = [
        '{"name": "a", "x": 1}', '{"name": "é", "x": "2.5", "more": [1]}', '{"name": 3, "x": 1.0}',
        '{"name": "a"}', '{"name": "a", "x": null}', '{"name": "a", "x": "wide"}', "[1]", "not json", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ok, rejected = quality.conform(df, "t", schema)
    assert {(r["i"], r["name"], r["x"]) for r in ok.collect()} == {(0, "a", 1.0), (1, "é", 2.5)}
    got = {r["i"]: r["bad_fields"] for r in rejected.collect()}
    both = ["name", "x"]
    assert got == {2: ["name"], 3: ["x"], 4: ["x"], 5: ["x"], 6: both, 7: both, 8: both, 9: both}


def test_records(spark):
    row = {**dict.fromkeys(alloys.RECORD_FIELDS), **RECORD, "name": "N°1", "family": "Cold work"}
    df = spark.createDataFrame([tuple(row[f] for f in alloys.RECORD_FIELDS)], alloys.RECORD_SCHEMA)
    df = df.withColumn("toughness", F.lit(None).cast("double")).withColumn("description", F.lit("Hard."))
    lines = records.collection(df, "name", "family", alloys.NARRATIVE).first()["document"].split("\n")
    assert lines == [
        "Grade Name: N°1",
        "Application Family: Cold work",
        "Standards: N/A",
        "Description: Hard.",
        "Tooling Applications: ",
        "Heat Treatment and Hardness: . Hardness range: 60.0 to 62.0 HRC.",
        "Properties profile: Machinability 5.0/10, Wear resistance 5.0/10, Toughness /10, "
        "Hot hardness 5.0/10, Grindability 5.0/10.",
    ]
    filled = quality.fill_defaults(df, alloys.TABLE_DEFAULTS).first()
    assert filled["toughness"] == 5.0 and filled["standards"] == ""
    stored = df.select(F.lit(1).alias("i"), records.to_payload(alloys.RECORD_FIELDS).alias("payload"))
    assert '"N°1"' in stored.first()["payload"]
    back = records.from_payload(stored, "payload", alloys.RECORD_SCHEMA)
    assert back.drop("i").first() == df.first()
    sheet = df.select(
        "name", "family", "standards", *[F.col(c).alias(c.replace("_pct", "_avg")) for c in alloys.CHEMISTRY],
        "hardness_min", "hardness_max", F.struct(*alloys.RATINGS).alias("ratings"), *alloys.TEXTS,
    )
    assert quality.flatten_record(sheet, alloys.DATASHEET_FIELDS).select(*df.columns).first() == df.first()


def test_sources(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text('[{"name": "é", "c_pct": 1, "more": true}, {"name": "b", "c_pct": 2.5}]', encoding="utf-8")
    df = catalog.read_catalog(spark, str(path), alloys.RECORD_SCHEMA)
    assert {(r["name"], r["c_pct"]) for r in df.collect()} == {("é", 1.0), ("b", 2.5)}
    with pytest.raises(FileNotFoundError):
        catalog.read_catalog(spark, str(tmp_path / "none.json"), alloys.RECORD_SCHEMA)
    assert catalog.catalog_health_at(spark, str(tmp_path / "none"), alloys.RECORD_SCHEMA, "json").first()[0] == 0
    assert catalog.catalog_health_at(spark, str(path), alloys.RECORD_SCHEMA, "json").first()[0] == 2

    table = str(tmp_path / "table")
    for _ in range(2):  # a rebuild replaces
        catalog.write_catalog(df, table, partition_by="family")
    again = catalog.read_catalog(spark, table, alloys.RECORD_SCHEMA, "parquet")
    assert again.count() == 2
    lines = str(tmp_path / "lines")
    catalog.write_records_json(df, lines)
    assert any("é" in f.read_text(encoding="utf-8") for f in (tmp_path / "lines").glob("part-*"))
    assert catalog.read_catalog(spark, lines, alloys.RECORD_SCHEMA, "jsonl").exceptAll(df).count() == 0

    docs = records.collection(df, "name", "family", alloys.NARRATIVE)
    for buckets in (None, 3):
        catalog.write_collection(docs, str(tmp_path / "collection"), buckets=buckets, table=buckets and "collection_test")
    assert spark.read.parquet(str(tmp_path / "collection")).count() == 2

    folder = tmp_path / "sheets"
    folder.mkdir()
    for name in ("b.txt", "a.txt", "c.md"):
        (folder / name).write_text(f"sheet {name}\nsecond line")
    sheets = catalog.scan_datasheets(spark, str(folder))
    assert {r["name"]: r["text"] for r in sheets.collect()}["a.txt"] == "sheet a.txt\nsecond line"
    assert [r["name"] for r in catalog.sorted_listing(sheets).collect()] == ["a.txt", "b.txt"]
    listed = catalog.catalog_listing(df, alloys.DISPLAY_NAMES)
    assert listed.columns[:3] == ["Grade", "Family", "C %"] and len(listed.columns) == 11
    shown = catalog.preview(df, alloys.PREVIEW_FIELDS, 1)
    assert len(shown.columns) == 9 and shown.count() == 1


def test_sheets_are_scanned_in_pages_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [(i, "en") for i in range(100)] + [(5, "de"), (70, "de")]
    monkeypatch.setattr(intake, "shared_folder", lambda *_: str(tmp_path / "pages"))
    found = intake._sheets_scanned(spark, spark.createDataFrame(rows, "doc_id long, lang string"), 3)
    assert {tuple(r) for r in found.collect()} == {("lang=en", 1, 1, 10 + 2 * 90 + 99), ("lang=de", 1, 1, 4)}
    pages = [page.read_text().split() for page in (tmp_path / "pages").glob("lang=en/*.txt")]
    assert max(map(len, pages)) <= 3 and sorted(int(i) for page in pages for i in page) == list(range(100))


def test_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('[{"id": "a", "query": "q", "numeric_rules": {"z": [">", 8], "b": ["==", 0.0], "c": ["<"]}}, {"id": "b", "query": "p"}]')
    read = cases.read_cases(spark, str(path))
    assert {r["case_id"]: (r["expected"], r["allow_no_match"]) for r in read.collect()} == {"a": ([], False), "b": ([], False)}
    got = [tuple(r) for r in cases.rules_long(read).orderBy("rule_pos").collect()]
    assert got == [("a", 0, "z", ">", 8.0), ("a", 1, "b", "==", 0.0), ("a", 2, "c", "<", None)]


def test_pages_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """Pages are many files of few bytes, so they are dealt over tasks whatever their bytes; places are in name order."""
    from sieverank.plans import intake

    monkeypatch.setattr(intake, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    listing = spark.conf.get(setting, None)
    rows = [(i, "de" if i % 3 else "en") for i in range(400)] + [(None, "en"), (7, "de"), (8, None)]
    got = intake._pages_listed(spark, spark.createDataFrame(rows, "doc_id long, lang string"), 10).collect()
    pages = {}
    for i, lang in rows:
        if i is not None:
            pages.setdefault(f"lang={lang or '__HIVE_DEFAULT_PARTITION__'}/page={i // 10:09d}", []).append(str(i))
    want = [(at, name, len(" ".join(pages[name]))) for at, name in enumerate(sorted(pages), 1)]
    assert sorted((r.position, r.name, r.n_chars) for r in got) == want
    files = list((tmp_path / "sheets").rglob("*.txt"))
    assert len(files) == len(pages) and len({f.name.split("-")[1] for f in files}) == 4
    assert spark.conf.get(setting, None) == listing
