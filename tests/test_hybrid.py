import pytest
from pyspark.sql import functions as F

from sieverank.operators import hybrid, predicates, report
from sieverank.operators.lexical import build_index
from sieverank.profiles import alloys

ALLOWED = ["name", "family", "hard", "share"]
ROWS = [
    ("a", "tools", 60.0, 0.0, "hard red tool", [1.0, 0.0]),
    ("b", "tools", 62.0, 8.0, "soft red tool", [1.0, 0.1]),
    ("c", "molds", 64.0, 0.0, "hard blue mold", [0.0, 1.0]),
    ("d", "molds", 66.0, 9.0, "tough blue mold", [0.1, 1.0]),
    ("e", "molds", None, float("nan"), "plain", [1.0, 1.0]),
    ("f", "tools", 60.0, 0.0, "hard red tool", [2.0, 0.0]),
    ("g", "tools", 60.0, 1.0, "never embedded", None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(
        ROWS, "name string, family string, hard double, share double, note string, vector array<double>"
    )


def single(catalog, conditions, vector, k=3):
    rows = hybrid.hybrid_search(
        catalog.drop("vector"), catalog.select("name", "vector"), conditions, vector,
        key="name", allowed=ALLOWED, k=k,
    ).collect()
    return [(r["rank"], r["name"], r["distance"]) for r in sorted(rows, key=lambda r: r["rank"])]


def test_single_query(catalog):
    assert single(catalog, [" hard == 60 "], [1.0, 0.0]) == [(1, "a", 0.0), (2, "f", 0.0)]
    assert single(catalog, ["hard > 100"], [1.0, 0.0]) == []
    assert single(catalog, ["", "  "], None) == [(1, "a", 0.0), (2, "b", 0.0), (3, "c", 0.0)]
    assert single(catalog, None, [0.0, 1.0], k=2) == [(1, "c", 0.0), (2, "d", 0.005)]
    # an OR inside a condition does not leak out of it
    assert single(catalog, ["hard = 64 OR hard = 66", "share = 0"], [1.0, 0.0]) == [(1, "c", 1.0)]


@pytest.mark.parametrize(
    "condition", ["note = 'plain'", "hard >", "nosuch = 1", "hard + 1", "hard > 'abc'", "count(*) > 1"]
)
def test_invalid_condition(catalog, condition):
    with pytest.raises(predicates.InvalidCondition, match="Invalid SQL condition"):
        single(catalog, [condition], None)


BATCH = {
    "q1": (["hard == 60"], [1.0, 0.0]),
    "q2": (["hard > 100"], [1.0, 0.0]),
    "q3": ([], None),
    "q4": (["nosuch = 1", "hard = 60"], [1.0, 0.0]),
    "q5": (None, [0.0, 1.0]),
    "q6": (["family IN ('molds')", "share < 5 OR hard LIKE '66%'"], [0.0, 1.0]),
    "q7": (["family = 'tools'"], None),
    "q8": (["hard == 60"], [0.0, 1.0]),
    "q9": (["share >= 0"], [1.0, 0.0]),
}


def batch(spark, catalog, names, **options):
    queries = spark.createDataFrame(
        [(q, *BATCH[q]) for q in names],
        "query_id string, conditions array<string>, vector array<double>",
    )
    return hybrid.hybrid_search_batch(
        catalog.drop("vector"), catalog.select("name", "vector"), queries,
        key="name", allowed=ALLOWED, **options,
    )


@pytest.mark.parametrize("max_sets", [1000, 3])
def test_batch_equals_single(spark, catalog, max_sets):
    rows = batch(spark, catalog, BATCH, max_sets=max_sets).collect()
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == set(BATCH)
    for q, (conditions, vector) in BATCH.items():
        got = sorted((r["rank"], r["name"], r["distance"]) for r in by_query[q] if r["rank"])
        state = by_query[q][0]
        try:
            expected = single(catalog, conditions, vector)
        except predicates.InvalidCondition:
            assert not state["success"] and "nosuch" in state["error"]
            assert got == [] and state["n_survivors"] == 0 and state["message"] is None
            continue
        assert state["success"] and state["error"] is None
        assert got == [(r, n, pytest.approx(d, abs=1e-4)) for r, n, d in expected]
        kept = predicates.apply_conditions(catalog, conditions, ALLOWED).count()
        assert state["n_survivors"] == kept
        assert (state["message"] == predicates.NO_MATCH) == (kept == 0)


def test_many_conditions_need_several_words(spark, catalog):
    queries = spark.createDataFrame(
        [(i, [f"hard >= {50 + i / 10}", f"share >= {i / 20}"]) for i in range(150)],
        "query_id long, conditions array<string>",
    )
    got = {
        r["query_id"]: r["n_survivors"]
        for r in predicates.evaluate_conditions(catalog, queries, ALLOWED).collect()
    }
    for i in range(150):
        # Spark sorts NaN above every number, but e has no hardness
        expected = sum(1 for r in ROWS if r[2] is not None and r[2] >= 50 + i / 10 and r[3] >= i / 20)
        assert got[i] == expected


def test_unembedded_survivors_are_counted(spark, catalog):
    plan = predicates.plan_conditions(catalog, [["hard = 60"], []], ALLOWED)
    embedded = catalog.filter("vector IS NOT NULL").select("name", "vector")
    got = hybrid.unembedded_counts(catalog, embedded, plan, "name").collect()
    lists = {s.set_id: s.conditions for s in plan.sets}
    assert {lists[r["set_id"]]: r["n_unembedded"] for r in got} == {("hard = 60",): 1, (): 1}


def test_payload_and_struct(spark, catalog):
    results = batch(spark, catalog, ["q1", "q2", "q4"])
    full = hybrid.with_payload(results, catalog, "name", ["name", "hard"])
    payloads = {(r["query_id"], r["name"]): r["payload"] for r in full.collect()}
    assert payloads[("q1", "a")] == '{"name":"a","hard":60.0}'
    assert payloads[("q2", None)] == "{}"
    nested = {r["query_id"]: r for r in hybrid.result_struct(full, "name", ["record"]).collect()}
    assert [m["name"] for m in nested["q1"]["matches"]] == ["a", "f"]
    assert nested["q1"]["matches"][0]["record"]["hard"] == 60.0
    assert nested["q2"]["matches"] == [] and nested["q2"]["message"]


def test_audit_text(spark, catalog):
    plan = predicates.plan_conditions(catalog, [["hard = 60"], ["hard > 100"], []], ALLOWED)
    queries = spark.createDataFrame(
        [("x", ["hard = 60"]), ("y", ["hard > 100"]), ("z", [])], "query_id string, conditions array<string>"
    ).join(plan.table(), "conditions")
    counted = queries.join(predicates.survivor_counts(catalog, plan), "set_id", "left").fillna(0)
    audits = report.audit_text(counted, ["name", "hard"], "catalog", alloys.AUDIT)
    got = {r["query_id"]: r["audit"] for r in audits.collect()}
    assert got["x"] == (
        "SELECT name, hard\nFROM catalog\nWHERE hard = 60\n\n"
        "-- Surviving candidate pool: 3 passed hard bounds"
    )
    assert got["y"].endswith("0 passed hard bounds\n-- ZERO candidates matched (constraint violated)")
    assert got["z"].endswith("7 passed hard bounds")
    kept = predicates.survivors(catalog, plan, "name")
    names = report.audit_survivors(queries, kept, "name").collect()
    assert sorted((r["query_id"], r["position"], r["name"]) for r in names) == [
        *(("x", i, n) for i, n in enumerate("afg", 1)),
        *(("z", i, r["name"]) for i, r in enumerate(catalog.select("name").orderBy("name").collect(), 1)),
    ]


def test_typed_conditions(spark):
    df = spark.createDataFrame(
        [(["co >= 1.5", "fam = 'Cold work'", "a <= 62 AND b >= 58", "x LIKE 'y'"],)], "c array<string>"
    )
    row = df.select(
        predicates.parse_conditions(F.col("c")).alias("t"),
        predicates.refused_fields(predicates.parse_conditions(F.col("c")), ["co", "a", "b"]).alias("r"),
    ).first()
    assert [tuple(t) for t in row["t"]] == [
        ("co", ">=", 1.5, None),
        ("fam", "=", None, "Cold work"),
        ("a", "<=", 62.0, None),
        ("b", ">=", 58.0, None),
        (None, None, None, None),
    ]
    assert row["r"] == ["fam", None]


def test_ask_searches_equal_requests_once(spark, catalog):
    from sieverank.operators.routing import Rule

    rules = [Rule(1, 1, r"\bhard\b", "hard >= 60"), Rule(2, 1, r"never", "hard > 100")]
    template = [["Best: ", ("name", "?")], ["Hardness ", ("hard", "n/a")]]
    texts = spark.createDataFrame(
        [(i, "A hard RED tool") for i in range(40)]
        + [(90, "never hard"), (91, "hard 10"), (92, "for the"), (93, "blue mold")],
        "text_id long, text string",
    )
    index = build_index(catalog.select("name", "note"), "name", "note", stored=True)
    got = {
        r["text_id"]: r
        for r in hybrid.ask(
            texts, catalog, index, rules, template, text_id="text_id", allowed=ALLOWED
        ).collect()
    }
    assert len(got) == 44
    for i in range(40):
        assert [m["name"] for m in got[i]["matches"]] == ["a", "f", "b"]
    assert got[0]["final_answer"] == "Best: a\nHardness 60.0\n\nNext best: f, b"
    assert "`hard >= 60 AND hard > 100`" in got[90]["final_answer"]
    assert got[92]["conditions"] == [] and [m["distance"] for m in got[92]["matches"]] == [0.0] * 3
    assert [m["name"] for m in got[93]["matches"]][:2] == ["c", "d"]


def test_query_database_reports_instead_of_raising(catalog):
    def run(conditions, vector):
        return hybrid.query_database(
            catalog.drop("vector"), catalog.select("name", "vector"), conditions, vector,
            key="name", allowed=ALLOWED, payload=["hard"],
        ).first()

    good = run(["hard = 60"], [1, 0])
    assert good["success"] and [(m["name"], m["record"]["hard"]) for m in good["matches"]] == [("a", 60.0), ("f", 60.0)]
    bad = run(["nosuch = 60"], None)
    assert not bad["success"] and bad["error"].startswith("Invalid SQL condition") and bad["matches"] == []
    assert run(["hard > 99"], [1, 0])["message"] == predicates.NO_MATCH


def test_reports(spark):
    df = spark.createDataFrame(
        [("q", 1, "a", 0.12345, "tools", 66.5, 8.5, ["x = 1", "y > 2"]), ("q", 2, "b", 0.5, None, None, None, [])],
        "query_id string, rank long, name string, distance double, family string, peak double, share double, c array<string>",
    )
    shown = report.ranking_table(df, "name", "family", "peak", "share", (" HRC", "%")).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in shown] == [
        ("#1", "a", "0.1235", "tools", "66 HRC", "8.5%"),
        ("#2", "b", "0.5000", "N/A", "0 HRC", "0%"),
    ]
    sql = df.orderBy("rank").select(report.sql_query(F.col("c"), ["name"], "t").alias("s")).collect()
    assert [r["s"] for r in sql] == ["SELECT name FROM t WHERE x = 1 AND y > 2", "SELECT name FROM t"]


def test_a_condition_that_fails_spoils_its_own_query(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "x int, s string")
    queries = spark.createDataFrame(
        [(1, ["x > 0"]), (2, ["10 / x > 1"]), (3, ["10 / (x + 1) > 4"]), (4, ["cast(s as int) > 0"]), (5, ["nullif(x, 1) = 0"])],
        "query_id int, conditions array<string>",
    )
    got = {r["query_id"]: r for r in predicates.evaluate_conditions(rows, queries, ["x", "s"]).collect()}
    assert [got[i]["success"] for i in range(1, 6)] == [True, False, True, False, True]
    assert "DIVIDE_BY_ZERO" in got[2]["error"] and "CAST_INVALID_INPUT" in got[4]["error"]
    assert [got[i]["n_survivors"] for i in range(1, 6)] == [2, 0, 2, 0, 1]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize(
    "condition",
    ["(select max(x) from secret) > 1", "java_method('java.lang.System', 'x') <> ''", "rand() > 0.5", "`rand`() > 0.5", "x > 0 -- y",
     "current_date > date'2020-01-01'", "x > 0; drop table t", "exists (select 1)", "secret.x > 0", "uuid() = s", "x > /* y */ 0"],
)
def test_conditions_stay_within_their_fields(spark, condition):
    rows = spark.createDataFrame([(1, "a")], "x int, s string")
    spark.createDataFrame([(5,)], "x int").createOrReplaceTempView("secret")
    assert condition in predicates.condition_errors(rows, [condition, "x > 0"], ["x", "s"])


@pytest.mark.parametrize(
    "condition",
    ["x > 0", "x = 1 OR s = 'rand()'", "s LIKE 'it''s%'", "x BETWEEN 0 AND 5", "s IN ('select', 'b')", "NOT x IS NULL", "`x` >= 1.5e0",
     "10 / (x - 1) > 0", "CASE WHEN x > 0 THEN true ELSE false END", "lower(s) = 'a'", "cast(s as int) > 0", 's = "b"', "x <=> 1"],
)
def test_plain_conditions_are_taken(spark, condition):
    rows = spark.createDataFrame([(1, "a")], "x int, s string")
    assert predicates.condition_errors(rows, [condition], ["x", "s"]) == {}


def test_a_vector_of_other_width_spoils_its_own_query(spark, catalog):
    vectors = spark.createDataFrame([(r[0], r[5]) for r in ROWS], "name string, vector array<double>")
    queries = spark.createDataFrame([(1, [], [1.0, 0.0]), (2, [], [1.0])], "query_id int, conditions array<string>, vector array<double>")
    found = hybrid.hybrid_search_batch(catalog, vectors, queries, key="name", allowed=ALLOWED).collect()
    assert sorted({(r["query_id"], r["success"]) for r in found}) == [(1, True), (2, False)]
    assert [r["error"] for r in found if r["query_id"] == 2] == ["The query vector has 1 dimensions, the records have 2."]
