"""Rule checks and scores of search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieverank.functions.measures import rule_holds
from sieverank.operators import evaluate, hybrid, nearest
from sieverank.plans.batches import group_results
from sieverank.plans.groups import GROUPS_SQL, catalog_of, mean_vectors, vectors_of
from sieverank.plans.tables import registry, table
from sieverank.profiles import alloys
from sieverank.session import cut

QUERIES, ORACLES, registered = registry()


@registered(
    """SELECT l_returnflag, l_linenumber::BIGINT AS l_linenumber, op, count(*) FILTER (CASE op
          WHEN '==' THEN abs(v - t) < 1e-4 WHEN '>' THEN v > t - 1e-4 WHEN '>=' THEN v >= t - 1e-4
          WHEN '<' THEN v < t + 1e-4 WHEN '<=' THEN v <= t + 1e-4 ELSE false END) AS n_holding
       FROM (SELECT *, l_discount AS v, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax + 0.01 END AS t,
               CASE l_linenumber WHEN 1 THEN '==' WHEN 2 THEN '>' WHEN 3 THEN '>=' WHEN 4 THEN '<' WHEN 5 THEN '<=' ELSE '!=' END AS op
             FROM lineitem) GROUP BY ALL"""
)
def rule_eps(spark, sf_dir):
    op = F.expr(
        "CASE l_linenumber WHEN 1 THEN '==' WHEN 2 THEN '>' WHEN 3 THEN '>=' WHEN 4 THEN '<' WHEN 5 THEN '<=' ELSE '!=' END"
    )
    threshold = F.when(F.col("l_tax") != 0, F.col("l_tax") + 0.01)
    lines = table(spark, sf_dir, "lineitem").withColumn("op", op)
    holds = rule_holds(F.col("l_discount"), F.col("op"), threshold)
    return lines.groupBy("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber"), "op").agg(
        F.count_if(holds).alias("n_holding")
    )


def _cases(spark, sf_dir):
    """A case per group query: impossible ones allow no match, expected is the longest document of the group."""
    documents = catalog_of(spark, sf_dir)
    longest = documents.groupBy("lang", "source").agg(
        F.max_by("doc_id", F.struct("n_chars", "doc_id")).cast("string").alias("longest"),
        F.floor(F.avg("n_chars")).alias("avg_chars"),
    )
    return longest.select(
        F.concat_ws("/", "lang", "source").alias("case_id"),
        F.array("longest").alias("expected"),
        F.col("source").isin("src18", "src16").alias("allow_no_match"),
        "source",
        "avg_chars",
    )


def _rules(cases):
    """Rules of a case: its mean length as a lower bound, a field no record has, and an upper bound."""
    rules = F.array(
        F.struct(F.lit("n_chars").alias("field"), F.lit(">=").alias("op"), F.col("avg_chars").cast("double").alias("threshold")),
        F.struct(F.lit("absent").alias("field"), F.lit("==").alias("op"), F.lit(0.0).alias("threshold")),
        F.struct(F.lit("n_chars").alias("field"), F.lit("<").alias("op"), F.lit(10000.0).alias("threshold")),
    )
    return cases.select("case_id", F.posexplode(rules).alias("rule_pos", "rule")).select(
        "case_id", "rule_pos", "rule.field", "rule.op", "rule.threshold"
    )


def evaluated_groups(spark, sf_dir):
    found = group_results(spark, sf_dir).filter("rank IS NOT NULL")
    detailed = hybrid.with_payload(found, catalog_of(spark, sf_dir), "doc_id", ["n_chars"])
    matches = detailed.select(
        F.col("query_id").alias("case_id"), "rank", F.col("doc_id").alias("name"),
        F.create_map(F.lit("n_chars"), F.col("record.n_chars").cast("double")).alias("fields"),
    )
    cases = cut(_cases(spark, sf_dir), "cases")
    return evaluate.evaluate_cases(cases.select("case_id", "expected", "allow_no_match"), matches, _rules(cases), wording=alloys.EVALUATION)


_EVALUATED = f"""WITH {GROUPS_SQL},
    cases AS (SELECT lang || '/' || source AS case_id, arg_max(doc_id, struct_pack(a := n_chars, b := doc_id)) AS longest,
        source IN ('src18', 'src16') AS allow_no_match, CAST(floor(avg(n_chars)) AS BIGINT) AS bound FROM d GROUP BY lang, source),
    broken AS (SELECT query_id, rank, 0 AS pos, doc_id, n_chars, bound, '>=' AS op, bound::DOUBLE AS threshold FROM hits JOIN cases ON case_id = query_id
               WHERE NOT n_chars >= bound - 1e-4
               UNION ALL SELECT query_id, rank, 2, doc_id, n_chars, bound, '<', 10000.0 FROM hits JOIN cases ON case_id = query_id
               WHERE NOT n_chars < 10000 + 1e-4),
    firsts AS (SELECT query_id, arg_min('Grade ' || doc_id || ' violated rule n_chars ' || op || ' ' || threshold::BIGINT || '.0 (actual=' || n_chars || '.0)',
                 struct_pack(a := rank, b := pos)) AS text FROM broken GROUP BY query_id),
    returned AS (SELECT query_id, string_agg(doc_id::VARCHAR, ', ' ORDER BY rank) AS names, count(*) AS n FROM hits GROUP BY query_id),
    evaluated AS (SELECT case_id, coalesce(names, '') AS returned_names,
        CASE WHEN allow_no_match AND n > 0 THEN 'Expected 0 matches for impossible query, but got ' || names
             WHEN NOT allow_no_match AND n IS NULL THEN 'No candidates returned for valid query'
             WHEN NOT allow_no_match THEN text END AS constraint_violation,
        CASE WHEN allow_no_match THEN (n IS NULL)::INT WHEN list_contains(string_split(names, ', '), longest::VARCHAR) THEN 1 ELSE 0 END::DOUBLE AS hit_at_k
      FROM cases LEFT JOIN returned ON returned.query_id = case_id LEFT JOIN firsts ON firsts.query_id = case_id),
    rated AS (SELECT *, constraint_violation IS NULL AS constraint_pass,
        CASE WHEN constraint_violation IS NULL THEN hit_at_k ELSE 0.0 END AS score FROM evaluated)"""


@registered(
    f"""{_EVALUATED} SELECT case_id, returned_names, constraint_pass, constraint_violation, hit_at_k, score FROM rated"""
)
def constraint_check(spark, sf_dir):
    return evaluated_groups(spark, sf_dir).select(
        "case_id", F.array_join("returned_names", ", ").alias("returned_names"), "constraint_pass",
        "constraint_violation", "hit_at_k", "score",
    )


@registered(
    f"""{_EVALUATED} SELECT case_id, CASE WHEN constraint_pass THEN 'PASS (100%)' ELSE 'FAIL (0%)' END AS constraint_check,
          CASE hit_at_k WHEN 1 THEN '1.0' ELSE '0.0' END AS hit_at_k,
          CASE returned_names WHEN '' THEN 'None (Correct)' ELSE split_part(returned_names, ', ', 1) END AS top_match,
          CASE score WHEN 1 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM rated"""
)
def scorecard(spark, sf_dir):
    return evaluate.scorecard(evaluated_groups(spark, sf_dir), alloys.SCORECARD)


@registered(
    f"""{_EVALUATED}, c AS (SELECT count(*) AS total, count(*) FILTER (constraint_pass) AS passed_constraints,
          count(*) FILTER (hit_at_k = 1) AS passed_hits, count(*) FILTER (score = 1) AS total_passed FROM rated)
        SELECT *, round(100.0 * passed_constraints / total, 1) AS constraint_rate, round(100.0 * passed_hits / total, 1) AS hit_rate,
          round(100.0 * total_passed / total, 1) AS overall_rate FROM c"""
)
def summary(spark, sf_dir):
    return evaluate.summary(evaluated_groups(spark, sf_dir))


@registered(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       c AS (SELECT label, list(x ORDER BY i) AS qv FROM (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
       r AS (SELECT c.label AS q, e.label AS l, row_number() OVER (PARTITION BY c.label
               ORDER BY round(1 - list_cosine_similarity(v, qv), 9), vec_id) AS rank FROM c, e)
       SELECT q::BIGINT AS case_id, max((q = l)::INT)::DOUBLE AS hit_at_k FROM r WHERE rank <= 3 GROUP BY q"""
)
def hit_at_k(spark, sf_dir):
    """Whether the three vectors nearest to the mean of a label include one of that label."""
    vectors = vectors_of(spark, sf_dir)
    queries = mean_vectors(vectors, ["label"]).withColumnRenamed("label", "query_id")
    found = nearest.knn(queries, vectors, 3, "doc_id").join(vectors.select("doc_id", "label"), "doc_id")
    returned = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("m"))
    labels = F.transform("m", lambda m: m["label"])
    return returned.select(
        F.col("query_id").cast("long").alias("case_id"),
        evaluate.hit_at_k(labels, F.array("query_id")).alias("hit_at_k"),
    )
