"""Conditions for one query and for tables of queries, hybrid search, and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieverank.functions.text import trim_number
from sieverank.operators import hybrid, predicates, report
from sieverank.plans.groups import (
    ALLOWED,
    CONDITION_TEXT_SQL,
    GROUPS_SQL,
    NO_MATCH_SQL,
    catalog_of,
    group_queries,
    mean_vectors,
    vectors_of,
)
from sieverank.plans.tables import registry, table
from sieverank.profiles import alloys
from sieverank.session import cut

QUERIES, ORACLES, registered = registry()


@registered(
    """SELECT doc_id, lang, n_chars FROM documents
       WHERE (lang = 'en' OR lang = 'fr') AND (n_chars >= 1000) AND (source LIKE 'src1%')"""
)
def conditions_filter(spark, sf_dir):
    conditions = ["lang == 'en' OR lang = 'fr'", " n_chars >= 1000 ", "", "source LIKE 'src1%'"]
    return predicates.apply_conditions(catalog_of(spark, sf_dir), conditions, ALLOWED).select("doc_id", "lang", "n_chars")


@registered("SELECT p_partkey FROM part WHERE p_size <= 32 AND p_size + 5 >= 28")
def window_overlap(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").filter(predicates.overlaps(size, size + 5, 30)).select("p_partkey")


PART_FIELDS = ["p_brand", "p_type", "p_size", "p_retailprice"]


def part_queries(spark, sf_dir):
    """One query per brand and type, with bounds taken from its own parts."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi")
    )
    conditions = F.expr(
        """CASE p_type
             WHEN 'PROMO' THEN array('p_container = 3', 'p_size >= ' || lo)
             WHEN 'LARGE' THEN array('p_size > ' || hi || ' AND p_size < ' || lo)
             WHEN 'SMALL' THEN array("p_brand IN ('" || p_brand || "', 'Brand#1')", "p_type = 'SMALL' OR p_size = " || hi)
             ELSE array("p_type == '" || p_type || "'", 'p_size >= ' || (lo + 5), 'p_size <= ' || (hi - 5)) END"""
    )
    return groups.select(F.concat_ws("/", "p_brand", "p_type").alias("query_id"), "p_type", conditions.alias("conditions"))


_PART_KEPT = """
    q AS (SELECT p_brand || '/' || p_type AS query_id, p_brand AS b, p_type AS t, min(p_size) AS lo, max(p_size) AS hi
          FROM part GROUP BY p_brand, p_type),
    kept AS (SELECT query_id, p_partkey FROM q JOIN part ON CASE t
        WHEN 'PROMO' THEN false
        WHEN 'LARGE' THEN p_size > hi AND p_size < lo
        WHEN 'SMALL' THEN p_brand IN (b, 'Brand#1') AND (p_type = 'SMALL' OR p_size = hi)
        ELSE p_type = t AND p_size >= lo + 5 AND p_size <= hi - 5 END)"""


@registered(
    f"""WITH {_PART_KEPT}, l AS (SELECT query_id, CASE t
          WHEN 'LARGE' THEN 'p_size > ' || hi || ' AND p_size < ' || lo
          WHEN 'SMALL' THEN 'p_brand IN (~' || b || '~, ~Brand#1~) & p_type = ~SMALL~ OR p_size = ' || hi
          ELSE 'p_type = ~' || t || '~ & p_size >= ' || (lo + 5) || ' & p_size <= ' || (hi - 5) END AS conditions FROM q)
        SELECT DISTINCT replace(conditions, '~', chr(39)) AS conditions, p_partkey FROM kept JOIN l USING (query_id)"""
)
def conditions_as_data(spark, sf_dir):
    """The survivors of every distinct condition list, which queries with that list share."""
    part = table(spark, sf_dir, "part")
    asked = cut(part_queries(spark, sf_dir), "part-queries")
    queries = asked.withColumn("conditions", predicates.normalise(F.col("conditions")))
    found = [
        predicates.survivors(part, plan, "p_partkey").join(F.broadcast(plan.table()), "set_id")
        for _, plan in predicates.planned_parts(part, queries, PART_FIELDS)
    ]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.array_join("conditions", " & ").alias("conditions"), "p_partkey")


@registered(
    f"""WITH {_PART_KEPT}, c AS (SELECT query_id, count(*) AS n FROM kept GROUP BY query_id)
        SELECT query_id, t <> 'PROMO' AS success, t = 'PROMO' AS has_error, coalesce(n, 0) AS n_survivors,
          CASE WHEN t <> 'PROMO' AND n IS NULL THEN 'No record meets all conditions.' END AS message
        FROM q LEFT JOIN c USING (query_id)"""
)
def no_match_and_errors(spark, sf_dir):
    asked = cut(part_queries(spark, sf_dir), "part-queries")
    outcome = predicates.evaluate_conditions(table(spark, sf_dir, "part"), asked, PART_FIELDS)
    return outcome.select(
        "query_id", "success", F.col("error").isNotNull().alias("has_error"), "n_survivors", "message"
    )


@registered(
    """SELECT lang, source, n_chars // 1000 * 1000 AS bound, (lang IN ('de', 'es')) AS refused, count(*) AS n
       FROM documents GROUP BY ALL"""
)
def typed_conditions(spark, sf_dir):
    """Condition texts made from the documents, read back as typed entries and checked."""
    texts = F.expr(
        """array('n_chars >= ' || (n_chars div 1000 * 1000) || " AND source = '" || source || "'",
                 if(lang IN ('de', 'es'), "language = '", "lang = '") || lang || "'")"""
    )
    typed = table(spark, sf_dir, "documents").select(predicates.parse_conditions(texts).alias("t"))
    refused = F.size(predicates.refused_fields(F.col("t"), ALLOWED)) > 0
    return typed.select(
        F.col("t")[2]["text"].alias("lang"), F.col("t")[1]["text"].alias("source"),
        F.col("t")[0]["number"].cast("long").alias("bound"), refused.alias("refused"),
    ).groupBy("lang", "source", "bound", "refused").agg(F.count("*").alias("n"))


@registered(
    """WITH q AS (SELECT list(x ORDER BY i) AS qv FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS x
                  FROM embeddings JOIN documents ON doc_id = vec_id AND lang = 'fr', range(1, 65) r(i) GROUP BY i)),
       s AS (SELECT doc_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS dist
             FROM documents JOIN embeddings ON doc_id = vec_id, q WHERE lang = 'en' AND n_chars >= 500)
       SELECT rank, doc_id, round(dist, 4) AS distance FROM (
         SELECT *, row_number() OVER (ORDER BY round(dist, 9), doc_id) AS rank FROM s) WHERE rank <= 3"""
)
def hybrid_single(spark, sf_dir):
    """English documents nearest to the mean of the French ones."""
    catalog, vectors = catalog_of(spark, sf_dir), vectors_of(spark, sf_dir)
    french = catalog.filter("lang = 'fr'").join(vectors, "doc_id")
    mean = mean_vectors(french, []).first()["vector"]  # one row, one vector
    return hybrid.hybrid_search(
        catalog, vectors, ["lang == 'en'", "n_chars >= 500"], mean, key="doc_id", allowed=ALLOWED
    )


@registered(
    """SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, CAST(0.0 AS DOUBLE) AS distance FROM documents
       WHERE lang = 'es' ORDER BY doc_id LIMIT 3"""
)
def blank_query(spark, sf_dir):
    return hybrid.hybrid_search(
        catalog_of(spark, sf_dir), vectors_of(spark, sf_dir), ["lang = 'es'"], None, key="doc_id", allowed=ALLOWED
    )


def _search_groups(spark, sf_dir):
    return hybrid.hybrid_search_batch(
        catalog_of(spark, sf_dir), vectors_of(spark, sf_dir), group_queries(spark, sf_dir),
        key="doc_id", allowed=ALLOWED,
    )


def group_results(spark, sf_dir):
    """The results of all group queries, stored: reports read them more than once."""
    return cut(_search_groups(spark, sf_dir), "group-results")


@registered(
    f"""WITH {GROUPS_SQL} SELECT q.query_id, success, NOT success AS has_error, {NO_MATCH_SQL} AS message,
          coalesce(n, 0) AS n_survivors, rank, doc_id, distance
        FROM q LEFT JOIN counts USING (query_id) LEFT JOIN hits ON hits.query_id = q.query_id"""
)
def hybrid_batch(spark, sf_dir):
    results = _search_groups(spark, sf_dir)
    return results.withColumn("has_error", F.col("error").isNotNull()).drop("error")


@registered(
    f"""WITH {GROUPS_SQL} SELECT query_id, count(*) FILTER (v IS NULL) AS n_unembedded FROM kept
        GROUP BY query_id HAVING count(*) FILTER (v IS NULL) > 0"""
)
def unembedded(spark, sf_dir):
    """Survivors of each query that have no vector."""
    catalog = catalog_of(spark, sf_dir)
    asked = group_queries(spark, sf_dir).withColumn("conditions", predicates.normalise(F.col("conditions")))
    counted = [
        part.select("query_id", "set_id")
        .join(hybrid.unembedded_counts(catalog, vectors_of(spark, sf_dir), plan, "doc_id"), "set_id")
        .select("query_id", "n_unembedded")
        for part, plan in predicates.planned_parts(catalog, asked, ALLOWED)
    ]
    whole = counted[0]
    for more in counted[1:]:
        whole = whole.unionByName(more)
    return whole


@registered(
    f"""WITH {GROUPS_SQL}, t AS (SELECT q.*, {CONDITION_TEXT_SQL} AS conds FROM q)
        SELECT t.query_id, success, NOT success AS has_error, {NO_MATCH_SQL} AS message, coalesce(n, 0) AS n_survivors,
          array_to_string(conds, ' & ') AS sql_conditions, 'near ' || t.query_id AS semantic_query,
          'SELECT doc_id, lang, source, n_chars FROM documents' ||
            CASE WHEN len(conds) = 0 THEN '' ELSE ' WHERE ' || array_to_string(conds, ' AND ') END AS sql_query,
          coalesce(string_agg(doc_id || ':' || hits.lang || ':' || n_chars, ' ' ORDER BY rank), '') AS matches
        FROM t LEFT JOIN counts USING (query_id) LEFT JOIN hits ON hits.query_id = t.query_id GROUP BY ALL"""
)
def result_struct(spark, sf_dir):
    """One row per query with what was asked, and its matches with their records."""
    full = hybrid.with_payload(group_results(spark, sf_dir), catalog_of(spark, sf_dir), "doc_id", ["lang", "n_chars"])
    asked = group_queries(spark, sf_dir).withColumn("semantic_query", F.concat(F.lit("near "), "query_id"))
    nested = hybrid.result_struct(full, "doc_id", ["record"], asked, ALLOWED, "documents")
    shown = F.transform(
        "matches", lambda m: F.concat_ws(":", m["name"].cast("string"), m["record"]["lang"], m["record"]["n_chars"].cast("string"))
    )
    return nested.select(
        "query_id", "success", F.col("error").isNotNull().alias("has_error"), "message", "n_survivors",
        F.array_join("sql_conditions", " & ").alias("sql_conditions"), "semantic_query", "sql_query",
        F.array_join(shown, " ").alias("matches"),
    )


@registered(
    f"""WITH {GROUPS_SQL} SELECT q.query_id, rank, CASE WHEN doc_id IS NULL THEN '' ELSE hits.lang END AS payload_lang,
          coalesce(n_chars, 0) AS payload_chars
        FROM q LEFT JOIN hits ON hits.query_id = q.query_id"""
)
def payload_lookup(spark, sf_dir):
    full = hybrid.with_payload(group_results(spark, sf_dir), catalog_of(spark, sf_dir), "doc_id", ["lang", "n_chars"])
    return full.select(
        "query_id", "rank",
        F.coalesce(F.get_json_object("payload", "$.lang"), F.lit("")).alias("payload_lang"),
        F.coalesce(F.get_json_object("payload", "$.n_chars").cast("long"), F.lit(0)).alias("payload_chars"),
    )


@registered(
    f"""WITH {GROUPS_SQL} SELECT query_id, max(doc_id) FILTER (rank = 1) AS best, max(distance) FILTER (rank = 1) AS best_distance,
          coalesce(string_agg(doc_id::VARCHAR, ', ' ORDER BY rank) FILTER (rank > 1), '') AS alternates FROM hits GROUP BY query_id"""
)
def best_and_alternates(spark, sf_dir):
    return report.best_and_alternates(group_results(spark, sf_dir), "doc_id")


@registered(
    f"""WITH {GROUPS_SQL} SELECT query_id, '#' || rank AS rank, doc_id AS name, printf('%.4f', distance) AS distance,
          hits.lang AS family, n_chars::VARCHAR AS peak, (n_chars // 10) || CASE n_chars % 10 WHEN 0 THEN '' ELSE '.' || (n_chars % 10) END AS share
        FROM hits"""
)
def ranking_report(spark, sf_dir):
    results = group_results(spark, sf_dir)
    detailed = hybrid.with_payload(results, catalog_of(spark, sf_dir), "doc_id", ["lang", "n_chars"]).select(
        "*", F.col("record.lang").alias("lang"), F.col("record.n_chars").alias("chars"),
        (F.col("record.n_chars") / 10).alias("tenth"),
    )
    return report.ranking_table(detailed, "doc_id", "lang", "chars", "tenth")


@registered(
    f"""WITH {GROUPS_SQL} SELECT query_id, rank, round(greatest(0.0, 100 - distance * 50), 4) AS proximity,
          round(least(greatest(distance * 9 * 10, 0.0), 100.0), 4) AS score_pct FROM hits"""
)
def match_scores(spark, sf_dir):
    found = group_results(spark, sf_dir).filter("rank IS NOT NULL").withColumn("score", F.col("distance") * 9)
    scored = report.rating_bars(report.match_scores(found), ["score"])
    return scored.select("query_id", "rank", F.round("proximity", 4).alias("proximity"), F.round("score_pct", 4).alias("score_pct"))


@registered(
    """SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2) || '.5' END AS half,
         '0' AS not_a_number FROM part"""
)
def trimmed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", trim_number(F.col("p_size") / 2).alias("half"), trim_number(F.col("p_name")).alias("not_a_number")
    )


@registered(
    f"""WITH {GROUPS_SQL}, t AS (SELECT q.*, coalesce(n, 0) AS n, {CONDITION_TEXT_SQL} AS conds FROM q LEFT JOIN counts USING (query_id))
        SELECT query_id, CASE WHEN len(conds) = 0 THEN 'SELECT * FROM documents -- no strict numeric bounds extracted'
            ELSE 'SELECT doc_id, lang, source, n_chars' || chr(10) || 'FROM documents' || chr(10) || 'WHERE ' ||
              array_to_string(conds, chr(10) || '  AND ') END
          || chr(10) || chr(10) || '-- Surviving candidate pool: ' || n || ' passed hard bounds'
          || CASE WHEN n = 0 THEN chr(10) || '-- ZERO candidates matched (constraint violated)' ELSE '' END AS audit
        FROM t"""
)
def audit_text(spark, sf_dir):
    catalog = catalog_of(spark, sf_dir)
    texts = []
    for part, plan in predicates.planned_parts(catalog, _asked_groups(spark, sf_dir), ALLOWED):
        counted = part.join(predicates.survivor_counts(catalog, plan), "set_id", "left").fillna(0, ["n_survivors"])
        texts.append(report.audit_text(counted, ALLOWED, "documents", alloys.AUDIT))
    return _whole(texts)


@registered(
    f"""WITH {GROUPS_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS position, doc_id FROM kept"""
)
def audit_survivors(spark, sf_dir):
    """The names of every query's survivors, in order."""
    catalog = catalog_of(spark, sf_dir)
    parts = predicates.planned_parts(catalog, _asked_groups(spark, sf_dir), ALLOWED)
    found = [report.audit_survivors(part, predicates.survivors(catalog, plan, "doc_id"), "doc_id") for part, plan in parts]
    return _whole(found).select("query_id", F.col("position").cast("long").alias("position"), "doc_id")


@registered(f"WITH {GROUPS_SQL} SELECT query_id, doc_id FROM kept")
def query_survivors(spark, sf_dir):
    """The survivors of every query, in error none."""
    return hybrid.query_survivors(catalog_of(spark, sf_dir), group_queries(spark, sf_dir), "doc_id", ALLOWED)


@registered(
    """SELECT o_orderkey AS query_id, c.c_custkey FROM orders JOIN customer o ON o.c_custkey = o_custkey
       JOIN customer c ON c.c_mktsegment = o.c_mktsegment AND c.c_nationkey = o.c_nationkey AND c.c_acctbal >= floor(o_totalprice / 50)"""
)
def many_condition_lists(spark, sf_dir):
    """A condition list per order: customers of its customer's segment and nation with enough money."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    conditions = F.expr(
        """array("c_mktsegment = '" || c_mktsegment || "'",
                 'c_nationkey = ' || c_nationkey || ' AND c_acctbal >= ' || cast(floor(o_totalprice / 50) as bigint))"""
    )
    asked = orders.join(customers, orders.o_custkey == customers.c_custkey)
    queries = cut(asked.select(F.col("o_orderkey").alias("query_id"), conditions.alias("conditions")), "order-queries")
    return hybrid.query_survivors(customers, queries, "c_custkey", ["c_mktsegment", "c_nationkey", "c_acctbal"])


@registered(
    """SELECT o_orderkey AS query_id, p_partkey FROM orders JOIN part
         ON p_retailprice >= (900000 + floor(o_totalprice)::BIGINT % 100000) / 1000.0
        AND p_retailprice < (900250 + floor(o_totalprice)::BIGINT % 100000) / 1000.0 AND p_size >= o_custkey % 50"""
)
def range_condition_lists(spark, sf_dir):
    """A condition list per order, ranges only and nearly all different: parts of a narrow range of prices and some size."""
    said = """(900 + {0} div 1000) || '.' || lpad({0} % 1000, 3, '0')"""
    conditions = F.expr(
        f"""array('p_retailprice >= ' || {said.format('cents')}, 'p_retailprice < ' || {said.format('(cents + 250)')} || ' AND p_size >= ' || (o_custkey % 50))"""
    )
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.floor("o_totalprice") % 100_000)
    queries = cut(orders.select(F.col("o_orderkey").alias("query_id"), conditions.alias("conditions")), "order-ranges")
    return hybrid.query_survivors(table(spark, sf_dir, "part"), queries, "p_partkey", ["p_size", "p_retailprice"])


_RISKY = """CASE source
    WHEN 'src1' THEN array("lang = 'en'", '1000 / (n_chars - n_chars % 2 - doc_id * 2) > 1')
    WHEN 'src2' THEN array("cast(substr(lang, 1, 1) as int) > 0")
    WHEN 'src3' THEN array('(select max(doc_id) from documents) > 1')
    WHEN 'src4' THEN array('rand() > 0.5')
    WHEN 'src5' THEN array("java_method('java.lang.System', 'currentTimeMillis') <> ''")
    WHEN 'src6' THEN array('1000 / (n_chars + 1) > 1')
    WHEN 'src7' THEN array('nullif(n_chars, 100) > 50')
    WHEN 'src8' THEN array('n_chars * 9223372036854775807 < 0')
    WHEN 'src9' THEN array("n_chars > 5", 'n_chars * 9223372036854775807 > 7')
    WHEN 'src10' THEN array("lang > 0")
    WHEN 'src11' THEN array("lang > 0 OR lang = 'en'", 'n_chars % (doc_id - doc_id) = 0')
    WHEN 'src12' THEN array('n_chars * 2147483647 > 0', 'try_divide(n_chars, n_chars - n_chars) is null')
    ELSE array("lang = 'en'") END"""


@registered(
    """WITH q AS (SELECT DISTINCT source FROM documents),
       r AS (SELECT source, CASE
           WHEN source IN ('src3', 'src4', 'src5') THEN 'refused'
           WHEN source IN ('src2', 'src10') THEN 'CAST_INVALID_INPUT'
           WHEN source = 'src1' AND EXISTS (FROM documents WHERE n_chars - n_chars % 2 - doc_id * 2 = 0) THEN 'DIVIDE_BY_ZERO'
           WHEN source IN ('src8', 'src9') AND EXISTS (FROM documents WHERE n_chars > 1) THEN 'ARITHMETIC_OVERFLOW'
           WHEN source = 'src11' THEN 'CAST_INVALID_INPUT, REMAINDER_BY_ZERO' END AS reason FROM q)
       SELECT source AS query_id, reason IS NULL AS success, reason,
         CASE WHEN reason IS NOT NULL THEN 0
              WHEN source = 'src1' THEN (SELECT count(*) FROM documents WHERE lang = 'en' AND 1000.0 / (n_chars - n_chars % 2 - doc_id * 2) > 1)
              WHEN source = 'src6' THEN (SELECT count(*) FROM documents WHERE 1000.0 / (n_chars + 1) > 1)
              WHEN source = 'src7' THEN (SELECT count(*) FROM documents WHERE nullif(n_chars, 100) > 50)
              WHEN source IN ('src8', 'src9') THEN 0
              WHEN source = 'src12' THEN (SELECT count(*) FROM documents WHERE n_chars > 0)
              ELSE (SELECT count(*) FROM documents WHERE lang = 'en') END AS n_survivors FROM r"""
)
def condition_runtime_errors(spark, sf_dir):
    """Conditions that fail on some row, or are refused, beside good ones: each spoils its own query only."""
    documents = catalog_of(spark, sf_dir)
    asked = cut(documents.select(F.col("source").alias("query_id"), F.expr(_RISKY).alias("conditions")).distinct(), "risky")
    outcome = predicates.evaluate_conditions(documents, asked, ALLOWED)
    named = F.array_join(F.regexp_extract_all("error", F.lit(r"\[([A-Z_]+)[.\]]"), F.lit(1)), ", ")
    reason = F.when(F.col("error").contains("is not allowed"), "refused").otherwise(named)
    return outcome.select("query_id", "success", reason.alias("reason"), "n_survivors")


def _asked_groups(spark, sf_dir):
    return group_queries(spark, sf_dir).withColumn("conditions", predicates.normalise(F.col("conditions")))


def _whole(parts):
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
