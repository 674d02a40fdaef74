"""Search queries derived from the tables: one per language and source.

Each asks for the documents nearest to the mean vector of its group, under conditions that
differ by source, so that every kind of condition list occurs: equality and range, OR,
BETWEEN, LIKE, IN, none, one nothing meets, one with an unknown field, and a query without a
search vector.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieverank.plans.tables import table
from sieverank.session import cut

ALLOWED = ["doc_id", "lang", "source", "n_chars"]


def vectors_of(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"
    )


def catalog_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(*ALLOWED)


def mean_vectors(rows, group):
    """Mean vector per group: one average per dimension, taken before the shuffle."""
    width = rows.select(F.size("vector").alias("n")).filter("n > 0").limit(1).collect()
    means = [F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(width[0]["n"] if width else 0)]
    vector = F.array(*means) if means else F.lit(None).cast("array<double>")
    return rows.groupBy(*group).agg(vector.alias("vector"))


_CONDITIONS = """CASE source
    WHEN 'src19' THEN array('no_such_field = 1', 'n_chars > 10')
    WHEN 'src18' THEN array('n_chars > 100000000')
    WHEN 'src17' THEN array('  ')
    WHEN 'src16' THEN array("lang = 'de' OR lang = 'fr'", 'n_chars >= 200')
    WHEN 'src15' THEN array('n_chars BETWEEN 500 AND 1500')
    WHEN 'src14' THEN array("source LIKE 'src1%'", "lang == '" || lang || "'")
    WHEN 'src12' THEN array("lang IN ('es', 'de')", "NOT source = 'src3'")
    ELSE array("lang = '" || lang || "'", ' n_chars >= ' || avg_chars) END"""


def group_queries(spark, sf_dir):
    """``query_id, lang, source, conditions, vector``."""
    documents = catalog_of(spark, sf_dir)
    groups = documents.groupBy("lang", "source").agg(F.floor(F.avg("n_chars")).alias("avg_chars"))
    embedded = documents.join(vectors_of(spark, sf_dir), "doc_id")
    means = mean_vectors(embedded, ["lang", "source"])
    vector = F.when(F.col("source") != "src13", F.col("vector"))
    asked = groups.join(means, ["lang", "source"], "left").select(
        F.concat_ws("/", "lang", "source").alias("query_id"),
        "lang",
        "source",
        F.expr(_CONDITIONS).alias("conditions"),
        vector.alias("vector"),
    )
    return cut(asked, "group-queries")


# The same in SQL: q are the queries, kept the pairs of query and surviving document, hits the
# three best with their distances.
GROUPS_SQL = """
d AS (SELECT doc_id, lang, source, n_chars, CAST(e.embedding AS DOUBLE[]) AS v, e.label
      FROM documents LEFT JOIN embeddings e ON doc_id = vec_id),
g AS (SELECT lang, source, CAST(floor(avg(n_chars)) AS BIGINT) AS avg_chars FROM d GROUP BY lang, source),
el AS (SELECT lang, source, i, avg(v[i]) AS x FROM d, range(1, 65) r(i) WHERE v IS NOT NULL GROUP BY ALL),
mv AS (SELECT lang, source, list(x ORDER BY i) AS qv FROM el GROUP BY ALL),
q AS (SELECT g.lang || '/' || g.source AS query_id, g.lang, g.source, avg_chars,
        CASE WHEN g.source <> 'src13' THEN qv END AS qv, g.source <> 'src19' AS success
      FROM g LEFT JOIN mv ON g.lang = mv.lang AND g.source = mv.source),
kept AS (SELECT query_id, qv, doc_id, d.lang, d.source, n_chars, v, label FROM q JOIN d ON CASE q.source
        WHEN 'src19' THEN false
        WHEN 'src18' THEN n_chars > 100000000
        WHEN 'src17' THEN true
        WHEN 'src16' THEN d.lang IN ('de', 'fr') AND n_chars >= 200
        WHEN 'src15' THEN n_chars BETWEEN 500 AND 1500
        WHEN 'src14' THEN starts_with(d.source, 'src1') AND d.lang = q.lang
        WHEN 'src12' THEN d.lang IN ('es', 'de') AND d.source <> 'src3'
        ELSE d.lang = q.lang AND n_chars >= q.avg_chars END),
counts AS (SELECT query_id, count(*) AS n FROM kept GROUP BY query_id),
scored AS (SELECT *, 1 - list_cosine_similarity(v, qv) AS dist FROM kept WHERE qv IS NOT NULL AND v IS NOT NULL
           UNION ALL SELECT *, 0.0 FROM kept WHERE qv IS NULL),
hits AS (SELECT query_id, doc_id, lang, source, n_chars, label, round(dist, 4) AS distance, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), doc_id) AS rank FROM scored)
         WHERE rank <= 3)
"""

NO_MATCH_SQL = "CASE WHEN success AND coalesce(n, 0) = 0 THEN 'No record meets all conditions.' END"

CONDITION_TEXT_SQL = """CASE source
    WHEN 'src19' THEN ['no_such_field = 1', 'n_chars > 10']
    WHEN 'src18' THEN ['n_chars > 100000000']
    WHEN 'src17' THEN []
    WHEN 'src16' THEN ['lang = ''de'' OR lang = ''fr''', 'n_chars >= 200']
    WHEN 'src15' THEN ['n_chars BETWEEN 500 AND 1500']
    WHEN 'src14' THEN ['source LIKE ''src1%''', 'lang = ''' || lang || '''']
    WHEN 'src12' THEN ['lang IN (''es'', ''de'')', 'NOT source = ''src3''']
    ELSE ['lang = ''' || lang || '''', 'n_chars >= ' || avg_chars] END"""
