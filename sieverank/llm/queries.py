"""Registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieverank.llm import (
    alignment,
    best_fit,
    decontamination,
    lines,
    mixing,
    nearest_exact,
    orchard,
    packing,
    quality,
    secrets,
    simhash,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository and uses this package

    return corpus_pipeline.run(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeats(table(spark, sf_dir, "documents"), equal_words=1)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op6_warc"] = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT p.*, max(page_id) OVER (PARTITION BY h) AS holder, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
            (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '')
        AS payload_digest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM d
"""


@query
def op7_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_exact.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op7_exact_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
    FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


@query
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.compress(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """Rounds of assigning parts to the nearest entry (a) and averaging (b), from the first entries (b0)."""
    steps = []
    for i in range(1, rounds + 2):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT p.part, p.rid, min((xx - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 16 + entry) AS best
    FROM p JOIN b{i - 1} AS b ON b.part = p.part GROUP BY ALL
)""")
        if i <= rounds:
            steps.append(f"""s{i} AS (
    SELECT part, best % 16 AS entry, spot, sum(x[spot])::BIGINT AS total, count(*) AS n
    FROM a{i} JOIN p USING (part, rid), range(1, 9) AS r(spot) GROUP BY ALL
), m{i} AS (
    SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY spot) AS c FROM s{i} GROUP BY ALL
), b{i} AS MATERIALIZED (
    SELECT part, entry, coalesce(m{i}.c, b{i - 1}.c) AS c FROM b{i - 1} LEFT JOIN m{i} USING (part, entry)
)""")
    return ", ".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), k AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS rid FROM v
), p AS MATERIALIZED (
    SELECT rid, part, e[8 * part + 1 : 8 * part + 8] AS x, list_inner_product(x, x) AS xx FROM k, range(8) AS r(part)
), b0 AS MATERIALIZED (
    SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 16
), {_rounds_sql(6)}, codes AS (
    SELECT rid, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM a7 GROUP BY rid
), books AS (
    SELECT sha256(string_agg(c[spot]::BIGINT::VARCHAR, ',' ORDER BY part, entry, spot)) AS codebooks_sha256 FROM b6, range(1, 9) AS r(spot)
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN codes USING (rid), books
"""


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), a, b)
