"""Conditions first, similarity second: for one query and for a table of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.functions.measures import cosine_distance_to
from sieverank.functions.text import is_blank
from sieverank.operators.joins import join_hot, keep_listed
from sieverank.operators.lexical import LexicalIndex, query_vectors
from sieverank.operators.nearest import (
    block_topk,
    first_by_key,
    prefilter_in,
    rank_within,
    round_distance,
)
from sieverank.operators.predicates import (
    MAX_SETS,
    NO_MATCH,
    ConditionPlan,
    apply_conditions,
    normalise,
    planned_parts,
    set_counts,
    survivor_counts,
    survivors,
    typed_survivors,
    with_outcome,
)
from sieverank.operators.records import payload_or_empty
from sieverank.operators.report import REJECTION, recommendation_or_rejection, sql_query
from sieverank.operators.routing import Rule, route
from sieverank.session import cut


def hybrid_search(
    catalog: DataFrame,
    vectors: DataFrame,
    conditions: Sequence[str] | None,
    query_vector: Sequence[float] | None,
    *,
    key: str,
    allowed: Sequence[str],
    k: int = 3,
) -> DataFrame:
    """One query: ``(rank, key, distance)`` of the k nearest survivors.

    Without a query vector the first k survivors by key come back at distance 0. A bad
    condition raises ``InvalidCondition``.
    """
    kept = apply_conditions(catalog, conditions, allowed).select(key)
    if query_vector is None:
        scored = kept.select(key, F.lit(0.0).alias("distance"))
        first = scored.orderBy(key).limit(k)
    else:
        near = prefilter_in(vectors.filter(F.size("vector") == len(query_vector)).select(key, "vector"), kept, key)
        scored = near.select(key, cosine_distance_to("vector", query_vector).alias("distance"))
        first = scored.orderBy(F.round("distance", 9), key).limit(k)
    ranked = rank_within(first.withColumn("query_id", F.lit(0)), k, "query_id", key)
    return ranked.select("rank", key, round_distance(F.col("distance")).alias("distance"))


def hybrid_search_batch(
    catalog: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    *,
    key: str,
    allowed: Sequence[str],
    k: int = 3,
    max_sets: int = MAX_SETS,
    no_match: str = NO_MATCH,
) -> DataFrame:
    """A table of queries, each with its own conditions and search vector.

    ``queries`` has ``query_id``, raw ``conditions`` and the features of ``vectors``
    (``vector``, or ``terms`` and ``weights``); a query with null features is blank. It is
    read several times and should be a stored table. The
    result has one row per query and rank, and one row for a query without matches:
    ``query_id, success, error, message, n_survivors, rank, key, distance``.
    """
    features = _features_of(vectors)
    cleaned = queries.withColumns(
        {"conditions": normalise(F.col("conditions")), "blank": F.col(features[0]).isNull()}
    )
    parts = [
        _search_part(catalog, vectors, part, plan, key, k, no_match)
        for part, plan in planned_parts(catalog, cleaned, allowed, max_sets)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _features_of(vectors: DataFrame) -> list[str]:
    return [c for c in ("vector", "terms", "weights") if c in vectors.columns]


def _search_part(
    catalog: DataFrame, vectors: DataFrame, queries: DataFrame, plan: ConditionPlan, key: str, k: int, no_match: str
) -> DataFrame:
    features = _features_of(vectors)
    # One pass over the catalog: ranking, first keys and counts all read the rows some list lets through.
    signed = cut(plan.signed(catalog, key), "signed")
    found = catalog.sparkSession.createDataFrame(
        [], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank long, "
        f"`{key}` {catalog.schema[key].dataType.simpleString()}, distance double",
    )

    wide = wrong_width(queries, vectors, features)
    if plan.spoken_ids:
        masks = plan.masks()
        spoken = queries.filter(~F.col("blank") & wide.isNull()).join(F.broadcast(masks), "set_id")
        wanted = signed.filter(F.size(plan.members(F.col("sig"), plan.spoken_ids)) > 0)
        records = wanted.join(vectors.select(key, *features), key)
        zeros = None
        if "terms" in features:  # records that share no term rank by key
            usable = records.filter(F.col("terms").isNotNull())
            kept = usable.select(F.explode(plan.members(F.col("sig"), plan.spoken_ids)).alias("set_id"), key)
            first = first_by_key(kept, k, "set_id", key)
            zeros = spoken.select("query_id", "set_id").join(F.broadcast(first), "set_id").select("query_id", key)
        found = block_topk(records, spoken.select("query_id", "mask", *features), k, key, zeros=zeros).select(
            "query_id", "rank", key, round_distance(F.col("distance")).alias("distance")
        )
    if plan.blank_ids:
        kept = signed.select(F.explode(plan.members(F.col("sig"), plan.blank_ids)).alias("set_id"), key)
        first = first_by_key(kept, k, "set_id", key)
        unranked = queries.filter("blank").join(F.broadcast(first), "set_id")
        found = found.unionByName(
            unranked.select("query_id", "rank", key, F.lit(0.0).alias("distance"))
        )

    counts = set_counts(signed, plan)
    state = with_outcome(
        queries.select("query_id", "set_id", F.coalesce("condition_error", wide).alias("condition_error")).join(
            F.broadcast(counts), "set_id", "left"
        ),
        no_match,
    )
    return state.join(found, "query_id", "left").select(
        "query_id", "success", "error", "message", "n_survivors", "rank", key, "distance"
    )


def wrong_width(queries: DataFrame, vectors: DataFrame, features: list[str]) -> Column:
    """The error of a query whose vector is not as wide as most records' are, else null; records of another width are not ranked for any."""
    if features != ["vector"]:
        return F.lit(None).cast("string")
    widths = vectors.filter("size(vector) > 0").groupBy(F.size("vector").alias("n")).count()
    width = widths.orderBy(F.desc("count"), "n").limit(1).collect()  # the usual one, the smaller of two
    if not width:
        return F.lit(None).cast("string")
    wrong = ~F.col("blank") & (F.size("vector") != width[0]["n"])
    return F.when(wrong, F.format_string(f"The query vector has %d dimensions, the records have {width[0]['n']}.", F.size("vector")))


def query_database(
    catalog: DataFrame,
    vectors: DataFrame,
    conditions: Sequence[str] | None,
    query_vector: Sequence[float] | None,
    *,
    key: str,
    allowed: Sequence[str],
    payload: Sequence[str],
    k: int = 3,
) -> DataFrame:
    """One query as a row: ``success, error, message, n_survivors, matches``.

    Unlike ``hybrid_search`` a bad condition does not raise; it is reported in ``error``.
    """
    asked = catalog.sparkSession.createDataFrame(
        [(0, list(conditions or []), None if query_vector is None else [float(x) for x in query_vector])],
        "query_id int, conditions array<string>, vector array<double>",
    )
    found = hybrid_search_batch(catalog, vectors, asked, key=key, allowed=allowed, k=k)
    detailed = with_payload(cut(found, "results"), catalog, key, payload)
    return result_struct(detailed, key, ["record"]).drop("query_id")


def unembedded_counts(catalog: DataFrame, vectors: DataFrame, plan: ConditionPlan, key: str) -> DataFrame:
    """``(set_id, n_unembedded)``: survivors that cannot be ranked for want of a vector."""
    return survivor_counts(catalog.join(vectors.select(key), key, "left_anti"), plan).withColumnRenamed(
        "n_survivors", "n_unembedded"
    )


def with_payload(results: DataFrame, catalog: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Adds the record as JSON text and as columns; ``results`` should be a stored table.

    The catalog is reduced to the few keys in the results first, so wide records are neither
    shuffled nor carried through the ranking.
    """
    copies = results.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_copies"))
    listed = keep_listed(catalog, results, key).select(key, F.struct(*columns).alias("record"))
    records = listed.join(copies, key)
    found = join_hot(results, records, on=key, copies="_copies", spread_by="query_id")
    return found.withColumn("payload", payload_or_empty(F.to_json("record"))).drop("_copies")


def result_struct(
    results: DataFrame, key: str, carry: Sequence[str] = (), queries: DataFrame | None = None,
    columns: Sequence[str] = (), table: str = "catalog",
) -> DataFrame:
    """One row per query with its matches in rank order.

    A list holds at most k matches; the survivors are the table of ``query_survivors``. With
    ``queries`` (``query_id``, raw ``conditions``, maybe ``semantic_query``) a row also has
    ``sql_conditions``, ``sql_query`` over ``columns`` of ``table``, and ``semantic_query``.
    """
    match = F.struct("rank", F.col(key).alias("name"), "distance", *carry)
    nested = results.groupBy("query_id").agg(
        F.bool_and("success").alias("success"),
        F.first("error").alias("error"),
        F.first("message").alias("message"),
        F.max("n_survivors").alias("n_survivors"),
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), match))).alias("matches"),
    )
    if queries is None:
        return nested
    spoken = F.col("semantic_query") if "semantic_query" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", normalise(F.col("conditions")).alias("sql_conditions"), spoken.alias("semantic_query"))
    return nested.join(asked, "query_id").withColumn("sql_query", sql_query(F.col("sql_conditions"), columns, table))


def query_survivors(catalog: DataFrame, queries: DataFrame, key: str, allowed: Sequence[str], max_sets: int = MAX_SETS) -> DataFrame:
    """``(query_id, key)``: every record that meets a query's conditions; none for a query in error.

    Lists of plain comparisons are joined as data, however many there are; the rest is planned.
    """
    cleaned = queries.select("query_id", normalise(F.col("conditions")).alias("conditions"))
    found, left = typed_survivors(catalog, cleaned, key, allowed)
    for part, plan in planned_parts(catalog, left, allowed, max_sets):
        one = survivors(catalog, plan, key).join(part.select("query_id", "set_id"), "set_id").select("query_id", key)
        found = found.unionByName(one)
    return found


def requests_of(texts: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Routed texts with a ``query_id`` that equal requests share."""
    routed = route(texts, rules, text)
    return routed.withColumn(
        "query_id", F.sha2(F.to_json(F.struct("conditions", "semantic_query")), 256)
    )


def distinct_requests(requests: DataFrame) -> DataFrame:
    """Each request once, with its number of copies; copies are counted before the shuffle."""
    return requests.groupBy("query_id", "conditions", "semantic_query").agg(
        F.count("*").alias("n_copies")
    )


def search_requests(
    distinct: DataFrame,
    catalog: DataFrame,
    index: LexicalIndex,
    *,
    allowed: Sequence[str],
    k: int = 3,
) -> DataFrame:
    """Results of distinct requests (a stored table) by their search text."""
    spoken = distinct.filter(~is_blank(F.col("semantic_query")))
    vectors = query_vectors(spoken, index, "query_id", "semantic_query")
    asked = distinct.select("query_id", "conditions").join(vectors, "query_id", "left")
    queries = cut(asked, "queries")
    return hybrid_search_batch(catalog, index.vectors, queries, key=index.key, allowed=allowed, k=k)


def ask(
    texts: DataFrame,
    catalog: DataFrame,
    index: LexicalIndex,
    rules: Sequence[Rule],
    template: Sequence,
    *,
    text_id: str,
    allowed: Sequence[str],
    text: str = "text",
    k: int = 3,
    wording: tuple[str, str, str, str] = REJECTION,
) -> DataFrame:
    """Request texts to answers: routed, searched and written up.

    Texts are routed once and equal requests are searched once. One row per text:
    ``text_id, query_id, success, error, message, conditions, semantic_query, n_survivors,
    matches, final_answer``.
    """
    requests = cut(requests_of(texts.select(text_id, text), rules, text).drop(text), "requests")
    distinct = cut(distinct_requests(requests), "distinct-requests")
    results = cut(search_requests(distinct, catalog, index, allowed=allowed, k=k), "results")
    detailed = with_payload(results, catalog, index.key, _template_fields(template))
    nested = result_struct(detailed, index.key, carry=["record"])
    answered = distinct.join(nested, "query_id").withColumn(
        "final_answer",
        recommendation_or_rejection(F.col("matches"), F.col("conditions"), template, wording),
    )
    return join_hot(
        requests.select(text_id, "query_id"),
        cut(answered, "answers"),
        on="query_id",
        copies="n_copies",
        spread_by=text_id,
    ).drop("n_copies")


def _template_fields(template: Sequence) -> list[str]:
    return sorted({part[0] for line in template for part in line if not isinstance(part, str)})
