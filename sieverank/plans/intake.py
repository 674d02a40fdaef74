"""Sources, clean-up, data quality, payloads and narratives."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sieverank.functions.text import absent_to_zero, parse_hardness, parse_rating, range_midpoint
from sieverank.operators import quality, records
from sieverank.operators.lexical import embed
from sieverank.operators.nearest import collection_count
from sieverank.plans.tables import registry, table
from sieverank.sources.cases import rules_from_json
from sieverank.sources.cases import rules_long as to_rules_long
from sieverank.session import cut, shared_folder
from sieverank.sources import catalog as files
from sieverank.sources import versions
from sieverank.sources.catalog import catalog_health as to_health
from sieverank.sources.catalog import catalog_listing as to_listing

QUERIES, ORACLES, registered = registry()


PART_NAMES = {"p_partkey": "Part", "p_name": "Name", "p_type": "Family", "p_size": "Size", "p_retailprice": "Price"}


@registered(
    """SELECT p_partkey AS "Part", p_name AS "Name", p_type AS "Family", p_size AS "Size",
              p_retailprice AS "Price" FROM part"""
)
def catalog_listing(spark, sf_dir):
    return to_listing(table(spark, sf_dir, "part"), PART_NAMES)


@registered(
    """SELECT (SELECT count(*) FROM part) AS catalog_size, (SELECT count(*) FROM embeddings) AS n_embedded,
              (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id))
                AS n_unembedded"""
)
def catalog_health(spark, sf_dir):
    documents, embeddings = (table(spark, sf_dir, t) for t in ("documents", "embeddings"))
    missing = documents.join(embeddings, documents.doc_id == embeddings.vec_id, "left_anti")
    size = to_health(table(spark, sf_dir, "part"))
    return size.select(
        "catalog_size",
        collection_count(embeddings).scalar().alias("n_embedded"),
        missing.agg(F.count("*")).scalar().alias("n_unembedded"),
    )


@registered(
    """SELECT event_id AS case_id, CAST(0 AS BIGINT) AS rule_pos, 'value' AS field, '>=' AS op,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) AS threshold FROM events
       UNION ALL
       SELECT event_id, CAST(1 AS BIGINT), event_type, '==', NULL FROM events
       UNION ALL
       SELECT event_id, CAST(2 AS BIGINT), 'user', '<', user_id + 0.5 FROM events"""
)
def rules_long(spark, sf_dir):
    rules = F.format_string(
        '{"value": [">=", %s], "%s": ["==", "n/a"], "user": ["<", %d.5]}',
        F.get_json_object("props", "$.k"), "event_type", "user_id",
    )
    cases = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("case_id"), rules_from_json(rules).alias("numeric_rules")
    )
    return to_rules_long(cases)


_RANGE_SQL = """CASE p_type WHEN 'PROMO' THEN p_size || '.5' WHEN 'SMALL' THEN 'n/a'
    WHEN 'LARGE' THEN NULL ELSE p_size || '.25 - ' || (p_size + 3) || '.75' END"""


@registered(
    f"""WITH t AS (SELECT p_partkey, list_transform(regexp_extract_all({_RANGE_SQL}, '[0-9]+(?:[.][0-9]+)?'),
                  lambda x: CAST(x AS DOUBLE)) AS n FROM part)
        SELECT p_partkey, (n[1] + n[-1]) / 2 AS midpoint, coalesce((n[1] + n[-1]) / 2, 0.0) AS share FROM t"""
)
def range_midpoint_of_parts(spark, sf_dir):
    midpoint = range_midpoint(F.expr(_RANGE_SQL))
    return table(spark, sf_dir, "part").select(
        "p_partkey", midpoint.alias("midpoint"), absent_to_zero(midpoint).alias("share")
    )


@registered(
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS hardness_min, CAST(p_size + 2.5 AS DOUBLE) AS hardness_max,
              CASE p_type WHEN 'PROMO' THEN NULL ELSE CAST((p_size % 11) + 0.5 AS DOUBLE) END AS rating FROM part"""
)
def parse_text_fields(spark, sf_dir):
    hardness = F.expr("p_size || '.0 - ' || (p_size + 2) || '.5 HRC'")
    rating = F.expr("CASE p_type WHEN 'PROMO' THEN 'good' ELSE (p_size % 11) || '.5/10' END")
    return table(spark, sf_dir, "part").select(
        "p_partkey", parse_hardness(hardness).alias("h"), parse_rating(rating).alias("rating")
    ).select("p_partkey", "h.*", "rating")


@registered(
    """SELECT event_id, event_type <> 'error' AND event_type <> 'view' AND event_type <> 'signup' AS ok,
         CASE event_type WHEN 'error' THEN 'k' WHEN 'view' THEN 'name,k' WHEN 'signup' THEN 'name,k'
           ELSE '' END AS bad_fields,
         CASE WHEN event_type IN ('click', 'purchase') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
         CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS name
       FROM events"""
)
def conform_split(spark, sf_dir):
    text = F.expr(
        """CASE event_type
             WHEN 'error' THEN '{"name": "error", "k": "much"}'
             WHEN 'view' THEN '{"name": 5, "k": null, "more": 1}'
             WHEN 'signup' THEN substr(props, 2)
             ELSE '{"name": "' || event_type || '", "k": ' || get_json_object(props, '$.k') || '}' END"""
    )
    schema = StructType([StructField("name", StringType()), StructField("k", DoubleType())])
    events = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    ok, rejected = quality.conform(events, "text", schema)
    good = ok.select("event_id", F.lit(True).alias("ok"), F.lit("").alias("bad_fields"), "k", "name")
    bad = rejected.select("event_id", F.lit(False).alias("ok"), F.array_join("bad_fields", ",").alias("bad_fields"))
    return good.unionByName(bad, allowMissingColumns=True)


@registered(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS toughness, event_type AS name FROM events"""
)
def flatten_record(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.from_json("props", "k double").alias("ratings")
    )
    return quality.flatten_record(
        nested, {"event_id": "event_id", "toughness": "ratings.k", "name": "event_type"}
    )


@registered(
    """SELECT d.doc_id, coalesce(CAST(quality AS BIGINT), 5) AS quality, coalesce(CAST(toxic AS BIGINT), 0) AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def fill_defaults(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    wide = joined.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return quality.fill_defaults(wide, {"quality": 5, "toxic": 0})


def line_checks():
    return [
        *quality.check_nonneg(["l_quantity", "margin"]),
        *quality.check_total(["l_quantity", "l_linenumber"], 50.0),
        *quality.check_bounds("l_quantity", "l_extendedprice", 5.0, 90000.0),
        *quality.check_ordered("l_discount", "l_tax"),
        *quality.check_rating(["l_linenumber"], 1.0, 6.0),
    ]


def _lines(spark, sf_dir):
    # a discount of exactly 0.1 stands for a value that is not a number, a tax of 0 for a missing one
    margin = F.when(F.col("l_discount") == 0.1, float("nan")).otherwise(F.col("l_discount") - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").withColumns(
        {"margin": F.round(margin, 4), "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0))}
    )


_LINE_REASONS = """
    WITH t AS (SELECT *, CASE WHEN l_discount = 0.1 THEN NULL ELSE round(l_discount - l_tax, 4) END AS margin,
                      nullif(l_tax, 0.0) AS tax FROM lineitem),
    m AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, list_filter([
        CASE WHEN NOT l_quantity >= 0 THEN 'negative:l_quantity' END,
        CASE WHEN margin IS NULL OR margin < 0 THEN 'negative:margin' END,
        CASE WHEN l_quantity + l_linenumber > 50 THEN 'total_above_limit' END,
        CASE WHEN l_quantity < 5 THEN 'below_bound:l_quantity' END,
        CASE WHEN l_extendedprice > 90000 THEN 'above_bound:l_extendedprice' END,
        CASE WHEN tax IS NULL OR l_discount > tax THEN 'not_ordered:l_discount' END,
        CASE WHEN l_linenumber > 6 THEN 'rating_out_of_range:l_linenumber' END], lambda x: x IS NOT NULL) AS reasons FROM t)"""


@registered(_LINE_REASONS + " SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM m) GROUP BY reason")
def quality_reasons(spark, sf_dir):
    return quality.reason_counts(_lines(spark, sf_dir), line_checks())


@registered(
    _LINE_REASONS
    + """ SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
                 array_to_string(reasons, ',') AS reasons FROM m WHERE len(reasons) > 0"""
)
def quality_rejects(spark, sf_dir):
    _, bad = quality.validate(_lines(spark, sf_dir), line_checks())
    return bad.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
        F.array_join("reasons", ",").alias("reasons"),
    )


@registered(
    _LINE_REASONS + " SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM m WHERE len(reasons) = 0"
)
def quality_accepted(spark, sf_dir):
    good, _ = quality.validate(_lines(spark, sf_dir), line_checks())
    return good.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@registered("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_extendedprice > 90000")
def offending_keys(spark, sf_dir):
    check = quality.check_bounds("l_quantity", "l_extendedprice", 5.0, 90000.0)[1]
    return quality.offenders(table(spark, sf_dir, "lineitem"), check, ["l_orderkey", "l_partkey"])


@registered(
    """SELECT bool_and(l_quantity >= 0) AS "negative:l_quantity", bool_and(l_linenumber <= 7) AS "rating_out_of_range:l_linenumber",
              bool_and(l_discount <= l_tax) AS "not_ordered:l_discount" FROM lineitem"""
)
def all_rows_hold(spark, sf_dir):
    checks = [
        *quality.check_nonneg(["l_quantity"]),
        *quality.check_rating(["l_linenumber"], 1.0, 7.0),
        *quality.check_ordered("l_discount", "l_tax"),
    ]
    return quality.all_hold(table(spark, sf_dir, "lineitem"), checks)


@registered(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n_rows
       FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
)
def unique_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return quality.check_unique(lines, ["l_orderkey", "l_linenumber"])


@registered(
    """SELECT 'incomplete' AS choice, doc_id, CAST(-1 AS BIGINT) AS quality FROM documents
       UNION ALL SELECT 'complete', doc_id, CAST(quality AS BIGINT) FROM labels"""
)
def with_fallback(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("long").alias("quality"))
    n_documents = documents.agg(F.count("*")).scalar()
    chosen = quality.with_fallback(labels, documents, n_documents)
    complete = quality.with_fallback(labels, documents, labels.agg(F.count("*")).scalar())
    return chosen.select(F.lit("incomplete").alias("choice"), "*").unionByName(
        complete.select(F.lit("complete").alias("choice"), "*")
    )


@registered("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, true AS whole FROM part")
def payload_roundtrip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    stored = part.select(F.col("p_partkey").alias("id"), records.to_payload(columns).alias("payload"))
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size long"
    back = records.from_payload(stored, "payload", StructType.fromDDL(schema))
    return back.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", (F.col("id") == F.col("p_partkey")).alias("whole"))


@registered(
    """SELECT json_extract_string(j, '$.p_name') AS p_name, CAST(json_extract(j, '$.p_size') AS BIGINT) AS p_size
       FROM (SELECT to_json({'p_name': p_name, 'p_size': p_size}) AS j FROM part)"""
)
def serialise(spark, sf_dir):
    text = records.serialise(table(spark, sf_dir, "part"), ["p_name", "p_size"])
    return text.select(
        F.get_json_object("json", "$.p_name").alias("p_name"),
        F.get_json_object("json", "$.p_size").cast("long").alias("p_size"),
    )


PART_NARRATIVE = [
    ["Grade Name: ", ("p_name", "")],
    ["Application Family: ", ("family", "N/A")],
    ["Standards: ", ("p_brand", "N/A")],
    ["Hardness range: ", ("p_size", ""), " to ", ("peak", ""), " HRC."],
]


@registered(
    """SELECT p_partkey AS id, 'Grade Name: ' || p_name || chr(10) || 'Application Family: ' ||
         coalesce(nullif(p_type, 'PROMO'), 'N/A') || chr(10) || 'Standards: ' || p_brand || chr(10) ||
         'Hardness range: ' || p_size || ' to ' || (p_size + 2) || ' HRC.' AS document,
         p_partkey AS grade_key, nullif(p_type, 'PROMO') AS grade_family FROM part"""
)
def narrative(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumns(
        {"family": F.nullif(F.col("p_type"), F.lit("PROMO")), "peak": F.col("p_size") + 2}
    )
    return records.collection(part, "p_partkey", "family", PART_NARRATIVE).select(
        "id", "document", F.col("metadata.key").alias("grade_key"), F.col("metadata.family").alias("grade_family")
    )


PART_SCHEMA = StructType([
    StructField("p_partkey", StringType()), StructField("p_name", StringType()), StructField("p_type", StringType()),
    StructField("p_retailprice", DoubleType()), StructField("p_note", StringType()),
])
_NOTED = "concat('é ', p_brand, ' \"', p_type, '\"')"
_PARTS_BACK = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type, p_retailprice,
    'é ' || p_brand || ' "' || p_type || '"' AS p_note FROM part"""


def _noted_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_type", "p_retailprice", F.expr(_NOTED).alias("p_note")
    )


@registered(_PARTS_BACK)
def records_json_roundtrip(spark, sf_dir):
    """Records written as JSON lines and read with the fixed schema."""
    path = shared_folder(spark, "records")
    files.write_records_json(_noted_parts(spark, sf_dir), path)
    return files.read_catalog(spark, path, PART_SCHEMA, "jsonl")


@registered(_PARTS_BACK)
def catalog_roundtrip(spark, sf_dir):
    """The table rebuilt twice by type, and read with the fixed schema."""
    path = shared_folder(spark, "catalog")
    for _ in range(2):
        files.write_catalog(_noted_parts(spark, sf_dir), path, "p_type")
    return files.read_catalog(spark, path, PART_SCHEMA, "parquet")


@registered("SELECT doc_id AS id, text AS document, source || '/' || lang AS metadata FROM documents")
def collection_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "collection")
    metadata = F.struct("source", "lang").alias("metadata")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), metadata)
    files.write_collection(rows, path)
    return spark.read.parquet(path).withColumn("metadata", F.concat_ws("/", "metadata.source", "metadata.lang"))


@registered(
    """SELECT 'kept' AS state, p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size = 1) AS n_refused FROM part
       UNION ALL SELECT 'replaced', p_partkey, upper(p_name), 0 FROM part WHERE p_size > 10"""
)
def versioned_rebuild(spark, sf_dir):
    """A rebuild with repeated keys, which leaves the rows of the one before, and a good one, which replaces them."""
    root, part = shared_folder(spark, "versions"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    versions.rebuild({"part": part}, root, {"part": "p_partkey"})
    refused = 0
    try:
        versions.rebuild({"part": part.withColumn("p_name", F.upper("p_name")).unionByName(part.filter("p_size = 1"))}, root, {"part": "p_partkey"})
    except versions.KeyViolation as error:
        refused = error.rows["part"]
    kept = versions.read_current(spark, root, "part").withColumns({"state": F.lit("kept"), "n_refused": F.lit(refused).cast("long")})
    changed = part.withColumn("p_name", F.upper("p_name")).filter("p_size > 10")
    versions.rebuild({"part": changed}, root, {"part": "p_partkey"})
    replaced = versions.read_current(spark, root, "part").withColumns({"state": F.lit("replaced"), "n_refused": F.lit(0).cast("long")})
    return kept.unionByName(replaced).select("state", "p_partkey", "p_name", "n_refused")


SHEET_ROWS = 100_000


@registered(
    """SELECT 'lang=' || lang AS folder, count(*) AS n_files, max(rank) AS last_rank, CAST(sum(chars) AS BIGINT) AS n_chars FROM (
         SELECT lang, length(text) AS chars, 1 AS rank FROM (SELECT lang, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS text
           FROM documents GROUP BY lang)) GROUP BY lang"""
)
def datasheet_scan(spark, sf_dir):
    """A sheet per language, in pages of bounded size that are scanned whole, and listed in order."""
    return _sheets_scanned(spark, table(spark, sf_dir, "documents"), SHEET_ROWS)


def _sheets_scanned(spark, documents, page_rows):
    """A sheet is a folder: ids in order, in files of up to ``page_rows`` ids. Counts are of whole sheets."""
    path = shared_folder(spark, "sheets")
    # Ranges of (lang, doc_id) spread a frequent language over tasks; a page is one file of one range.
    ids = documents.select("lang", "doc_id").filter("doc_id is not null")
    dealt = ids.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    pages = dealt.select(F.col("doc_id").cast("string").alias("text"), "lang")
    pages.write.partitionBy("lang").option("lineSep", " ").option("maxRecordsPerFile", page_rows).text(path)
    folder = F.element_at(F.split("path", "/"), -2)
    found = files.scan_datasheets(spark, path, "*.txt").withColumn("folder", folder)
    # Pages are joined by a space each.
    sheets = found.groupBy("folder").agg((F.sum(F.length(F.rtrim("text"))) + F.count("*") - 1).alias("n_chars"))
    named = sheets.select(F.col("folder").alias("path"), F.col("folder").alias("name"))
    listed = files.sorted_listing(named).groupBy(F.col("path").alias("folder")).agg(F.count("*").alias("listed"))
    return sheets.join(listed, "folder").groupBy("folder").agg(
        F.count("*").alias("n_files"), F.max("listed").cast("int").alias("last_rank"), F.sum("n_chars").alias("n_chars"),
    )


PAGE_IDS = 100


@registered(
    """SELECT row_number() OVER (ORDER BY name) AS position, name, n_chars FROM (
         SELECT 'lang=' || lang || '/page=' || printf('%09d', doc_id // 100) AS name, CAST(length(string_agg(doc_id::VARCHAR, ' ')) AS BIGINT) AS n_chars
         FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)"""
)
def datasheet_pages(spark, sf_dir):
    """Pages of ids, scanned whole and listed in the order of their names, each with its place in that list."""
    return _pages_listed(spark, table(spark, sf_dir, "documents"), PAGE_IDS)


def _pages_listed(spark, documents, page_ids):
    """A page is a file in a folder of its own, with the ids of one language and one range."""
    path = shared_folder(spark, "sheets")
    ids = documents.select("lang", "doc_id").filter("doc_id is not null")
    # Pages are few bytes and many files: the number of tasks is given, so that it is not made smaller.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paged = ids.withColumn("page", F.format_string("%09d", F.expr(f"doc_id div {page_ids}"))).repartition(parts, "lang", "page")
    paged.select(F.col("doc_id").cast("string").alias("text"), "lang", "page").write.partitionBy("lang", "page").option("lineSep", " ").text(path)
    name = F.array_join(F.slice(F.split("path", "/"), -3, 2), "/")
    n_chars = F.length(F.rtrim("text")).cast("long").alias("n_chars")
    with _folders_per_task(spark, parts):
        scanned = files.scan_datasheets(spark, path, "*.txt")
    # Files are opened once; sorting reads what is stored.
    found = cut(scanned.withColumn("name", name).select("path", "name", n_chars), "pages")
    listed = cut(files.sorted_listing(found).select("name", F.monotonically_increasing_id().alias("place")), "listing")
    # A place is the task's number and the place within the task, whose rows follow those of all tasks before.
    task, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = listed.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = listed.withColumn("task", task).join(F.broadcast(starts), "task")
    numbered = placed.select("name", (F.col("start") + within + 1).alias("position"))
    return found.select("name", "n_chars").join(numbered, "name").select("position", "name", "n_chars")


@contextmanager
def _folders_per_task(spark, parts):
    """While a path is loaded, folders are listed by up to ``parts`` tasks, not by one task for each."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(parts))
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


@registered("SELECT least(20, count(*)) AS n_rows, 3 AS n_columns FROM part")
def preview_size(spark, sf_dir):
    """A preview is any 20 rows, so its size is what can be compared."""
    shown = files.preview(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_size"])
    return shown.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(shown.columns)))


@registered(
    """SELECT reason, n_rows FROM (
         SELECT 'negative:l_discount' AS reason, count(*) FILTER (NOT coalesce(l_discount - 0.02 >= 0, false)) AS n_rows FROM lineitem
         UNION ALL SELECT 'negative:l_tax', count(*) FILTER (NOT coalesce(l_tax - 0.01 >= 0, false)) FROM lineitem) WHERE n_rows > 0"""
)
def rejected_counts(spark, sf_dir):
    """What raise mode says of a batch with bad rows, as rows."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_discount") - 0.02).alias("l_discount"), (F.col("l_tax") - 0.01).alias("l_tax")
    )
    try:
        quality.validate(lines, quality.check_nonneg(["l_discount", "l_tax"]), mode="raise")
        counts = {}
    except quality.RejectedRows as error:
        counts = error.counts
    return spark.createDataFrame(list(counts.items()), "reason string, n_rows long")


_HASH_DIM = 8


def _hash_model():
    """Counts a text's words by the length of the word: a model that needs no training."""

    def run(texts):
        found = []
        for text in texts:
            vector = [0.0] * _HASH_DIM
            for word in text.split(" "):
                if word:
                    vector[len(word) % _HASH_DIM] += 1.0
            found.append(vector)
        return found

    return run


@registered(
    """SELECT doc_id, i, CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '' AND length(w) % 8 = i)) AS DOUBLE) AS x
       FROM documents, range(8) r(i)"""
)
def embedded_texts(spark, sf_dir):
    """Vectors of a model that is loaded in the tasks."""
    vectors = embed(table(spark, sf_dir, "documents"), "text", _hash_model)
    return vectors.select("doc_id", F.posexplode("vector").alias("i", "x")).select(
        "doc_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")
    )
