"""Conditions: SQL boolean texts that are ANDed, for one query or for a table of queries.

For a table of queries the distinct condition texts become one signature per catalog row:
bit i is set when condition i holds. A query's condition list is then a bit mask, and a row
survives when all bits of the mask are set. Each distinct condition is evaluated once per
row, in compiled code, however many queries share it; the rows are never paired with the
queries.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructType

from sieverank.functions.text import WHITESPACE, strip
from sieverank.operators.joins import fits, join_spread
from sieverank.session import cut

MAX_SETS = 1_000
WORD_BITS = 62

NO_MATCH = "No record meets all conditions."
INVALID = "Invalid SQL condition: "


class InvalidCondition(ValueError):
    """A condition that does not parse, or uses a field outside the allowed list."""


def normalise(conditions: Column) -> Column:
    """Trimmed texts with ``==`` as ``=``; blanks and nulls dropped; no list is an empty list."""
    cleaned = F.transform(conditions, lambda c: F.replace(strip(c), F.lit("=="), F.lit("=")))
    kept = F.filter(cleaned, lambda c: c.isNotNull() & (c != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def normalise_list(conditions: Sequence[str] | None) -> list[str]:
    cleaned = (c.strip(WHITESPACE).replace("==", "=") for c in conditions or [])
    return [c for c in cleaned if c]


def overlaps(low: Column, high: Column, target: float | Column, tolerance: float = 2) -> Column:
    """The range from low to high meets the window around the target."""
    return (low <= target + tolerance) & (high >= target - tolerance)


# What a condition may say besides fields and literals: words of boolean expressions, names of
# types, and functions that depend on their arguments only.
_WORDS = set(
    "and or not in between like ilike rlike regexp is null true false case when then else end div escape as "
    "int integer bigint smallint tinyint double float decimal string boolean date timestamp distinct from".split()
)
_FUNCTIONS = set(
    "in and or not when then else like between if coalesce nullif ifnull nvl nvl2 isnull isnotnull isnan nanvl greatest least "
    "abs sign round floor ceil ceiling sqrt pow power exp ln log log2 log10 mod pmod try_add try_subtract try_multiply try_divide "
    "cast try_cast int bigint double float decimal string boolean date timestamp "
    "lower upper trim ltrim rtrim length char_length octet_length substr substring left right concat concat_ws instr locate "
    "replace translate reverse startswith endswith contains regexp_like regexp_extract split lpad rpad ascii "
    "array size cardinality array_contains array_size get element_at try_element_at "
    "year month day dayofmonth hour minute second quarter datediff date_add date_sub to_date to_timestamp".split()
)
_TOKEN = re.compile(
    r"""'(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.)*" | (?P<name>`[^`]+`|[A-Za-z_][A-Za-z0-9_]*)(?P<call>\s*\()?
    | \d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]{0,2} | (?P<other>--|/\*|;|.)""",
    re.VERBOSE | re.DOTALL,
)
# Comparisons of one field with literals, joined by AND and OR: nothing in them can fail on a row.
_VALUE = r"(?:'[^'\\]*'|-?\d{1,15}(?:\.\d{1,15})?)"
_PLAIN = re.compile(
    rf"""\s*(?:NOT\s+)?(?P<field>`[^`]+`|[A-Za-z_]\w*)\s*
    (?:(?:<=>|<>|!=|>=|<=|==|=|>|<)\s*{_VALUE} | \b(?:NOT\s+)?IN\s*\(\s*{_VALUE}(?:\s*,\s*{_VALUE})*\s*\)
     | \b(?:NOT\s+)?BETWEEN\s+{_VALUE}\s+AND\s+{_VALUE} | \b(?:NOT\s+)?LIKE\s+'[^'\\]*' | \bIS\s+(?:NOT\s+)?NULL\b)
    \s*(?P<more>\b(?:AND|OR)\b|$)""",
    re.VERBOSE | re.IGNORECASE,
)


def refused_word(condition: str, allowed: Sequence[str]) -> str | None:
    """The first word or sign of a condition that is neither a field, a literal nor a plain function.

    So a condition cannot look into other tables, run code, or give another answer each time.
    """
    fields = {name.lower() for name in allowed}
    after_dot = False
    for token in _TOKEN.finditer(condition):
        name, call, other = token["name"], token["call"], token["other"]
        if other in ("--", "/*", ";"):
            return other
        if name:
            bare = name.strip("`").lower()
            known = bare in _FUNCTIONS if call else after_dot or bare in fields or (bare in _WORDS and name[0] != "`")
            if not known:
                return name
        after_dot = other == "." if not (other or "").isspace() else after_dot
    return None


def _probe(spark: SparkSession, schema: StructType) -> DataFrame:
    """One constant row with the allowed fields, for the analyzer only; it is never read."""
    values, names = [], []
    for f in schema.fields:
        values.append(f"cast(null as {f.dataType.simpleString()})")
        names.append(f"`{f.name}`")
    return spark.sql(f"select * from values ({', '.join(values)}) as t({', '.join(names)})")


def _problem(probe: DataFrame, conditions: Sequence[str]) -> str | None:
    """What the analyzer says against the conditions, or None. Nothing is executed."""
    try:
        probe.filter(F.expr(" AND ".join(f"({c})" for c in conditions))).schema
    except PySparkException as error:
        return str(error).split("\n")[0]
    return None


def is_plain(condition: str, kinds: dict[str, DataType]) -> bool:
    """Whether it only compares fields with literals of their own kind, texts or numbers.

    ``kinds`` has the types of the allowed fields by lower-cased name. Such a condition is valid and cannot
    fail on any row, so neither the analyzer nor the rows have to be asked.
    """
    place = 0
    while found := _PLAIN.match(condition, place):
        kind = kinds.get(found["field"].strip("`").lower())
        literals = re.findall(_VALUE, condition[found.end("field") : found.end()])
        if not isinstance(kind, StringType | NumericType) or any((x[0] == "'") != isinstance(kind, StringType) for x in literals):
            return False
        if not found["more"]:
            return True
        place = found.end()
    return False


def _kinds(catalog: DataFrame, allowed: Sequence[str]) -> dict[str, DataType]:
    return {f.name.lower(): f.dataType for f in catalog.select(*allowed).schema.fields}


def condition_errors(
    catalog: DataFrame, conditions: Sequence[str], allowed: Sequence[str]
) -> dict[str, str]:
    """The invalid ones among the conditions, with the reason.

    A condition may use the allowed fields, literals and functions that depend on their arguments
    only; what is left is resolved by Spark's analyzer against the allowed fields alone.
    """
    kinds = _kinds(catalog, allowed)
    doubtful = [c for c in conditions if not is_plain(c, kinds)]
    refused = {c: refused_word(c, allowed) for c in doubtful}
    errors = {c: f"{word} is not allowed" for c, word in refused.items() if word}
    left = [c for c in doubtful if c not in errors]
    return errors | _bad_ones(_probe(catalog.sparkSession, catalog.select(*allowed).schema), left) if left else errors


def _bad_ones(probe: DataFrame, conditions: list[str]) -> dict[str, str]:
    """Halves a list that fails until the conditions at fault are alone."""
    problem = _problem(probe, conditions) if conditions else None
    if problem is None:
        return {}
    if len(conditions) == 1:
        return {conditions[0]: problem}
    middle = len(conditions) // 2
    return _bad_ones(probe, conditions[:middle]) | _bad_ones(probe, conditions[middle:])


def apply_conditions(
    catalog: DataFrame, conditions: Sequence[str] | None, allowed: Sequence[str]
) -> DataFrame:
    """Rows for which all conditions hold; no condition keeps all rows.

    Raises ``InvalidCondition`` for one that is refused or fails on some row. To know the latter the
    catalog is read once, at the call, if some condition is more than plain comparisons.
    """
    cleaned = normalise_list(conditions)
    errors = condition_errors(catalog, cleaned, allowed) or failing_conditions(catalog, cleaned, allowed)
    if errors:
        raise InvalidCondition(INVALID + "; ".join(f"{c}: {e}" for c, e in errors.items()))
    if not cleaned:
        return catalog
    return catalog.filter(" AND ".join(f"({c})" for c in cleaned))


# --- conditions as data -----------------------------------------------------------------


@dataclass(frozen=True)
class ConditionSet:
    set_id: int
    conditions: tuple[str, ...]
    mask: tuple[int, ...] = ()
    error: str | None = None


@dataclass(frozen=True)
class ConditionPlan:
    """The distinct condition lists of some queries, ready to be evaluated on a catalog."""

    atoms: tuple[str, ...]
    sets: tuple[ConditionSet, ...]
    spark: SparkSession = field(repr=False, compare=False)
    blank_lists: frozenset[tuple[str, ...]] = frozenset()
    spoken_lists: frozenset[tuple[str, ...]] = frozenset()

    @property
    def valid(self) -> list[ConditionSet]:
        return [s for s in self.sets if s.error is None]

    @property
    def blank_ids(self) -> list[int]:
        """Sets some query without search text uses."""
        return [s.set_id for s in self.valid if s.conditions in self.blank_lists]

    @property
    def spoken_ids(self) -> list[int]:
        """Sets some query with search text uses."""
        return [s.set_id for s in self.valid if s.conditions in self.spoken_lists]

    def signature(self) -> Column:
        """Bit i of the words is set when condition i holds; null counts as not holding."""
        # one SQL text: hundreds of conditions as single Columns would be slow to build
        words = []
        for start in range(0, max(len(self.atoms), 1), WORD_BITS):
            bits = [
                f"if(({a}), {1 << i}L, 0L)" for i, a in enumerate(self.atoms[start : start + WORD_BITS])
            ]
            words.append(" | ".join(bits) or "0L")
        return F.expr(f"array({', '.join(words)})")

    def signed(self, catalog: DataFrame, *columns: str) -> DataFrame:
        """The columns with ``sig``, the signature, for rows that some list lets through."""
        rows = catalog.select(*columns, self.signature().alias("sig"))
        return rows.filter(F.size(self.members(F.col("sig"))) > 0)

    def members(self, signature: Column, ids: Sequence[int] | None = None) -> Column:
        """Ids of the sets a row with this signature belongs to."""
        chosen = [
            {"set_id": s.set_id, "mask": list(s.mask)}
            for s in self.valid
            if ids is None or s.set_id in ids
        ]
        table = F.from_json(F.lit(json.dumps(chosen)), "array<struct<set_id:int,mask:array<bigint>>>")
        if len(self.atoms) <= WORD_BITS:
            word = F.get(signature, F.lit(0))
            hit = F.filter(
                table, lambda s: word.bitwiseAND(F.get(s["mask"], F.lit(0))) == F.get(s["mask"], F.lit(0))
            )
        else:
            hit = F.filter(
                table,
                lambda s: F.forall(
                    F.zip_with(signature, s["mask"], lambda a, m: a.bitwiseAND(m) == m), lambda x: x
                ),
            )
        return F.transform(hit, lambda s: s["set_id"])

    def table(self) -> DataFrame:
        """``(conditions, set_id, error)``, at most as many rows as sets were allowed."""
        return self._local(
            {
                "conditions": ([list(s.conditions) for s in self.sets], pa.list_(pa.string())),
                "set_id": ([s.set_id for s in self.sets], pa.int32()),
                "condition_error": ([s.error for s in self.sets], pa.string()),
            }
        )

    def masks(self) -> DataFrame:
        """``(set_id, mask)`` of the valid sets."""
        return self._local(
            {
                "set_id": ([s.set_id for s in self.valid], pa.int32()),
                "mask": ([list(s.mask) for s in self.valid], pa.list_(pa.int64())),
            }
        )

    def _local(self, columns: dict) -> DataFrame:
        return self.spark.createDataFrame(pa.table({n: pa.array(v, t) for n, (v, t) in columns.items()}))


def plan_conditions(
    catalog: DataFrame,
    condition_lists: Sequence[Sequence[str]],
    allowed: Sequence[str],
    blank: Sequence[bool] | None = None,
) -> ConditionPlan:
    """Masks for normalised condition lists. A bad condition spoils the lists that use it only.

    ``blank`` tells which lists come from queries without search text.
    """
    flags = list(blank or [False] * len(condition_lists))
    lists = sorted({tuple(c) for c in condition_lists})
    distinct = sorted({c for conditions in lists for c in conditions})
    errors = condition_errors(catalog, distinct, allowed)
    errors |= failing_conditions(catalog, [c for c in distinct if c not in errors], allowed)
    atoms = tuple(c for c in distinct if c not in errors)
    place = {a: i for i, a in enumerate(atoms)}
    n_words = max(1, -(-len(atoms) // WORD_BITS))
    sets = []
    for set_id, conditions in enumerate(lists):
        bad = [f"{c}: {errors[c]}" for c in conditions if c in errors]
        if bad:
            sets.append(ConditionSet(set_id, conditions, error=INVALID + "; ".join(bad)))
            continue
        mask = [0] * n_words
        for c in conditions:
            mask[place[c] // WORD_BITS] |= 1 << (place[c] % WORD_BITS)
        sets.append(ConditionSet(set_id, conditions, tuple(mask)))
    used = [frozenset(tuple(c) for c, b in zip(condition_lists, flags) if b is f) for f in (True, False)]
    return ConditionPlan(atoms, tuple(sets), catalog.sparkSession, *used)


def planned_parts(
    catalog: DataFrame,
    queries: DataFrame,
    allowed: Sequence[str],
    max_sets: int = MAX_SETS,
    _level: int = 0,
) -> Iterator[tuple[DataFrame, ConditionPlan]]:
    """Queries with their plan; usually one part.

    ``queries`` needs normalised ``conditions`` and may have a ``blank`` flag. Only the distinct lists come to the driver,
    never more than ``max_sets`` at a time: beyond that the lists are divided by hash and
    every division gets its own pass over the catalog.
    """
    blank = F.col("blank") if "blank" in queries.columns else F.lit(False)
    used = queries.groupBy("conditions").agg(F.bool_or(blank).alias("blank"), F.bool_or(~blank).alias("spoken"))
    lists = used.limit(max_sets + 1).collect()
    if len(lists) <= max_sets:
        flags = [(r["conditions"], f) for r in lists for f, on in ((True, r["blank"]), (False, r["spoken"])) if on]
        plan = plan_conditions(catalog, [c for c, _ in flags], allowed, [f for _, f in flags])
        yield queries.join(F.broadcast(plan.table()), "conditions"), plan
        return
    divisions = 8
    place = F.pmod(F.xxhash64("conditions", F.lit(_level)), F.lit(divisions))
    for i in range(divisions):
        yield from planned_parts(catalog, queries.filter(place == i), allowed, max_sets, _level + 1)


def survivors(catalog: DataFrame, plan: ConditionPlan, key: str) -> DataFrame:
    """``(set_id, key)`` of every row that passes, per condition list.

    Queries with the same conditions share their survivors; join on ``set_id`` for the
    survivors of a query.
    """
    return plan.signed(catalog, key).select(F.explode(plan.members(F.col("sig"))).alias("set_id"), key)


def survivor_counts(catalog: DataFrame, plan: ConditionPlan) -> DataFrame:
    """``(set_id, n_survivors)``; each task hands on one row per list at most."""
    return set_counts(plan.signed(catalog), plan)


def set_counts(signed: DataFrame, plan: ConditionPlan) -> DataFrame:
    """The same from rows that have their signature already."""
    members = signed.select(F.explode(plan.members(F.col("sig"))).alias("set_id"))
    return members.groupBy("set_id").agg(F.count("*").alias("n_survivors"))


def judged(condition: str, guard: str) -> str:
    """A condition as SQL that cannot end the job: a date, the later one where it holds, and null where it fails.

    ``try_add`` gives null for whatever fails while the days to add are computed: an overflow, a bad cast, a
    division by zero. The ``if`` around it is always true, which the optimizer cannot know; without it,
    parts that several conditions share would be computed ahead, outside of the try.
    """
    days = f"cast(coalesce(({condition}), false) as int)"
    return f"if(hash(`{guard}`) >= -2147483648, try_add(date'2000-01-01', {days}), date'2000-01-01')"


def failing_conditions(catalog: DataFrame, conditions: Sequence[str], allowed: Sequence[str]) -> dict[str, str]:
    """The conditions that fail on some row, with the reason.

    Plain conditions cannot fail. All others are judged in one pass, which hands on one row for each
    that fails; that row alone tells Spark's reason.
    """
    kinds = _kinds(catalog, allowed)
    risky = [c for c in conditions if not is_plain(c, kinds)]
    if not risky:
        return {}
    failed = [f"if({judged(c, allowed[0])} is null, {i}, null)" for i, c in enumerate(risky)]
    rows = catalog.select(*allowed, F.expr(f"array_compact(array({', '.join(failed)}))").alias("_failed"))
    found = rows.select(F.struct(*allowed).alias("row"), F.explode("_failed").alias("i")).groupBy("i").agg(F.min("row").alias("row"))
    schema = catalog.select(*allowed).schema
    return {risky[r["i"]]: _reason_on(catalog.sparkSession.createDataFrame([r["row"]], schema), risky[r["i"]]) for r in found.collect()}


def _reason_on(row: DataFrame, condition: str) -> str:
    try:
        row.filter(F.expr(f"({condition})")).collect()
    except PySparkException as error:
        return _reason(error)
    return "it fails on some record"


def _reason(error: PySparkException) -> str:
    found = re.search(r"\[[A-Z_.0-9]+\][^\n]*", str(error))
    return found[0] if found else str(error).split("\n")[0]


def evaluate_conditions(
    catalog: DataFrame,
    queries: DataFrame,
    allowed: Sequence[str],
    max_sets: int = MAX_SETS,
    no_match: str = NO_MATCH,
) -> DataFrame:
    """Outcome of every query's conditions: ``success``, ``error``, ``message``, ``n_survivors``.

    ``queries`` has ``query_id`` and ``conditions`` (raw texts).
    """
    cleaned = queries.withColumn("conditions", normalise(F.col("conditions")))
    outcomes = []
    for part, plan in planned_parts(catalog, cleaned, allowed, max_sets):
        counts = survivor_counts(catalog, plan)
        outcomes.append(with_outcome(part.join(F.broadcast(counts), "set_id", "left"), no_match))
    return _union(outcomes)


def with_outcome(queries: DataFrame, no_match: str = NO_MATCH) -> DataFrame:
    """Adds the result state of queries that carry ``condition_error`` and ``n_survivors``."""
    failed = F.col("condition_error").isNotNull()
    n = F.when(~failed, F.coalesce("n_survivors", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return (
        queries.withColumn("n_survivors", n)
        .withColumn("success", ~failed)
        .withColumn("error", F.col("condition_error"))
        .withColumn("message", F.when(~failed & (F.col("n_survivors") == 0), F.lit(no_match)))
        .drop("condition_error")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# --- typed conditions -------------------------------------------------------------------

TYPED = "array<struct<field:string,op:string,number:double,text:string>>"
_COMPARISON = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(>=|<=|=|>|<)\s*(?:'([^']*)'|(-?[0-9]+(?:\.[0-9]+)?))\s*$"


def parse_conditions(conditions: Column) -> Column:
    """Simple comparisons as ``(field, op, number, text)``; ``A AND B`` gives two entries.

    A text that is no such comparison has a null field.
    """
    pieces = F.flatten(F.transform(conditions, lambda c: F.split(c, r"(?i)\s+AND\s+")))

    def typed(piece: Column) -> Column:
        part = [F.nullif(F.regexp_extract(piece, _COMPARISON, i), F.lit("")) for i in range(5)]
        number = part[4].try_cast("double")
        text = F.when(part[1].isNotNull() & number.isNull(), F.regexp_extract(piece, _COMPARISON, 3))
        return F.struct(
            part[1].alias("field"), part[2].alias("op"), number.alias("number"), text.alias("text")
        )

    return F.transform(pieces, typed)


def refused_fields(typed: Column, allowed: Sequence[str]) -> Column:
    """Fields outside the list, and one null per entry that could not be read."""
    outside = F.filter(typed, lambda c: ~F.coalesce(c["field"].isin(list(allowed)), F.lit(False)))
    return F.transform(outside, lambda c: c["field"])


# --- many lists of typed conditions -----------------------------------------------------

BINS = 256
MAX_LIST_BYTES = 16 << 20
LIST_QUERIES = 1_024
_COMPARED = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def typed_survivors(
    catalog: DataFrame, queries: DataFrame, key: str, allowed: Sequence[str], bins: int = BINS, max_bytes: int = MAX_LIST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, key)`` for queries whose conditions are plain comparisons, and the queries left over.

    ``queries`` has ``query_id`` and normalised ``conditions``, any number of different lists. Lists and
    records are joined by two things: the values of the fields that a list compares for equality, and a range
    of one number field. The bounds that lists name cut the field's numbers into ``bins``; these are the
    leaves of a binary tree. A list's range is a few nodes of that tree, at most two a level; a record lies in one
    node of every level, so it meets each list of its range once. All comparisons are checked on the joined
    rows. So a frequent value meets only lists with the right range, and lists without any equality need no
    pairing with all records. What a list says of a field is one value per operator, the strictest, so the
    checks are plain columns and run in the join's generated code.

    A list goes along with its queries, ``LIST_QUERIES`` at a time. So each is checked once for all of them, and what
    it finds is neither shuffled nor stored: that may be queries times records.

    Lists of up to ``max_bytes``, measured, are broadcast: then the catalog is read once and not shuffled. More go
    through a shuffle, and the records of a frequent value or node are spread (``join_spread``). Joins with lists ask
    for a merge, as lists are many times larger than their files, by which Spark would choose to broadcast. Lists with
    neither an equality nor a bound on a number, or with anything but comparisons of allowed fields with
    literals of their kind, are left over for ``planned_parts``.
    """
    kinds = {f.name: f.dataType for f in catalog.select(*allowed).schema.fields}
    texts = [f for f, kind in kinds.items() if isinstance(kind, StringType)]
    numbers = [f for f, kind in kinds.items() if isinstance(kind, NumericType)]

    def plain(c: Column) -> Column:
        # a backslash may stand for another sign: the planner reads such texts
        text = c["field"].isin(texts) & c["text"].isNotNull() & ~c["text"].contains("\\")
        number = c["field"].isin(numbers) & c["number"].isNotNull() & (F.abs(c["number"]) < 2**53)
        return F.coalesce(text | number, F.lit(False))

    def bounds(c: Column) -> Column:
        return c["field"].isin(numbers) & (c["op"] != "=")

    # Each step is stored or named, so that no expression of a step before is computed again.
    distinct = queries.groupBy("conditions").agg(F.count("*").alias("n")).withColumn("typed", parse_conditions(F.col("conditions")))
    lists = cut(distinct.withColumn("list_id", F.monotonically_increasing_id()), "lists")
    equal = F.array_distinct(F.transform(F.filter("typed", lambda c: c["op"] == "="), lambda c: c["field"]))
    indexed = (F.size(equal) > 0) | F.exists("typed", bounds)
    usable = F.coalesce(indexed & F.forall("typed", plain), F.lit(False))
    unread = lists.filter(~usable).select("conditions")
    left = queries.filter(F.lit(False)) if unread.isEmpty() else queries.join(unread.hint("merge"), "conditions", "left_semi").select(queries.columns)
    lists = lists.filter(usable)
    of_queries = queries.select("query_id", "conditions").join(lists.select("conditions", "list_id", "n").hint("merge"), "conditions")
    piece = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / LIST_QUERIES))
    asking = of_queries.groupBy("list_id", piece.alias("piece")).agg(F.collect_list(F.struct("query_id")).alias("asked"))
    asking = asking.select("list_id", F.col("asked.query_id").alias("queries"))  # with null ids
    lists = lists.select("list_id", "typed", F.array_sort(equal).alias("fields"))
    said, edges = _said(lists, bins)
    strictest = {(f, op): f"_{i}_{n}" for i, f in enumerate(kinds) for n, op in enumerate(_COMPARED) if op in said.get(f, [])}

    def values(field: str, op: str) -> Column:
        chosen = F.filter("typed", lambda c: (c["field"] == field) & (c["op"] == op))
        return F.transform(chosen, lambda c: c["text"] if field in texts else c["number"] + 0.0)  # -0.0 equals 0.0

    possible = F.lit(True)  # nothing equals two values
    for field, op in strictest:
        if op == "=":
            possible &= F.coalesce(F.array_min(values(field, op)) == F.array_max(values(field, op)), F.lit(True))
    named = [(F.array_max if op in (">", ">=") else F.array_min)(values(field, op)).alias(name) for (field, op), name in strictest.items()]
    lists = cut(_with_nodes(lists.filter(possible), edges).select("list_id", "fields", "range_field", "nodes", *named), "list-nodes")
    level = F.length(F.bin("node")) - 1
    kinds_of = lists.select("fields", "range_field", F.explode("nodes").alias("node")).groupBy("fields", "range_field").agg(F.collect_set(level).alias("levels")).collect()
    combos = {(tuple(r["fields"]), r["range_field"]): i for i, r in enumerate(kinds_of)}  # sets of allowed fields, with one of them
    value_of = {f: F.col(f"_{i}") if f in texts else F.col(f"_{i}").cast("double") + 0.0 for i, f in enumerate(kinds)}

    def part(value_of) -> list[tuple[Column, Column, str | None]]:
        """Per kind of list: its number, the hash of its equal values, and the field of its range."""
        return [(F.lit(i), F.xxhash64(F.lit(i), *[value_of(f) for f in fields]), ranged) for (fields, ranged), i in combos.items()]

    def is_kind(fields: Sequence[str], ranged: str | None) -> Column:
        return (F.col("fields") == F.array(*map(F.lit, fields)).cast("array<string>")) & F.col("range_field").eqNullSafe(F.lit(ranged))

    kind, hashes = F.lit(None).cast("int"), F.lit(None).cast("long")
    for (fields, ranged), (i, hashed, _) in zip(combos, part(lambda f: F.col(strictest[f, "="]))):
        kind, hashes = F.when(is_kind(fields, ranged), i).otherwise(kind), F.when(is_kind(fields, ranged), hashed).otherwise(hashes)
    places = lists.withColumns({"kind": kind, "hash": hashes}).join(asking.hint("merge"), "list_id")
    places = cut(places.select("kind", "hash", F.explode("nodes").alias("node"), *strictest.values(), "queries"), "list-places")

    def place(i: Column, h: Column, node: Column) -> Column:
        return F.struct(i.alias("kind"), h.alias("hash"), node.alias("node"))

    ranged_by = sorted({ranged for _, ranged in combos if ranged})
    numbered = catalog.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{i}") for i, f in enumerate(kinds)])
    numbered = numbered.withColumns({f"_leaf_{f}": _leaf_of(F.col(f"_{list(kinds).index(f)}").cast("double"), edges[f]) for f in ranged_by})
    met_at = [
        place(i, h, node)
        for (i, h, ranged), found in zip(part(value_of.__getitem__), kinds_of)
        for node in (_upwards(F.col(f"_leaf_{ranged}"), edges[ranged], found["levels"]) if ranged else [F.lit(1)])
    ]
    nowhere = F.array().cast("array<struct<kind:int,hash:bigint,node:int>>")
    rows = numbered.select("_key", *[f"_{i}" for i in range(len(kinds))], F.explode(F.array(*met_at) if met_at else nowhere).alias("at"))
    rows = rows.select("_key", *[f"_{i}" for i in range(len(kinds))], "at.*")

    holds = F.lit(True)
    for (field, op), name in strictest.items():
        holds &= F.col(name).isNull() | _COMPARED[op](value_of[field], F.col(name))

    on = ["kind", "hash", "node"]
    if fits(places, places.columns, max_bytes):
        # A record may meet very many lists: a small catalog is dealt over all tasks by a number that is not made smaller.
        parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = rows.repartition(parts, *rows.columns).join(F.broadcast(places), on)
    else:
        pairs = join_spread(rows, places, on, "_key")
    return pairs.filter(holds).select(F.explode("queries").alias("query_id"), F.col("_key").alias(key)), left


def _said(lists: DataFrame, bins: int) -> tuple[dict[str, list[str]], dict[str, list[float]]]:
    """Per field its operators, and up to ``bins`` - 1 of the numbers that bound it, ascending, with about as many between any two."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    edges = F.percentile_approx(F.when(F.col("c.op") != "=", F.col("c.number")), shares, 10_000)
    found = lists.select(F.explode("typed").alias("c")).groupBy("c.field").agg(F.collect_set("c.op").alias("ops"), edges.alias("edges")).collect()  # one row per field
    return {r["field"]: r["ops"] for r in found}, {r["field"]: sorted({x + 0.0 for x in r["edges"]}) for r in found if r["edges"]}


def _leaves(edges: Sequence[float]) -> int:
    """A power of two that is above the number of edges."""
    return 1 << len(edges).bit_length()


def _bin_of(value: Column, edges: Sequence[float]) -> Column:
    """How many edges a number reaches; NaN is above all."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= value))


def _leaf_of(value: Column, edges: Sequence[float]) -> Column:
    """The leaf a number lies in; none for a null."""
    return F.when(value.isNotNull(), _leaves(edges) + _bin_of(value, edges))


def _upwards(leaf: Column, edges: Sequence[float], levels: Sequence[int]) -> list[Column]:
    """Of the leaf and all nodes above it, up to the root, which is 1, those of the given levels; the root's is 0."""
    last = _leaves(edges).bit_length() - 1
    return [F.shiftright(leaf, last - level).cast("int") for level in sorted(levels)]


def _with_nodes(lists: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Adds ``range_field``, the field with the narrowest range of a list, and ``nodes``, the nodes that cover it.

    Lists without a range have a null field and the root alone.
    """
    ranges = [F.lit(None).cast("struct<share:double,field:string,nodes:array<int>>")]
    for i, (field, cuts) in enumerate(sorted(edges.items())):
        leaves = _leaves(cuts)

        def bound(ops: Sequence[str], pick, field=field) -> Column:
            chosen = F.filter("typed", lambda c: (c["field"] == field) & c["op"].isin(*ops))
            return pick(F.transform(chosen, lambda c: c["number"]))

        lists = lists.withColumns({f"_low{i}": bound((">", ">="), F.array_max), f"_high{i}": bound(("<", "<="), F.array_min)})
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        lists = lists.withColumns({
            f"_first{i}": F.when(low.isNotNull(), _bin_of(low, cuts)).otherwise(0) + leaves,
            f"_behind{i}": F.when(high.isNotNull(), _bin_of(high, cuts)).otherwise(len(cuts)) + leaves + 1,
        })
        first, behind, nodes = F.col(f"_first{i}"), F.col(f"_behind{i}"), []
        for level in range(leaves.bit_length()):
            a, b = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(behind, level)
            nodes += [F.when((a < b) & (a % 2 == 1), a.cast("int")), F.when((a < b) & (b % 2 == 1), (b - 1).cast("int"))]
        found = F.struct(((behind - first) / leaves).alias("share"), F.lit(field).alias("field"), F.array_compact(F.array(*nodes)).alias("nodes"))
        lists = lists.withColumn(f"_range{i}", F.when(low.isNotNull() | high.isNotNull(), found))
        ranges.append(F.col(f"_range{i}"))
    best = F.array_min(F.array(*ranges))
    return lists.select("list_id", "typed", "fields", best.alias("_best")).select(
        "list_id", "typed", "fields", F.col("_best.field").alias("range_field"), F.coalesce("_best.nodes", F.array(F.lit(1))).alias("nodes")
    )
