"""Request rules as a table of any size.

A rule names words of which every text it matches holds at least one. Texts and rules meet on these words, and only
then are the patterns tried. So a text is tried against the rules that share a word with it, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.functions.text import semantic_text
from sieverank.operators.joins import fits, join_spread
from sieverank.session import cut

MAX_RULE_BYTES = 64 << 20


def words_of(lowered: Column) -> Column:
    """The distinct runs of letters and digits, in any script, of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def route_by_table(texts: DataFrame, rules: DataFrame, text_id: str, text: str = "text", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """Adds ``conditions`` and ``semantic_query`` to texts with a unique id.

    ``rules`` has ``slot, priority, words, pattern, not_pattern, condition``. A rule applies to a lower-cased text that
    holds one of its words, matches its pattern and does not match its ``not_pattern`` (if that is not null). In
    every slot the applying rule with the lowest priority counts, of equal ones that with the smallest condition;
    conditions come in slot order. A rule without words applies to nothing. Rules of up to ``max_rule_bytes``, which
    are measured, are broadcast; of more, and of the texts, the rows of a frequent word are spread.
    Texts that no rule applies to keep an empty list; null texts count as empty.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    entries = rules.select("slot", "priority", "pattern", "not_pattern", "condition", F.explode(F.array_distinct("words")).alias("word"))
    entries = cut(entries.withColumn("word", F.lower("word")), "rules")
    spread = texts.select(F.col(text_id).alias("_id"), lowered.alias("_text")).withColumn("word", F.explode(words_of(F.col("_text"))))
    if fits(entries, ["word", "pattern", "not_pattern", "condition"], max_rule_bytes):
        met = spread.join(F.broadcast(entries), "word")
    else:
        met = join_spread(spread, entries, ["word"], "_id")
    # (?U): word boundaries and blanks in the Unicode sense, as in rules that are written out
    unicode = F.lit("(?U)")
    refused = F.coalesce(F.rlike("_text", F.concat(unicode, "not_pattern")), F.lit(False))
    hit = met.filter(F.rlike("_text", F.concat(unicode, "pattern")) & ~refused)
    best = hit.groupBy("_id", "slot").agg(F.min(F.struct("priority", "condition")).alias("best"))
    chosen = best.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("best.condition").alias("condition")))).alias("chosen"))
    found = chosen.select(F.col("_id").alias(text_id), F.col("chosen.condition").alias("conditions"))
    routed = texts.join(found, text_id, "left").withColumn("conditions", F.coalesce("conditions", F.array().cast("array<string>")))
    return routed.withColumn("semantic_query", semantic_text(lowered))
