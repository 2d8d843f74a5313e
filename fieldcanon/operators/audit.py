"""Find, report and resolve conflicting mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..registry import field_table, resolution_table
from .batches import RANGE_ROWS, in_ranges, ranked

COLUMNS = ["Field", "Conflict Group", "Raw Value", "Num Answers", "All Answers", "Standardized Value", "Country", "Resolution", "Field Key"]


def conflicts(triples: DataFrame) -> DataFrame:
    """``field_key, raw, answers``: the raw values with more than one label, labels sorted."""
    pairs = triples.select("field_key", "raw", "std").distinct()
    return pairs.groupBy("field_key", "raw").agg(F.array_sort(F.collect_list("std")).alias("answers")).where(F.size("answers") > 1)


def numbered(keys: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``group_no``: 1, 2, ... over field order and raw value.

    Raw values are ranked inside sampled ranges (``batches.ranked``), whatever letters they share, and the
    counts of the fields before, a row each, are added.
    """
    fields = F.broadcast(field_table(keys.sparkSession).select("field_key", "field_order", "display_name"))
    placed = ranked(keys.join(fields, "field_key"), "raw", "_place", "field_order", range_rows)
    sizes = placed.groupBy("field_order").agg(F.count("*").alias("_n"))
    earlier = sizes.alias("b").join(F.broadcast(sizes.alias("a")), F.col("a.field_order") < F.col("b.field_order"), "left")
    earlier = earlier.groupBy(F.col("b.field_order").alias("field_order")).agg(F.coalesce(F.sum("a._n"), F.lit(0)).alias("_earlier"))
    joined = placed.join(F.broadcast(earlier), "field_order")
    return joined.withColumn("group_no", (F.col("_place") + F.col("_earlier")).cast("int")).drop("_place", "_earlier")


def audit_rows(triples: DataFrame) -> DataFrame:
    """One row for each (raw value, label, country) of a conflict, with an empty ``Resolution``."""
    found = numbered(conflicts(triples))
    rows = triples.distinct().join(found, ["field_key", "raw"])
    return rows.select(
        F.col("display_name").alias("Field"),
        F.col("group_no").alias("Conflict Group"),
        F.col("raw").alias("Raw Value"),
        F.size("answers").alias("Num Answers"),
        F.array_join("answers", " | ").alias("All Answers"),
        F.col("std").alias("Standardized Value"),
        F.col("country").alias("Country"),
        F.lit("").alias("Resolution"),
        F.col("field_key").alias("Field Key"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("Conflict Group", "Standardized Value", "Country")


def conflict_summary(triples: DataFrame) -> DataFrame:
    """Conflicting raw values of each field, none included, and of all (``field_key`` null)."""
    counted = conflicts(triples).groupBy("field_key").agg(F.count("*").alias("n"))
    fields = field_table(triples.sparkSession).select("field_key")
    return fields.join(counted, "field_key", "left").rollup("field_key").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("conflicts"))


def answer_lines(rows: DataFrame, shown: int = 8) -> DataFrame:
    """A line for each label of a conflict, with its first ``shown`` countries."""
    named = rows.groupBy("Field Key", "Raw Value", "Standardized Value").agg(F.array_sort(F.collect_set("Country")).alias("_countries"))
    more = F.when(F.size("_countries") > shown, "...").otherwise("")
    line = F.concat(F.lit("    -> "), quoted(F.col("Standardized Value")), F.lit("  ["), F.array_join(F.slice("_countries", 1, shown), ", "), more, F.lit("]"))
    return named.select("Field Key", "Raw Value", "Standardized Value", line.alias("Line"))


def summary_parts(rows: DataFrame, shown: int = 8, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``part, text``: the audit as text, in parts of about ``range_rows`` lines that follow each other; joined by
    line breaks they are the whole.

    Each field has a head, each raw value a line, each of its labels a line with its first countries. A part
    may begin anywhere: whether a line comes first in its field or value is known from the numbers of all,
    not from the line before it.
    """
    ruler, at = "=" * 60, Window.partitionBy("Field Key", "Raw Value")
    lines = answer_lines(rows, shown).join(rows.select("Field Key", "Raw Value", "Field", "Conflict Group").distinct(), ["Field Key", "Raw Value"])
    fields = F.broadcast(lines.groupBy("Field Key").agg(F.min("Conflict Group").alias("_first"), F.count_distinct("Conflict Group").alias("_n")))  # a row a field
    head = F.concat(F.lit(f"\n{ruler}\nFIELD: "), F.col("Field"), F.lit("  ("), F.col("_n").cast("string"), F.lit(f" conflicting raw values)\n{ruler}\n"))
    first_label = F.col("Standardized Value") == F.min("Standardized Value").over(at)
    name = F.concat(F.lit("\n  Raw: "), quoted(F.col("Raw Value")), F.lit("\n"))
    before = F.concat(F.when(F.col("Conflict Group") == F.col("_first"), head).otherwise(""), name)
    whole = lines.join(fields, "Field Key").withColumn("_text", F.concat(F.when(first_label, before).otherwise(""), F.col("Line")))
    placed = in_ranges(whole.select("Conflict Group", "Standardized Value", "_text"), ["Conflict Group", "Standardized Value"], range_rows)
    inside = F.array_sort(F.collect_list(F.struct("Conflict Group", "Standardized Value", "_text")))
    return placed.groupBy(F.col("_range").alias("part")).agg(F.array_join(F.transform(inside, lambda x: x["_text"]), "\n").alias("text"))


def write_summary(parts: DataFrame, path: str) -> None:
    """Text files whose contents, in the order of their names, are the summary."""
    parts.orderBy("part").select("text").write.text(path)


def apply_resolutions(rows: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Fill ``Resolution`` by field key and raw value, outer spaces aside. Spark broadcasts the resolutions
    while they are below its threshold."""
    known = resolution_table(rows.sparkSession) if resolutions is None else resolutions
    known = known.select(F.col("field_key").alias("_field"), F.col("raw").alias("_raw"), F.col("resolution").alias("_resolution"))
    joined = rows.join(known, (F.trim("Field Key") == F.col("_field")) & (F.trim("Raw Value") == F.col("_raw")), "left")
    return joined.withColumn("Resolution", F.coalesce("_resolution", "Resolution")).drop("_field", "_raw", "_resolution")


def unresolved(rows: DataFrame) -> DataFrame:
    """The distinct keys of audit rows without a resolution, sorted."""
    known = resolution_table(rows.sparkSession).select("field_key", "raw")
    keys = rows.where("`Field Key` is not null and `Raw Value` is not null").select(F.trim("Field Key").alias("field_key"), F.trim("Raw Value").alias("raw")).distinct()
    return keys.join(F.broadcast(known), ["field_key", "raw"], "left_anti").orderBy("field_key", "raw")


def resolution_breakdown(resolutions: DataFrame) -> DataFrame:
    return resolutions.groupBy("resolution").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "resolution")
