"""Statistics of a run, and its log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_key, short_name
from ..registry import ANALYTICS_FIELD_TYPES, field_table
from .route import type_label, with_field_key
from .standardize import REVIEW

#: Schema of a run record; one JSON line each. Failed batches are rows of a table of their own.
RECORD = (
    "timestamp string, source_file string, raw_column string, total_rows bigint, blank_rows bigint, unique_values_sent bigint, duplicates_reused bigint, "
    "batches_total bigint, batches_failed bigint, values_failed bigint, retries_used bigint, flagged_count bigint, mismatches array<string>"
)
FAILURES = "timestamp string, source_file string, field_key string, batch_index bigint, values array<string>, error string"


def field_type_summary(df: DataFrame, type_column: str, types: dict[str, str] = ANALYTICS_FIELD_TYPES) -> DataFrame:
    """``field_type, field_key, display_name, row_count, known`` of each field type, most rows first."""
    counted = df.groupBy(F.col(f"`{type_column}`").alias("field_type")).agg(F.count("*").alias("row_count"))
    named = F.broadcast(field_table(df.sparkSession).select("field_key", "display_name"))
    routed = with_field_key(counted, "field_type", types).join(named, "field_key", "left")
    return routed.select("field_type", "field_key", "display_name", "row_count", F.col("field_key").isNotNull().alias("known")).orderBy(F.desc("row_count"), "field_type")


def run_stats(rows: DataFrame, type_column: str, batch_size: int = 100, weight: str | None = None) -> DataFrame:
    """Counters of each field type from standardised rows that still have ``_key`` and ``_answer``.

    The rows are first counted by type and key, so hot values shrink before the second count. With
    ``weight``, a row stands for so many; see ``standardize.counted_analytics``. ``calls_saved``
    adds hits of the lookup (keys) to duplicates and blanks (rows).
    """
    n = F.lit(1) if weight is None else F.col(weight)
    by_key = rows.groupBy(type_label(F.col(f"`{type_column}`")).alias("field_type"), F.col("_key.field_key").alias("field_key"), F.col("_key.country").alias("country"), F.col("_key.raw").alias("raw")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.startswith(F.col(f"`{REVIEW}`"), F.lit("Needs Review")), n).otherwise(0)).alias("flagged"), F.first("_answer.from_lookup", ignorenulls=True).alias("hit")
    )
    blank, known = F.col("raw") == "", F.col("field_key").isNotNull()
    asked = known & ~blank
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counted = by_key.groupBy("field_type", "field_key").agg(
        whole(F.col("n")).alias("total_rows"),
        whole(F.when(known & blank, F.col("n"))).alias("blanks"),
        F.count_if(asked).alias("unique_values"),
        whole(F.when(asked, F.col("n") - 1)).alias("duplicates"),
        F.count_if(asked & F.col("hit")).alias("lookup_hits"),
        whole(F.col("flagged")).alias("flagged"),
    )
    return counted.withColumn("batches", F.ceil((F.col("unique_values") - F.col("lookup_hits")) / batch_size).cast("bigint")).withColumn(
        "calls_saved", F.col("duplicates") + F.col("blanks") + F.col("lookup_hits")
    )


def observed(rows: DataFrame, type_column: str, types: dict[str, str] = ANALYTICS_FIELD_TYPES) -> tuple[DataFrame, Observation]:
    """Standardised rows (with ``_key``) that are counted as they are written, and where the counts will be.

    Counted are rows, blanks and flagged rows of each known field type, and of all others together: what
    ``run_stats`` says of them, without a second reading. ``observed_stats`` makes a table of the counts
    once the rows are written.
    """
    seen, label = Observation(), F.lower(F.trim(F.col(f"`{type_column}`").cast("string")))
    flagged, blank = F.startswith(F.col(f"`{REVIEW}`"), F.lit("Needs Review")), F.col("_key.raw") == ""
    counts = []
    for n, name in enumerate([*types, None]):
        own = F.coalesce(label == name, F.lit(False)) if name is not None else F.coalesce(~label.isin(*types), F.lit(True))
        known = F.lit(name is not None)
        counts += [F.count_if(own).alias(f"rows_{n}"), F.count_if(own & blank & known).alias(f"blanks_{n}"), F.count_if(own & flagged).alias(f"flagged_{n}")]
    return rows.observe(seen, *counts), seen


def observed_stats(spark: SparkSession, seen: Observation, types: dict[str, str] = ANALYTICS_FIELD_TYPES) -> DataFrame:
    """``type_text, field_key, total_rows, blanks, flagged`` of the types that occurred; the others have a null type."""
    found = seen.get
    rows = [(name, types.get(name), found[f"rows_{n}"], found[f"blanks_{n}"], found[f"flagged_{n}"]) for n, name in enumerate([*types, None]) if found[f"rows_{n}"]]
    return spark.createDataFrame(rows, "type_text string, field_key string, total_rows bigint, blanks bigint, flagged bigint")


def run_totals(stats: DataFrame) -> DataFrame:
    """Totals over all field types, and the sorted names of the unknown ones."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    unknown = F.array_sort(F.collect_set(F.when(F.col("field_key").isNull(), F.col("field_type"))))
    return stats.agg(*(total(c) for c in ("total_rows", "blanks", "unique_values", "duplicates", "lookup_hits", "flagged", "batches", "calls_saved")), unknown.alias("unknown_types"))


def run_record(stats: DataFrame, source_file: str, raw_column: str, timestamp: Column | None = None, failures: DataFrame | None = None, retries: int = 0) -> DataFrame:
    """The log record of a run: ``stats`` summed up, with the numbers of failed batches and of their
    values. ``failures`` has ``field_key, batch_index, values, error``; only its counts are gathered."""
    spark = stats.sparkSession
    failed = failures if failures is not None else spark.createDataFrame([], "field_key string, batch_index bigint, values array<string>, error string")
    lost = failed.agg(F.count("*").alias("batches_failed"), F.coalesce(F.sum(F.size("values")), F.lit(0)).cast("bigint").alias("values_failed"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if timestamp is None else timestamp
    both = run_totals(stats).withColumn("_one", F.lit(1)).join(lost.withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.select(
        now.alias("timestamp"),
        F.lit(source_file).alias("source_file"),
        F.lit(raw_column).alias("raw_column"),
        "total_rows",
        F.col("blanks").alias("blank_rows"),
        F.col("unique_values").alias("unique_values_sent"),
        F.col("duplicates").alias("duplicates_reused"),
        F.col("batches").alias("batches_total"),
        "batches_failed",
        "values_failed",
        F.lit(retries).cast("bigint").alias("retries_used"),
        F.col("flagged").alias("flagged_count"),
        F.array().cast("array<string>").alias("mismatches"),
    )


def failure_rows(failures: DataFrame, source_file: str, timestamp: Column) -> DataFrame:
    """The failed batches of a run as rows of the failure table, to be appended beside its record."""
    return failures.select(timestamp.alias("timestamp"), F.lit(source_file).alias("source_file"), "field_key", F.col("batch_index").cast("bigint").alias("batch_index"), "values", "error")


def log_measures(records: DataFrame) -> DataFrame:
    """Each run's output count (rows without those of failed batches) and number of failed batches."""
    return records.select("timestamp", "source_file", (F.col("total_rows") - F.col("values_failed")).alias("output_count"), "batches_failed")


def row_country_lists(df: DataFrame, country_column: str, field_column: str | None = None) -> DataFrame:
    """For a hand-off: the sorted distinct countries (trimmed, not empty) of each field."""
    place = F.trim(F.col(f"`{country_column}`").cast("string"))
    rows = df.select((F.col(f"`{field_column}`") if field_column else F.lit("")).alias("field"), place.alias("country")).where("country <> ''")
    return rows.distinct().groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("country")), ", ").alias("countries"))


def handoff(df: DataFrame, value_column: str, field_column: str) -> DataFrame:
    """The mapping to hand over: ``Input, Value, Type`` of each distinct value."""
    return df.select(norm_key(F.col(f"`{value_column}`")).alias("Input"), F.col("`Standardized Value`").alias("Value"), F.col(f"`{field_column}`").alias("Type")).where("Input <> ''").distinct()


def handoff_fields(df: DataFrame, type_column: str, country_column: str, types: dict[str, str] = ANALYTICS_FIELD_TYPES) -> DataFrame:
    """What a hand-off says of each known field: its name without the abbreviation in brackets, its
    distinct field types and its sorted countries."""
    names = F.broadcast(field_table(df.sparkSession).select("field_key", short_name(F.col("display_name")).alias("field_name")))
    place = F.trim(F.col(f"`{country_column}`").cast("string"))
    distinct = with_field_key(df.select(F.col(f"`{type_column}`").alias("field_type"), place.alias("country")).distinct(), "field_type", types).where("field_key is not null")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return distinct.groupBy("field_key").agg(listed(F.trim("field_type")).alias("field_types"), listed(F.when(F.col("country") != "", F.col("country"))).alias("countries")).join(names, "field_key")
