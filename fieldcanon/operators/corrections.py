"""The correction queue: diffs of corrected tables, submissions, decisions, and the queue's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..registry import ANALYTICS_FIELD_TYPES, field_table
from .route import with_field_key

KEY = ["field_key", "raw_value", "country"]


def _first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def diff_standard(original: DataFrame, corrected: DataFrame, raw_column: str, country_column: str | None, field_key: Column, order_column: str) -> DataFrame:
    """Corrections of a table: labels that differ from the first original row of the same country
    and value. The first correction of a key in ``order_column`` is kept."""

    def rows(df: DataFrame, label: str) -> DataFrame:
        country = norm_key(F.col(f"`{country_column}`")) if country_column in df.columns else F.lit("")
        return df.select(F.col(order_column).alias("_order"), field_key.alias("field_key"), country.alias("country"), norm_key(F.col(f"`{raw_column}`")).alias("raw_value"), norm_key(F.col("`Standardized Value`")).alias(label))

    first = _first(rows(original, "original"), ["field_key", "country", "raw_value"], "_order").drop("_order")
    joined = rows(corrected, "proposed").where("raw_value <> '' and proposed <> ''").join(first, ["field_key", "country", "raw_value"]).where("proposed <> original")
    return _first(joined, KEY, "_order").select(*KEY, "original", "proposed", "_order")


def diff_analytics(original: DataFrame, corrected: DataFrame, order_column: str) -> DataFrame:
    """Corrections of an analytics export: rows match by value and field type alone, and the
    country is that of the first original row. Unknown types have an empty field key."""

    def rows(df: DataFrame, label: str, *more: Column) -> DataFrame:
        return df.select(F.col(order_column).alias("_order"), norm_key(F.col("inputText")).alias("raw_value"), norm_key(F.col("fieldType")).alias("field_type"), norm_key(F.col("`Standardized Value`")).alias(label), *more)

    first = _first(rows(original, "original", norm_key(F.col("Country")).alias("country")), ["raw_value", "field_type"], "_order").drop("_order")
    joined = rows(corrected, "proposed").where("raw_value <> '' and proposed <> ''").join(first, ["raw_value", "field_type"]).where("proposed <> original")
    routed = with_field_key(joined, "field_type", ANALYTICS_FIELD_TYPES).withColumn("field_key", F.coalesce("field_key", F.lit("")))
    return _first(routed, KEY, "_order").select(*KEY, "original", "proposed", "_order")


def make_corrections(diff: DataFrame, submitted_by: str = "", source: str = "user", submitted_at: Column | None = None) -> DataFrame:
    """Pending corrections with an id that depends on their content only, so a retry gives the same."""
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if submitted_at is None else submitted_at
    names = F.broadcast(field_table(diff.sparkSession).select("field_key", F.col("display_name").alias("field_display")))
    return diff.join(names, "field_key", "left").select(
        F.sha2(F.concat_ws("\x1f", when, *KEY, "proposed"), 256).alias("id"),
        when.alias("submitted_at"),
        F.lit(submitted_by).alias("submitted_by"),
        "country",
        "raw_value",
        "field_key",
        F.coalesce("field_display", "field_key").alias("field_display"),
        "original",
        "proposed",
        F.lit(source).alias("source"),
    )


def normalised(df: DataFrame) -> DataFrame:
    return df.select("*", *(norm_key(F.col(c)).alias(f"_{c}") for c in KEY))


def new_submissions(submissions: DataFrame, queue: DataFrame, order_column: str) -> DataFrame:
    """The submissions to append: the first of each key, unless the key is pending in the queue."""
    keys = [f"_{c}" for c in KEY]
    fresh = normalised(submissions).join(normalised(queue.where("status = 'pending'")).select(*keys).distinct(), keys, "left_anti")
    return _first(fresh, keys, order_column).drop(*keys)


def queue_state(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue from its events: a submission's first decision counts, later ones are ignored.

    ``decisions``: ``id, action (approve, reject), decided_at, seq, note, needs_update``.
    """
    first = decisions.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("decided_at", "seq"))).where("_n = 1")
    decided = first.select("id", F.col("action").alias("_action"), F.col("decided_at").alias("_at"), F.col("note").alias("_note"), F.col("needs_update").alias("_update"))
    approved = F.col("_action") == "approve"
    return submissions.join(decided, "id", "left").select(
        *submissions.columns,
        F.when(F.col("_action").isNull(), "pending").when(approved, "approved").otherwise("rejected").alias("status"),
        F.col("_at").alias("reviewed_at"),
        F.coalesce("_note", F.lit("")).alias("reviewer_note"),
        F.coalesce(approved & F.col("_update"), F.lit(False)).alias("needs_prompt_update"),
    )


def decide_all(queue: DataFrame, action: str, decided_at: Column, note: str = "", needs_update: bool = False) -> DataFrame:
    """Decision events for all that is pending."""
    return queue.where("status = 'pending'").select("id", F.lit(action).alias("action"), decided_at.alias("decided_at"), F.lit(0).alias("seq"), F.lit(note).alias("note"), F.lit(needs_update).alias("needs_update"))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'")


def history(queue: DataFrame) -> DataFrame:
    return queue.where("status <> 'pending'")


def needs_rule_update(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'approved' and needs_prompt_update")


def without_demo(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("source").eqNullSafe(F.lit("demo")))


def approvals(queue: DataFrame) -> DataFrame:
    """What ``lookup.upsert`` takes."""
    return queue.where("status = 'approved'").select("id", "field_key", "country", F.col("raw_value").alias("raw"), "proposed", "reviewed_at")
