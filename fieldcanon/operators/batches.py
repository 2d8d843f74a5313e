"""Number distinct keys in first-seen order and cut them into batches with their request text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAKS
from ..sources.storage import written

#: Rows of a range that is ranked in one task.
RANGE_ROWS = 100_000


def first_seen(rows: DataFrame, keys: list[str], order_column: str) -> DataFrame:
    """Distinct keys with ``first_row``, the smallest value of ``order_column``."""
    return rows.groupBy(*keys).agg(F.min(order_column).alias("first_row"))


def in_ranges(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_range``: Spark deals the rows in this order to ranges of about ``range_rows``, whose
    borders it samples, so any spread of the columns gives even ranges. The result is written."""
    rows = written(rows, "unranked")
    n = max(1, -(-rows.count() // range_rows))
    return written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def ranked(rows: DataFrame, order_column: str, into: str = "position", within: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add each row's position (from 1) in the order of a column with distinct values, for each value
    of ``within`` if given.

    Rows are ranked inside ranges, and the numbers of rows in the ranges before are added. So no
    task ranks the whole table, and what is summed up is a row for each range and value of ``within``.
    """
    group = [within] if within else []
    parts = in_ranges(rows, [*group, order_column], range_rows)
    sizes = parts.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order_column))
    joined = parts.withColumn("_rank", inside).join(offsets, [*group, "_range"])
    return joined.withColumn(into, F.col("_rank") + F.col("_before")).drop("_rank", "_before", "_range")


def display_text(raw: Column, country: Column) -> Column:
    """What a client sees: the value, behind its country if there is one."""
    return F.when(F.coalesce(country, F.lit("")) == "", raw).otherwise(F.concat(F.lit("[Country: "), country, F.lit("] "), raw))


def batch_plan(keys: DataFrame, batch_size: int, order_column: str = "first_row", within: str = "field_key") -> DataFrame:
    """Add ``batch_no`` and ``item`` (both from 1) to each key, in first-seen order of its field."""
    placed = ranked(keys, order_column, "_position", within)
    at = F.col("_position") - 1
    return placed.withColumn("batch_no", F.floor(at / batch_size) + 1).withColumn("item", at % batch_size + 1).drop("_position")


def messages(plan: DataFrame, within: str = "field_key") -> DataFrame:
    """The request text of each batch: a head line, an empty one, and the numbered values."""
    value = F.trim(F.regexp_replace(display_text(F.col("raw"), F.col("country")), LINE_BREAKS, " "))
    items = F.array_sort(F.collect_list(F.struct(F.col("item").alias("item"), value.alias("value"))))
    lines = F.transform("_items", lambda x: F.concat(x["item"].cast("string"), F.lit(". "), x["value"]))
    head = F.concat(F.lit("Classify the following "), F.size("_items").cast("string"), F.lit(" entries:\n\n"))
    return plan.groupBy(within, "batch_no").agg(items.alias("_items")).select(within, "batch_no", F.size("_items").alias("n_items"), F.concat(head, F.array_join(lines, "\n")).alias("message"))
