"""Recognise a table's layout and route its rows to fields and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import country_name, numeric_id
from ..registry import ANALYTICS_FIELD_TYPES, STANDARD_FIELD_TYPES, field_type_table

ANALYTICS_COLUMNS = frozenset({"countryid", "fieldtype", "inputtext"})


def column_named(df: DataFrame, name: str) -> str | None:
    """The column whose name matches, case and outer white space aside."""
    return next((c for c in df.columns if c.strip().lower() == name), None)


def is_analytics(df: DataFrame) -> bool:
    return ANALYTICS_COLUMNS <= {c.strip().lower() for c in df.columns}


def is_mixed(df: DataFrame) -> bool:
    """Whether a ``Field`` column holds at least one known field type."""
    column = column_named(df, "field")
    if column is None:
        return False
    return not df.where(F.lower(F.trim(F.col(f"`{column}`"))).isin(*STANDARD_FIELD_TYPES)).isEmpty()


def layout(df: DataFrame) -> str:
    """``analytics``, ``mixed`` or ``single``."""
    return "analytics" if is_analytics(df) else "mixed" if is_mixed(df) else "single"


def with_field_key(df: DataFrame, type_column: str, types: dict[str, str] = ANALYTICS_FIELD_TYPES, into: str = "field_key") -> DataFrame:
    """Add the field's key, null for an unknown or missing type. The types fit any broadcast."""
    known = field_type_table(df.sparkSession, types).select(F.col("type_text").alias("_type_text"), F.col("field_key").alias("_type_key"))
    text = F.lower(F.trim(F.col(f"`{type_column}`").cast("string")))
    joined = df.join(F.broadcast(known), text == F.col("_type_text"), "left")
    return joined.withColumn(into, F.col("_type_key")).drop("_type_text", "_type_key")


def with_country(df: DataFrame, id_column: str, countries: DataFrame, into: str = "Country") -> DataFrame:
    """Add the country's name by ``countries`` (``country_id, country``), a column of that name is
    overwritten. Spark broadcasts the dimension while it is below its threshold."""
    names = countries.select(F.col("country_id").cast("bigint").alias("_country_id"), F.col("country").alias("_country_name")).dropDuplicates(["_country_id"])
    value = F.col(f"`{id_column}`")
    joined = df.join(names, numeric_id(value) == F.col("_country_id"), "left")
    return joined.withColumn(into, country_name(value, F.col("_country_name"))).drop("_country_id", "_country_name")


def type_label(field_type: Column) -> Column:
    """The field type as statistics name it: a missing one is ``nan``."""
    return F.coalesce(field_type.cast("string"), F.lit("nan"))
