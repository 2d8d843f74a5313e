"""Standardise the raw values of a table: distinct keys, lookup, classification, fan-out, review flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify
from ..functions.text import norm_key, quoted
from ..registry import ANALYTICS_FIELD_TYPES, CATCH_ALL, FIELDS, NEEDS_REVIEW, STANDARD_FIELD_TYPES, UNKNOWN_FIELD_TYPE
from ..sources.storage import written
from .lookup import resolve
from .route import column_named, type_label, with_country, with_field_key

STANDARDIZED, REVIEW, REASON = "Standardized Value", "Needs Review", "Review Reason"
RESULT_COLUMNS = (STANDARDIZED, REVIEW, REASON)
KEYS = ["field_key", "country", "raw"]

#: Takes distinct keys (``field_key, country, raw``) and adds ``std, confidence, alternatives, reasoning``.
#: If it has a ``column``, a function of the three columns that gives the four as a struct, that is used
#: instead: then hits and misses of the lookup need no plans of their own.
Classifier = Callable[[DataFrame], DataFrame]


def by_column(column: Callable[[Column, Column, Column], Column]) -> Classifier:
    """A classifier of a function of field key, raw value and country."""

    def classifier(keys: DataFrame) -> DataFrame:
        found = column(F.col("field_key"), F.col("raw"), F.col("country"))
        return keys.withColumn("_c", found).select(*KEYS, "_c.std", "_c.confidence", "_c.alternatives", "_c.reasoning")

    classifier.column = column
    return classifier


#: Classify with the keyword cascades.
by_keywords = by_column(classify)


def keyed(df: DataFrame, field_key: Column, value: Column, country: Column | None) -> DataFrame:
    """Add the key of each row as struct ``_key``; the country only where the field depends on it."""
    dependent = [k for k, (_, _, by_country) in FIELDS.items() if by_country]
    place = F.when(field_key.isin(*dependent), norm_key(country)).otherwise("") if country is not None else F.lit("")
    return df.withColumn("_key", F.struct(field_key.alias("field_key"), place.alias("country"), norm_key(value).alias("raw")))


def distinct_keys(rows: DataFrame) -> DataFrame:
    """The distinct keys that need an answer: blanks and unknown fields don't."""
    return rows.select("_key.*").where("raw <> '' and field_key is not null").distinct()


def answers(keys: DataFrame, lookup: DataFrame | None, classifier: Classifier = by_keywords) -> DataFrame:
    """``field_key, country, raw, std, confidence, alternatives, reasoning, from_lookup`` for each key."""
    if lookup is None:
        return classifier(keys).withColumn("from_lookup", F.lit(False))
    resolved = resolve(keys, lookup, "_found")
    column = getattr(classifier, "column", None)
    if column is not None:
        hit = F.struct(F.col("_found").alias("std"), F.lit("HIGH").alias("confidence"), F.array().cast("array<string>").alias("alternatives"), F.lit("").alias("reasoning"))
        found = F.when(F.col("_found").isNotNull(), hit).otherwise(column(F.col("field_key"), F.col("raw"), F.col("country")))
        return resolved.withColumn("_c", found).select(*KEYS, "_c.std", "_c.confidence", "_c.alternatives", "_c.reasoning", F.col("_found").isNotNull().alias("from_lookup"))
    hits = resolved.where("_found is not null").select(
        *KEYS, F.col("_found").alias("std"), F.lit("HIGH").alias("confidence"), F.array().cast("array<string>").alias("alternatives"), F.lit("").alias("reasoning"), F.lit(True).alias("from_lookup")
    )
    misses = classifier(resolved.where("_found is null").select(*KEYS)).withColumn("from_lookup", F.lit(False))
    return hits.unionByName(misses)


def fan_out(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Join the answers to all rows as struct ``_answer``.

    Rows without a question have a null key, so the many blanks match nothing. The answers are
    broadcast while their table is below Spark's threshold; beyond it hot keys are left to the
    adaptive skew join.
    """
    packed = found.select(F.struct(*KEYS).alias("_asked"), F.struct("std", "confidence", "alternatives", "reasoning", "from_lookup").alias("_answer"))
    asked = F.when((F.col("_key.raw") != "") & F.col("_key.field_key").isNotNull(), F.col("_key"))
    parts = [asked[k] == F.col("_asked")[k] for k in KEYS]
    return rows.join(packed, parts[0] & parts[1] & parts[2], "left").drop("_asked")


def review_columns(type_text: Column | None = None) -> dict[str, Column]:
    """The three result columns from ``_key`` and ``_answer``."""
    known, blank = F.col("_key.field_key").isNotNull(), F.col("_key.raw") == ""
    confidence = F.coalesce(F.col("_answer.confidence"), F.lit(""))
    low = confidence.isin("", "LOW")
    options = F.array_join(F.transform("_answer.alternatives", lambda a: F.concat(a, F.lit("?"))), " / ")
    flag = F.when(F.coalesce(options, F.lit("")) == "", NEEDS_REVIEW).otherwise(F.concat(F.lit(f"{NEEDS_REVIEW}: "), options))
    unknown = F.lit(NEEDS_REVIEW)
    if type_text is not None:
        text = F.when(type_text.isNull(), "nan").otherwise(quoted(type_text.cast("string")))
        unknown = F.concat(F.lit(f"{NEEDS_REVIEW}: no classifier for field type "), text)
    return {
        STANDARDIZED: F.when(~known, UNKNOWN_FIELD_TYPE).when(blank, CATCH_ALL).otherwise(F.coalesce(F.col("_answer.std"), F.lit(""))),
        REVIEW: F.when(~known, unknown).when(blank, NEEDS_REVIEW).when(low, flag).otherwise(""),
        REASON: F.when(known & ~blank & (low | (confidence == "MEDIUM")), F.coalesce(F.col("_answer.reasoning"), F.lit(""))).otherwise(""),
    }


def _finished(rows: DataFrame, lookup: DataFrame | None, classifier: Classifier) -> DataFrame:
    """Answer the rows' keys and join the answers back.

    The answers are written first: where they are small, as they mostly are, Spark then plans a
    broadcast at once, and the rows are never shuffled.
    """
    return fan_out(rows, written(answers(distinct_keys(rows), lookup, classifier), "answers"))


def standardize(df: DataFrame, value_column: str, field_key: str, country_column: str | None = None, lookup: DataFrame | None = None, classifier: Classifier = by_keywords) -> DataFrame:
    """Standardise a table of one field.

    All columns are passed through, with the three result columns right after the value column;
    older ones are dropped. Blank values get the catch-all and are flagged.
    """
    clean = df.drop(*RESULT_COLUMNS)
    country = F.col(f"`{country_column}`") if country_column else None
    rows = keyed(clean, F.lit(field_key), F.col(f"`{value_column}`"), country)
    result = review_columns()
    columns: list[Column] = []
    for c in clean.columns:
        columns.append(F.col(f"`{c}`"))
        if c == value_column:
            columns += [v.alias(k) for k, v in result.items()]
    return _finished(rows, lookup, classifier).select(*columns)


def _mixed(df: DataFrame, type_column: str, types: dict[str, str], value_column: str, country: Column | None, lookup: DataFrame | None, classifier: Classifier) -> DataFrame:
    clean = df.drop(*RESULT_COLUMNS)
    routed = with_field_key(clean, type_column, types, "_field_key")
    rows = keyed(routed, F.col("_field_key"), F.col(f"`{value_column}`"), country).drop("_field_key")
    result = review_columns(F.col(f"`{type_column}`"))
    return _finished(rows, lookup, classifier).select(*(F.col(f"`{c}`") for c in clean.columns), *(v.alias(k) for k, v in result.items()), "_key", "_answer")


def standardize_analytics(df: DataFrame, countries: DataFrame, lookup: DataFrame | None = None, classifier: Classifier = by_keywords, keep_keys: bool = False) -> DataFrame:
    """Standardise an analytics export (``countryId, fieldType, inputText``), all fields in one plan.

    ``Country`` and the result columns are appended. ``keep_keys`` leaves the columns ``_key``
    and ``_answer`` that the statistics need.
    """
    types, values, ids = (column_named(df, c) for c in ("fieldtype", "inputtext", "countryid"))
    if not (types and values and ids):
        raise ValueError("an analytics export has columns countryId, fieldType and inputText")
    placed = with_country(df, ids, countries)
    out = _mixed(placed, types, ANALYTICS_FIELD_TYPES, values, F.col("Country"), lookup, classifier)
    return out if keep_keys else out.drop("_key", "_answer")


def counted_analytics(df: DataFrame, countries: DataFrame, lookup: DataFrame | None = None, classifier: Classifier = by_keywords) -> DataFrame:
    """What ``run_stats`` needs of an analytics export, a row for each field type and key: the rows are
    counted in ``n`` before anything is asked or joined, and read once."""
    types, values, ids = (column_named(df, c) for c in ("fieldtype", "inputtext", "countryid"))
    routed = with_field_key(with_country(df, ids, countries), types, ANALYTICS_FIELD_TYPES, "_field_key")
    rows = keyed(routed, F.col("_field_key"), F.col(f"`{values}`"), F.col("Country"))
    counts = written(rows.groupBy(F.col(f"`{types}`"), "_key").agg(F.count("*").alias("n")), "counts")
    result = review_columns(F.col(f"`{types}`"))
    return _finished(counts, lookup, classifier).select(F.col(f"`{types}`"), "n", *(v.alias(k) for k, v in result.items()), "_key", "_answer")


def standardize_mixed(df: DataFrame, value_column: str, country_column: str | None = None, lookup: DataFrame | None = None, classifier: Classifier = by_keywords, keep_keys: bool = False) -> DataFrame:
    """Standardise a table whose ``Field`` column names each row's field."""
    types = column_named(df, "field")
    if not types:
        raise ValueError("a mixed table has a column Field")
    country = F.col(f"`{country_column}`") if country_column else None
    out = _mixed(df, types, STANDARD_FIELD_TYPES, value_column, country, lookup, classifier)
    return out if keep_keys else out.drop("_key", "_answer")


def export(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chosen original columns and the three result columns. Without a choice: the country, the field
    and the raw value of an analytics export, as far as they are there."""
    if columns is None:
        columns = [c for c in ("Country", column_named(df, "fieldtype"), column_named(df, "inputtext")) if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in columns if c not in RESULT_COLUMNS), *RESULT_COLUMNS)


__all__ = ["RESULT_COLUMNS", "answers", "by_keywords", "counted_analytics", "distinct_keys", "export", "fan_out", "keyed", "standardize", "standardize_analytics", "standardize_mixed", "type_label"]
