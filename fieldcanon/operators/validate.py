"""Accuracy against known-good mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .standardize import Classifier, by_keywords


def truth(triples: DataFrame) -> DataFrame:
    """``field_key, raw, labels``: the distinct labels of each raw value, sorted."""
    pairs = triples.select("field_key", "raw", "std").distinct()
    return pairs.groupBy("field_key", "raw").agg(F.array_sort(F.collect_list("std")).alias("labels"))


def truth_split(labelled: DataFrame) -> DataFrame:
    """Raw values, consistent and ambiguous ones of each field."""
    return labelled.groupBy("field_key").agg(F.count("*").alias("raw_values"), F.count_if(F.size("labels") == 1).alias("consistent"), F.count_if(F.size("labels") > 1).alias("ambiguous"))


def scored(labelled: DataFrame, classifier: Classifier = by_keywords, limit: int | None = None) -> DataFrame:
    """Each consistent raw value with ``expected, std, confidence, correct``, classified without country.

    ``limit`` scores the first so many in order of field and raw value only.
    """
    known = labelled.where(F.size("labels") == 1).select("field_key", "raw", F.element_at("labels", 1).alias("expected"))
    if limit is not None:
        known = known.orderBy("field_key", "raw").limit(limit)
    got = classifier(known.select("field_key", F.lit("").alias("country"), "raw")).select("field_key", "raw", "std", "confidence")
    return known.join(got, ["field_key", "raw"]).withColumn("correct", F.col("std") == F.col("expected"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)


def accuracy(scores: DataFrame) -> DataFrame:
    """``scored, correct, mismatches, accuracy`` (percent; 0 if nothing was scored) of each field."""
    counted = scores.groupBy("field_key").agg(F.count("*").alias("scored"), F.count_if("correct").alias("correct"))
    return counted.withColumn("mismatches", F.col("scored") - F.col("correct")).withColumn("accuracy", _percent(F.col("correct"), F.col("scored")))


def accuracy_by_confidence(scores: DataFrame) -> DataFrame:
    """The same for each level of confidence: HIGH, MEDIUM, LOW, then ``(missing)``."""
    level = F.when(F.coalesce("confidence", F.lit("")) == "", "(missing)").otherwise(F.col("confidence"))
    counted = scores.groupBy(level.alias("level")).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    order = F.array_position(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW", "(missing)"))), F.col("level"))
    return counted.withColumn("accuracy", _percent(F.col("correct"), F.col("total"))).orderBy(order)


def mismatches(scores: DataFrame, n: int) -> DataFrame:
    """The first ``n`` mismatches by field and raw value."""
    return scores.where("not correct").orderBy("field_key", "raw").select("field_key", "raw", "expected", F.col("std").alias("got")).limit(n)
