"""Parse numbered responses of a batched classifier and line them up with their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAKS

# The line formats, most specific first.
_START = r"(?i)^\s*(\d+)[.)]\s*(.+?)\s*"
WITH_LOW = _START + r"\|\s*LOW\s*\|\s*Alternatives:\s*(.+?)\s*\|\s*Reason:\s*(.+?)\s*$"
WITH_MEDIUM = _START + r"\|\s*MEDIUM\s*\|\s*Reason:\s*(.+?)\s*$"
WITH_CONFIDENCE = _START + r"\|\s*(HIGH|MEDIUM|LOW)\s*$"
NUMBERED = _START + "$"
TOTAL = r"(?i)\[\s*Total:\s*(\d+)\s+of\s+(\d+)\s+mapped\s*\]"


def _group(pattern: str, n: int, text: Column) -> Column:
    return F.regexp_extract(text, pattern, n)


def parsed_lines(responses: DataFrame) -> DataFrame:
    """Every answering line of ``batch_id, response``: ``batch_id, line_no, idx, std, confidence,
    alternatives, reasoning, tagged``.

    Only lines that begin with a digit are tried, so most text costs one test.
    """
    lines = responses.select("batch_id", F.posexplode(F.split("response", LINE_BREAKS)).alias("line_no", "line"))
    line = F.col("line")
    lines = lines.where(line.rlike(r"^\s*\d") & ~line.rlike(TOTAL))
    kind = F.when(line.rlike(WITH_LOW), 3).when(line.rlike(WITH_MEDIUM), 2).when(line.rlike(WITH_CONFIDENCE), 1).when(line.rlike(NUMBERED), 0)
    lines = lines.withColumn("kind", kind).where("kind is not null")
    pick = lambda low, medium, plain, bare: F.when(F.col("kind") == 3, low).when(F.col("kind") == 2, medium).when(F.col("kind") == 1, plain).otherwise(bare)
    options = F.filter(F.transform(F.split(_group(WITH_LOW, 3, line), ","), lambda a: F.trim(a)), lambda a: a != "")
    return lines.select(
        "batch_id",
        "line_no",
        _group(NUMBERED, 1, line).cast("bigint").alias("idx"),
        F.trim(pick(_group(WITH_LOW, 2, line), _group(WITH_MEDIUM, 2, line), _group(WITH_CONFIDENCE, 2, line), _group(NUMBERED, 2, line))).alias("std"),
        F.upper(pick(F.lit("LOW"), F.lit("MEDIUM"), _group(WITH_CONFIDENCE, 3, line), F.lit(""))).alias("confidence"),
        F.when(F.col("kind") == 3, options).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        pick(_group(WITH_LOW, 4, line), _group(WITH_MEDIUM, 3, line), F.lit(""), F.lit("")).alias("reasoning"),
        (F.col("kind") > 0).alias("tagged"),
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """The first line of each item, with ``repeats``: how many tagged lines of it follow."""
    item = Window.partitionBy("batch_id", "idx")
    return (
        lines.withColumn("_n", F.row_number().over(item.orderBy("line_no")))
        .withColumn("_tagged", F.count_if("tagged").over(item))
        .where("_n = 1")
        .withColumn("repeats", F.col("_tagged") - F.col("tagged").cast("bigint"))
        .drop("_n", "_tagged", "line_no")
    )


def aligned(responses: DataFrame, inputs: DataFrame) -> DataFrame:
    """A row for each input (``batch_id, idx, raw``): its answer, or empty texts if there is none."""
    found = first_lines(parsed_lines(responses))
    joined = inputs.select("batch_id", F.col("idx").cast("bigint").alias("idx"), "raw").join(found, ["batch_id", "idx"], "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select("batch_id", "idx", "raw", text("std"), text("confidence"), F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"), text("reasoning"))


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def batch_warnings(responses: DataFrame, inputs: DataFrame) -> DataFrame:
    """``batch_id, ok, warnings`` of each batch: duplicates, missing tags, missing and extra items,
    and counts that don't agree. Warnings of items come in the order of item numbers."""
    found = first_lines(parsed_lines(responses)).select("batch_id", "idx", "repeats", "tagged", F.lit(True).alias("answered"))
    asked = inputs.select("batch_id", F.col("idx").cast("bigint").alias("idx"), F.lit(True).alias("asked"))
    item = asked.join(found, ["batch_id", "idx"], "full")
    idx = F.col("idx")
    own = F.concat(
        F.when(F.col("repeats") > 0, F.array_repeat(_text("duplicate output for item ", idx), F.col("repeats").cast("int"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.col("tagged"), F.array(_text("item ", idx, ": no confidence tag parsed"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("answered").isNull(), F.array(_text("no output returned for item ", idx))).otherwise(F.array().cast("array<string>")),
    )
    batches = item.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", own.alias("own")))).alias("items"),
        F.count_if("asked").alias("expected"),
        F.count_if("answered").alias("answered"),
        F.array_sort(F.collect_list(F.when(F.col("asked").isNull(), idx))).alias("extra"),
    )
    totals = responses.select("batch_id", F.nullif(F.regexp_extract("response", TOTAL, 1), F.lit("")).cast("bigint").alias("reported"), F.nullif(F.regexp_extract("response", TOTAL, 2), F.lit("")).cast("bigint").alias("reported_of"))
    joined = batches.join(totals, "batch_id", "left")
    col = F.col
    general = F.array_compact(
        F.array(
            F.when(col("reported_of") != col("expected"), _text("model's [Total: … of ", col("reported_of"), "] != ", col("expected"), " inputs sent")),
            F.when(F.size("extra") > 0, _text("output had out-of-range item numbers: [", F.array_join(F.transform("extra", lambda x: x.cast("string")), ", "), "]")),
            F.when(col("answered") != col("expected"), _text("parsed ", col("answered"), " outputs for ", col("expected"), " inputs")),
            F.when(col("reported") != col("answered"), _text("model reported ", col("reported"), " mapped but ", col("answered"), " lines parsed")),
        )
    )
    warnings = F.concat(F.flatten(F.transform("items", lambda i: i["own"])), general)
    return joined.select("batch_id", warnings.alias("warnings")).withColumn("ok", F.size("warnings") == 0)


def needs_review(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit("")).isin("", "LOW")
