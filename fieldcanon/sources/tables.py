"""Read and write the tables that the jobs work on."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stats import FAILURES, RECORD
from .commits import CommittedTable
from .quoted import read_quoted
from .storage import exists

# Headers of the raw-value column and of the country column; texts that mean "missing".
VALUE_HEADERS = ("value", "raw value", "raw_value", "raw", "input", "inputs", "raw input", "original value", "original", "raw values")
COUNTRY_HEADERS = ("country", "countries")
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

QUEUE = (
    "id string, submitted_at string, submitted_by string, country string, raw_value string, field_key string, field_display string, original string, proposed string, "
    "status string, reviewed_at string, reviewer_note string, needs_prompt_update boolean, source string"
)


def read_table(spark: SparkSession, path: str, kind: str | None = None, null_tokens: tuple[str, ...] = NULL_TOKENS, breaks: str = "split") -> DataFrame:
    """A table of raw values from CSV, text, JSON lines or Parquet (by suffix, or ``kind``).

    Text columns stay text: numbers aren't guessed. Values in ``null_tokens`` become null. ``breaks`` says
    how line breaks inside the quotes of a CSV are found: ``split`` reads the splits of a file in parallel
    and lands its records (``quoted``); ``file`` takes a task a file; ``none`` reads in parallel without
    looking for any, and is right only for files that have none.
    """
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "txt") and breaks == "split":
        df = read_quoted(spark, path)
    elif kind in ("csv", "txt") and breaks in ("file", "none"):
        df = spark.read.option("header", True).option("multiLine", breaks == "file").option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.option("primitivesAsString", True).json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "txt"):
        raise ValueError(f"breaks is split, file or none, not {breaks!r}")
    else:
        raise ValueError(f"no reader for {kind!r}: land spreadsheets as CSV or Parquet")
    texts = [c for c, t in df.dtypes if t == "string"]
    return df.select(*(F.when(F.col(f"`{c}`").isin(*null_tokens), None).otherwise(F.col(f"`{c}`")).alias(c) if c in texts and null_tokens else F.col(f"`{c}`") for c in df.columns))


def value_column(df: DataFrame, chosen: str | None = None) -> str:
    """The raw-value column: the chosen one, or the only one with a usual header."""
    if chosen is not None:
        found = [c for c in df.columns if c == chosen] or [c for c in df.columns if c.strip().lower() == chosen.strip().lower()]
        if not found:
            raise ValueError(f"no column {chosen!r}; there are {df.columns}")
        return found[0]
    found = [c for c in df.columns if c.strip().lower() in VALUE_HEADERS]
    if len(found) != 1:
        raise ValueError(f"{'several columns' if found else 'no column'} could hold the raw values: name one of {found or df.columns}")
    return found[0]


def country_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.strip().lower() in COUNTRY_HEADERS), None)


def read_master(spark: SparkSession, paths: dict[str, str], kind: str | None = None) -> DataFrame:
    """The master mapping ``field_key, country, raw, std`` from one table a field.

    The first three columns of each count, whatever their headers; a field without rows is left
    out. Texts such as ``N/A`` are real values here.
    """
    parts = []
    for field_key, path in paths.items():
        df = read_table(spark, path, kind, null_tokens=())
        country, raw, std = (F.col(f"`{c}`").cast("string") for c in df.columns[:3])
        parts.append(df.select(F.lit(field_key).alias("field_key"), country.alias("country"), raw.alias("raw"), std.alias("std")))
    if not parts:
        return spark.createDataFrame([], "field_key string, country string, raw string, std string")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_countries(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The country dimension ``country_id, country`` from a table's first two columns."""
    df = read_table(spark, path, kind, null_tokens=())
    number, name = df.columns[:2]
    return df.select(F.col(f"`{number}`").cast("bigint").alias("country_id"), F.col(f"`{name}`").alias("country"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        raise ValueError(f"no writer for {kind!r}")


def _or_empty(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    return read(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _append_lines(rows: DataFrame, path: str, run: str | None) -> None:
    """A run that is named has a folder of its own, which a rerun writes anew."""
    if run is None:
        rows.write.mode("append").json(path)
    else:
        rows.write.mode("overwrite").json(f"{path}/{hashlib.sha256(run.encode()).hexdigest()}")


def append_record(record: DataFrame, path: str, run: str | None = None) -> None:
    """Append run records as JSON lines; with the name of a ``run`` only once, however often it is rerun."""
    _append_lines(record.coalesce(1), path, run)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All run records; none if nothing was written yet."""
    return _or_empty(spark, path, RECORD, spark.read.schema(RECORD).option("recursiveFileLookup", True).json)


def append_failures(failures: DataFrame, path: str, run: str | None = None) -> None:
    """Append the failed batches of a run, a JSON line each; ``run`` as for its record."""
    _append_lines(failures, path, run)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, path, FAILURES, spark.read.schema(FAILURES).option("recursiveFileLookup", True).json)


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append submissions or decisions to an event table of the correction queue. A batch of that name that
    is there already isn't appended again, so a job can be rerun."""
    _committed(events.sparkSession, path, events.schema).append(events, batch)


def read_events(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return _committed(spark, path, schema).read()


def _committed(spark: SparkSession, path: str, schema: str | StructType) -> CommittedTable:
    return CommittedTable(spark, path, schema if isinstance(schema, str) else schema.toDDL())
