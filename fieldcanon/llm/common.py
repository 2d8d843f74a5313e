"""What the operators of this subpackage share: tables, shared storage, text columns and row keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import written

__all__ = ["first_of", "free_names", "table", "text_of", "with_rows", "written"]

#: The columns that ``with_rows`` adds, where their names are free.
ROW = ("_row_file", "_row_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def first_of(doc_id: str = "doc_id", row: str = "row") -> Column:
    """What rows of a group are ranked by: ids before a missing id, smaller ids first, then the row."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"))


def free_names(taken: list[str], *wanted: str) -> tuple[str, ...]:
    """The wanted names, with underscores behind them until no column has them, in any letter case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


def with_rows(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two more columns, which name each row whatever its other columns hold or are called; and
    the names of the two.

    They are the 64-bit hash of the path of the row's file, and its place there, so every job that
    reads the table finds the same, and keys are small wherever they are joined. (Of a million files
    two have the same hash once in 37 million tables.) A table that isn't read from files is written
    first.
    """
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        docs = written(docs, "rows")
        place = docs.metadataColumn("_metadata")
    file, at = free_names(docs.columns, *ROW)
    return docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(at)), (file, at)
