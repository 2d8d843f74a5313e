"""Read quoted text files in parallel, however their records and Spark's splits lie.

A line break inside quotes doesn't end a record, so whether a line begins a record depends on all that
comes before it. Each split is therefore read twice. First it tells where a reader would be at its end,
inside quotes or not, for either state at its beginning; these small maps, put one behind the other,
give the state at the beginning of each split. Then the splits are cut into records on their own, and
only pieces of records that cross a border are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .storage import written

#: Letters of records that a task hands on at a time.
BATCH_CHARS = 4_000_000

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a line ends inside quotes if it begins inside them, or not. A quote opens only where a
    field begins; in an unquoted field it is a letter like any other."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside or (at < n and line[at] == '"'):
            at = _QUOTED.match(line, at if inside else at + 1).end()
            if at >= n:
                return True
            inside = False
            at += 1
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line``: in a task the lines of a split follow each other in order. A carriage return
    stays at the end of its line."""
    place = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value").alias("line"))


def _end_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file, block, from_outside, from_inside``: a row for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states = None, [False, True]
        done: list[tuple] = []
        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line"))):
                if (file, block) != at:
                    if at is not None:
                        done.append((*at, *states))
                    at, states = (file, block), [False, True]
                if '"' in line:
                    states = [ends_inside(line, s, delimiter) for s in states]
        if at is not None:
            done.append((*at, *states))
        columns = list(zip(*done)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=["file", "block", "from_outside", "from_inside"])

    return lines.mapInArrow(run, "file bigint, block bigint, from_outside boolean, from_inside boolean")


def begins_inside(ends: DataFrame) -> DataFrame:
    """``file, block`` of the splits that begin inside quotes, from the maps of all splits of a file."""
    maps = F.array_sort(F.collect_list(F.struct("block", "from_outside", "from_inside")))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<bigint>").alias("found"))
    walked = F.aggregate(
        "maps",
        start,
        lambda s, m: F.struct(F.when(s["inside"], m["from_inside"]).otherwise(m["from_outside"]).alias("inside"), F.when(s["inside"], F.array_append(s["found"], m["block"])).otherwise(s["found"]).alias("found")),
    )
    return ends.groupBy("file").agg(maps.alias("maps")).select("file", F.explode(walked["found"]).alias("block"))


def _cut(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file, block, n, piece, record`` of lines that know whether their split begins ``inside`` quotes.

    A record that lies in one split has piece ``whole``; ``first`` is the beginning of one that goes on, and
    ``more`` what the split begins with of one that began before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, inside, piece, held, letters = None, 0, False, "whole", [], 0
        done: list[tuple] = []

        def close(kind: str) -> None:
            nonlocal n, held
            if held:
                record = "\n".join(held)
                if kind != "whole" or record.strip("\r"):
                    done.append((*at, n, kind, record))
                    n += 1
                held = []

        def out() -> pa.RecordBatch:
            nonlocal letters
            columns = list(zip(*done))
            done.clear()
            letters = 0
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=["file", "block", "n", "piece", "record"])

        for batch in batches:
            for file, block, starts, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "line"))):
                if (file, block) != at:
                    if at is not None:
                        close("more" if piece == "more" else "first")
                    at, n, inside, piece = (file, block), 0, starts, "more" if starts else "whole"
                held.append(line)
                letters += len(line)
                inside = ends_inside(line, inside, delimiter)
                if not inside:
                    close(piece)
                    piece = "whole"
            if letters >= BATCH_CHARS and done:
                yield out()
        if at is not None:
            close("more" if piece == "more" else "first")
        if done:
            yield out()

    return lines.mapInArrow(run, "file bigint, block bigint, n bigint, piece string, record string")


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``file, block, n, record``: every record of the files, whole, written. ``block`` and ``n`` are those of
    its beginning and give the order of a file's records."""
    lines = _lines(spark, path)
    # A row for each split that begins inside quotes: some 20 bytes for each 128 MB at most.
    inside = F.broadcast(begins_inside(_end_states(lines, delimiter)).withColumn("inside", F.lit(True)))
    known = lines.join(inside, ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    pieces = written(_cut(known, delimiter), "records")
    whole = pieces.where("piece = 'whole'").select("file", "block", "n", "record")
    # Pieces are two for each split at most; each belongs to the last beginning before it.
    begun = F.count_if(F.col("piece") == "first").over(Window.partitionBy("file").orderBy("block", "n"))
    parts = pieces.where("piece <> 'whole'").withColumn("_begun", begun)
    joined = parts.groupBy("file", "_begun").agg(F.array_sort(F.collect_list(F.struct("block", "n", "record"))).alias("p"))
    crossing = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), F.array_join(F.col("p.record"), "\n").alias("record"))
    return whole.unionByName(crossing)


def read_quoted(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A delimited table with a header in each file, all columns text, read by as many tasks as it has splits.

    The same rows as Spark's own reader of records of several lines gives, which takes a task a file. Quotes
    inside quoted fields are doubled; lines end with ``\\n`` or ``\\r\\n``, and stay as they are inside quotes; empty
    lines are left out.
    """
    options = {"sep": delimiter, "escape": '"', "multiLine": "true"}
    # Spark reads the first record of one file for the names.
    names = spark.read.options(**options).option("header", True).csv(path).columns
    names = [name.rstrip("\r") for name in names]
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = records(spark, path, delimiter).where("not (block = 0 and n = 0)")
    parsed = rows.select(F.from_csv(F.regexp_replace("record", "\r$", ""), schema.toDDL(), options).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)))
