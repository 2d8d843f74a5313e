"""Removal of repeated passages by hashing units of text: sentences, lines or paragraphs.

Every document is cut into units, lines and within them sentences by default: a passage that
someone has set inside a line would never be found by whole lines. Units are normalised and
hashed, digests are grouped over the whole corpus, and the earliest occurrence of each, by
document and place, is kept. Later occurrences are removed where a run of consecutive ones has
``MIN_WORDS`` words, so that short sentences that turn up everywhere are left alone. Spans refer
to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from .common import free_names, text_of, with_rows, written

MIN_WORDS = 50

#: Where a unit ends: behind the match. A sentence also ends before a capitalised word, as a passage
#: may begin in the middle of another sentence.
CUTS = {
    "sentence": re.compile(r"[.!?。！？]+|\n|[ \t](?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n\n+"),
}
SPACES = " \t\n\x0b\x0c\r"


def units_of(text: str, kind: str = "sentence") -> Iterator[tuple[int, int, int, int, bytes]]:
    """``unit, start, end, words, digest`` of each unit that has words, numbered from 0.

    Words are what ASCII white space separates, A-Z in lower case; the digest is the XXH3 of 128
    bits of the words with single spaces.
    """
    import xxhash

    at, k = 0, 0
    for end in [*(m.end() for m in CUTS[kind].finditer(text)), len(text)]:
        piece, start, at = text[at:end], at, end
        words = piece.encode("utf-8", "surrogatepass").lower().split()
        if words:
            start += len(piece) - len(piece.lstrip(SPACES))
            yield k, start, start + len(piece.strip(SPACES)), len(words), xxhash.xxh3_128_digest(b" ".join(words))
            k += 1


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "sentence", min_words: int = MIN_WORDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Return the spans to remove: ``doc_id, start, end, n_units, n_words, first_doc_id``, after the
    columns ``keys``.

    Offsets are code points of the original text, end exclusive; ``first_doc_id`` is the document
    that keeps the span's first unit. Units rank by doc_id, of rows that repeat one in the order
    read, then by place. Rows without a doc_id come last: they keep what no other row has. Null and
    empty texts have no units; texts may be of any length; documents without repeats have no row. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType
    schema = StructType().add("row", LongType()).add("doc_id", id_type).add("unit", IntegerType()).add("start", LongType()).add("end", LongType()).add("words", IntegerType()).add("digest", BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *u) for k, text in enumerate(batch.column("text").to_pylist()) for u in units_of(text, kind)]
            at, unit, start, end, words, digest = zip(*found) if found else [()] * 6
            at = pa.array(at, pa.int64())
            numbers = (pa.array(unit, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(words, pa.int32()), pa.array(digest, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), *numbers], names=schema.names)

    rows = docs.select(*keys, F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    if keys:  # the rows' numbers must be those of the units
        rows = written(rows, "rows")
    units = written(rows.select("row", "doc_id", "text").mapInArrow(cut, schema), "units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "unit")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join below has a plain shuffle on either side and a line that is
    # everywhere can be split among tasks.
    first = written(first, "first")
    later = units.join(first, "digest").where((F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit")))
    later = later.select("doc_id", "row", "unit", "start", "end", "words", F.col("first.doc_id").alias("first_doc_id"))
    run = F.col("unit") - F.row_number().over(Window.partitionBy("row").orderBy("unit"))
    spans = (
        later.withColumn("run", run)
        .groupBy("row", "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"),
            F.min_by("first_doc_id", "unit").alias("first_doc_id"),
        )
        .where(F.col("n_words") >= min_words)
    )
    found = ["doc_id", "start", "end", "n_units", "n_words", "first_doc_id"]
    return spans.join(rows.select("row", *keys), "row").select(*keys, *found) if keys else spans.select(found)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of the text column, all other columns as they are.

    Spans belong to rows, not to ids, so rows without a doc_id or with one that others have lose
    their own spans only.
    """
    rows, row = with_rows(docs)
    (name,) = free_names(rows.columns, "_cuts")
    spans = repeated_spans(rows, id_col, text_col, kind, min_words, keys=row)
    cuts = spans.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, spans_ in zip(texts, places):
            at, parts = 0, []
            for s in spans_:
                parts.append(text[at : s["start"]])
                at = s["end"] + (text[s["end"] : s["end"] + 1] in tuple(SPACES))  # and one space behind it
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    joined = rows.join(cuts, list(row), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole, some = joined.where(F.col(name).isNull()).select(own), joined.where(F.col(name).isNotNull())
    return whole.unionByName(some.withColumn(text_col, cut(text_col, name)).select(own))


#: DuckDB SQL of the registered query: cuts are marked with a character of their own.
ORACLE_SQL = rf"""
    with m as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？]+)', '\1' || chr(1), 'g'), '(\n)', '\1' || chr(1), 'g'),
                                             '([ \t])([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])', '\1' || chr(1) || '\2', 'g') as t from documents),
    l as (select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as piece from (select doc_id, string_split(t, chr(1)) as ls from m)),
    p as (select *, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from l),
    w as (select *, pos + length(piece) - length(regexp_replace(piece, '^[\x20\x09-\x0D]+', '')) as s, regexp_replace(piece, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as q from p),
    v as (select *, regexp_extract_all(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from w),
    u as (select doc_id, s, s + length(q) as e, len(ws) as words, array_to_string(ws, ' ') as g, row_number() over (partition by doc_id order by i) as k from v where len(ws) > 0),
    f as (select *, first_value(doc_id) over (partition by g order by doc_id, k) as fd, row_number() over (partition by g order by doc_id, k) as r from u),
    r as (select *, k - row_number() over (partition by doc_id order by k) as run from f where r > 1)
    select doc_id, cast(min(s) as bigint) as start, cast(max(e) as bigint) as "end", count(*) as n_units, cast(sum(words) as bigint) as n_words, arg_min(fd, k) as first_doc_id
    from r group by doc_id, run having sum(words) >= {MIN_WORDS}"""
