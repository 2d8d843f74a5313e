"""From raw documents to packed sequences: quality, exact and near duplicates, contamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcanon.llm.common import table, with_rows, written
from fieldcanon.llm.decontaminate import contamination
from fieldcanon.llm.exact import exact_duplicates
from fieldcanon.llm.packing import packed
from fieldcanon.llm.quality import good_documents
from fieldcanon.llm.simhash import near_duplicates

# Stages judge rows, not ids: each row is named by its file and place there. So rows without a
# doc_id and rows that repeat one, with the same text or another, are judged like any other.
#
# All stages take texts of any length and read them whole, keep all columns of their documents whatever
# these are called (but ``doc_id`` and ``text``, no column is looked at), and give an empty table for an
# empty one; what else they do with odd rows is said at each.


def _without(rows: DataFrame, row: tuple[str, str], dropped: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without those named in ``dropped``, which are written first: Spark then knows
    their size and broadcasts them only below its threshold."""
    kept = rows.join(written(dropped.select(*row), "dropped"), list(row), "left_anti")
    return kept.select([F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts.

    Every row is judged by its text, repeated rows alike. Null and empty texts, which say nothing, get the
    share of good ones among the labelled documents as their score; without labels all scores are 0.5.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the smallest doc_id, of those that repeat it
    the first row; a row without a doc_id only where no other is. Null equals empty. Of repeated rows one
    stays."""
    rows, row = with_rows(docs)
    return _without(rows, row, exact_duplicates(rows, keys=row).where("not kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, chosen like that of equal texts, ties too. Null and
    empty texts are near duplicates of each other, and repeated rows of themselves."""
    rows, row = with_rows(docs)
    return _without(rows, row, near_duplicates(rows, keys=row).where("not kept"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the contamination rule names, repeated rows alike. Null and empty texts, and all
    where the benchmark has no words, stay."""
    rows, row = with_rows(docs)
    return _without(rows, row, contamination(rows, table(spark, sf_dir, "benchmark"), keys=row).where("contaminated"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left, by its tokens: every row, also a repeated one or one without text or doc_id. A text
    that is longer than a sequence gets its own sequences."""
    import public_tokenizers

    return packed(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Stages 1 and 3 have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Inside ``run_folder`` what is written between them is deleted at
    the end."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
