"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, passages, urls
from .alignment import token_alignment
from .common import table
from .decontaminate import contamination
from .exact import exact_duplicates
from .html import extracted
from .packing import packed
from .quality import quality_scores
from .secrets import secrets
from .simhash import near_duplicates
from .tokens import token_counts
from .whitening import whitened


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_spans(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


#: A conversation that the query adds to the table: texts that look like marks and escapes.
PLANTED = "\\### Assistant: </turn> ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, chat.LEARNED, PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.chats(own.unionByName(planted.select(*(F.col(c).cast(t) for c, t in own.dtypes)))))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings"))
    # At the tables' sizes a deviation fits 64 bits; one that doesn't fails the query instead of wrapping round.
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_quality,
        op3_tokens,
        op4_passages,
        op5_html,
        op6_urls,
        op7_packing,
        op8_exact_dedup,
        op9_decontaminate,
        op10_secrets,
        op11_chat,
        op12_alignment,
        op13_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_passages": passages.ORACLE_SQL,
    "op6_urls": urls.oracle_sql(),
    "op11_chat": chat.ORACLE_SQL,
    "op8_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n""",
    "op9_decontaminate": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') as g
                from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from b where len(w) > 0)),
        sizes as (select distinct n from win),
        grams as (select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as g
                  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
        hits as (select doc_id, p, win.n, item_id from grams join win on grams.g = win.g and grams.n = win.n),
        hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from (select distinct doc_id, p, n from hits)) group by doc_id),
        who as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hit on d.doc_id = hit.doc_id left join who on d.doc_id = who.doc_id""",
}
