"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be frequent. Their exact
counts and first documents are then computed over all rows and broadcast: ``COUNTERS`` rows at
most, whatever the input. Rows of these digests are settled map-side and never shuffled; all
other digests are spread evenly enough for an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_of, text_of, written

#: Counters of a Misra-Gries summary, and most digests that are broadcast.
COUNTERS = 1024

_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text_col: str = "text"):
    """The text with each run of ASCII white space as one space; null is empty.

    A lone space already is what it should be and isn't matched, which saves most of the work.
    """
    return F.regexp_replace(text_of(text_col), _SPACES, " ")


def summarise(counts: dict, more: pd.Series, k: int) -> dict:
    """Add ``more`` (digest to count) to a Misra-Gries summary of ``k`` counters."""
    for digest, n in more.items():
        counts[digest] = counts.get(digest, 0) + int(n)
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = {d: n - cut for d, n in counts.items() if n > cut}
    return counts


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` candidate values of column ``digest``, the most frequent by Misra-Gries."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for batch in batches:
            counts = summarise(counts, batch["digest"].map(bytes).value_counts(), k)
        kept = {d: n for d, n in counts.items() if n > 1}
        yield pd.DataFrame({"digest": list(kept), "n": list(kept.values())})

    parts = digests.select("digest").mapInPandas(count, "digest binary, n bigint")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Return ``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``, after
    the columns ``keys``.

    Texts are equal when identical after ``normalised``; null equals empty, and texts may be of
    any length. Of each group exactly one row is kept: the one with the smallest doc_id, of those
    that repeat it the first one read. A row without a doc_id is kept only in a group that has no
    other; ``keep_id`` is then null. Every row counts in ``group_size``. Empty tables give empty
    results; other columns are ignored, whatever their names.
    """
    digest = F.unhex(F.sha2(normalised(text_col), 256))
    rows = written(docs.select(*keys, F.col(id_col).alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    hot = F.broadcast(frequent(rows, counters))
    least, size = F.min(first_of()), F.count("*")
    winners = rows.join(hot, "digest").groupBy("digest").agg(least.alias("first"), size.alias("group_size"))
    winners = F.broadcast(written(winners, "winners"))
    settled = rows.join(winners, "digest").select(*keys, "digest", "doc_id", "row", "first", "group_size")
    # No digest is left that has more than a small share of the rows; the window spills.
    own = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select(*keys, "digest", "doc_id", "row", least.over(own).alias("first"), size.over(own).alias("group_size"))
    return settled.unionByName(rest).select(
        *keys,
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
