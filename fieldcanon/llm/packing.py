"""Conflict-constrained best-fit packing of documents into sequences.

Documents are dealt evenly to shards of bounded size by a hash of their row, so that no source,
cluster or repeated row meets in one task. In a shard, bins are kept in order of their residual space, each with a
bitmap of the sources and one of the duplicate clusters it holds. A document, longest first,
goes to the tightest compatible bin: the search starts at the first bin that is large enough
and steps to the next until the bitmaps don't meet.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import text_of, written
from .exact import normalised
from .tokens import library_count

#: Tokens of a bin, with one for the end of each document.
CAPACITY = 2048
#: Documents of a shard, on average.
SHARD_ROWS = 4000


def conflict_bits(docs: list[tuple[int, str | None, int | None]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Source and cluster bitmap of each document (length, source, cluster).

    No two documents with a common bit may share a bin. A cluster has one bit. A source has as
    many as its share of the tokens lets expect of its documents in a full bin, one at least,
    dealt to its documents in turn, so that a bin holds no more of them. A null source or
    cluster conflicts with nothing.
    """
    total = sum(n for n, _, _ in docs)
    tokens: Counter = Counter()
    for n, source, _ in docs:
        tokens[source] += min(n, capacity)
    rows = Counter(s for _, s, _ in docs)
    of_source: dict[str, tuple[int, int]] = {}
    first = 0
    for source in sorted(s for s in rows if s is not None):
        mean = tokens[source] / rows[source]
        slots = max(1, -(-int(capacity * tokens[source] / total) // max(1, int(mean))))
        of_source[source] = (first, slots)
        first += slots
    members = Counter(c for _, _, c in docs if c is not None)
    of_cluster = {c: k for k, c in enumerate(sorted(c for c, n in members.items() if n > 1))}
    turn: Counter = Counter()
    bits = []
    for _, source, cluster in docs:
        s = 0
        if source is not None:
            at, slots = of_source[source]
            s = 1 << (at + turn[source] % slots)
            turn[source] += 1
        bits.append((s, 1 << of_cluster[cluster] if cluster in of_cluster else 0))
    return bits


def best_fit(pieces: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Bin and offset of each piece (length, source bits, cluster bits), taken in the given order.

    Of the compatible bins with room the tightest is taken, of equal ones the oldest.
    """
    bins: list[tuple[int, int]] = []  # residual, bin: in order
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for n, source, cluster in pieces:
        at = bisect_left(bins, (n, -1))
        while at < len(bins) and (sources[bins[at][1]] & source or clusters[bins[at][1]] & cluster):
            at += 1
        if at < len(bins):
            residual, k = bins.pop(at)
        else:
            residual, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((k, capacity - residual))
        sources[k] |= source
        clusters[k] |= cluster
        if residual > n:
            insort(bins, (residual - n, k))
    return placed


def pack_shard(docs: pa.Table, capacity: int) -> pa.Table:
    """Pack one shard; columns ``shard, row, doc_id, source, cluster, length``."""
    docs = docs.sort_by([("length", "descending"), ("row", "ascending")])
    rows = list(zip(*(docs[c].to_pylist() for c in ("length", "source", "cluster"))))
    whole, rest = [], []  # full bins of long documents; what is left to pack
    for at, ((n, _, _), bits) in enumerate(zip(rows, conflict_bits(rows, capacity))):
        full, tail = divmod(n, capacity)
        whole += [(at, k, capacity) for k in range(full)]
        if tail:
            rest.append((at, full, tail, *bits))
    rest.sort(key=lambda r: -r[2])
    placed = best_fit([r[2:] for r in rest], capacity)
    used = 1 + max((k for k, _ in placed), default=-1)
    out = [(d, p, n, k, at) for (d, p, n, _, _), (k, at) in zip(rest, placed)]
    out += [(d, p, n, used + i, 0) for i, (d, p, n) in enumerate(whole)]
    at, piece, length, bins, offset = (list(x) for x in zip(*out))
    base = docs["shard"][0].as_py() << 32
    numbers = ([*piece], [*length], [base + k for k in bins], [*offset])
    # The ids are taken over as they are, whatever their type.
    return pa.table([docs["doc_id"].take(pa.array(at)), *(pa.array(x, pa.int64()) for x in numbers)], names=["doc_id", "piece", "length", "bin", "offset"])


def word_length(text_col: str = "text") -> Column:
    """Words between ASCII white space, and one for the document's end."""
    text = F.trim(normalised(text_col))
    return F.when(text == "", 1).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 2).cast("bigint")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, tokenizer: str | None = None, cluster_col: str | None = None) -> DataFrame:
    """Return ``doc_id, piece, length, bin, offset``: where each piece of each document goes.

    Lengths are tokens of the file at ``tokenizer``, which every worker can read, and one for the
    document's end. Without a file, words between ASCII white space stand for tokens. Documents of
    more than ``capacity`` tokens, however long, fill bins of their own, and the rest of them is
    packed like any other; nothing is cut off. Of equally long ones the first read comes first. A
    duplicate cluster is a value of ``cluster_col``, such as the component of near duplicates, or
    else a normalised text; a null cluster or source conflicts with nothing.

    Null and empty texts take one token. Rows that repeat a doc_id or the whole row are packed each,
    and ids of any type, null too, are passed through. Rows are dealt to shards by a number of their
    own, so repeated rows don't meet in one. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    cluster = F.xxhash64(normalised(text_col)) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col))
    length = word_length(text_col) if tokenizer is None else library_count(tokenizer, text_of(text_col)) + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), length.alias("length"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "lengths")
    shards = max(1, round(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    schema = StructType([rows.schema["doc_id"]])
    for name in ("piece", "length", "bin", "offset"):
        schema = schema.add(name, LongType())
    return dealt.groupBy("shard").applyInArrow(lambda part: pack_shard(part, capacity), schema)
