"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is cut into a ring of eight segments of eight bits. If two fingerprints differ
in at most two bits, then some segment starts a chain in which the differences of the first ``l``
segments never exceed their proportional budget ``2 l / 8``: none in the first three segments, at
most one in the first four to seven. Candidates come from such chains alone. The fourth segment of a
chain either has no difference, and then four consecutive segments agree; or it has the one that is
allowed, and then the fifth to seventh agree like the first three. So there are two keys for a start:
four consecutive segments, or three and the three behind the next one. Fingerprints that share a key
are tested for the whole chain from the key's start, and only then compared in full.

A key shared by more than ``BLOCK`` different fingerprints would give too many candidates. Its
fingerprints go another exact way: two of them differ in at most two bits exactly if flipping at
most one bit of each gives the same value, so all fingerprints are dealt by their 65 such
values, and those that meet (65 at most) are linked in a star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import first_of, text_of, written
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Most different fingerprints of a key that are compared pair by pair.
BLOCK = 64
SEGMENTS = 8
#: Start and segments of each key. Three and three segments are the same from either start.
KEYS = [(s, [(s + k) % SEGMENTS for k in range(4)]) for s in range(SEGMENTS)] + [(s, [(s + k) % SEGMENTS for k in (0, 1, 2, 4, 5, 6)]) for s in range(SEGMENTS // 2)]

_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text; zero for a text without words."""
    import xxhash

    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    if len(gaps) < SHINGLE:
        return xxhash.xxh64_intdigest(data, SEED)
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(data)]
    digest = xxhash.xxh64_intdigest
    n = len(starts) - SHINGLE + 1
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), np.uint64, n)
    # Eight one-byte counters ride in each word, so rows of 255 can't overflow.
    rows = np.zeros(-(-n // 255) * 255, np.uint64)
    rows[:n] = hashes
    rows = rows.reshape(-1, 255)
    counts = np.empty((8, 8), np.int64)
    for s in range(8):
        lanes = ((rows >> np.uint64(s)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[:, s] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch)).view(np.int64))


def _key(n: int, segments: list[int]) -> Column:
    """The key's number above its segments of ``fp``."""
    key = F.lit(n).cast("bigint")
    for i in segments:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF)))
    return F.struct(F.lit(8 * KEYS[n][0]).alias("start"), key.alias("key"))


def chained(x: Column, start: Column) -> Column:
    """Whether the difference ``x`` keeps to the budgets of the chain from the bit ``start`` on, up
    to its seventh segment; the eighth is the full Hamming test."""
    turned = F.call_function("shiftrightunsigned", x, start).bitwiseOR(F.call_function("shiftleft", x, F.lit(64) - start))
    return (turned.bitwiseAND(F.lit(0xFFFFFF)) == 0) & (F.bit_count(turned.bitwiseAND(F.lit(0x00FFFFFFFFFFFFFF))) <= 1)


def keyed(prints: DataFrame) -> DataFrame:
    """``fp, start, key`` of every key of the distinct fingerprints ``fp``."""
    return prints.select("fp", F.inline(F.array(*(_key(n, segments) for n, (_, segments) in enumerate(KEYS)))))


def candidates(keys: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of fingerprints that share a key and the chain that starts there."""
    x, y = keys.alias("x"), keys.alias("y")
    difference = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & chained(difference, F.col("x.start")))
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints ``fp`` within ``DISTANCE`` bits.
    Inside a crowded key they are stars and not all pairs."""
    keys = keyed(prints)
    # Written, so that the join has a plain shuffle on either side and a crowded key can be split.
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = written(keys.join(shared, "key"), "keys")
    pairs = candidates(met.where(F.col("n") <= block)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    many = met.where(F.col("n") > block).select("fp").distinct()
    flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    stars = (
        many.select("fp", F.explode(F.concat(F.array("fp"), flipped)).alias("value"))
        .groupBy("value")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    )
    return pairs.unionByName(stars.where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keys: tuple[str, ...] = ()) -> DataFrame:
    """Return ``doc_id, fingerprint, component_id, kept`` for every row of ``docs``, after the
    columns ``keys``.

    Null and empty texts have fingerprint zero and link like any other; texts may be of any
    length. ``component_id`` is the smallest doc_id that can be reached, null if no row there has
    one. Exactly one row of a component is ``kept``: the one with that id, of those that repeat it
    the first one read. An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    rows = docs.select(*keys, F.col(id_col).alias("doc_id"), _fingerprints(text_of(text_col)).alias("fp"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min(first_of()).alias("first")), "prints")
    labels = connected_components(near_links(prints.select("fp"), block))
    members = labels.select(F.col("node").alias("fp"), "component").unionByName(labels.select(F.col("component").alias("fp"), "component").distinct())
    members = written(prints.join(members, "fp"), "members")
    best = written(members.groupBy("component").agg(F.min("first").alias("best")), "best")
    found = members.join(best, "component").select("fp", "best")
    of_print = written(prints.join(found, "fp", "left").select("fp", F.coalesce("best", "first").alias("first")), "components")
    return rows.join(of_print, "fp").select(
        *keys,
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
