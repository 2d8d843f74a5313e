"""SimHash near-duplicates, exact duplicates and components against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldcanon.llm import exact, simhash
from fieldcanon.llm.components import connected_components

from .helpers import docs_of, found


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, linked):
    nodes = sorted(nodes)
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {x: top(x) for x in nodes}


def near_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgéßñ", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", " \t\n", "one", "One two", "one TWO\x0bthree", "\x00 \x1c x y z", "É é ſ K"]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(3, 400))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", " \t "]).join(copy))
    texts += ["long word " * 30000, "x" * 200000]
    return list(enumerate(texts)) + [(0, None), (9, texts[9])]


@pytest.mark.parametrize("block", [64, 1])
def test_near_duplicates(spark, block):
    rows = near_texts()
    out = simhash.near_duplicates(docs_of(spark, rows, extra=True), block=block).collect()
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in out}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(prints, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert got == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len({c for c in want.values()}) < len(want)
    assert len(out) == len(rows) and sorted(r.doc_id for r in out if r.kept) == sorted({c for c in want.values()})


@pytest.mark.parametrize("block", [64, 1])
def test_links_of_close_fingerprints(spark, block):
    """Crowds of fingerprints a few bits apart, in any segment of the ring."""
    rng = random.Random(5)
    prints = {0, 2**63, 2**64 - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                x ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    prints = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), block)
    got = {p: p for p in prints} | {r.node: r.component for r in connected_components(links).collect()}
    assert got == slow_components(prints, lambda a, b: bits(a ^ b) <= 2)


def bits(x):
    return bin(x & (2**64 - 1)).count("1")


def test_every_close_pair_is_a_candidate_and_chains_prune_others(spark):
    """All differences of one and two bits, and pairs that share a key but differ in more bits."""
    rng = random.Random(15)
    pairs, signed = set(), lambda x: x - 2**64 if x >= 2**63 else x
    for i in range(64):
        for j in range(i, 64):
            x = rng.getrandbits(64)
            pairs.add((signed(x), signed(x ^ (1 << i | 1 << j))))
    loose = set()
    for _ in range(2000):  # equal in four consecutive segments, random beyond them
        x, turn = rng.getrandbits(64), 8 * rng.randrange(8)
        y = (rng.getrandbits(32) << 32 << turn | rng.getrandbits(32) << 32 >> (64 - turn)) & (2**64 - 1)
        loose.add((signed(x), signed(x ^ y)))
    rows = [(n, f) for n, pair in enumerate(sorted(pairs | loose)) for f in pair]
    # Only the two fingerprints of a pair are to meet.
    frame = spark.createDataFrame(rows, "n bigint, fp bigint")
    keys = simhash.keyed(frame.select("fp").distinct()).join(frame, "fp").withColumn("key", F.struct("n", "key"))
    met = keys.alias("x").join(keys.alias("y"), "key").where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    found = {tuple(r) for r in simhash.candidates(keys).distinct().collect()}
    close = {tuple(sorted(p)) for p in pairs | loose if 0 < bits(p[0] ^ p[1]) <= 2}
    assert close <= found
    n, shared = len(found), {tuple(r) for r in met.collect()}
    assert found <= shared and len(shared) > 3500
    # The chains remove nearly all that share a key only, before any full comparison.
    assert n - len(close) < 0.02 * (len(shared) - len(close))


def test_a_hub_of_many_edges(spark):
    edges = spark.range(1, 200_001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    found = connected_components(edges.unionByName(edges.limit(1).select(F.lit(200_000).cast("bigint").alias("a"), F.lit(-5).cast("bigint").alias("b"))))
    assert found.where("component = -5").count() == found.count() == 200_001


def test_near_duplicates_of_nothing(spark):
    out = simhash.near_duplicates(docs_of(spark, []))
    assert out.columns == ["doc_id", "fingerprint", "component_id", "kept"] and out.count() == 0


def test_near_duplicates_null_id(spark):
    got = found(simhash.near_duplicates(docs_of(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q"), (None, "q")]).coalesce(1)))
    assert [(r[0], r[2], r[3]) for r in got] == [(4, 4, False), (4, 4, True), (None, 4, False), (None, None, False), (None, None, True)]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ids_of_any_type(spark, kind):
    ids = ["b", "a", None] if kind == "string" else [2**53 + 1, 2**53 + 3, None]
    docs = spark.createDataFrame([(i, "one two three four") for i in ids], f"doc_id {kind}, text string")
    least = min(i for i in ids if i is not None)
    assert {(r.doc_id, r.component_id, r.kept) for r in simhash.near_duplicates(docs).collect()} == {(i, least, i == least) for i in ids}
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact.exact_duplicates(docs).collect()} == {(i, least, i == least) for i in ids}


def test_components_of_a_long_path(spark):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {i: 0 for i in range(1, n)} | {1001: 1000}


def slow_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for n, ((i, _), t) in enumerate(zip(rows, norm)):
        group = [(j is None, j or 0, m) for m, ((j, _), u) in enumerate(zip(rows, norm)) if u == t]
        none, keep, first = min(group)
        out.append((i, None if none else keep, len(group), n == first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_duplicates(spark, counters):
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\tb", " a b ", "a b", "x" * 100000, "é"]
    rng = random.Random(2)
    rows = [(i, rng.choice(texts + ["a b"] * 9)) for i in range(200)] + [(5, "a b"), (5, "a b"), (None, "é"), (None, "null only"), (None, "null only")]
    assert found(exact.exact_duplicates(docs_of(spark, rows, extra=True).repartition(5), counters=counters)) == slow_exact(rows)


def test_exact_duplicates_of_nothing(spark):
    assert exact.exact_duplicates(docs_of(spark, [])).count() == 0


def test_misra_gries_keeps_what_is_frequent(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary").alias("digest"))
    assert [bytes(r.digest) for r in exact.frequent(rows.repartition(6), 5).collect()] == [b"hot"]
