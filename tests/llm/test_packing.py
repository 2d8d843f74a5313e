import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from fieldcanon.llm import packing, queries, tokens
from fieldcanon.llm.exact import normalised


def slow_best_fit(pieces, capacity):
    bins, placed = [], []
    for n, s, c in pieces:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and not b[1] & s and not b[2] & c]
        if fits:
            _, k = min(fits)
        else:
            k = len(bins)
            bins.append([capacity, 0, 0])
        placed.append((k, capacity - bins[k][0]))
        bins[k] = [bins[k][0] - n, bins[k][1] | s, bins[k][2] | c]
    return placed


def test_best_fit_against_brute_force():
    rng = random.Random(12)
    for _ in range(40):
        pieces = [(rng.randint(1, 50), 1 << rng.randrange(5), rng.choice([0, 1 << rng.randrange(4)])) for _ in range(rng.randint(0, 120))]
        assert packing.best_fit(pieces, 50) == slow_best_fit(pieces, 50)


def rows():
    rng = random.Random(13)
    out = []
    for i in range(400):
        text = " ".join(["w"] * rng.choice([0, 1, 5, 40, 99, 100, 101, 350]) + [rng.choice("ab")])
        out.append((i, rng.choice(["hot", "hot", "x", "y", None]), text))
    return out + [(500, "x", None), (501, "x", ""), (502, None, " \n"), (3, *out[3][1:]), (None, "x", "no id")]


@pytest.mark.parametrize("shard_rows", [4000, 60])
def test_packed(spark, shard_rows):
    docs = spark.createDataFrame(rows(), "doc_id bigint, source string, text string").selectExpr("*", "1 as bin", "2 as shard", "3 as length")
    got = packing.packed(docs, capacity=100, shard_rows=shard_rows).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    want = Counter()
    for i, _, t in rows():
        want[i] += len((t or "").split()) + 1
    assert lengths == want
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 100
    texts = {r.doc_id: r.t for r in docs.select("doc_id", normalised().alias("t")).collect()}
    for pieces in bins.values():
        own = [texts[p.doc_id] for p in pieces]
        assert len(own) == len(set(own))


def test_lengths_are_tokens(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    count = tokens.counter_for(path)
    texts = [None, "", "日本語テキスト" * 60, "unverständliche " * 90, "a b c", "it's 3,000\x1cx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'s' as source")
    got = packing.packed(docs, capacity=100, tokenizer=path).collect()
    lengths, bins = Counter(), Counter()
    for r in got:
        lengths[r.doc_id] += r.length
        bins[r.bin] += r.length
    assert lengths == {i: count(t) + 1 for i, t in enumerate(texts)} and max(bins.values()) <= 100
    assert lengths[2] > 100 and lengths[3] > 200  # texts that are 2 and 91 words are split

    docs.selectExpr("*", "'en' as lang", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    by_tokens = {r.doc_id: r.length for r in queries.op7_packing(spark, str(tmp_path)).collect()}
    assert by_tokens == lengths
    assert {r.doc_id: r.length for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == lengths


@pytest.mark.parametrize("kind, part, stretches, words", [(pa.string(), 1 << 22, 1 << 18, 100_000), (pa.large_string(), 200, 7, 5)])
def test_lengths_are_the_library_s(monkeypatch, kind, part, stretches, words):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    for name, value in (("PART", part), ("STRETCHES", stretches), ("WORDS", words)):
        monkeypatch.setattr(tokens, name, value)
    rng = random.Random(15)
    pool = [chr(c) for r in ((0, 0x250), (0x300, 0x460), (0x2000, 0x2070)) for c in range(*r)]
    pool += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "H\u0331", " the ", "  ", "\n", "\t\x0b", "\x1c", "\x85", "\u3000", "日本"] * 9
    texts = ["", " ", " \n\t", " a  b ", "\u3000a b\u3000", "don't we'LL 'S", "a" * 5000, "Word " * 3000, "<|endoftext|>", "<|endoftext|> a<|endoftext|>b<|startoftext|>"]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    count = tokens.ArrayCounter(path)
    assert count(pa.array(["x", *texts, "x"], kind).slice(1, len(texts))).to_pylist() == want
    assert count(pa.array([], kind)).to_pylist() == [] and count(pa.array(texts[:4], kind)).to_pylist() == [0, 0, 0, 2]


def test_lengths_take_less_time_than_counts():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(19)
    new = ["".join(rng.choices("aeinorstlé", k=rng.randint(5, 14))) for _ in range(40_000)]
    texts = [" ".join(rng.choices(new, k=400)) for _ in range(500)]
    count, one = tokens.ArrayCounter(path), tokens.counter_for.__wrapped__(path)
    t = [time.process_time()]
    got = count(pa.array(texts)).to_pylist()
    t.append(time.process_time())
    assert got == [one(x) for x in texts]
    t.append(time.process_time())
    assert t[1] - t[0] < 0.6 * (t[2] - t[1])


def test_sources_keep_to_their_share():
    docs = [(10, "hot", None)] * 50 + [(10, f"s{k}", None) for k in range(50)]
    bits = packing.conflict_bits(docs, 100)
    assert len({s for s, _ in bits[:50]}) == 5 and len({s for s, _ in bits[50:]}) == 50
    assert packing.conflict_bits([(1, None, 4), (1, None, 4), (1, None, 5)]) == [(0, 1), (0, 1), (0, 0)]


def test_a_shard_against_brute_force():
    rng = random.Random(14)
    for _ in range(20):
        docs = [(rng.choice([1, 5, 40, 60, 100, 130, 250]), rng.choice(["hot", "hot", "x", None]), rng.choice([None, 1, 2, *range(3, 40)])) for _ in range(rng.randint(1, 90))]
        table = pa.table({"shard": [3] * len(docs), "row": list(range(len(docs))), "doc_id": [f"d{k}" for k in range(len(docs))], **dict(zip(("length", "source", "cluster"), map(list, zip(*docs))))})
        got = {(r["doc_id"], r["piece"]): (r["length"], r["bin"], r["offset"]) for r in packing.pack_shard(table, 100).to_pylist()}
        order = sorted(range(len(docs)), key=lambda k: (-docs[k][0], k))
        bits = dict(zip(order, packing.conflict_bits([docs[k] for k in order], 100)))
        rest = sorted((k for k in order if docs[k][0] % 100), key=lambda k: -(docs[k][0] % 100))
        placed = slow_best_fit([(docs[k][0] % 100, *bits[k]) for k in rest], 100)
        want = {(f"d{k}", docs[k][0] // 100): (docs[k][0] % 100, (3 << 32) + b, at) for k, (b, at) in zip(rest, placed)}
        own = 1 + max((b for b, _ in placed), default=-1)
        for k in order:
            for piece in range(docs[k][0] // 100):
                want[f"d{k}", piece] = (100, (3 << 32) + own, 0)
                own += 1
        assert got == want


def test_repeated_rows_are_dealt_to_many_shards(spark):
    docs = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "'s' as source", "'a b c' as text")
    sizes = Counter(r.bin >> 32 for r in packing.packed(docs, shard_rows=500).collect())
    assert sum(sizes.values()) == 20_000 and len(sizes) == 40 and max(sizes.values()) < 700


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ids_are_passed_through(spark, kind):
    ids = ["b", "a", None] if kind == "string" else [2**53 + 1, 2**53 + 3, None]
    docs = spark.createDataFrame([(i, "s", "a b", k % 2) for k, i in enumerate(ids)], f"doc_id {kind}, source string, text string, group bigint").coalesce(1)
    assert sorted(map(str, (r.doc_id for r in packing.packed(docs).collect()))) == sorted(map(str, ids))
    bins = {r.doc_id: r.bin for r in packing.packed(docs.withColumn("source", docs.doc_id.cast("string")), cluster_col="group").collect()}
    assert bins[ids[0]] != bins[ids[2]]  # one cluster


def test_nothing_to_pack(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0
