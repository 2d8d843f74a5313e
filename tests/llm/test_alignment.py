"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldcanon.llm import alignment, queries

from .helpers import docs_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.Aligner(A, B)


def slow(rows, library):
    a, b, tables = library
    done = {}
    for text in {t for _, t in rows if t}:
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left, right = [tables.bytes_a[i] for i in x], [tables.bytes_b[i] for i in y]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            continue
        ends_x, ends_y = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
        links, i, j = [], 0, 0
        while i < len(x):
            links.append((x[i], y[j]))
            end = min(ends_x[i], ends_y[j])
            i, j = i + (ends_x[i] == end), j + (ends_y[j] == end)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_x) & set(ends_y)):
            p, q = ends_x.index(end, i) + 1, ends_y.index(end, j) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        done[text] = (len(x), len(y), groups, links)
    count, best = Counter(), defaultdict(int)
    for _, text in rows:
        if text in done:
            count.update(set(done[text][3]))
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, text in rows:
        n_a, n_b, groups, links = done.get(text, (0, 0, [], []))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), digest))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(5)
    letters = ["a", "b", "é", "ß", "中", "ﬁ", "Å", "Å", "１", " ", "  ", "\n", "\t", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'", "▁", "👩‍👧", "<s>", "<0x41>", "<|endoftext|>", "<unk>", ".", "12", "र्", "́", "﻿"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(1500)]
    words = ["the", "then", "Überraschung", "don't", "été", "xyzzy", "12345", "\nnew", "end.\n", "a", "…"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)]
    return texts + ["", None, " ", "  ", "x ", " x", "\n", "long " * 20000, "x" * 50000, " " * 3000]


@pytest.mark.parametrize("top", [alignment.TOP_PAIRS, 40, 0])
def test_against_slow(spark, library, top):
    texts = odd_texts()[:: 1 if top == 40 else 7]
    rows = list(enumerate(texts)) + [(None, "the end"), (3, "the end"), (4, "the end")] + [(10_000 + i, "hot text") for i in range(900)]
    df = docs_of(spark, rows, extra=True)
    for c in ("pair", "count", "best", "copies", "digest", "pairs", "times", "n_a"):
        df = df.withColumn(c, F.lit("clash"))
    got = alignment.token_alignment(df.repartition(6), A, B, top=top)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows, library)


def test_words_are_what_the_library_gives(library):
    """Cutting a text changes no token, and the cache can be emptied at any time."""
    a, b, _ = library
    own = alignment.Aligner(A, B)
    assert own.cuts
    for text in filter(None, odd_texts()[:1700]):
        words = own.words(text)
        assert "".join(" " + w for w in words) == " " + text
        assert [i for w in words for i in a.encode(" " + w, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:  # B reads it as a space; such texts are asked whole
            assert [i for ids in own._encode_b(words) for i in ids] == b.encode(text)


def test_forgetting(library, monkeypatch):
    texts = [t for t in odd_texts()[:400] if t]
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "CACHE", 3)
    own = alignment.Aligner(A, B)
    parts = [own.align(texts[i : i + 5]) for i in range(0, len(texts), 5)]
    assert sum((p["groups"] for p in parts), []) == whole["groups"]
    assert sum((p["pairs"].to_pylist() for p in parts), []) == whole["pairs"].to_pylist()


def test_without_cuts(library, monkeypatch):
    monkeypatch.setattr(alignment.Aligner, "_can_cut", lambda self, path: False)
    texts = [t for t in odd_texts()[:200] if t]
    one, two = alignment.Aligner(A, B), library[2]
    got, want = one.align(texts), two.align(texts)
    assert got["groups"] == want["groups"] and got["times"].to_pylist() == want["times"].to_pylist()


def test_empty_table(spark):
    got = alignment.token_alignment(docs_of(spark, []), A, B)
    assert got.columns == COLUMNS and got.collect() == []


def test_query_on_table(spark, library):
    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_alignment"](spark, data)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == slow(rows, library)
    assert re.fullmatch("[0-9a-f]{64}", got.first().groups_sha256)
