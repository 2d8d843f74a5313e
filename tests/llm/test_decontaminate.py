import random

import numpy as np
import pytest

from fieldcanon.llm import decontaminate as dc

from .helpers import docs_of, found

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["É", "a", "b", "Zü"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(n)) for i, n in enumerate((13, 14, 20, 40, 12, 5, 30))] + [(100, None), (101, "..."), (20, ""), (7, "a " * 15), (8, "unseen words of an item that no document has at all in any place of it")]
    docs = [(0, None), (1, ""), (2, " .,;"), (3, "a " * 400), (4, "other " * 300)]
    for i in range(5, 60):
        parts = [say(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(items)[1] or ""
            parts += [rng.choice([text, text.upper().replace("É", "É"), text.replace(" ", ", ")]), "other", say(rng.randint(0, 60))]
        docs.append((i, " ".join(parts)))
    return docs + [docs[7]], items


def frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("shard", [1_000_000, 50])
def test_against_brute_force(spark, shard):
    docs, items = corpus()
    got = found(dc.contamination(docs_of(spark, docs, extra=True), frame(spark, items), shard_words=shard).select(COLUMNS))
    want = sorted(dc.brute_force(docs, items), key=str)
    assert got == want and any(r[5] for r in want) and not all(r[5] for r in want)


def test_blocks_of_items(spark):
    docs, items = corpus()
    docs = list(dict(docs).items())
    got = found(dc.contamination(docs_of(spark, docs), frame(spark, items), item_bytes=1500).select(COLUMNS))
    assert got == sorted(dc.brute_force(docs, items), key=str)


def test_blocks_judge_every_row(spark):
    docs, items = corpus()  # with a repeated row
    docs += [(None, docs[20][1]), (None, docs[21][1]), (None, None), (9, docs[22][1]), (9, "clean")]
    got = found(dc.contamination(docs_of(spark, docs), frame(spark, items), item_bytes=1500).select(COLUMNS))
    assert got == sorted(dc.brute_force(docs, items), key=str)


def test_blocks_are_bounded_whatever_the_ids(spark):
    """Many items of one id, and one that is longer than a block, still make blocks of a size, none empty."""
    rng = random.Random(4)
    docs, _ = corpus()
    words = [w.decode() for _, t in docs for w in dc.words_of(t)]
    at = [rng.randrange(len(words) - 40) for _ in range(400)]
    items = [(7, " ".join(words[a : a + rng.randint(1, 40)])) for a in at] + [(8, " ".join(words[:2500])), (None, "x"), (9, ""), (9, None)]
    most = 4000
    parts = dc.blocks(frame(spark, items), "item_id", "text", most)
    sizes = [sum(len(r.text.encode()) + dc.ITEM_COST for r in part.collect()) for part in parts]
    assert len(parts) > 5 and 0 < min(sizes) and max(sizes) <= most
    columns = ["doc_id", "n_words", "spans", "items"]
    whole = found(dc.contamination_spans(docs_of(spark, docs), frame(spark, items)).select(columns))
    got = found(dc.contamination_spans(docs_of(spark, docs), frame(spark, items), item_bytes=4 * most).select(columns))
    assert got == whole and len(dc.blocks(frame(spark, items), "item_id", "text", 4 * most)) > 1


@pytest.mark.parametrize("block", [16_000_000, 150])
def test_rows_keep_their_ids(spark, block):
    rows = [(2**53 + 1, "a b"), (2**53 + 3, "q r s"), (None, "a b"), (1, "a b"), (1, "q r s"), (1, "q r s"), (2, "z")]
    items = [(1, "a b"), (2, "q r s"), (3, "y y y y y"), (4, "x x x x x x x")]
    for kind, named in (("bigint", lambda i: i), ("string", lambda i: i and f"id {i}")):
        docs = spark.createDataFrame([(named(i), t) for i, t in rows], f"doc_id {kind}, text string").coalesce(1)
        got = found(dc.contamination(docs, frame(spark, items), item_bytes=block).select("doc_id", "n_words", "n_hit"))
        assert got == sorted(((named(i), len(t.split()), 0 if t == "z" else len(t.split())) for i, t in rows), key=str)


def test_a_text_longer_than_a_shard(spark):
    docs, items = corpus()
    words = dc.words_of(" ".join(t or "" for _, t in docs))
    long = [(1, b" ".join(words).decode()), (2, "a b c")]
    got = found(dc.contamination(docs_of(spark, long), frame(spark, items), shard_words=100))
    whole = found(dc.contamination(docs_of(spark, long), frame(spark, items)))
    assert got == whole and got[0][2] > 500


def test_items_with_text_ids(spark):
    items = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("a", "y z"), ("c", "n o n e")], "item_id string, text string")
    (row,) = dc.contamination_spans(docs_of(spark, [(1, "w x y z")]), items).collect()
    assert (row.spans, row["items"]) == ([[1, 4]], ["a", "b"])


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_shards_with_and_without_hits(spark, kind):
    rows = [(i, "x y" if i % 5 == 4 else "no hit") for i in range(40)]
    items = spark.createDataFrame([("7" if kind == "string" else 7, "x y")], f"item_id {kind}, text string")
    out = dc.contamination_spans(docs_of(spark, rows).coalesce(1), items, shard_words=4)
    assert out.schema["items"].dataType.elementType.simpleString() == kind
    assert {r.doc_id for r in out.collect() if r["items"] == [items.first().item_id]} == {i for i, t in rows if t == "x y"}


def test_windows_take_little_memory():
    rng = random.Random(3)
    windows = dc.Windows([" ".join(f"w{rng.randrange(5000)}" for _ in range(40_000)) for _ in range(4)] + ["w1 w2", "w1 w2"])
    arrays = sum(x.nbytes for x in vars(windows).values() if hasattr(x, "nbytes"))
    assert arrays < 40 * 160_000 and len(windows.lengths) > 159_000
    assert windows.owners(np.array([k for k in range(len(windows.lengths)) if windows.lengths[k] == 2])) == [4, 5]


def test_empty_tables(spark):
    assert dc.contamination(docs_of(spark, []), frame(spark, [(1, "a b")])).count() == 0
    (row,) = dc.contamination(docs_of(spark, [(1, "a b")]), frame(spark, [])).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_suffix_order_is_complete():
    import numpy as np

    line = np.array([3, 1, 3, 1, 3, 1, 0, 3, 1, 3, 1, 0, 1, 1, 1, 1, 0])
    ends = {p: k for k, p in enumerate(np.flatnonzero(line == 0))}
    key = lambda i: [(0, ends[j]) if line[j] == 0 else (1, line[j]) for j in range(i, len(line))]
    assert dc.suffix_order(line).tolist() == sorted(range(len(line)), key=key)
