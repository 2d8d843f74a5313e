"""The pipeline against a plain version that runs each stage by brute force."""

import importlib
import random

import public_tokenizers

from pyspark.sql import functions as F

import corpus_pipeline
from fieldcanon.llm import decontaminate, quality, tokens

from .test_dedup import slow_components, slow_exact, slow_fingerprint


def corpus():
    rng = random.Random(21)
    words = [rng.choice(["the", "of", "ing", "er"]) + rng.choice(["an", "ti", "on", "ou", "es"]) + rng.choice(["", "th", "s", "re"]) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    items = [(i, say(30)) for i in range(5)]
    texts = [say(rng.randint(20, 300)) for _ in range(120)]
    texts += [rng.choice(texts) for _ in range(25)] + [t.replace(" ", "\n", 2) for t in texts[:10]]
    for t in texts[20:50]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [say(40) + " " + rng.choice(items)[1] for _ in range(12)] + [say(900) + " " + items[0][1] for _ in range(3)]
    texts += [" ".join([say(1)] * 60) for _ in range(30)] + [say(60).upper().replace(" ", "!! ") for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < len(texts) - 60), 0) for i in range(len(texts)) if i % 2]
    rng.shuffle(rows)
    return rows, labels, items


def test_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {r[0]: r[1] for r in rows}
    sizes = [len(left)]
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {i: t for i, t in left.items() if model.score([t])[0] >= quality.THRESHOLD}
    sizes.append(len(left))
    keep = {r[0] for r in slow_exact(list(left.items())) if r[3]}
    left = {i: t for i, t in left.items() if i in keep}
    sizes.append(len(left))
    prints = {i: slow_fingerprint(t) for i, t in left.items()}
    root = slow_components(prints, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    left = {i: t for i, t in left.items() if root[i] == i}
    sizes.append(len(left))
    dirty = {r[0] for r in decontaminate.brute_force(list(left.items()), items) if r[5]}
    left = {i: t for i, t in left.items() if i not in dirty}
    sizes.append(len(left))
    assert sizes == sorted(set(sizes), reverse=True)  # every stage drops some
    lengths: dict[int, int] = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    count = tokens.counter_for(public_tokenizers.path("word_bpe_49k.json"))
    assert lengths == {i: count(t) + 1 for i, t in left.items()}


ODD = [
    (None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "Another text", "en", "s", 3), (5, "a  b", "en", "s", 3), (2, None, None, None, 0), (3, "", "", "", 0),
    (None, "x y z", None, None, 5), (None, "x y z", None, None, 5), (7, "a benchmark passage", "en", "s", 1), (7, "a clean text", "en", "s", 1), (None, "a benchmark passage", "en", "s", 1),
    (2**53 + 1, "Unique words of one", "en", "s", 1), (2**53 + 3, "Other words of another", "en", "s", 1),
]


def stage(spark, tmp_path, name, rows):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if not (tmp_path / "labels.parquet").exists():
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(None, "x"), (1, None), (2, "benchmark passage")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, columns).coalesce(1)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    if name != "pack":
        assert out.columns == docs.columns
    return [tuple(r) for r in out.collect()]


def test_stages_judge_rows_and_not_ids(spark, tmp_path):
    same = lambda x: sorted(x, key=str)
    for name in dict(corpus_pipeline.STAGES):
        assert stage(spark, tmp_path, name, []) == []
    # One label, for good: whatever has words is near it or gets its share.
    assert same(stage(spark, tmp_path, "quality", ODD)) == same(ODD)
    # One row of each text, the smallest id first, then the first row; null equals empty.
    want = [ODD[1], ODD[3], ODD[5], ODD[7], ODD[9], ODD[10], ODD[12], ODD[13]]
    assert same(stage(spark, tmp_path, "exact_dedup", ODD)) == same(want)
    assert same(stage(spark, tmp_path, "near_dedup", ODD)) == same(want)
    assert same(stage(spark, tmp_path, "decontaminate", ODD)) == same(r for r in ODD if "passage" not in (r[1] or ""))
    assert same(r[0] for r in stage(spark, tmp_path, "pack", ODD)) == same(r[0] for r in ODD)


def test_stages_take_clashing_names_and_long_texts(spark, tmp_path):
    """Columns may have the names that rows get, or those of hidden columns; a long text stays whole."""
    long = ("a long text that goes on and on " * 40_000).strip()
    rows = [(1, "some words of a text", "en", "s", 1), (2, "some  words of a text", "en", "s", 1), (3, long, "en", "s", 1), (4, "other words altogether here", "en", "s", 1)]
    stage(spark, tmp_path, "quality", [])  # writes the other tables
    names = ("_metadata", "_row_file", "_row_at", "_ROW_AT_", "digest", "fp", "row", "kept", "spans", "file_path")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *(F.lit(n).alias(n) for n in names)).coalesce(1)
    docs.write.parquet(f"{tmp_path}/read.parquet")
    for own in (docs, spark.read.parquet(f"{tmp_path}/read.parquet")):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, own, str(tmp_path))
            assert out.columns == docs.columns
            left = {r.doc_id: r.text for r in out.collect()}
            assert left[3] == long and left[4] == rows[3][1]
            assert sorted(left) == ([1, 3, 4] if name in ("exact_dedup", "near_dedup") else [1, 2, 3, 4])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4}
    from fieldcanon.llm.passages import without_repeats

    left = without_repeats(docs.withColumn("_cuts", F.lit(1)))
    assert left.columns == [*docs.columns, "_cuts"] and left.count() == 4


def test_the_entry_module_has_all_queries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} <= {n.split("_")[0] + "_" for n in names}
    assert set(entry.oracle_sql()) <= names


def test_a_run_folder_is_deleted(spark):
    from fieldcanon.sources.storage import exists, run_folder, written

    with run_folder(spark) as folder:
        assert written(spark.range(3), "x").count() == 3 and exists(spark, folder)
    assert not exists(spark, folder)
