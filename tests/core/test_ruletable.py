"""Classification by a table of rules against a plain version, and its plan with very many rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldcanon.operators import ruletable
from fieldcanon.operators.standardize import standardize
from fieldcanon.registry import field_table
from fieldcanon.sources.storage import written

KEYS = "field_key string, country string, raw string"


def fold(text):
    return text.lower().replace("ς", "σ")


def fits(kind, phrase, text):
    if kind == "exact":
        return text == phrase
    if kind == "prefix":
        return text.startswith(phrase)
    if kind == "within":
        return phrase in text
    if kind == "word":
        return re.search(f"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])", text) is not None
    return re.search(phrase, text) is not None


def slow(field, country, raw, rules):
    plain, other = [], []
    for f, place, kind, phrase, label, priority, over in rules:
        if f == field and (place or "").lower() in ("", (country or "").lower()) and raw and fits(kind, phrase if kind == "pattern" else fold(phrase), fold(raw)):
            (plain if over is None else other).append((priority, label, over))
    best = min(((p, x) for p, x, _ in plain), default=None)
    over = [(p, x) for p, x, o in other if best and p < best[0] and best[1] in o]
    return min(over)[1] if over else best and best[1]


def random_rules(rng, n):
    words = ["a", "ab", "abc", "abcd", "co-op", "(x)", "s.a.", "été", "ος", "ΟΣ", "9", "x y", "ab abc", "-", "Ab"]
    rows = []
    for _ in range(n):
        kind = rng.choice(ruletable.KINDS)
        phrase = rng.choice(["^ab", "b$", "[0-9]", "(^|[^a-z0-9])x"]) if kind == "pattern" else " ".join(rng.choices(words, k=rng.randint(1, 3)))
        over = rng.sample(["L1", "L2", "L3"], 2) if rng.random() < 0.2 else None
        rows.append((rng.choice(["f", "g"]), rng.choice(["", None, "Fr", "de"]), kind, phrase, rng.choice(["L1", "L2", "L3", "L4"]), rng.randint(1, 9), over))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_slow(spark, seed):
    rng = random.Random(seed)
    rules = random_rules(rng, 40)
    parts = [p for r in rules if r[2] != "pattern" for p in (r[3], r[3].upper())] + ["zz", "1", " ", "\n", "ab", "x"]
    values = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(250)] + ["", None, "a" * 2000, "ab " * 700]
    keys = [(rng.choice(["f", "g", "h", None]), rng.choice(["", None, "FR", "DE", "us"]), v) for v in values]
    df = spark.createDataFrame(keys + keys[:50], KEYS).withColumn("label2", F.lit("kept"))
    got = ruletable.classify_by_rules(df, spark.createDataFrame(rules, ruletable.SCHEMA))
    assert got.columns == [*df.columns, "label"]
    want = sorted(((f, c, v, "kept", slow(f, c, v, rules)) for f, c, v in keys + keys[:50]), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_very_many_rules(spark):
    """A hundred thousand phrases: found by equality joins alone, and right."""
    n = 100_000
    phrase = F.concat_ws(" ", F.lit("grade"), F.col("id").cast("string"), F.lit("clerk"))
    kind = F.element_at(F.array(*map(F.lit, ("word", "exact", "prefix", "within"))), (F.col("id") % 4 + 1).cast("int"))
    rules = spark.range(n).select(
        F.lit("f").alias("field_key"), F.lit("").alias("country"), kind.alias("kind"), phrase.alias("phrase"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"),
        F.lit(1).alias("priority"), F.lit(None).cast("array<string>").alias("only_over"),
    )
    rules = written(rules.unionByName(ruletable.written_rules(spark)), "rules")  # as read from a table
    numbers = list(range(0, n, 4999))
    raws = [(k, f"Grade {k} Clerk") for k in numbers] + [(k, f"the grade {k} clerk of x") for k in numbers] + [(k, f"xgrade {k} clerk") for k in numbers]
    keys = spark.createDataFrame([("f", "", r) for _, r in raws] + [("brn_type", "fr", "SIREN")], KEYS)
    plans = []
    found = ruletable.matches(keys.withColumn("_id", F.monotonically_increasing_id()), rules)
    plans.append(found._jdf.queryExecution().toString())
    out = ruletable.classify_by_rules(keys, rules)
    plans.append(out._jdf.queryExecution().toString())
    assert not any(bad in plan for plan in plans for bad in ("NestedLoop", "CartesianProduct", "Python"))
    kinds = ("word", "exact", "prefix", "within")
    want = {r: f"L{k}" if fits(kinds[k % 4], f"grade {k} clerk", r.lower()) else None for k, r in raws} | {"SIREN": "Business Registration Number"}
    assert {r.raw: r.label for r in out.collect()} == want


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text('field_key,kind,phrase,label,priority,only_over\nbrn_type,word,tin,Tax ID Number,1,\nbrn_type,word,"tin, old",LEI,0,Tax ID Number | Other\nbrn_type,odd,x,LEI,1,\nbrn_type,word,x,No Label,1,\n')
    rules = ruletable.read_rules(spark, str(path))
    df = spark.createDataFrame([("The TIN",), ("TIN, old",), ("tins",), (None,)], "value string")
    out = standardize(df, "value", "brn_type", classifier=ruletable.by_rules(rules)).collect()
    assert sorted((r.value or "", r["Standardized Value"], r["Needs Review"]) for r in out) == [
        ("", "Other / Unclassified", "Needs Review"),
        ("TIN, old", "LEI", ""),
        ("The TIN", "Tax ID Number", ""),
        ("tins", "Other / Unclassified", "Needs Review"),
    ]
    assert sorted(r.phrase for r in ruletable.unknown_rules(rules, field_table(spark)).collect()) == ["x", "x"]


def test_no_rules_and_no_keys(spark):
    none, rules = spark.createDataFrame([], KEYS), spark.createDataFrame([], ruletable.SCHEMA)
    assert ruletable.classify_by_rules(none, ruletable.written_rules(spark)).collect() == []
    assert [r.label for r in ruletable.classify_by_rules(spark.createDataFrame([("f", "", "x")], KEYS), rules).collect()] == [None]
