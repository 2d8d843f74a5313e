"""Classification by a table of rules: phrases are found by equality joins, however many there are.

A rule is a row ``field_key, country, kind, phrase, label, priority, only_over``; the one with the
smallest priority wins. Kinds, on the lower-cased value: ``exact``; ``prefix``; ``word`` (a phrase
that no letter a-z or digit touches); ``within`` (anywhere); ``pattern`` (a regular expression). A rule
without a country holds everywhere; names of countries are compared in lower case.

Phrases are indexed by their head, as many of their first letters as the largest power of two allows.
A value is cut into what could be such heads: all of it, its beginnings, the letters from each start of
a word, or from each letter; only lengths and kinds that the field's rules have. Heads are joined by
equality, and the whole phrase is compared behind that. Only patterns are tried on values one by one,
and only where no better rule has been found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import BOARD_COUNTRIES, BOARD_TITLES, POSITIONS
from ..registry import CATCH_ALL
from ..sources.storage import written
from ..sources.tables import read_table
from .rules import EXECUTIVE, REGIONAL, RULES

SCHEMA = "field_key string, country string, kind string, phrase string, label string, priority int, only_over array<string>"
COLUMNS = ["field_key", "country", "kind", "phrase", "label", "priority", "only_over"]
KINDS = ("exact", "prefix", "word", "within", "pattern")
#: Positions by keyword come behind the titles of the countries.
POSITION = "positions_designations"


def folded(text: Column) -> Column:
    """In lower case, with a final sigma as any other: engines differ in what they make of a capital one."""
    return F.translate(F.lower(text), "ς", "σ")


def written_rules(spark: SparkSession, fields: dict = RULES) -> DataFrame:
    """The written rules of ``rules.RULES`` as a table."""
    rows = [(field, "", kind, phrase, label, n, None) for field, rules in fields.items() for n, (kind, label, phrases) in enumerate(rules, 1) for phrase in phrases]
    return spark.createDataFrame(rows, SCHEMA)


def position_rules(spark: SparkSession, regional: dict = REGIONAL, executive: dict = EXECUTIVE) -> DataFrame:
    """Titles as a table: those of countries, then chief executives where they sit on the board, then keywords.

    A country's other management titles only count over what would make a board member or director of them.
    """
    rows = []
    for names, (board, management) in regional.items():
        for name in names:
            rows += [(POSITION, name, "word", t, "Board Member", 1, None) for t in board]
            rows += [(POSITION, name, "word", t, "Executive Management", 2, None) for t in executive.get(names, ())]
            rows += [(POSITION, name, "word", t, "Executive Management", 3, ["Board Member", "Director"]) for t in management]
    rows += [(POSITION, name, "within" if " " in t else "word", t, "Board Member", 4, None) for name in BOARD_COUNTRIES for t in BOARD_TITLES]
    rows += [(POSITION, "", "within", word, label, n, None) for n, (label, words) in enumerate(POSITIONS, 5) for word in words]
    return spark.createDataFrame(rows, SCHEMA)


def read_rules(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rules from a table with the columns of ``SCHEMA``; ``only_over`` may be text, labels parted by ``|``, and
    with ``country`` it may be missing."""
    df = read_table(spark, path, kind, null_tokens=("",))
    for name in ("country", "only_over"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    over = F.col("only_over")
    if df.schema["only_over"].dataType.simpleString() == "string":
        over = F.transform(F.split(over, r"\|"), lambda x: F.trim(x))
    return df.select("field_key", F.coalesce(F.trim("country"), F.lit("")).alias("country"), "kind", "phrase", "label", F.col("priority").cast("int").alias("priority"), over.alias("only_over"))


def unknown_rules(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """Rules that can't be used: of an unknown kind or without a phrase, or with a label that isn't in ``labels``
    (``field_key, labels``) of their field."""
    joined = rules.join(labels.select("field_key", "labels"), "field_key", "left")
    odd = ~F.col("kind").isin(*KINDS) | F.col("kind").isNull() | (F.coalesce("phrase", F.lit("")) == "") | ~F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False))
    return joined.where(odd).select(*COLUMNS)


def _indexed(rules: DataFrame) -> DataFrame:
    """The rules with their phrase's head and its length class; a whole phrase has class 0."""
    phrase = F.when(F.col("kind") == "pattern", F.col("phrase")).otherwise(folded(F.col("phrase")))
    letters = F.length("phrase")
    size = F.when(F.col("kind") == "exact", 0).otherwise(F.pow(F.lit(2), F.floor(F.log2(letters))).cast("int"))
    return (
        rules.where("phrase <> ''")
        .select("field_key", F.lower(F.coalesce("country", F.lit(""))).alias("scope"), "kind", phrase.alias("phrase"), "label", "priority", "only_over")
        .withColumn("class", size)
        .withColumn("head", F.when(F.col("class") == 0, F.col("phrase")).otherwise(F.left("phrase", F.col("class"))))
    )


def _windows(scoped: DataFrame, index: DataFrame) -> DataFrame:
    """``_id, field_key, scope, kind, head, seen`` for all that could be a head: ``seen`` is the value from there
    on, as far as the longest phrase and one letter more reach."""
    shape = index.where("kind <> 'pattern'").groupBy("field_key", "scope", "kind").agg(F.array_distinct(F.collect_set("class")).alias("classes"), F.max(F.length("phrase")).alias("longest"))
    text, reach = F.col("text"), (F.col("longest") + 1).cast("string")
    ahead = F.concat(F.lit("(?=(.{1,"), reach, F.lit("}))"))
    starts = F.when(F.col("kind") == "word", F.regexp_extract_all(text, F.concat(F.lit("(?s)(?<![a-z0-9])"), ahead), 1)).otherwise(F.regexp_extract_all(text, F.concat(F.lit("(?s)"), ahead), 1))
    seen = (
        F.when((F.col("kind") == "exact") & (F.length("text") <= F.col("longest")), F.array(text))
        .when(F.col("kind") == "prefix", F.array(F.left(text, F.col("longest"))))
        .when(F.col("kind").isin("word", "within"), F.array_distinct(starts))
    )
    opened = scoped.join(shape, ["field_key", "scope"]).select("_id", "field_key", "scope", "kind", "classes", F.explode(seen).alias("seen"))
    sized = opened.select("_id", "field_key", "scope", "kind", "seen", F.explode("classes").alias("class")).where("length(seen) >= class")
    return sized.select("_id", "field_key", "scope", "kind", "seen", F.when(F.col("class") == 0, F.col("seen")).otherwise(F.left("seen", F.col("class"))).alias("head"), "class")


def matches(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``_id, label, priority, only_over`` of the rules that fit, as far as they can matter. ``keys``: ``_id, field_key, country, raw``."""
    index = _indexed(rules)
    place = F.lower(F.coalesce("country", F.lit("")))
    scoped = keys.where("raw <> ''").select("_id", "field_key", folded(F.col("raw")).alias("text"), F.explode(F.array_distinct(F.array(F.lit(""), place))).alias("scope"))
    phrase, behind = F.col("phrase"), F.substring("seen", F.length("phrase") + 1, F.lit(1))
    fits = (F.left("seen", F.length(phrase)) == phrase) & ((F.col("kind") != "word") | ~behind.rlike("[a-z0-9]"))
    by_phrase = _windows(scoped, index).join(index.where("kind <> 'pattern'"), ["field_key", "scope", "kind", "class", "head"]).where(fits)
    found = written(by_phrase.select("_id", "label", "priority", "only_over").distinct(), "matches")
    best = found.where("only_over is null").groupBy("_id").agg(F.min("priority").alias("_best"))
    patterns = index.where("kind = 'pattern'").select("field_key", "scope", F.col("phrase").alias("pattern"), "label", "priority", "only_over")
    open_yet = F.col("_best").isNull() | (F.col("priority") <= F.col("_best"))
    by_pattern = scoped.join(best, "_id", "left").join(patterns, ["field_key", "scope"]).where(open_yet).where(F.regexp_like("text", F.col("pattern")))
    return found.unionByName(by_pattern.select("_id", "label", "priority", "only_over").distinct())


def classify_by_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``label`` to keys ``field_key, country, raw``: that of the best rule that fits, null if none does.

    Of rules with the same priority the first label in order wins. A rule with ``only_over`` counts only where
    the best rule without it gives one of those labels and a larger priority. Blank values fit no rule. All keys
    are returned, with all their columns; equal ones are asked once. Work grows with the letters of the values,
    times the longest phrase of their field; a field's patterns are all tried on what has no better rule.
    """
    asked = written(keys.select("field_key", "country", "raw").distinct().withColumn("_id", F.monotonically_increasing_id()), "rule_keys")
    rule = F.struct("priority", "label")
    plain, other = F.col("only_over").isNull(), F.col("only_over").isNotNull()
    by_key = matches(asked, rules).groupBy("_id").agg(F.min(F.when(plain, rule)).alias("best"), F.collect_set(F.when(other, F.struct("priority", "label", "only_over"))).alias("others"))
    over = F.array_min(F.filter("others", lambda o: (o["priority"] < F.col("best.priority")) & F.array_contains(o["only_over"], F.col("best.label"))))
    labelled = written(asked.join(by_key, "_id", "left").select("field_key", "country", "raw", F.coalesce(over["label"], F.col("best.label")).alias("label")), "labels")
    parts = [keys[c].eqNullSafe(labelled[c]) for c in ("field_key", "country", "raw")]
    return keys.join(labelled, parts[0] & parts[1] & parts[2], "left").select(keys["*"], labelled["label"])


def by_rules(rules: DataFrame, other: str = CATCH_ALL):
    """A classifier for ``standardize``: HIGH where a rule fits, else ``other`` with low confidence."""

    def classifier(keys: DataFrame) -> DataFrame:
        found = classify_by_rules(keys, rules)
        sure, none = F.col("label").isNotNull() & (F.col("label") != other), F.array().cast("array<string>")
        return found.select(
            "field_key",
            "country",
            "raw",
            F.coalesce("label", F.lit(other)).alias("std"),
            F.when(sure, "HIGH").otherwise("LOW").alias("confidence"),
            none.alias("alternatives"),
            F.when(sure, "").otherwise("No written rule fits").alias("reasoning"),
        )

    return classifier
