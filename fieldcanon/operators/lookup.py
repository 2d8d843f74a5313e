"""The two-tier lookup: build it from a master mapping, use it, correct it, save it.

Its working form is the flat table ``field_key, tier, country, raw, std``; the country is empty
in tier ``consistent``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fix_label, norm_key
from ..registry import KEEP, LEGACY_LABELS, field_table, resolution_table
from ..sources.storage import written

COLUMNS = ["field_key", "tier", "country", "raw", "std"]
#: Buckets of a saved lookup.
BUCKETS = 64
#: Most entries of a field (about) in one JSON text.
JSON_ENTRIES = 50_000
JSON_SCHEMA = "map<string, struct<consistent: map<string, string>, by_country: map<string, map<string, string>>>>"


def master_triples(master: DataFrame, legacy: dict[str, str] = LEGACY_LABELS, keep_empty_std: bool = False) -> DataFrame:
    """Distinct normalised ``field_key, country, raw, std`` of a master mapping.

    Rows without a raw value or a label are left out (the audit keeps labels of blanks only). A
    mapping repeats itself: its distinct rows are written first, so that texts are normalised
    once each and not for every row.
    """
    distinct = master.where("raw is not null and std is not null").select("field_key", "country", "raw", "std").distinct()
    rows = written(distinct, "master").select(
        "field_key", norm_key(F.col("country")).alias("country"), norm_key(F.col("raw")).alias("raw"), fix_label(norm_key(F.col("std")), legacy).alias("std")
    )
    rows = rows.where("raw <> ''")
    return (rows if keep_empty_std else rows.where("std <> ''")).distinct()


def _judged(triples: DataFrame) -> DataFrame:
    """Each triple with its raw value's number of answers, resolution, and its label's validity.

    One shuffle by field and raw value serves the number of answers and, as the finer key is
    hashed inside it, the count of answers in a country.
    """
    spark = triples.sparkSession
    labels = F.broadcast(field_table(spark).select("field_key", "labels"))
    resolutions = F.broadcast(resolution_table(spark))
    by_raw = Window.partitionBy("field_key", "raw")
    answers = F.size(F.collect_set("std").over(by_raw))
    return (
        triples.withColumn("answers", answers)
        .join(labels, "field_key")
        .join(resolutions, ["field_key", "raw"], "left")
        .withColumn("valid", F.array_contains("labels", F.col("std")))
        .withColumn("resolved_valid", F.array_contains("labels", F.col("resolution")))
        .drop("labels")
    )


def _branches(triples: DataFrame) -> DataFrame:
    """One row for each possible entry, with what became of it.

    A raw value with one answer gives that answer, a conflict with an override the override, and
    a conflict kept by country each country's answers; ``kind`` and ``ok`` tell them apart. All
    come from one aggregation, whose key holds the country only where it matters.
    """
    single, kept = F.col("answers") == 1, F.col("resolution") == KEEP
    entries = (
        _judged(triples)
        .where(single | F.col("resolution").isNotNull())
        .withColumn("kind", F.when(single, "consistent").when(kept, "country").otherwise("override"))
        .withColumn("country", F.when(F.col("kind") == "country", F.col("country")).otherwise(""))
        .groupBy("field_key", "country", "raw", "kind")
        .agg(F.count("*").alias("n"), F.min("std").alias("std"), F.first("valid").alias("valid"), F.first("resolution").alias("resolution"), F.first("resolved_valid").alias("resolved_valid"))
    )
    override = F.col("kind") == "override"
    several = (F.col("kind") == "country") & (F.col("n") > 1)
    return entries.select(
        "field_key",
        "country",
        "raw",
        F.when(override, F.col("resolution")).otherwise(F.col("std")).alias("std"),
        F.when(several, "ambiguous").otherwise(F.col("kind")).alias("kind"),
        F.when(several, False).when(override, F.col("resolved_valid")).otherwise(F.col("valid")).alias("ok"),
    )


def build_lookup(triples: DataFrame) -> DataFrame:
    """The lookup of ``master_triples``.

    A raw value with one answer is taken as it is. One with several needs a resolution: an
    override replaces all answers, or each country keeps its own, unless it has several. Labels
    outside the field's list are left out, but count as answers.
    """
    tier = F.when(F.col("kind") == "country", "by_country").otherwise("consistent")
    return _branches(triples).where("ok and kind <> 'ambiguous'").withColumn("tier", tier).select(COLUMNS)


def lookup_counters(triples: DataFrame) -> DataFrame:
    """Counts of a build for each field, and for all (``field_key`` null)."""
    kind = lambda k, ok=True: F.count_if((F.col("kind") == k) & F.col("ok")) if ok else F.count_if(F.col("kind") == k)
    return (
        _branches(triples)
        .rollup("field_key")
        .agg(
            kind("consistent").alias("consistent"),
            kind("country").alias("country_specific"),
            kind("override").alias("resolved"),
            F.count_if((F.col("kind") != "ambiguous") & ~F.col("ok")).alias("skipped_invalid"),
            kind("ambiguous", ok=False).alias("skipped_ambiguous"),
            F.count_if(F.col("ok") & (F.col("kind") != "ambiguous")).alias("total_entries"),
        )
    )


def resolve(keys: DataFrame, lookup: DataFrame, into: str = "std") -> DataFrame:
    """Add the lookup's label for ``field_key, country, raw``, null if it has none.

    A country's own entry comes first. Entries without a country in the country tier are never
    reached. Spark broadcasts the lookup while it is below its threshold.
    """
    own = lookup.where("tier = 'by_country' and country <> ''").select("field_key", "country", "raw", F.col("std").alias("_own"))
    general = lookup.where("tier = 'consistent'").select("field_key", "raw", F.col("std").alias("_general"))
    joined = keys.join(own, ["field_key", "country", "raw"], "left").join(general, ["field_key", "raw"], "left")
    return joined.withColumn(into, F.coalesce("_own", "_general")).drop("_own", "_general")


def save_buckets(lookup: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Save the lookup as a bucketed table of the catalogue, a row for each field and raw value: the general label,
    and those of countries (at most one for each of them) as a map. For lookups beyond any broadcast."""
    own = F.col("tier") == "by_country"
    pairs = F.array_sort(F.collect_list(F.when(own & (F.col("country") != ""), F.struct("country", "std"))))
    wide = lookup.groupBy("field_key", "raw").agg(F.max(F.when(~own, F.col("std"))).alias("general"), F.map_from_entries(pairs).alias("own"))
    wide.repartition(buckets, "field_key", "raw").write.bucketBy(buckets, "field_key", "raw").sortBy("field_key", "raw").mode("overwrite").saveAsTable(name)


def resolve_buckets(keys: DataFrame, name: str, into: str = "std") -> DataFrame:
    """The same as ``resolve`` with a lookup of ``save_buckets``: one join serves both tiers, and only the keys are
    shuffled, for the lookup lies in buckets of the join's keys. Where Spark expects few keys to be found, it
    puts a Bloom filter of one side in front of the other by itself."""
    found = keys.sparkSession.table(name)
    joined = keys.join(found, ["field_key", "raw"], "left")
    label = F.coalesce(F.try_element_at("own", F.col("country")), F.col("general"))
    return joined.select(*(keys[c] if c not in ("field_key", "raw") else F.col(c) for c in keys.columns), label.alias(into))


def upsert(lookup: DataFrame, approved: DataFrame) -> DataFrame:
    """The lookup with approved corrections (``field_key, country, raw, proposed, reviewed_at, id``).

    The last approval of a key wins and replaces the lookup's entry.
    """
    last = Window.partitionBy("field_key", "country", "raw").orderBy(F.desc("reviewed_at"), F.desc("id"))
    new = (
        approved.select("field_key", norm_key(F.col("country")).alias("country"), norm_key(F.col("raw")).alias("raw"), F.col("proposed").alias("std"), "reviewed_at", "id")
        .withColumn("_n", F.row_number().over(last))
        .where("_n = 1")
        .withColumn("tier", F.when(F.col("country") != "", "by_country").otherwise("consistent"))
        .select(COLUMNS)
    )
    return lookup.select(COLUMNS).join(new, ["field_key", "tier", "country", "raw"], "left_anti").select(COLUMNS).unionByName(new)


def save_lookup(lookup: DataFrame, path: str) -> None:
    lookup.select(COLUMNS).write.partitionBy("field_key").parquet(path)


def to_json(lookup: DataFrame, entries: int = JSON_ENTRIES) -> DataFrame:
    """Rows ``field_key, part, entry``: entries of a field as nested maps in JSON.

    A field of up to ``entries`` entries has one row; those of a larger one are dealt to as many
    rows as it takes by a hash of the raw value. ``from_json`` reads them back together.
    """
    sizes = F.broadcast(lookup.groupBy("field_key").agg(F.ceil(F.count("*") / entries).alias("parts")))  # a row a field
    dealt = lookup.join(sizes, "field_key").withColumn("part", F.pmod(F.xxhash64("raw"), F.col("parts")).cast("int"))
    pair = F.struct("raw", "std")
    maps = dealt.groupBy("field_key", "part", "tier", "country").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("answers"))
    own = F.array_sort(F.collect_list(F.when(F.col("tier") == "by_country", F.struct("country", F.map_entries("answers").alias("answers")))))
    nested = maps.groupBy("field_key", "part").agg(
        F.first(F.when(F.col("tier") == "consistent", F.col("answers")), ignorenulls=True).alias("consistent"),
        F.transform_values(F.map_from_entries(own), lambda _, v: F.map_from_entries(v)).alias("by_country"),
    )
    entry = F.struct(F.coalesce("consistent", F.create_map().cast("map<string,string>")).alias("consistent"), "by_country")
    return nested.select("field_key", "part", F.to_json(entry).alias("entry"))


def from_json(text: DataFrame, column: str = "value") -> DataFrame:
    """The flat lookup of a JSON object ``{field: {consistent, by_country}}`` in a text column."""
    fields = text.select(F.explode(F.from_json(column, JSON_SCHEMA)).alias("field_key", "e"))
    general = fields.select("field_key", F.lit("consistent").alias("tier"), F.lit("").alias("country"), F.explode("e.consistent").alias("raw", "std"))
    own = fields.select("field_key", F.explode("e.by_country").alias("country", "m")).select("field_key", F.lit("by_country").alias("tier"), "country", F.explode("m").alias("raw", "std"))
    return general.select(COLUMNS).unionByName(own.select(COLUMNS))
