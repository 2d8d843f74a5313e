"""The registered queries of the field standardisation jobs."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..countries import country_table
from ..functions.classify import POSITIONS, classify
from ..operators import audit, batches, corrections, external, lookup, responses, route, rules, ruletable, standardize, stats, stores, validate
from ..registry import CATCH_ALL, FIELDS, LEGACY_LABELS_AUDIT, resolution_table
from ..sources import tables
from ..sources.storage import new_folder, written
from . import derived

RESULT = {"Standardized Value": "standardized_value", "Needs Review": "needs_review", "Review Reason": "review_reason"}


def _renamed(df: DataFrame) -> DataFrame:
    """Columns in lower case with underscores; an ``Input`` sorts with its own name."""
    return df.toDF(*(RESULT.get(c, c.replace(" ", "_").lower()) for c in df.columns))


def _of_type(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The rows of one field with their country, as a table of a single field."""
    routed = route.with_field_key(route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark)), "fieldType")
    return routed.where(F.col("field_key") == key).select("row_id", "Country", "inputText")


def standardize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(standardize.standardize(_of_type(spark, sf_dir, "positions_designations"), "inputText", "positions_designations", "Country"))


def standardize_legal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(standardize.standardize(_of_type(spark, sf_dir, "business_legal_form"), "inputText", "business_legal_form"))


def standardize_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark)))


def standardize_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose ``Field`` column names each row's field."""
    return _renamed(standardize.standardize_mixed(derived.field_values(spark, sf_dir), "Value", "Country"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tables are recognised: by their columns, and by what a ``Field`` column holds."""
    fields = derived.field_values(spark, sf_dir)
    found = {
        "export": route.layout(derived.raw_values(spark, sf_dir)),
        "fields": route.layout(fields),
        "no known field": route.layout(fields.where("Field like 'Odd%' or Field is null")),
        "values": route.layout(fields.drop("Field")),
    }
    return spark.createDataFrame(list(found.items()), "name string, layout string")


def quoted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with line breaks, quotes and commas written as one CSV file and read back by its splits."""
    key = F.col("o_orderkey")
    marks = derived.pick(('"', '""', "\n", '"\n"', ",", "\n\n,", '",\n"', " "), key % 8)
    rows = derived.table(spark, sf_dir, "orders").select(key.alias("row_id"), F.concat(F.lit("a"), marks, F.col("o_custkey").cast("string"), marks, F.lit("z")).alias("Value"), F.lit('5" pipe').alias("Size"))
    path = f"{new_folder(spark)}/quoted.csv"
    tables.write_table(rows.coalesce(1), path, "csv")
    df = tables.read_table(spark, path)
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("Value").alias("value"), F.col("Size").alias("size"))


def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV, read back, and its columns found by their headers."""
    path = f"{new_folder(spark)}/table.csv"
    tables.write_table(derived.written_values(spark, sf_dir), path, "csv")
    df = tables.read_table(spark, path)
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col(f"`{tables.country_column(df)}`").alias("country"), F.col(f"`{tables.value_column(df)}`").alias("value"))


def master_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master mapping written as one table a field, and read back as one."""
    master, folder, paths = derived.master(spark, sf_dir), new_folder(spark), {}
    for n, key in enumerate(derived.FIELD_KEYS):
        kind = ("csv", "parquet")[n % 2]
        paths[key] = f"{folder}/{key}.{kind}"
        own = master.where(F.col("field_key") == key).select("country", F.col("raw").alias("Raw"), F.col("std").alias("Standard"), F.lit("x").alias("Note"))
        tables.write_table(own, paths[key], kind)
    place = F.coalesce("country", F.lit("")).alias("country")  # an empty text in a CSV is a missing one
    return tables.read_master(spark, paths).groupBy("field_key", place, "raw", "std").agg(F.count("*").alias("n"))


def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that an export of a finished table has by default, equal rows counted."""
    done = standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark))
    return _renamed(standardize.export(done)).groupBy("country", "fieldtype", "inputtext", *RESULT.values()).agg(F.count("*").alias("n"))


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.build_lookup(lookup.master_triples(derived.master(spark, sf_dir)))


def standardize_with_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark), written(_lookup(spark, sf_dir), "lookup")))


def resolve_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark)).select("row_id", F.col("Country").alias("country"))


def field_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.field_type_summary(derived.raw_values(spark, sf_dir), "fieldType")


def build_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir)


def lookup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_counters(lookup.master_triples(derived.master(spark, sf_dir)))


def lookup_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup written as nested JSON and read back."""
    entries = lookup.to_json(_lookup(spark, sf_dir))
    return lookup.from_json(entries.select(F.concat(F.lit('{"'), F.col("field_key"), F.lit('":'), F.col("entry"), F.lit("}")).alias("value")))


def lookup_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = route.with_field_key(route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark)), "fieldType")
    keyed = standardize.keyed(rows, F.col("field_key"), F.col("inputText"), F.col("Country"))
    return lookup.resolve(standardize.distinct_keys(keyed), written(_lookup(spark, sf_dir), "lookup")).select("field_key", "country", "raw", "std")


def lookup_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``lookup_resolve``, by a lookup in buckets."""
    rows = route.with_field_key(route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark)), "fieldType")
    keyed = standardize.keyed(rows, F.col("field_key"), F.col("inputText"), F.col("Country"))
    name = f"lookup_{uuid.uuid4().hex}"
    lookup.save_buckets(_lookup(spark, sf_dir), name, 8)
    found = written(lookup.resolve_buckets(standardize.distinct_keys(keyed), name), "resolved")
    spark.sql(f"drop table {name}")
    return found.select("field_key", "country", "raw", "std")


def observed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run, taken while its rows are written."""
    out = standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark), keep_keys=True)
    rows, seen = stats.observed(out, "fieldType")
    rows.drop("_key", "_answer").write.parquet(f"{new_folder(spark)}/standardized")
    return stats.observed_stats(spark, seen)


def _audit_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.master_triples(derived.master(spark, sf_dir), LEGACY_LABELS_AUDIT, keep_empty_std=True)


def conflict_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(audit.in_order(audit.apply_resolutions(audit.audit_rows(_audit_triples(spark, sf_dir)))))


def conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.conflict_summary(_audit_triples(spark, sf_dir))


def conflict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(audit.answer_lines(audit.audit_rows(_audit_triples(spark, sf_dir))))


def conflict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit as text, in parts."""
    return audit.summary_parts(audit.audit_rows(_audit_triples(spark, sf_dir)))


def unresolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unresolved(audit.audit_rows(_audit_triples(spark, sf_dir)))


def resolution_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each resolution settles a conflict of the master mapping."""
    used = audit.conflicts(_audit_triples(spark, sf_dir)).join(F.broadcast(resolution_table(spark)), ["field_key", "raw"])
    return audit.resolution_breakdown(used)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a run over an export, a row for each field type."""
    counted = standardize.counted_analytics(derived.raw_values(spark, sf_dir), country_table(spark), written(_lookup(spark, sf_dir), "lookup"))
    return stats.run_stats(counted, "fieldType", 10, weight="n")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_totals(_run(spark, sf_dir)).withColumn("unknown_types", F.array_join("unknown_types", ", "))


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with a wrong total, as if they had failed."""
    items = derived.inputs(spark, sf_dir).where("batch_id % 7 = 0")
    return items.groupBy(F.lit("positions_designations").alias("field_key"), F.col("batch_id").alias("batch_index")).agg(F.array_sort(F.collect_list("raw")).alias("values"), F.lit("timed out").alias("error"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log measures of a run whose batches with a wrong total count as failed."""
    record = stats.run_record(_run(spark, sf_dir), "orders", "inputText", F.lit("2024-01-01T00:00:00+00:00"), _failed(spark, sf_dir))
    return stats.log_measures(record)


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two runs, appended to a log with their failed batches, and read back."""
    folder, per_type, failed = new_folder(spark), written(_run(spark, sf_dir), "stats"), written(_failed(spark, sf_dir), "failed")
    for name, lost in (("first", failed), ("second", None)):
        when = F.lit(f"2024-01-01T00:00:00+00:00 {name}")
        for _ in range(2):  # a rerun adds nothing
            tables.append_record(stats.run_record(per_type, name, "inputText", when, lost, retries=2), f"{folder}/log", name)
            if lost is not None:
                tables.append_failures(stats.failure_rows(lost, name, when), f"{folder}/failures", name)
    values = tables.read_failures(spark, f"{folder}/failures").groupBy("source_file").agg(F.sum(F.size("values")).alias("values_listed"))
    records = tables.read_records(spark, f"{folder}/log").join(values, "source_file", "left").drop("mismatches")
    return records.withColumn("values_listed", F.coalesce("values_listed", F.lit(0)).cast("bigint"))


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.aligned(derived.responses(spark, sf_dir), derived.inputs(spark, sf_dir))
    return rows.withColumn("alternatives", F.array_join("alternatives", "; ")).withColumn("review", responses.needs_review(F.col("confidence")))


def response_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.batch_warnings(derived.responses(spark, sf_dir), derived.inputs(spark, sf_dir))
    return rows.withColumn("warnings", F.array_join("warnings", "; "))


def _corrected(original: DataFrame) -> DataFrame:
    value = F.when(F.col("row_id") % 17 == 0, "Director").when(F.col("row_id") % 19 == 0, "").otherwise(F.col("`Standardized Value`"))
    return original.withColumn("Standardized Value", value)


def correction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = standardize.standardize(_of_type(spark, sf_dir, "positions_designations"), "inputText", "positions_designations", "Country")
    return corrections.diff_standard(original, _corrected(original), "inputText", "Country", F.lit("positions_designations"), "row_id").drop("_order")


def correction_diff_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark))
    return corrections.diff_analytics(original, _corrected(original), "row_id").drop("_order")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.queue_state(derived.submissions(spark, sf_dir), derived.decisions(spark, sf_dir))


def correction_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir)


def correction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue from event tables that were appended to in two steps, one of them rerun, and read back."""
    folder, sent, decided = new_folder(spark), derived.submissions(spark, sf_dir), derived.decisions(spark, sf_dir)
    for name, events in (("submissions", sent), ("decisions", decided)):
        for odd in (1, 0, 1):  # the third append repeats the first one's batch
            tables.append_events(events.where(F.col("id") % 2 == odd), f"{folder}/{name}", f"part {odd}")
    read = lambda name, like: tables.read_events(spark, f"{folder}/{name}", like.schema)
    return corrections.queue_state(read("submissions", sent), read("decisions", decided))


def queue_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue from its store: decisions in three batches, one of them rerun, and rewritten before the last."""
    sent, decided = derived.submissions(spark, sf_dir), derived.decisions(spark, sf_dir)
    store = stores.QueueStore(spark, new_folder(spark), sent.schema.toDDL(), decided.schema.toDDL())
    store.submissions.append(sent, "sent")
    for part in (0, 1, 0, 2):
        if part == 2:
            store.compact()
        store.decide(decided.where(F.col("seq") % 3 == part), f"decided {part}")
    return store.state()


def queue_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a queue that holds the latest submission of each key takes of all submissions, sent twice."""
    latest = Window.partitionBy("field_key", "raw_value", "country").orderBy(F.desc("id"))
    sent, decided = derived.submissions(spark, sf_dir), derived.decisions(spark, sf_dir)
    store = stores.QueueStore(spark, new_folder(spark), sent.schema.toDDL(), decided.schema.toDDL())
    store.submissions.append(sent.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n"))
    store.decide(decided)
    at = store.submissions.version()
    for _ in range(2):
        store.submit(sent, "id", "all")
    return store.submissions.since(at)


def lookup_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored lookup after approvals were brought in, twice by one name; read from the store."""
    store = stores.lookup_store(spark, new_folder(spark))
    store.replace(_lookup(spark, sf_dir), "built")
    for _ in range(2):
        stores.apply_approvals(store, corrections.approvals(_queue(spark, sf_dir)), "approved")
    return store.read()


def make_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences of a corrected table as pending corrections."""
    original = standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark))
    diff = corrections.diff_analytics(original, _corrected(original), "row_id")
    return corrections.make_corrections(diff, "someone", submitted_at=F.lit("2024-01-01T00:00:00+00:00"))


def queue_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids in each view of the queue."""
    queue = _queue(spark, sf_dir).withColumn("source", F.when(F.col("id") % 5 == 0, "demo").when(F.col("id") % 5 == 1, "user"))
    views = {"pending": corrections.pending, "history": corrections.history, "needs rule update": corrections.needs_rule_update, "without demo": corrections.without_demo}
    return functools.reduce(DataFrame.unionByName, [view(queue).select(F.lit(name).alias("view"), "id") for name, view in views.items()])


def correction_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of all submissions is new to a queue that holds the latest one of each key."""
    latest = Window.partitionBy("field_key", "raw_value", "country").orderBy(F.desc("id"))
    queue = _queue(spark, sf_dir).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return corrections.new_submissions(derived.submissions(spark, sf_dir), queue, "id")


def lookup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.upsert(_lookup(spark, sf_dir), corrections.approvals(_queue(spark, sf_dir)))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.truth(lookup.master_triples(derived.master(spark, sf_dir), LEGACY_LABELS_AUDIT))


def truth_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.truth_split(_truth(spark, sf_dir))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accuracy(validate.scored(_truth(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 6))


def accuracy_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accuracy_by_confidence(validate.scored(_truth(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 6))


def first_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.mismatches(validate.scored(_truth(spark, sf_dir)), 12)


def handoff_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(stats.handoff(standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark)), "inputText", "fieldType"))


def handoff_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark))
    return stats.row_country_lists(rows, "Country", "fieldType")


def handoff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark))
    return stats.handoff_fields(rows, "fieldType", "Country")


def _plan(spark: SparkSession, sf_dir: str, batch_size: int) -> DataFrame:
    rows = route.with_field_key(route.with_country(derived.raw_values(spark, sf_dir), "countryId", country_table(spark)), "fieldType")
    keyed = standardize.keyed(rows, F.col("field_key"), F.col("inputText"), F.col("Country")).where("_key.raw <> '' and _key.field_key is not null").select("row_id", "_key.*")
    return batches.batch_plan(batches.first_seen(keyed, ["field_key", "country", "raw"], "row_id"), batch_size)


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, 25)


def batch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.messages(_plan(spark, sf_dir, 25))


#: What the registered run's client knows: the written rules, and keywords for positions.
CLIENT_RULES = rules.RULES | {"positions_designations": tuple(("within", label, words) for label, words in POSITIONS)}


def external_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export standardised by a client that is asked in batches and answers from written rules."""
    client = functools.partial(external.RulesClient, CLIENT_RULES, {k: labels for k, (_, labels, _) in FIELDS.items()})
    classifier = external.external_classifier(client, {k: k for k in FIELDS}, new_folder(spark), batch_size=25)
    return _renamed(standardize.standardize_analytics(derived.raw_values(spark, sf_dir), country_table(spark), classifier=classifier))


def _rules(field_key: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = derived.rule_values(spark, sf_dir, field_key)
        return rows.select("row_id", "raw", rules.label_by_rules(field_key, F.col("raw")).alias("label"))

    return query


def _form() -> Column:
    return derived.pick(("LLC", "Corporation", "LLP", None), F.col("row_id") % 4)


def rules_positions_regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the tables of their country; each title of a country is asked for once."""
    rows = derived.rule_values(spark, sf_dir, "positions_designations")
    general = classify(F.lit("positions_designations"), F.col("raw"), F.col("country"))["std"]
    keys = written(rows.select("raw", "country").distinct(), "titles").withColumn("general", general)
    label = rules.position_by_region(F.col("raw"), F.col("country"), F.col("general"))
    labelled = rows.join(written(keys.select("raw", "country", label.alias("label")), "labels"), ["raw", "country"])
    return labelled.select("row_id", "raw", "country", rules.governor(F.col("raw"), _form(), F.col("label")).alias("label"))


def rule_table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all fields with written rules, labelled in one plan by a table of rules."""
    rows = [derived.rule_values(spark, sf_dir, key).select(F.lit(key).alias("field_key"), "row_id", F.lit("").alias("country"), "raw") for key in derived.RULE_VALUES if key in rules.RULES]
    found = ruletable.classify_by_rules(functools.reduce(DataFrame.unionByName, rows), ruletable.written_rules(spark))
    return found.select("field_key", "row_id", "raw", F.coalesce("label", F.lit(CATCH_ALL)).alias("label"))


def rule_table_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``rules_positions_regional``, by a table of rules."""
    rows = derived.rule_values(spark, sf_dir, "positions_designations").withColumn("field_key", F.lit("positions_designations"))
    found = ruletable.classify_by_rules(rows, ruletable.position_rules(spark))
    label = rules.governor(F.col("raw"), _form(), F.coalesce("label", F.lit(CATCH_ALL)))
    return found.select("row_id", "raw", "country", label.alias("label"))


def compliance_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.rule_values(spark, sf_dir, "positions_designations")
    return rows.where(rules.compliance_flag(F.col("raw"))).select("row_id", "raw")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        standardize_positions,
        standardize_legal_form,
        standardize_analytics,
        standardize_mixed,
        layouts,
        table_round_trip,
        quoted_round_trip,
        master_round_trip,
        export_columns,
        standardize_with_lookup,
        resolve_countries,
        field_type_summary,
        build_lookup,
        lookup_counters,
        lookup_json,
        lookup_resolve,
        lookup_buckets,
        conflict_audit,
        conflict_summary,
        conflict_lines,
        conflict_text,
        unresolved_conflicts,
        resolution_use,
        run_stats,
        run_totals,
        observed_stats,
        run_log,
        run_records,
        parse_responses,
        response_warnings,
        correction_diff,
        correction_diff_analytics,
        correction_queue,
        correction_events,
        queue_store,
        queue_submit,
        make_corrections,
        queue_views,
        correction_enqueue,
        lookup_upsert,
        lookup_store,
        truth_split,
        accuracy,
        accuracy_by_confidence,
        first_mismatches,
        handoff_mapping,
        handoff_countries,
        handoff_fields,
        batch_plan,
        batch_messages,
        external_batches,
        rules_positions_regional,
        rule_table_labels,
        rule_table_positions,
        compliance_flag,
    )
} | {
    name: _rules(key)
    for name, key in (
        ("rules_status", "business_status"),
        ("rules_do_status", "directors_officers_status"),
        ("rules_do_type", "directors_officers_type"),
        ("rules_entity_type", "business_entity_type"),
        ("rules_owner_type", "ownership_relationship_type"),
        ("rules_psc", "psc_beneficiary_type"),
        ("rules_brn", "brn_type"),
        ("rules_legal_form", "business_legal_form"),
    )
}
