import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldcanon.countries import country_table
from fieldcanon.operators import audit, batches, corrections, external, lookup, responses, route, stats, validate
from fieldcanon.operators.rules import rules_column
from fieldcanon.operators.standardize import RESULT_COLUMNS, by_column, counted_analytics, export, standardize, standardize_analytics, standardize_mixed
from fieldcanon.registry import CATCH_ALL, COUNTRIES, ERROR_LABEL, FIELDS, LEGACY_LABELS_AUDIT
from fieldcanon.sources import tables

POSITIONS = "positions_designations"


def rows(df):
    return [tuple(r) for r in df.collect()]


# The seven contract cases of the response parser.
INPUTS = ["ceo", "director", "beneficial owner"]
HEAD = "1. Executive Management | HIGH\n2. Director | HIGH\n3. Owner / Controller | MEDIUM | Reason: maybe\n[Total: 3 of 3 mapped]"
CASES = {
    "happy": (HEAD, True, ["Executive Management", "Director", "Owner / Controller"], ["HIGH", "HIGH", "MEDIUM"]),
    "shuffled": ("3) Owner / Controller | LOW | Alternatives: Director, Board Member | Reason: x\n1. Executive Management | high\r\n2. Director | Medium | reason: y", True, ["Executive Management", "Director", "Owner / Controller"], ["HIGH", "MEDIUM", "LOW"]),
    "missing": ("1. Executive Management | HIGH\n3. Owner / Controller | HIGH", False, ["Executive Management", "", "Owner / Controller"], ["HIGH", "", "HIGH"]),
    "extra": ("1. Executive Management | HIGH\n2. Director | HIGH\n3. Owner / Controller | HIGH\n4. Director | HIGH", False, ["Executive Management", "Director", "Owner / Controller"], ["HIGH"] * 3),
    "duplicate": ("1. Executive Management | HIGH\n2. Director | HIGH\n2. Other | LOW\n3. Owner / Controller | HIGH", False, ["Executive Management", "Director", "Owner / Controller"], ["HIGH"] * 3),
    "untagged": ("1. Executive Management | HIGH\n2. Director\n3. Owner / Controller | HIGH", False, ["Executive Management", "Director", "Owner / Controller"], ["HIGH", "", "HIGH"]),
    "bars": ("1. A | LOW | Alternatives: x\n2. B | HIGH | Reason: r\n3. C | HIGH", False, ["A | LOW | Alternatives: x", "B | HIGH | Reason: r", "C"], ["", "", "HIGH"]),
}


@pytest.mark.parametrize("case", CASES)
def test_response_contract(spark, case):
    text, ok, values, confidences = CASES[case]
    reply = spark.createDataFrame([(1, text)], "batch_id bigint, response string")
    asked = spark.createDataFrame([(1, i, r) for i, r in enumerate(INPUTS, 1)], "batch_id bigint, idx int, raw string")
    got = responses.aligned(reply, asked).orderBy("idx").collect()
    assert [r.raw for r in got] == INPUTS and [r.std for r in got] == values and [r.confidence for r in got] == confidences
    (row,) = responses.batch_warnings(reply, asked).collect()
    assert row.ok == ok and row.ok == (row.warnings == [])


def test_a_later_untagged_line_is_ignored_silently(spark):
    reply = spark.createDataFrame([(1, "1. A | HIGH\n1. B\n[total: 2 of 1 mapped]")], "batch_id bigint, response string")
    asked = spark.createDataFrame([(1, 1, "x")], "batch_id bigint, idx int, raw string")
    assert responses.batch_warnings(reply, asked).first().warnings == ["model reported 2 mapped but 1 lines parsed"]


def test_review_flags(spark):
    df = spark.createDataFrame([("HIGH",), ("LOW",), ("MEDIUM",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(responses.needs_review(F.col("c"))).collect()] == [False, True, False, True, True]


def test_standardize_places_its_columns(spark):
    df = spark.createDataFrame([("GB", "CEO", "old", 1), ("FR", " ", "old", 2), (None, None, "old", 3), ("FR", "blah", "old", 4)], "country string, `Raw Value` string, `Needs Review` string, n int")
    out = standardize(df, "Raw Value", POSITIONS, "country")
    assert out.columns == ["country", "Raw Value", *RESULT_COLUMNS, "n"]
    got = {r.n: (r["Standardized Value"], r["Needs Review"], bool(r["Review Reason"])) for r in out.collect()}
    assert got == {1: ("Board Member", "", False), 2: (CATCH_ALL, "Needs Review", False), 3: (CATCH_ALL, "Needs Review", False), 4: (CATCH_ALL, "Needs Review: Board Member? / Director?", True)}
    assert export(out, ["n", "Needs Review"]).columns == ["n", *RESULT_COLUMNS]


def analytics(spark):
    data = [("224", "Standardized Designation", "CEO"), ("74.0", "standardized position ", "CEO"), ("7777", "Business Legal Form", "Muster AG"), (None, "It's new", "x"), ("x", None, "x"), ("2", "BRN Type", "")]
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "row_id int, countryId string, fieldType string, inputText string")


def test_analytics(spark):
    got = {r.row_id: r for r in standardize_analytics(analytics(spark), country_table(spark)).collect()}
    assert [got[i].Country for i in range(6)] == ["United Kingdom", "France", "Unknown (ID: 7777)", "Unknown", "x", "United States"]
    assert [got[i]["Standardized Value"] for i in range(6)] == ["Board Member", "Executive Management", "Company", "Unknown field type", "Unknown field type", CATCH_ALL]
    assert got[3]["Needs Review"] == 'Needs Review: no classifier for field type "It\'s new"' and got[4]["Needs Review"].endswith("field type nan")
    assert got[5]["Needs Review"] == "Needs Review"


def test_layouts(spark):
    assert route.layout(analytics(spark)) == "analytics"
    assert route.layout(spark.createDataFrame([("Position", "x")], "` Field` string, value string")) == "mixed"
    assert route.layout(spark.createDataFrame([("something", "x")], "Field string, value string")) == "single"
    mixed = spark.createDataFrame([("UK", "designation", "CEO"), ("UK", "brn_type", "LEI"), ("UK", "?", "LEI")], "country string, Field string, value string")
    got = sorted(r["Standardized Value"] for r in standardize_mixed(mixed, "value", "country", classifier=by_column(rules_column)).collect())
    assert got == sorted([CATCH_ALL, "LEI", "Unknown field type"])


MASTER = [
    (POSITIONS, "UK", "Boss", "Director"), (POSITIONS, "FR", " Boss ", "Director"),  # one answer
    (POSITIONS, "UK", "President", "Board Member"), (POSITIONS, "FR", "President", "Executive Management"),  # kept by country
    (POSITIONS, "DE", "President", "Director"), (POSITIONS, "DE", "President", "Board Member"),  # ambiguous inside a country
    (POSITIONS, "IT", "President", "Nonsense"),  # invalid label
    (POSITIONS, "", "President", "Owner/Controller"),  # no country
    (POSITIONS, "UK", "Nobody", "Director"), (POSITIONS, "FR", "Nobody", "Board Member"),  # no resolution
    ("brn_type", "UK", "CAGE", "LEI"), ("brn_type", "FR", "CAGE", "Unknown"),  # override
    ("brn_type", "UK", "Odd", "Nonsense"), ("brn_type", "UK", "Old", "Unknown"), ("brn_type", "UK", None, "LEI"), ("brn_type", "UK", "Gone", None), ("brn_type", "UK", "  ", "LEI"),
]


def master(spark):
    return spark.createDataFrame(MASTER, "field_key string, country string, raw string, std string")


def test_build_and_use_a_lookup(spark):
    triples = lookup.master_triples(master(spark))
    built = lookup.build_lookup(triples)
    assert sorted(rows(built)) == sorted(
        [
            (POSITIONS, "consistent", "", "Boss", "Director"),
            (POSITIONS, "by_country", "UK", "President", "Board Member"),
            (POSITIONS, "by_country", "FR", "President", "Executive Management"),
            (POSITIONS, "by_country", "", "President", "Owner / Controller"),
            ("brn_type", "consistent", "", "CAGE", "Proprietary / Third-party ID"),
            ("brn_type", "consistent", "", "Old", CATCH_ALL),
        ]
    )
    counters = {r.field_key: tuple(r)[1:] for r in lookup.lookup_counters(triples).collect()}
    assert counters == {POSITIONS: (1, 3, 0, 1, 1, 4), "brn_type": (1, 0, 1, 1, 0, 2), None: (2, 3, 1, 2, 1, 6)}
    keys = spark.createDataFrame([(POSITIONS, "UK", "President"), (POSITIONS, "ES", "President"), (POSITIONS, "", "President"), (POSITIONS, "ES", "Boss"), ("brn_type", "", "CAGE"), ("brn_type", "", "cage")], "field_key string, country string, raw string")
    got = {tuple(r)[:3]: r.std for r in lookup.resolve(keys, built).select("field_key", "country", "raw", "std").collect()}
    assert list(got.values()).count(None) == 3 and got[POSITIONS, "UK", "President"] == "Board Member" and got[POSITIONS, "ES", "Boss"] == "Director"
    back = lookup.from_json(lookup.to_json(built).select(F.concat(F.lit('{"'), "field_key", F.lit('":'), "entry", F.lit("}")).alias("value")))
    assert sorted(rows(back)) == sorted(rows(built))
    parts = lookup.to_json(built, entries=1)
    assert parts.count() > parts.select("field_key").distinct().count()
    assert sorted(rows(lookup.from_json(parts.select(F.concat(F.lit('{"'), "field_key", F.lit('":'), "entry", F.lit("}")).alias("value"))))) == sorted(rows(built))


def test_lookup_saved_and_corrected(spark, tmp_path):
    built = lookup.build_lookup(lookup.master_triples(master(spark)))
    lookup.save_lookup(built, f"{tmp_path}/lookup")
    saved = spark.read.parquet(f"{tmp_path}/lookup").select(lookup.COLUMNS)
    approved = spark.createDataFrame([(1, POSITIONS, "", "Boss", "Board Member", "t1"), (2, POSITIONS, "", "Boss ", "Executive Management", "t2"), (3, POSITIONS, "ES", "Boss", "Director", "t1")], "id int, field_key string, country string, raw string, proposed string, reviewed_at string")
    got = {tuple(r)[1:4]: r.std for r in lookup.upsert(saved, approved).collect()}
    assert got["consistent", "", "Boss"] == "Executive Management" and got["by_country", "ES", "Boss"] == "Director" and len(got) == built.count() + 1


def test_audit(spark):
    triples = lookup.master_triples(master(spark), LEGACY_LABELS_AUDIT, keep_empty_std=True)
    out = audit.in_order(audit.audit_rows(triples))
    assert out.columns == audit.COLUMNS
    got = out.collect()
    assert [(r["Conflict Group"], r["Raw Value"]) for r in got] == sorted((r["Conflict Group"], r["Raw Value"]) for r in got)
    assert {r["Raw Value"]: r["Conflict Group"] for r in got} == {"Nobody": 1, "President": 2, "CAGE": 3}
    assert {r["Raw Value"]: r["Resolution"] for r in audit.apply_resolutions(out).collect()} == {"Nobody": "", "President": "keep_by_country", "CAGE": "Proprietary / Third-party ID"}
    assert rows(audit.unresolved(out)) == [(POSITIONS, "Nobody")]
    summary = dict(rows(audit.conflict_summary(triples)))
    assert summary[None] == 3 and summary[POSITIONS] == 2 and summary["business_status"] == 0 and len(summary) == 11
    many = spark.createDataFrame([("brn_type", f"C{i}", "v", std) for i in range(10) for std in ("LEI", "VAT Number")], "field_key string, country string, raw string, std string")
    assert audit.answer_lines(audit.audit_rows(many)).where("`Standardized Value` = 'LEI'").first().Line == "    -> 'LEI'  [C0, C1, C2, C3, C4, C5, C6, C7...]"


def test_statistics(spark):
    df = spark.createDataFrame([(i, "224", "BRN Type", v) for i, v in enumerate(["LEI", "LEI", " LEI", "", None, "zzz"])] + [(9, "224", None, "x")], "row_id int, countryId string, fieldType string, inputText string")
    known = spark.createDataFrame([("brn_type", "consistent", "", "LEI", "LEI")], "field_key string, tier string, country string, raw string, std string")
    done = standardize_analytics(df, country_table(spark), known, keep_keys=True)
    per_type = stats.run_stats(done, "fieldType", 100)
    got = {r.field_type: r.asDict() for r in per_type.collect()}
    assert {k: got["BRN Type"][k] for k in ("total_rows", "blanks", "unique_values", "duplicates", "lookup_hits", "flagged", "batches", "calls_saved")} == dict(total_rows=6, blanks=2, unique_values=2, duplicates=2, lookup_hits=1, flagged=3, batches=1, calls_saved=5)
    assert got["nan"]["flagged"] == 1 and got["nan"]["unique_values"] == 0
    totals = stats.run_totals(per_type).first()
    assert totals.total_rows == 7 and totals.unknown_types == ["nan"]
    failed = spark.createDataFrame([(1, ["a", "b"], "down")], "batch_index int, values array<string>, error string")
    record = stats.run_record(per_type, "f.csv", "inputText", failures=failed, retries=3)
    assert rows(stats.log_measures(record).select("output_count", "batches_failed")) == [(5, 1)]


def test_failed_batches_are_rows(spark, tmp_path):
    failed = spark.createDataFrame([("brn_type", 1, ["a", "b"], "down"), ("brn_type", 2, ["c"], "down")], "field_key string, batch_index int, values array<string>, error string")
    assert tables.read_failures(spark, f"{tmp_path}/failed").count() == 0
    for name in ("a.csv", "b.csv"):
        tables.append_failures(stats.failure_rows(failed, name, F.lit("t")), f"{tmp_path}/failed")
    assert sorted((r.source_file, r.batch_index, r["values"]) for r in tables.read_failures(spark, f"{tmp_path}/failed").collect()) == [(f, b, v) for f in ("a.csv", "b.csv") for b, v in ((1, ["a", "b"]), (2, ["c"]))]


def test_counted_statistics_are_those_of_the_rows(spark):
    df = analytics(spark).unionByName(analytics(spark))
    known = spark.createDataFrame([("brn_type", "consistent", "", "LEI", "LEI")], "field_key string, tier string, country string, raw string, std string")
    for lookup_ in (None, known):
        of_rows = stats.run_stats(standardize_analytics(df, country_table(spark), lookup_, keep_keys=True), "fieldType")
        of_counts = stats.run_stats(counted_analytics(df, country_table(spark), lookup_), "fieldType", weight="n")
        assert sorted(rows(of_rows), key=str) == sorted(rows(of_counts.select(of_rows.columns)), key=str)


def test_run_log_round_trip(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert tables.read_records(spark, path).count() == 0
    per_type = spark.createDataFrame([("BRN Type", "brn_type", 1, 0, 1, 0, 0, 0, 1, 0)], "field_type string, field_key string, total_rows bigint, blanks bigint, unique_values bigint, duplicates bigint, lookup_hits bigint, flagged bigint, batches bigint, calls_saved bigint")
    for name in ("a.csv", "b.csv"):
        tables.append_record(stats.run_record(per_type, name, "v"), path)
    assert sorted(r.source_file for r in tables.read_records(spark, path).collect()) == ["a.csv", "b.csv"]


def test_correction_loop(spark):
    df = spark.createDataFrame([(1, "UK", "CEO"), (2, "UK", "CEO "), (3, "FR", "CEO"), (4, "UK", "")], "row_id int, country string, value string")
    original = standardize(df, "value", POSITIONS, "country")
    label = F.when(F.col("row_id").isin(1, 2), "Director").when(F.col("row_id") == 3, "").otherwise(F.col("`Standardized Value`"))
    diff = corrections.diff_standard(original, original.withColumn("Standardized Value", label), "value", "country", F.lit(POSITIONS), "row_id")
    assert rows(diff.drop("_order")) == [(POSITIONS, "CEO", "UK", "Board Member", "Director")]
    made = corrections.make_corrections(diff, "me", submitted_at=F.lit("t0"))
    assert made.first().id == corrections.make_corrections(diff, "me", submitted_at=F.lit("t0")).first().id and made.first().field_display == "Positions / Designations"
    none = spark.createDataFrame([], "id string, action string, decided_at string, seq int, note string, needs_update boolean")
    queue = corrections.queue_state(made, none)
    assert corrections.pending(queue).count() == 1
    again = made.withColumn("raw_value", F.lit(" CEO "))
    assert corrections.new_submissions(again, queue, "id").count() == 0
    decided = corrections.decide_all(queue, "approve", F.lit("t1"), needs_update=True).unionByName(corrections.decide_all(queue, "reject", F.lit("t2")))
    state = corrections.queue_state(made, decided)
    assert state.first().status == "approved" and corrections.needs_rule_update(state).count() == 1 and corrections.history(state).count() == 1
    assert corrections.new_submissions(again, state, "id").count() == 1
    empty = spark.createDataFrame([], "field_key string, tier string, country string, raw string, std string")
    fixed = standardize(df, "value", POSITIONS, "country", lookup=lookup.upsert(empty, corrections.approvals(state)))
    assert {r.row_id: r["Standardized Value"] for r in fixed.collect()} == {1: "Director", 2: "Director", 3: "Executive Management", 4: CATCH_ALL}
    assert corrections.without_demo(state.withColumn("source", F.lit("demo"))).count() == 0


def test_validation(spark):
    labelled = validate.truth(lookup.master_triples(master(spark)))
    split = {r.field_key: tuple(r)[1:] for r in validate.truth_split(labelled).collect()}
    assert split == {POSITIONS: (3, 1, 2), "brn_type": (3, 2, 1)}
    scores = validate.scored(labelled)
    assert {r.field_key: (r.scored, r.correct, r.mismatches) for r in validate.accuracy(scores).collect()} == {POSITIONS: (1, 0, 1), "brn_type": (2, 1, 1)}
    assert [r.level for r in validate.accuracy_by_confidence(scores).collect()] == ["LOW"]
    assert validate.scored(labelled, limit=1).count() == 1
    assert rows(validate.mismatches(scores, 1)) == [("brn_type", "Odd", "Nonsense", CATCH_ALL)]


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_batches_are_in_first_seen_order(spark, range_rows):
    ids = [5, 17, 2, 40, 11, 8, 23]
    df = spark.createDataFrame([(i, "f" if i % 2 else "g") for i in ids], "n bigint, field_key string").repartition(4)
    got = {r.n: r.position for r in batches.ranked(df, "n", range_rows=range_rows).collect()}
    assert got == {n: k for k, n in enumerate(sorted(ids), 1)}
    own = {r.n: r.position for r in batches.ranked(df, "n", within="field_key", range_rows=range_rows).collect()}
    assert own == {n: sum(m <= n and m % 2 == n % 2 for m in ids) for n in ids}


@pytest.mark.parametrize("order", ["xxhash64(id)", "id * id * id", "id"])
def test_no_task_ranks_a_whole_field(spark, order):
    """200,000 keys of one field, ordered by a hash, sparsely, and densely."""
    df = spark.range(200_000).selectExpr("id", f"{order} as at", "'f' as field_key")
    out = batches.ranked(df, "at", within="field_key", range_rows=10_000)
    plain = df.withColumn("want", F.row_number().over(Window.orderBy("at"))).select("id", "want")
    assert out.join(plain, "id").where("position <> want").count() == 0 and out.count() == 200_000
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    ranges = batches.in_ranges(df, ["field_key", "at"], 10_000).groupBy("_range").count().collect()
    assert 15 <= len(ranges) <= 20 and max(r["count"] for r in ranges) < 30_000 and sizes


def test_messages(spark):
    keys = spark.createDataFrame([("f", "UK", "a\nb", 1), ("f", "", "c", 2), ("f", "", "d", 3)], "field_key string, country string, raw string, first_row bigint")
    got = {r.batch_no: r.message for r in batches.messages(batches.batch_plan(keys, 2)).collect()}
    assert got == {1: "Classify the following 2 entries:\n\n1. [Country: UK] a b\n2. c", 2: "Classify the following 1 entries:\n\n1. d"}


class FlakyClient:
    """Fails once for every text, always for ``broken``, and answers with the first label."""

    def __init__(self):
        self.seen = set()

    def complete(self, system, user):
        if "broken" in user:
            raise external.TransientError("down")
        if user not in self.seen:
            self.seen.add(user)
            raise external.TransientError("busy")
        items = user.split("\n")[2:]
        return "\n".join(f"{k}. {system} | MEDIUM | Reason: says {v.split('. ', 1)[1]}" for k, v in enumerate(items, 1))


def test_external_classifier(spark, tmp_path):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b", "broken", "a", None, "c"])], "n int, value string")
    ask = external.external_classifier(FlakyClient, {POSITIONS: "Director"}, f"{tmp_path}/run", batch_size=1, base_delay=0.0)
    got = {r.n: (r["Standardized Value"], r["Needs Review"], r["Review Reason"]) for r in standardize(df, "value", POSITIONS, classifier=ask).collect()}
    assert got == {0: ("Director", "", "says a"), 1: ("Director", "", "says b"), 2: (ERROR_LABEL, "Needs Review", ""), 3: ("Director", "", "says a"), 4: (CATCH_ALL, "Needs Review", ""), 5: ("Director", "", "says c")}
    lost = external.failures(f"{tmp_path}/run", spark).collect()
    assert [r["values"] for r in lost] == [["broken"]] and "4 attempt" in lost[0].error and lost[0].field_key == POSITIONS


def test_failures_of_several_fields_are_told_apart(spark, tmp_path):
    ask = external.external_classifier(FlakyClient, {}, f"{tmp_path}/run", batch_size=1, base_delay=0.0)
    keys = spark.createDataFrame([(f, "", f"broken {n}") for f in ("brn_type", POSITIONS, "business_status") for n in range(3)], "field_key string, country string, raw string")
    assert ask(keys).count() == 9
    lost = [(r.field_key, r.batch_index) for r in external.failures(f"{tmp_path}/run", spark).collect()]
    assert len(lost) == len(set(lost)) == 9 and len({b for _, b in lost}) == 3


def test_all_countries(spark):
    names = {r.country_id: r.country for r in country_table(spark).collect()}
    assert sorted(names) == list(range(-1, 251)) and all(names.values()) and len(set(names.values())) == 252
    known = {
        -1: "Global", 0: "Unknown", 1: "Australia", 2: "United States", 3: "Andorra", 9: "Armenia", 10: "Netherlands Antilles", 18: "Bosnia and Herzegovina", 28: "Brunei Darussalam", 39: "Congo, the Democratic Republic of the",
        43: "Cote D'Ivoire", 50: "Serbia and Montenegro", 52: "Cape Verde", 65: "Western Sahara", 71: "Falkland Islands (Malvinas)", 87: "South Georgia and the South Sandwich Islands", 92: "Hong Kong",
        104: "Iran, Islamic Republic of", 107: "Jersey", 116: "Saint Kitts and Nevis", 118: "Korea, Republic of", 134: "Saint Martin", 135: "Monaco", 137: "Madagascar", 139: "Macedonia, the Former Yugoslav Republic of",
        141: "Myanmar", 155: "Namibia", 175: "Saint Pierre and Miquelon", 178: "Palestinian Territory, Occupied", 183: "Reunion", 193: "Saint Helena", 195: "Svalbard and Jan Mayen", 202: "Sao Tome and Principe",
        206: "Turks and Caicos Islands", 213: "Timor-Leste", 217: "Türkiye", 220: "Taiwan, Province of China", 224: "United Kingdom", 228: "Holy See (Vatican City State)", 229: "Saint Vincent and the Grenadines",
        232: "Virgin Islands, U.S.", 233: "Viet Nam", 236: "Samoa", 239: "South Africa", 241: "Zimbabwe", 242: "Curaçao", 243: "Sint Maarten", 244: "Caribbean Netherlands", 245: "Montenegro", 247: "South Sudan", 250: "Kosovo",
    }
    assert {k: names[k] for k in known} == known and {k: names[k] for k in COUNTRIES} == COUNTRIES
    ids = spark.createDataFrame([(str(n),) for n in (-2, -1, 250, 251)], "countryId string")
    got = {r.countryId: r.Country for r in route.with_country(ids, "countryId", country_table(spark)).collect()}
    assert got == {"-2": "Unknown (ID: -2)", "-1": "Global", "250": "Kosovo", "251": "Unknown (ID: 251)"}


def test_numbers_of_values_that_share_their_letters(spark):
    """Many values with the same first letters are still ranked in several ranges."""
    n = 60_000
    keys = spark.range(n).select(F.lit("brn_type").alias("field_key"), F.format_string("same letters %06d", "id").alias("raw")).unionByName(spark.createDataFrame([("business_legal_form", "a"), ("business_legal_form", "b")], "field_key string, raw string"))
    got = audit.numbered(keys, range_rows=5_000)
    order = list(FIELDS)
    before = 2 if order.index("business_legal_form") < order.index("brn_type") else 0
    wrong = got.where(f"field_key = 'brn_type' and group_no <> cast(substring(raw, 14, 6) as int) + 1 + {before}").count()
    assert wrong == 0 and got.count() == n + 2 and got.select("group_no").distinct().count() == n + 2


def test_resolutions_of_any_size(spark):
    """A large table of resolutions isn't broadcast."""
    many = spark.range(3_000_000).select(F.lit("brn_type").alias("field_key"), F.col("id").cast("string").alias("raw"), F.lit("LEI").alias("resolution"))
    rows = spark.createDataFrame([("brn_type", "7", "")], "`Field Key` string, `Raw Value` string, Resolution string")
    out = audit.apply_resolutions(rows, many)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString() or "BuildLeft" in out._jdf.queryExecution().executedPlan().toString()
    assert out.first()["Resolution"] == "LEI"


def test_retry():
    waits = []
    state = {"left": 2}

    def call():
        state["left"] -= 1
        if state["left"] >= 0:
            raise external.TransientError("x")
        return "ok"

    assert external.call_with_retry(call, sleep=waits.append) == ("ok", 2, None)
    assert 1 <= waits[0] <= 1.25 and 2 <= waits[1] <= 2.5

    def wrong():
        raise KeyError("bug")

    with pytest.raises(KeyError):
        external.call_with_retry(wrong)


def test_sources(spark, tmp_path):
    tables.write_table(spark.createDataFrame([("NA", "7", " CEO "), ("GB", "N/A", 'say "x"')], "Country string, `Inputs ` string, other string"), f"{tmp_path}/t.csv", "csv")
    df = tables.read_table(spark, f"{tmp_path}/t.csv")
    assert tables.value_column(df) == "Inputs " and tables.country_column(df) == "Country" and tables.value_column(df, "OTHER") == "other"
    assert sorted(rows(df), key=str) == sorted([(None, "7", " CEO "), ("GB", None, 'say "x"')], key=str)
    both = spark.createDataFrame([("a", "b")], "value string, raw string")
    for bad, chosen in ((both, None), (both.select(F.lit(1).alias("z")), None), (both, "nope")):
        with pytest.raises(ValueError):
            tables.value_column(bad, chosen)
    tables.write_table(spark.createDataFrame([("UK", "N/A", "Unknown", "more")], "c string, r string, s string, x string"), f"{tmp_path}/m.parquet")
    assert rows(tables.read_master(spark, {"brn_type": f"{tmp_path}/m.parquet"})) == [("brn_type", "UK", "N/A", "Unknown")]
    assert tables.read_master(spark, {}).count() == 0
    assert tables.read_events(spark, f"{tmp_path}/none", tables.QUEUE).count() == 0


def test_handoff(spark):
    df = spark.createDataFrame([("a ", "Director", "F", " UK "), ("a", "Director", "F", "FR"), ("", "x", "F", "")], "v string, `Standardized Value` string, t string, country string")
    assert rows(stats.handoff(df, "v", "t")) == [("a", "Director", "F")]
    assert rows(stats.row_country_lists(df, "country", "t")) == [("F", "FR, UK")]
