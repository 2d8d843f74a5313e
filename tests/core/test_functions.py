import pytest
from pyspark.sql import functions as F

from fieldcanon.functions.classify import classify
from fieldcanon.functions.text import country_name, fix_label, norm_key, numeric_id, quoted, short_name
from fieldcanon.operators.rules import compliance_flag, governor, label_by_rules, position_by_region
from fieldcanon.registry import CATCH_ALL, FIELDS, LEGACY_LABELS_AUDIT, RESOLUTIONS

SPACES = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_norm_key_is_split_and_join(spark):
    values = ["a b", "  CEO\t\tof  it ", "", "   ", None, "x​y", *(f"{s}a{s}{s}b{s}" for s in SPACES), "\x00a", "A﻿"]
    assert column(spark, values, norm_key) == [" ".join((v or "").split()) for v in values]


def test_labels_of_older_files(spark):
    values = ["Other / Unknown", "Unknown", "Owner/Controller", "Director", None]
    assert column(spark, values, fix_label) == [CATCH_ALL, CATCH_ALL, "Owner / Controller", "Director", None]
    assert column(spark, values, lambda c: fix_label(c, LEGACY_LABELS_AUDIT))[2] == "Owner/Controller"


def test_country_ids(spark):
    values = ["224", "224.0", " 80 ", "-1", "37.9", "1e2", "999", "n/a", "1d", "nan", "inf", "", None, "1" * 30]
    assert column(spark, values, numeric_id) == [224, 224, 80, -1, 37, 100, 999, None, None, None, None, None, None, None]
    got = column(spark, values, lambda c: country_name(c, F.when(numeric_id(c) == 224, "United Kingdom")))
    assert got[:2] == ["United Kingdom"] * 2 and got[6:13] == ["Unknown (ID: 999)", "n/a", "1d", "nan", "inf", "", "Unknown"]


def test_quoted_is_repr(spark):
    values = ["Mystery Type", "it's", 'say "x"', "it's \"x\"", "back\\slash"]
    assert column(spark, values, quoted) == [repr(v) for v in values]


def test_short_name(spark):
    assert column(spark, ["Business Legal Form (BLF)", "BRN Type", "X (a)"], short_name) == ["Business Legal Form", "BRN Type", "X (a)"]


def test_resolutions_are_all_there():
    assert len(RESOLUTIONS) == 96 and sum(v == "keep_by_country" for v in RESOLUTIONS.values()) == 65
    assert {k for k, _ in RESOLUTIONS} <= set(FIELDS)


@pytest.mark.parametrize(
    "field, country, raw, std, confidence",
    [
        ("positions_designations", "", "General Manager", CATCH_ALL, "HIGH"),
        ("positions_designations", "", "Company Secretary", CATCH_ALL, "HIGH"),
        ("positions_designations", "", "Secretary", "Executive Management", "HIGH"),
        ("positions_designations", "GB", "Managing Director", "Board Member", "HIGH"),
        ("positions_designations", "France", "Managing Director", "Director", "HIGH"),
        ("positions_designations", "Gibraltar", "CEO", "Board Member", "HIGH"),
        ("positions_designations", "US", "CEO", "Executive Management", "HIGH"),
        ("positions_designations", "IE", "oceor", "Executive Management", "HIGH"),
        ("positions_designations", "", "Coordinator", "Executive Management", "HIGH"),
        ("positions_designations", "", "Ned", CATCH_ALL, "LOW"),
        ("positions_designations", "", "Fred Ned", "Board Member", "HIGH"),
        ("positions_designations", "", "xyz123", CATCH_ALL, "LOW"),
        ("positions_designations", "", "REPRÉSENTANT légal", "Authorized Representative", "HIGH"),
        ("business_legal_form", "", "Limited Partnership", "Partnership", "HIGH"),
        ("business_legal_form", "", "Government Agency", "Government / Public Sector Entity", "HIGH"),
        ("business_legal_form", "", "Management", CATCH_ALL, "LOW"),
        ("business_legal_form", "", "Muster AG", "Company", "HIGH"),
        ("business_legal_form", "", "cooperative credit unions", "Non-Profit / Cooperative", "HIGH"),
        ("business_status", "", "Active", CATCH_ALL, "LOW"),
        ("positions_designations", "", "", CATCH_ALL, "LOW"),
    ],
)
def test_keyword_cascades(spark, field, country, raw, std, confidence):
    c = spark.range(1).select(classify(F.lit(field), F.lit(raw), F.lit(country)).alias("c")).first().c
    assert (c.std, c.confidence) == (std, confidence)
    assert c.alternatives == ([] if confidence == "HIGH" else [x for x in FIELDS[field][1] if x != CATCH_ALL][:2])
    assert bool(c.reasoning) == (confidence == "LOW")


def test_an_unknown_field_gets_nothing(spark):
    assert spark.range(1).select(classify(F.lit(None).cast("string"), F.lit("x"), F.lit("")).alias("c")).first().c is None


@pytest.mark.parametrize(
    "field, raw, label",
    [
        ("business_status", "Active – Dissolution Pending", "Pending / Insolvency"),
        ("business_status", "Company dissolved, was in liquidation", "Inactive"),
        ("business_status", "Start", CATCH_ALL),
        ("ownership_relationship_status", "Good Standing", "Active"),
        ("directors_officers_status", "Inactive", CATCH_ALL),
        ("directors_officers_status", "Former", "Resigned"),
        ("directors_officers_type", "corporate-llp-member", "Business"),
        ("directors_officers_type", "llp-member", "Individual"),
        ("business_entity_type", "ORGANISATION", "Business"),
        ("ownership_relationship_type", "42", CATCH_ALL),
        ("ownership_relationship_type", "x", CATCH_ALL),
        ("ownership_relationship_type", "Class A Common", CATCH_ALL),
        ("ownership_relationship_type", "corporate-anything", "Business"),
        ("psc_beneficiary_type", "Ultimate Parent", "Root Business"),
        ("psc_beneficiary_type", "Parent", CATCH_ALL),
        ("psc_beneficiary_type", "Managing Partner", "Controller"),
        ("brn_type", "Value Added Tax Number (DE)", "VAT Number"),
        ("brn_type", "GST/HST Account Number", "VAT Number"),
        ("brn_type", "GST/HST number registered on this transaction date", CATCH_ALL),
        ("brn_type", "RNA Registration Number", "Charity Number"),
        ("business_legal_form", "Joint Venture LLC", "Company"),
        ("business_legal_form", "Joint Venture Company", "Partnership"),
        ("business_legal_form", "Public Limited", "Company"),
        ("business_legal_form", "Limited by guarantee", "Company"),
        ("business_legal_form", "Domestic Corporation", "Company"),
        ("business_legal_form", "Alien corporation", "Foreign Entity / Branch"),
        ("business_legal_form", "Foreign company (RCS)", "Foreign Entity / Branch"),
        ("business_legal_form", "Limited Partnership", "Partnership"),
        ("business_legal_form", "Limited Liability Partnership (LLP)", "Partnership"),
        ("business_legal_form", "Private Limited Company", "Company"),
        ("business_legal_form", "limited", "Company"),
        ("psc_beneficiary_type", "Corporate body", "Root Business"),
        ("psc_beneficiary_type", "Company", "Root Business"),
        ("psc_beneficiary_type", "Registered Company", "Root Business"),
        ("psc_beneficiary_type", "Foreign Corporation Record", "Root Business"),
        ("psc_beneficiary_type", "Corporate Entity (overseas)", "Root Business"),
        ("psc_beneficiary_type", "Other Legal Entity", "Root Business"),
        ("psc_beneficiary_type", "Company Secretary", "Controller"),
        ("psc_beneficiary_type", "Corporate Director", "Controller"),
        ("psc_beneficiary_type", "Company Shareholder", "Owner / Beneficial Owner"),
        ("psc_beneficiary_type", "PSC with control", "Controller"),
        ("psc_beneficiary_type", "Controlling ISC", "Controller"),
        ("psc_beneficiary_type", "PSC", "Owner / Beneficial Owner"),
        ("psc_beneficiary_type", "Person with Significant Control (PSC)", "Owner / Beneficial Owner"),
        ("psc_beneficiary_type", "PSC (Person with Significant Control)", "Owner / Beneficial Owner"),
        ("psc_beneficiary_type", "Corporate Beneficial Owner", "Owner / Beneficial Owner"),
        ("psc_beneficiary_type", "Holding Company owner", "Root Business"),
        ("brn_type", "CRA Business Number, incorporated in SK", "Tax ID Number"),
        ("brn_type", "Business Registration Number - Head Office", "Business Registration Number"),
        ("brn_type", "Charity Commission of Northern Ireland Charity Number (GB)", "Charity Number"),
    ],
)
def test_written_rules(spark, field, raw, label):
    assert spark.range(1).select(label_by_rules(field, F.lit(raw))).first()[0] == label


def test_regional_titles_of_any_number_of_countries(spark):
    """The expression doesn't grow with the cascade that it falls back on, and its code compiles."""
    df = spark.createDataFrame([("Bestuurder", "NL")], "raw string, country string").withColumn("general", classify(F.lit("positions_designations"), F.col("raw"), F.col("country"))["std"])
    plan = df.select(position_by_region(F.col("raw"), F.col("country"), F.col("general")).alias("label"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000  # it was 207,000
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = spark.range(1000).select(F.lit("Bestuurder").alias("raw"), F.when(F.col("id") % 2 == 0, "NL").otherwise("CA").alias("country")).repartition(2).withColumn("general", F.lit("Director"))
        counts = rows.groupBy(position_by_region(F.col("raw"), F.col("country"), F.col("general")).alias("label")).count().collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert {r.label: r["count"] for r in counts} == {"Board Member": 500, "Director": 500}


def test_regional_titles(spark):
    cases = [
        ("NL", "Bestuurder", "Director", "Board Member"),
        ("Belgium", "Bestuurder", "Director", "Board Member"),
        ("Canada", "Bestuurder", "Director", "Director"),
        ("Austria", "Vorsitzender", "Other / Unclassified", "Board Member"),
        ("BG", "Член на съвета", "Other / Unclassified", "Board Member"),
        ("Bulgaria", "УПРАВИТЕЛ", "Other / Unclassified", "Executive Management"),
        ("Switzerland", "Präsident des Verwaltungsrats", "Other / Unclassified", "Board Member"),
        ("Cyprus", "Διοικητικός Σύμβουλος", "Other / Unclassified", "Board Member"),
        ("Greece", "ΠΡΌΕΔΡΟΣ ΔΣ", "Other / Unclassified", "Board Member"),
        ("Czech Republic", "Jednatel", "Other / Unclassified", "Executive Management"),
        ("Denmark", "Bestyrelsesformand", "Other / Unclassified", "Board Member"),
        ("Estonia", "Juhatuse liige", "Other / Unclassified", "Board Member"),
        ("Spain", "Director General", "Director", "Executive Management"),
        ("Spain", "Director de Departamento", "Director", "Executive Management"),
        ("Finland", "Toimitusjohtaja", "Other / Unclassified", "Executive Management"),
        ("Croatia", "Nadzorni odbor", "Other / Unclassified", "Board Member"),
        ("Hungary", "Igazgatósági tag", "Other / Unclassified", "Board Member"),
        ("Iceland", "Stjórnarmaður", "Other / Unclassified", "Board Member"),
        ("Italy", "Amministratore Delegato", "Director", "Board Member"),
        ("Liechtenstein", "Prokurist", "Authorized Representative", "Authorized Representative"),
        ("Lithuania", "Direktorius", "Other / Unclassified", "Executive Management"),
        ("Luxembourg", "Administrateur", "Director", "Board Member"),
        ("Latvia", "Valdes loceklis", "Other / Unclassified", "Board Member"),
        ("Monaco", "Membre du Conseil", "Other / Unclassified", "Board Member"),
        ("Malta", "Direttur Mhux Eżekuttiv (NED)", "Other / Unclassified", "Board Member"),
        ("Norway", "Daglig leder", "Other / Unclassified", "Executive Management"),
        ("Poland", "Prezes Zarządu", "Other / Unclassified", "Board Member"),
        ("Portugal", "Administrador", "Other / Unclassified", "Board Member"),
        ("Romania", "Administrator", "Other / Unclassified", "Executive Management"),
        ("Romania", "Membru al Consiliului de Administrație", "Other / Unclassified", "Board Member"),
        ("Sweden", "Verkställande direktör (VD)", "Other / Unclassified", "Executive Management"),
        ("Slovenia", "Upravni odbor", "Other / Unclassified", "Board Member"),
        ("Slovakia", "Predseda predstavenstva", "Other / Unclassified", "Board Member"),
        ("Gibraltar", "Department Head", "Other / Unclassified", "Other / Unclassified"),
        ("UK", "Operations Director", "Director", "Executive Management"),
        ("", "CEO", "Executive Management", "Executive Management"),
    ]
    df = spark.createDataFrame(cases, "country string, raw string, general string, expected string")
    got = df.select(position_by_region(F.col("raw"), F.col("country"), F.col("general")), "expected").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    more = spark.createDataFrame([("Governor", "LLC"), ("Governor", "Corp"), ("CEO", "LLC")], "raw string, form string")
    assert [r[0] for r in more.select(governor(F.col("raw"), F.col("form"), F.lit("x"))).collect()] == ["Owner / Controller", "Director", "x"]
    assert column(spark, ["Official Liquidator", "Receiver", "CEO"], compliance_flag) == [True, True, False]
