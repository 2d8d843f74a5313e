"""Inputs of the registered queries, derived from the driver's tables by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import CATCH_ALL, FIELDS

TITLES = (
    "CEO", "Chief Financial Officer", "Director", "President", "xyz123", "LLC", "GmbH", "subsidiary", "headquarters", "asdkjhqwe", "Managing Director", "Company Secretary", "Partner",
    "Secretary", "Manager of Nothing", "Limited Partnership", "Sole Trader", "company", "Pending", "Stichting", "Geschäftsführer", "Beneficial Owner", "Manager", "Controller",
    "Coordinator", "Government Agency", "Liquidator", "CAGE", "SWIFT BIC CODE", "Struck Off",
)
FIELD_KEYS = ("positions_designations", "business_legal_form", "business_status", "psc_beneficiary_type", "brn_type")
LABELS = tuple(label for k in FIELD_KEYS for label in FIELDS[k][1][:3])
COUNTRIES = ("United Kingdom", "Ireland", "Malta", "United States", "France", "Germany", "Netherlands", "Canada", "")
LEGACY = ("Other / Unknown", "Unknown", "Owner/Controller", "Not A Label")
COUNTRY_IDS = ("224", "80", "99", "148", "2", "37.0", "74", "56", "161", "1", "0", "-1", "999", "n/a", None)
#: A country of each table of regional titles, and some without one.
REGIONS = (
    "Austria", "Belgium", "Bulgaria", "Switzerland", "Cyprus", "Czech Republic", "Germany", "Denmark", "Estonia", "Spain", "Finland", "France", "Gibraltar", "Greece", "Croatia", "Hungary",
    "Ireland", "Iceland", "Italy", "Liechtenstein", "Lithuania", "Luxembourg", "Latvia", "Monaco", "Malta", "Netherlands", "Norway", "Poland", "Portugal", "Romania", "Sweden", "Slovenia",
    "Slovakia", "United Kingdom", "United States", "Canada", "",
)
#: Every character that keys take for white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FIELD_TYPES = (
    "Standardized Designation", "standardized position ", "Business Legal Form", "Business Status", "BRN Type", "PSC Beneficiary Type", "Mystery Type", None,
)

#: Values of a ``Field`` column.
FIELD_VALUES = ("Designation", " position", "business_legal_form", "Business Status", "BRN TYPE", "psc_beneficiary_type", "Odd 'Field'", None)
#: What a written table's values end with; those that are a text for "missing" stand alone.
ENDINGS = ("", ', "quoted"', "\nsecond line", ";", " ")
MISSING = ("N/A", "null", "nan", "")

#: Raw values for the queries on written rules.
RULE_VALUES: dict[str, tuple[str, ...]] = {
    "business_status": (
        "Good Standing", "Dissolved", "Struck Off", "In Liquidation", "Liquidation", "Active – Dissolution Pending", "Active", "Registered", "Inactive", "Unknown", "1", "Start",
        "Suspended", "Live Company", "Merged", "Company closed, in liquidation", "Active, in default", "Immatriculée", "Refer to Ministry of Finance", "Default",
    ),
    "directors_officers_status": ("Active", "Resigned", "Inactive", "Former director", "Currently serving", "Stepped Down", "Refer to Governing Jurisdiction", "In Office", "left", "???", "Retired", "appointed 2020"),
    "directors_officers_type": ("director", "corporate-director", "Corporate-LLP-Member", "llp-member", "managing-officer", "Nominee-Secretary", "xyz", "corporate", "Chairman", "secretary, retired"),
    "business_entity_type": ("business", "COMPANY", "Natural Person", "director", "Legal Entity", "Unknown", "robot", "Organisation", "Person", "personal company"),
    "ownership_relationship_type": (
        "corporate-entity-beneficial-owner", "7", "10", "A", "Class A Common", "COMMON", "Person", "Parent", "Share Ownership", "Voting Shareholder", "Voting Shares", "Holding corporation", "natural person", "zzz",
    ),
    "psc_beneficiary_type": (
        "Corporate body", "PSC with control", "Controlling ISC", "PSC (Person with Significant Control)", "Company", "Corporate Beneficial Owner", "Ultimate Parent", "Parent", "Beneficial Owner", "Managing Partner", "General Partner", "Director", "Signatory, joint", "Holding Company owner", "Guardian", "BO", "UBO", "Members", "Governor", "bob", "Process Agent",
    ),
    "brn_type": (
        "LEI", "Legal Entity Identifier", "Value Added Tax Number (BE)", "Value Added Tax Number", "GST/HST Account Number", "GST/HST number is not valid",
        "GST/HST number registered on this transaction date", "CRA Business Number incorporated in NS", "CRA Business Number, incorporated in SK", "CRA Business Number", "SIREN", "UK COMPANY NUMBER",
        "RNA Registration Number", "CAGE", "XXX ACURIS ID", "Business Registration Number - Branch", "Registration Number", "whatever", "Charity Commission of Northern Ireland Charity Number (GB)", "CNPJ",
    ),
    "business_legal_form": (
        "Public Limited", "Limited by guarantee", "Domestic Corporation", "Alien corporation", "Limited Liability Partnership (LLP)", "Joint Venture LLC", "Joint Venture Company", "Limited Partnership", "LLC / Partnership", "GmbH & Co. KG", "Sole Trader", "Credit Union", "Unit Trust", "Foreign company (RCS)", "Statutory body",
        "Business Name", "S.A.", "management", "limited", "Enkeltpersonforetak (ENK)", "Stichting", "Sub", "N/A", "Holdco", "asbl",
    ),
    "positions_designations": TITLES + ("Vorstand", "Bestuurder", "Directeur Général", "Executive Director", "General Manager", "Governor", "Insolvency Practitioner", "Official Receiver")
    + (
        "Lid van de Raad van Bestuur", "Zaakvoerder", "Член на съвета", "Управител", "Verwaltungsrat", "Πρόεδρος ΔΣ", "Γενικός Διευθυντής", "Představenstvo", "Jednatel", "Bestyrelsesmedlem",
        "Direktør", "Juhatuse liige", "Consejero", "Director General", "Hallituksen jäsen", "Toimitusjohtaja", "Nadzorni odbor", "Direktor", "Igazgatósági tag", "Igazgató", "Stjórnarmaður",
        "Amministratore Delegato", "Direttore Generale", "Stiftungsrat", "Valdybos narys", "Gérant", "Padomes loceklis", "Membre du Conseil", "Membru tal-Bord", "Styremedlem", "Daglig leder",
        "Prezes Zarządu", "Administrador", "Cenzor", "Administrator", "Styrelseledamot", "Verkställande direktör (VD)", "Upravni odbor", "Predstavenstvo", "Konateľ", "Operations Director",
    ),
}


def pick(values: tuple, index: Column) -> Column:
    """The value at a place counted from 0."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analytics export: ``row_id, countryId, fieldType, inputText``."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, base, white = F.col("o_orderkey"), F.col("base"), pick(tuple(WHITE), F.floor(F.col("o_orderkey") / 13) % len(WHITE))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("base", pick(TITLES, F.col("o_custkey") % 30))
    text = (
        F.when(key % 13 == 0, None)
        .when(key % 13 == 1, "   ")
        .when(key % 13 == 2, F.concat(white, F.lit(" "), base, white))
        .when(key % 13 == 3, F.replace(base, F.lit(" "), F.concat(F.lit(" "), white)))
        .when(key % 13 == 4, F.upper(base))
        .otherwise(base)
    )
    return rows.select(key.alias("row_id"), pick(COUNTRY_IDS, F.col("c_nationkey") % 15).alias("countryId"), pick(FIELD_TYPES, key % 8).alias("fieldType"), text.alias("inputText"))


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a ``Field`` column: ``row_id, Country, Field, Value``."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, base = F.col("o_orderkey"), pick(TITLES, F.col("o_custkey") % 30)
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    value = F.when(key % 11 == 0, None).when(key % 11 == 1, F.concat(base, F.lit(" "))).otherwise(base)
    return rows.select(key.alias("row_id"), pick(COUNTRIES, F.col("c_nationkey") % 9).alias("Country"), pick(FIELD_VALUES, key % 8).alias("Field"), value.alias("Value"))


def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as files hold them, with texts for "missing": ``row_id, Country, Raw Value``."""
    key = F.col("o_orderkey")
    text = F.when(key % 5 == 0, pick(MISSING, F.floor(key / 5) % 4)).otherwise(F.concat(pick(TITLES, F.col("o_custkey") % 30), pick(ENDINGS, key % 5)))
    return table(spark, sf_dir, "orders").select(key.cast("string").alias("row_id"), pick(COUNTRIES[:8], key % 8).alias("Country"), text.alias(" Raw Value"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master mapping: ``field_key, country, raw, std``."""
    lines, supplier = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    f, c = F.col("l_partkey") % 5, F.col("s_nationkey") % 9
    r = F.floor(F.col("l_partkey") / 5) % 30
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(f.alias("f"), c.alias("c"), r.alias("r"), "l_suppkey")
    k, c = F.col("r") % 5, F.col("c")
    p = F.when(k == 2, c % 2).when((k == 3) & (c < 4), c % 2).when(k == 3, F.col("l_suppkey") % 3).otherwise(F.col("r") % 3)
    std = F.when(k == 4, pick(LEGACY, F.floor(F.col("r") / 5) % 4)).otherwise(pick(LABELS, F.col("f") * 3 + p))
    return rows.select(pick(FIELD_KEYS, F.col("f")).alias("field_key"), pick(COUNTRIES, c).alias("country"), pick(TITLES, F.col("r")).alias("raw"), std.alias("std"))


def rule_values(spark: SparkSession, sf_dir: str, field_key: str) -> DataFrame:
    """``row_id, country, raw`` for a field's written rules; every third value in capitals."""
    values = RULE_VALUES[field_key]
    places = REGIONS if field_key == "positions_designations" else COUNTRIES
    raw = pick(values, F.col("o_custkey") % len(values))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), pick(places, F.col("o_orderkey") % len(places)).alias("country"), F.when(F.col("o_orderkey") % 3 == 0, F.upper(raw)).otherwise(raw).alias("raw")
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items sent to a client in batches of 20: ``batch_id, idx, raw``."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(key / 20).alias("batch_id"), (key % 20 + 1).alias("idx"), pick(TITLES, F.col("o_custkey") % 30).alias("raw"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client answered: ``batch_id, response``, with every kind of fault."""
    key = F.col("o_orderkey")
    labels = FIELDS["positions_designations"][1]
    rows = table(spark, sf_dir, "orders").select(F.floor(key / 20).alias("batch_id"), (key % 20 + 1).alias("i"), (key % 11).alias("m"), pick(labels, F.col("o_custkey") % 6).alias("label"))
    head = F.concat(F.col("i").cast("string"), F.lit(". "), F.col("label"))
    line = (
        F.when(F.col("m") == 1, F.concat(head, F.lit(" | MEDIUM | Reason: close call")))
        .when(F.col("m") == 2, F.concat(head, F.lit(" | LOW | Alternatives: Director, , Board Member | Reason: too short")))
        .when(F.col("m") == 3, head)
        .when(F.col("m") == 4, None)
        .when(F.col("m") == 5, F.concat(head, F.lit(" | HIGH\n"), F.col("i").cast("string"), F.lit(f") {CATCH_ALL} | low")))
        .when(F.col("m") == 6, F.concat((F.col("i") + 100).cast("string"), F.lit(". "), F.col("label"), F.lit(" | HIGH")))
        .otherwise(F.concat(head, F.lit(" | HIGH")))
    )
    lines = F.transform(F.reverse(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("i", line.alias("line")))))), lambda x: x["line"])
    wrong = F.col("batch_id") % 7 == 0
    total = F.when(wrong, "[Total: 19 of 21 mapped]").otherwise("[Total: 20 of 20 mapped]")
    return rows.groupBy("batch_id").agg(F.array_join(lines, "\n").alias("lines")).select("batch_id", F.concat("lines", F.lit("\n"), total).alias("response"))


def _event_key(user: Column) -> list[Column]:
    return [pick(FIELD_KEYS, user % 5).alias("field_key"), pick(COUNTRIES, F.floor(user / 5) % 9).alias("country"), pick(TITLES, user % 30).alias("raw_value")]


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections sent in: every event that isn't a decision."""
    events, user = table(spark, sf_dir, "events"), F.col("user_id")
    return events.where("event_type not in ('purchase', 'error')").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("submitted_at"), *_event_key(user), pick(LABELS, user % 5 * 3 + F.col("event_id") % 3).alias("proposed")
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase approves, and an error rejects, the same user's latest submission before it."""
    decided = F.col("event_type").isin("purchase", "error")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(~decided, F.col("event_id")), ignorenulls=True).over(before)
    rows = table(spark, sf_dir, "events").withColumn("id", target).where(decided & F.col("id").isNotNull())
    return rows.select(
        "id",
        F.when(F.col("event_type") == "purchase", "approve").otherwise("reject").alias("action"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("decided_at"),
        F.col("event_id").alias("seq"),
        F.lit("").alias("note"),
        (F.col("event_id") % 2 == 0).alias("needs_update"),
    )
