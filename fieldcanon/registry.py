"""Fields, labels, field types and resolutions: the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATCH_ALL = "Other / Unclassified"
UNKNOWN_FIELD_TYPE = "Unknown field type"
ERROR_LABEL = "ERROR - Not Classified (API Failure)"
NEEDS_REVIEW = "Needs Review"

# Display name, labels (the last one is the catch-all), whether the country matters.
FIELDS: dict[str, tuple[str, tuple[str, ...], bool]] = {
    "business_legal_form": (
        "Business Legal Form (BLF)",
        (
            "Sole Proprietorship / Individual Business",
            "Partnership",
            "Company",
            "Non-Profit / Cooperative",
            "Trust / Fund / Scheme",
            "Foreign Entity / Branch",
            "Government / Public Sector Entity",
            CATCH_ALL,
        ),
        False,
    ),
    "positions_designations": (
        "Positions / Designations",
        ("Board Member", "Director", "Executive Management", "Owner / Controller", "Authorized Representative", CATCH_ALL),
        True,
    ),
    "business_status": ("Business Status", ("Active", "Inactive", "Pending / Insolvency", CATCH_ALL), False),
    "psc_beneficiary_type": ("PSC / Beneficiary Type", ("Root Business", "Owner / Beneficial Owner", "Controller", CATCH_ALL), False),
    "brn_type": (
        "BRN Type",
        ("Business Registration Number", "Tax ID Number", "VAT Number", "LEI", "Charity Number", "Proprietary / Third-party ID", CATCH_ALL),
        False,
    ),
    "directors_officers_type": ("DirectorsOfficers Type", ("Individual", "Business", CATCH_ALL), False),
    "business_entity_type": ("Business Entity Type", ("Individual", "Business", CATCH_ALL), False),
    "ownership_relationship_type": ("OwnershipRelationship Type", ("Individual", "Business", CATCH_ALL), False),
    "directors_officers_status": ("DirectorsOfficers Status", ("Active", "Resigned", CATCH_ALL), False),
    "ownership_relationship_status": ("OwnershipRelationship Status", ("Active", "Inactive", "Pending / Insolvency", CATCH_ALL), False),
}

# Field types of analytics exports, in lower case.
ANALYTICS_FIELD_TYPES = {
    "standardized designation": "positions_designations",
    "standardized position": "positions_designations",
    "business legal form": "business_legal_form",
    "universal business legal form": "business_legal_form",
    "business status": "business_status",
    "psc beneficiary type": "psc_beneficiary_type",
    "brn type": "brn_type",
    "directors officers type": "directors_officers_type",
    "business entity type": "business_entity_type",
    "ownership relationship type": "ownership_relationship_type",
    "directors officers status": "directors_officers_status",
    "ownership relationship status": "ownership_relationship_status",
}

# Values of a ``Field`` column, in lower case; the fields' own keys are values too.
STANDARD_FIELD_TYPES = {
    "designation": "positions_designations",
    "position": "positions_designations",
    "business legal form": "business_legal_form",
    "business status": "business_status",
    "psc beneficiary type": "psc_beneficiary_type",
    "brn type": "brn_type",
    "directors officers type": "directors_officers_type",
    "business entity type": "business_entity_type",
    "ownership relationship type": "ownership_relationship_type",
    "directors officers status": "directors_officers_status",
    "ownership relationship status": "ownership_relationship_status",
    "business_legal_form": "business_legal_form",
    "positions_designations": "positions_designations",
    "business_status": "business_status",
    "psc_beneficiary_type": "psc_beneficiary_type",
    "brn_type": "brn_type",
    "directors_officers_type": "directors_officers_type",
    "business_entity_type": "business_entity_type",
    "ownership_relationship_type": "ownership_relationship_type",
    "directors_officers_status": "directors_officers_status",
    "ownership_relationship_status": "ownership_relationship_status",
}

# Labels of older files. The audit and the validation know only the first two.
LEGACY_LABELS = {"Other / Unknown": CATCH_ALL, "Unknown": CATCH_ALL, "Owner/Controller": "Owner / Controller"}
LEGACY_LABELS_AUDIT = {k: v for k, v in LEGACY_LABELS.items() if v == CATCH_ALL}

KEEP = "keep_by_country"

# How conflicting raw values of a field are resolved: by one label, or by keeping each country's own.
_RESOLUTIONS = {
    "positions_designations": {
        "Administrator": KEEP,
        "Assistant General Manager": KEEP,
        "Associate": KEEP,
        "Commissioner": KEEP,
        "Communication Director": KEEP,
        "Controller": KEEP,
        "Director": KEEP,
        "Liquidating Agent": KEEP,
        "Manager": KEEP,
        "Member": KEEP,
        "Officer": KEEP,
        "President": KEEP,
        "President,President": KEEP,
        "Principal": KEEP,
        "Secretary": KEEP,
        "Sole Administrator": KEEP,
        "Treasurer": KEEP,
        "administration director": KEEP,
        "administrator": KEEP,
        "administrator,partner": KEEP,
        "ambassador": KEEP,
        "assistant director": KEEP,
        "ceo": KEEP,
        "chief executive officer": KEEP,
        "commissioner": KEEP,
        "company administrator": KEEP,
        "company formation agent": KEEP,
        "controller": KEEP,
        "cotas em tesouraria": KEEP,
        "director": KEEP,
        "director of finance": KEEP,
        "director of operations": KEEP,
        "entrepreneur": KEEP,
        "executive": KEEP,
        "executive director": KEEP,
        "financial director": KEEP,
        "managing director": KEEP,
        "managing director,director": KEEP,
        "managing director,partner": KEEP,
        "marketing director": KEEP,
        "mayor": KEEP,
        "operations director": KEEP,
        "personnel director": KEEP,
        "president": KEEP,
        "president,director": KEEP,
        "presidente": KEEP,
        "principal": KEEP,
        "production director": KEEP,
        "purchasing director": KEEP,
        "sales director": KEEP,
        "senior managing director": KEEP,
        "socio-administrador": KEEP,
        "sole managing administrator": KEEP,
        "sole trader": KEEP,
        "superintendent": KEEP,
        "supervisor": KEEP,
        "technical director": KEEP,
        "trustee": KEEP,
        "tutor": KEEP,
    },
    "business_legal_form": {
        "As": KEEP,
        "business name": KEEP,
        "headquarters": KEEP,
        "subsidiary": KEEP,
        "company": "Company",
        "non-stock": "Non-Profit / Cooperative",
    },
    "business_status": {
        "Pending": "Pending / Insolvency",
    },
    "psc_beneficiary_type": {
        "Partner": KEEP,
        "ORDINARY": "Owner / Beneficial Owner",
        "Person with Significant Control": "Controller",
        "unidentified share ownership": CATCH_ALL,
    },
    "brn_type": {
        "Business Identification Number (BIN)": "Business Registration Number",
        "CAGE": "Proprietary / Third-party ID",
        "CAN BUSINESS NUMBER": "Business Registration Number",
        "CRA Business Number": "Business Registration Number",
        "CRA Business Number incorporated in NS": "Business Registration Number",
        "CRA Business Number, incorporated in BC": "Business Registration Number",
        "CRA Business Number, incorporated in SK": "Business Registration Number",
        "Canadian Business Number": "Business Registration Number",
        "Commercial And Government Entity Code": "Proprietary / Third-party ID",
        "DNK ENTITY": "Business Registration Number",
        "Federal Business Number": "Business Registration Number",
        "Financial Conduct Authority Reference Number (GB)": "Proprietary / Third-party ID",
        "Provincial Business Number": "Business Registration Number",
        "SWIFT BIC CODE": "Proprietary / Third-party ID",
        "Tax ID Number - BN9": "Tax ID Number",
        "USA FEI NUMBER": "Proprietary / Third-party ID",
        "USA SAM UEI NUMBER": "Proprietary / Third-party ID",
        "USA SEC CIK NUMBER": "Proprietary / Third-party ID",
    },
    "ownership_relationship_type": {
        "Share Ownership": KEEP,
        "Unidentified Share Ownership": CATCH_ALL,
    },
    "ownership_relationship_status": {
        "Active (Revived)": "Active",
        "Dissolved": "Inactive",
        "Inactive - Cancellation of GP": "Inactive",
        "Pending": "Pending / Insolvency",
        "Resigned": "Inactive",
        "Start": CATCH_ALL,
    },
}
RESOLUTIONS: dict[tuple[str, str], str] = {(field, raw): to for field, pairs in _RESOLUTIONS.items() for raw, to in pairs.items()}

# The countries that have regional titles, and those that the registered queries meet
# besides, written down for tests and SQL. ``countries.country_table`` makes the whole dimension; another
# one can be read with ``sources.tables.read_countries``.
COUNTRIES = {
    -1: "Global",
    0: "Unknown",
    1: "Australia",
    2: "United States",
    15: "Austria",
    21: "Belgium",
    23: "Bulgaria",
    37: "Canada",
    42: "Switzerland",
    54: "Cyprus",
    55: "Czech Republic",
    56: "Germany",
    58: "Denmark",
    63: "Estonia",
    67: "Spain",
    69: "Finland",
    74: "France",
    80: "Gibraltar",
    86: "Greece",
    95: "Croatia",
    97: "Hungary",
    99: "Ireland",
    105: "Iceland",
    106: "Italy",
    125: "Liechtenstein",
    129: "Lithuania",
    130: "Luxembourg",
    131: "Latvia",
    135: "Monaco",
    148: "Malta",
    161: "Netherlands",
    162: "Norway",
    174: "Poland",
    179: "Portugal",
    184: "Romania",
    191: "Sweden",
    194: "Slovenia",
    196: "Slovakia",
    224: "United Kingdom",
}


def field_table(spark: SparkSession) -> DataFrame:
    """``field_key, field_order, display_name, labels, country_dependent``: one row a field."""
    rows = [(k, n, name, list(labels), by_country) for n, (k, (name, labels, by_country)) in enumerate(FIELDS.items())]
    return spark.createDataFrame(rows, "field_key string, field_order int, display_name string, labels array<string>, country_dependent boolean")


def field_type_table(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(types.items()), "type_text string, field_key string")


def resolution_table(spark: SparkSession) -> DataFrame:
    rows = [(f, raw, to) for (f, raw), to in RESOLUTIONS.items()]
    return spark.createDataFrame(rows, "field_key string, raw string, resolution string")
