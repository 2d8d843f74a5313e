"""The country dimension: numbers follow the two-letter codes of ISO 3166, names are those of the JVM's
English locale data, where no older name is fixed here."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

# Numbers without a country; codes that come first, and those that came later, in this
# order; codes without a number; what some are sorted as; codes that ISO has withdrawn or never had.
NUMBERS = {-1: "Global", 0: "Unknown"}
FIRST = ("AU", "US")
LATER = ("CW", "SX", "BQ", "ME", "RS", "SS", "GG", "IM", "XK")
NOT_NUMBERED = ("AX", "BL")
SORTED_AS = {"GB": "UK", "MF": "MB"}
NOT_IN_ISO = {"AN": "Netherlands Antilles", "CS": "Serbia and Montenegro", "XK": "Kosovo"}

# Names that differ from those of the locale data, or may differ in another version of it.
NAMES = {
    "BN": "Brunei Darussalam",
    "BQ": "Caribbean Netherlands",
    "CD": "Congo, the Democratic Republic of the",
    "CG": "Congo",
    "CI": "Cote D'Ivoire",
    "CV": "Cape Verde",
    "CZ": "Czech Republic",
    "FK": "Falkland Islands (Malvinas)",
    "FM": "Micronesia, Federated States of",
    "GS": "South Georgia and the South Sandwich Islands",
    "HK": "Hong Kong",
    "HM": "Heard Island and McDonald Islands",
    "IR": "Iran, Islamic Republic of",
    "KP": "Korea, Democratic People's Republic of",
    "KR": "Korea, Republic of",
    "LA": "Lao People's Democratic Republic",
    "LY": "Libyan Arab Jamahiriya",
    "MD": "Moldova, Republic of",
    "MK": "Macedonia, the Former Yugoslav Republic of",
    "MM": "Myanmar",
    "MO": "Macao",
    "PN": "Pitcairn",
    "PS": "Palestinian Territory, Occupied",
    "RE": "Reunion",
    "RU": "Russian Federation",
    "ST": "Sao Tome and Principe",
    "SY": "Syrian Arab Republic",
    "SZ": "Eswatini",
    "TR": "Türkiye",
    "TW": "Taiwan, Province of China",
    "TZ": "Tanzania, United Republic of",
    "UM": "United States Minor Outlying Islands",
    "VA": "Holy See (Vatican City State)",
    "VC": "Saint Vincent and the Grenadines",
    "VG": "Virgin Islands, British",
    "VI": "Virgin Islands, U.S.",
    "VN": "Viet Nam",
}


@functools.lru_cache(maxsize=1)
def _named(locale) -> dict[str, str]:
    found = {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}
    return {code: name.replace(" & ", " and ").replace("St. ", "Saint ") for code, name in found.items()}


def countries(spark: SparkSession) -> dict[int, str]:
    """Number and name of each country."""
    names = _named(spark.sparkContext._jvm.java.util.Locale) | NOT_IN_ISO | NAMES
    codes = sorted(set(names) - {*FIRST, *LATER, *NOT_NUMBERED}, key=lambda c: SORTED_AS.get(c, c))
    return NUMBERS | {n: names[code] for n, code in enumerate([*FIRST, *codes, *LATER], 1)}


def country_table(spark: SparkSession) -> DataFrame:
    """``country_id, country``."""
    return spark.createDataFrame(list(countries(spark).items()), "country_id bigint, country string")
