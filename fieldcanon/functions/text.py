"""Column functions on raw values, labels and country ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import LEGACY_LABELS

_OTHER = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The white space that keys are collapsed on, all of Unicode's and the ASCII separators; a lone
#: space already is what it should be and isn't matched.
SPACES = rf"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"
#: What ends a line in a response.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def norm_key(value: Column) -> Column:
    """The value with white space collapsed and trimmed, null as ``''``; case is kept."""
    return F.coalesce(F.trim(F.regexp_replace(value.cast("string"), SPACES, " ")), F.lit(""))


def fix_label(label: Column, legacy: dict[str, str] = LEGACY_LABELS) -> Column:
    """Labels of older files as they are called now."""
    renamed = F.create_map(*(F.lit(x) for pair in legacy.items() for x in pair))
    return F.coalesce(F.try_element_at(renamed, label), label)


def numeric_id(value: Column) -> Column:
    """The whole part of a number written as text, else null (without Java's ``1d``, ``NaN`` and the like)."""
    text = F.trim(value.cast("string"))
    written = F.regexp_like(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    number = F.when(written, text).try_cast("double")
    return F.when(F.abs(number) < 9.2e18, number).cast("bigint")


def country_name(value: Column, found: Column) -> Column:
    """The country found for ``numeric_id(value)``, or a text that says that there is none."""
    number = numeric_id(value)
    return F.when(value.isNull(), "Unknown").when(number.isNull(), value.cast("string")).otherwise(F.coalesce(found, F.concat(F.lit("Unknown (ID: "), number.cast("string"), F.lit(")"))))


def quoted(value: Column) -> Column:
    """The text in single quotes, or in double quotes if it holds single ones only."""
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def short_name(display: Column) -> Column:
    """A field's display name without the abbreviation in brackets at its end."""
    return F.regexp_replace(display, r"\s*\([A-Z]+\)\s*$", "")
