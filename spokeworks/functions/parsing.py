"""Text to typed columns: every landed value arrives as a string.

All parsers answer NULL for text they cannot read; ``is_bad`` tells such a
value from one that was missing in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The texts pandas' CSV reader takes for a missing value by default.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

#: Timestamp layouts by name: (pattern of the whole text, rewrite to ISO order).
#: A ``None`` rewrite leaves the text as it is.
TIMESTAMP_LAYOUTS = {
    # 2023-03-06 14:05[:59[.123]]
    "iso": (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$", None),
    # 6/1/2019 0:05[:59]
    "month_first": (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)$", "$3-$1-$2 $4"),
    # 18/12/2019 14:05
    "day_first_minutes": (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2})$", "$3-$2-$1 $4"),
    # 2023-03-06 14:05
    "iso_minutes": (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", None),
}


def blank_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TOKENS), text)


def parse_timestamp(text: Column, layouts: tuple[str, ...]) -> Column:
    """Wall-clock timestamp in the first layout that fits; no session zone involved."""
    parsed = []
    for name in layouts:
        pattern, rewrite = TIMESTAMP_LAYOUTS[name]
        iso = text if rewrite is None else F.regexp_replace(text, pattern, rewrite)
        parsed.append(F.when(text.rlike(pattern), iso.try_cast("timestamp_ntz")))
    return F.coalesce(*parsed)


def parse_long(text: Column) -> Column:
    """Whole number; a decimal text such as ``1985.0`` is rounded like a database cast."""
    return F.coalesce(text.try_cast("bigint"), F.rint(text.try_cast("double")).try_cast("bigint"))


def parse_typed(text: Column, kind: str, layouts: tuple[str, ...] = ("iso",)) -> Column:
    """One parser per declared kind: text, long, double or timestamp."""
    if kind == "string":
        return text
    if kind == "bigint":
        return parse_long(text)
    if kind == "double":
        return text.try_cast("double")
    if kind == "timestamp_ntz":
        return parse_timestamp(text, layouts)
    raise ValueError(f"no parser for kind {kind!r}")


def is_bad(text: Column, parsed: Column) -> Column:
    """A value was there but could not be read as the declared kind."""
    return text.isNotNull() & parsed.isNull()
