"""Column expressions that turn source text into JSON documents and typed values.

Everything stays a built-in expression, so it runs inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a value.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Strict JSON without a limit on the length of strings; NaN and Infinity are read.
JSON_OPTIONS = {"allowSingleQuotes": "false", "maxStringLen": str(2**31 - 1)}
INTEGER_TEXT = r"^[+-]?[0-9]+$"
NUMBER_TEXT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
DATED_TEXT = r"^\d{4}-\d{2}-\d{2}"
COMPACT_TEXT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?"


def strip(value: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def clean_text(value: Column) -> Column:
    """Stripped text; blank becomes NULL."""
    return F.nullif(strip(value), F.lit(""))


def whole_document(text: Column) -> Column:
    """Parse a JSON text so that ``document_root`` can tell whether it was read to its end.

    Parsing stops after the first value and ignores what follows, so ``{"a":1} x`` would
    pass. Here the text becomes the first element of an array and its own hash the second:
    a text with anything after the first value either fails to parse or hides the hash.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]"))
    return F.from_json(wrapped, "variant", JSON_OPTIONS)


def document_root(wrapped: Column, text: Column) -> Column:
    """The parsed value behind ``whole_document``, or NULL if the text is not one JSON value."""
    complete = F.try_variant_get(wrapped, "$[1]", "bigint").eqNullSafe(F.xxhash64(text))
    return F.when(complete, F.try_variant_get(wrapped, "$[0]", "variant"))


def large_document(text: Column, columns: str) -> Column:
    """Members of a JSON object that is too large to be one JSON value, or NULL.

    Each member is read as what ``columns`` says, so that only single members have to fit.
    As in ``whole_document``, the text's hash has to follow it, here in an object.
    """
    own_hash = F.xxhash64(text)
    wrapped = F.concat(F.lit("["), text, F.lit(',{"_hash":'), own_hash.cast("string"), F.lit("}]"))
    found = F.from_json(wrapped, f"array<struct<{columns}, `_hash`: bigint>>", JSON_OPTIONS)

    def first(parts: Column) -> Column:
        whole = (F.size(parts) == 2) & (F.get(parts, F.lit(1))["_hash"] == own_hash)
        return F.when(whole, F.get(parts, F.lit(0)))

    # A list of one, so that the text is parsed once, however often the result is used.
    return F.get(F.transform(F.array(found), first), F.lit(0))


def fields_of(
    document: Column, texts: Iterable[str], values: Iterable[str] = ()
) -> Column:
    """Members of a JSON object as one struct, in one pass; NULL if it is not an object.

    ``texts`` are read as text, ``values`` stay JSON values. Keys may contain dots.
    """
    wanted = [f"`{key}`: string" for key in texts] + [f"`{key}`: variant" for key in values]
    return F.try_variant_get(document, "$", f"struct<{', '.join(wanted)}>")


def json_text(value: Column) -> Column:
    """JSON text of a value; strings are kept as they are and JSON null is NULL."""
    as_text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(as_text, F.nullif(F.to_json(value), F.lit("null")))


def to_decimal_number(value: Column) -> Column:
    """Double from text; not a number is NULL (Spark alone would accept ``1d`` or ``NaN``)."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.cast("double"))


def to_whole_number(value: Column, as_type: str = "bigint") -> Column:
    """Integer from text: half rounds to even, not a number or out of range is NULL."""
    text = strip(value.cast("string"))
    return (
        F.when(text.rlike(INTEGER_TEXT), text.try_cast(as_type))
        .when(text.rlike(NUMBER_TEXT), F.rint(text.cast("double")).try_cast(as_type))
    )


def to_flag(value: Column) -> Column:
    """``true`` and ``false`` in any case; everything else is NULL."""
    text = F.lower(strip(value.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def to_utc(value: Column) -> Column:
    """Timestamp from ISO text; times without a zone are UTC, other text is NULL.

    The date has to be there: Spark alone reads ``10:00`` as today. ISO's compact form,
    without dashes and colons, is written out first.
    """
    text = strip(value)
    seconds = F.coalesce(F.nullif(F.regexp_extract(text, COMPACT_TEXT, 6), F.lit("")), F.lit("00"))
    written = F.concat(
        F.regexp_replace(F.regexp_extract(text, COMPACT_TEXT, 0), COMPACT_TEXT, "$1-$2-$3T$4:$5:"),
        seconds,
        F.regexp_replace(text, COMPACT_TEXT, ""),
    )
    return (
        F.when(text.rlike(DATED_TEXT), F.try_to_timestamp(text))
        .when(text.rlike(COMPACT_TEXT), F.try_to_timestamp(written))
    )


def snake_case(name: str) -> str:
    """Column name in lower case words joined by underscores."""
    words = re.findall(r"[0-9A-Za-z]+", name)
    split = [re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", word) for word in words]
    return "_".join(split).lower()
