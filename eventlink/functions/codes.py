"""Codes typed by hand or cut from extracts: zones, orders, postcodes, grid references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers the extracts use for "no value".
NOT_ASSIGNED = "Not assigned"
EXTRACT_SENTINELS = ("Not assigned", "#", "#/#")

NO_OPERATION = "00"


def zero_fill(code: Column, width: int = 5) -> Column:
    """Pad on the left with zeros. ``lpad`` alone would also cut longer codes, which must stay."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def zone_code(code: Column) -> Column:
    """Text zone code as at least five digits."""
    return zero_fill(F.trim(code))


def zone_code_from_number(code: Column) -> Column:
    """Zone code loaded as an integer or a float."""
    return zero_fill(code.cast("bigint").cast("string"))


def zone_free_text(code: Column) -> Column:
    """Zone typed by hand: drop slashes, spaces and stars, then pad."""
    return zero_fill(F.translate(code, "/ *", ""))


def integer_text(text: Column) -> Column:
    """Canonical text of a whole number; null for anything else, ``'7.9'`` included."""
    whole = text.rlike(r"^\s*[+-]?[0-9]{1,38}\s*$")
    return F.when(whole, F.trim(text).try_cast("decimal(38,0)").cast("string"))


def zone_from_district(district: Column, number: Column) -> Column:
    """District and up to three digits within it, such as 8 and 65 giving ``08065``."""
    return zero_fill(F.concat(integer_text(district), zero_fill(integer_text(number), 3)))


def digit_prefix(code: Column, width: int = 5) -> Column:
    """The first characters where they are all digits, else null."""
    prefix = F.substring(code, 1, width)
    return F.when(prefix.rlike("^[0-9]+$"), prefix)


def crop(code: Column, width: int = 5) -> Column:
    return F.substring(code, 1, width)


def has_prefix(code: Column, prefix: str) -> Column:
    return code.startswith(prefix)


def order_op(order: Column, operation: Column | None = None) -> Column:
    """``order/operation``; an extract without operations gets ``00``."""
    op = F.lit(NO_OPERATION) if operation is None else operation.cast("string")
    return F.concat(order.cast("string"), F.lit("/"), op)


def order_op_integers(order: Column, operation: Column) -> Column:
    """``order/operation`` from text that must hold whole numbers, else null."""
    return F.concat(integer_text(order), F.lit("/"), integer_text(operation))


def order_part(order_and_op: Column) -> Column:
    return F.try_element_at(F.split(order_and_op, "[/-]"), F.lit(1))


def operation_part(order_and_op: Column) -> Column:
    return F.try_element_at(F.split(order_and_op, "[/-]"), F.lit(2))


def as_number(text: Column, kind: str = "bigint") -> Column:
    """Number from text with thousands separators; null where it is none, NaN included."""
    number = F.regexp_replace(text, ",", "").try_cast(kind)
    return F.when(~F.isnan(number), number) if kind in ("double", "float") else number


def lenient_order(text: Column) -> Column:
    """Order number as canonical text.

    The whole text if it is an integer, else the first or second of the pieces between spaces,
    ``&``, ``-`` and ``/`` that is one, else the text as it stands.
    """
    pieces = F.split(text, "[ &/-]")
    first = F.try_element_at(pieces, F.lit(1))
    second = F.try_element_at(pieces, F.lit(2))
    return F.coalesce(integer_text(text), integer_text(first), integer_text(second), text)


def lenient_order_from_number(number: Column) -> Column:
    return number.cast("bigint").cast("string")


def strip_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def postcode(text: Column) -> Column:
    return F.upper(strip_spaces(text))


def grid_x(pair: Column) -> Column:
    """First six characters of a joined easting and northing."""
    return F.when(pair != NOT_ASSIGNED, F.substring(pair, 1, 6))


def grid_y(pair: Column) -> Column:
    return F.when(pair != NOT_ASSIGNED, F.right(pair, F.lit(6)))


def null_if_listed(value: Column, sentinels=EXTRACT_SENTINELS) -> Column:
    return F.when(~value.isin(*sentinels), value)


def null_if(value: Column, sentinel) -> Column:
    return F.nullif(value, F.lit(sentinel))


def list_codes(text: Column, width: int = 5) -> Column:
    """Comma list to an array of padded codes, blanks left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: zero_fill(p, width))


def content_key(*columns: str) -> Column:
    """A digest of the columns' values with nulls told apart, wide enough not to collide at any number of rows."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
