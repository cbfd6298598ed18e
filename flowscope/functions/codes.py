"""Code lists: parsing, formatting and vocabulary membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """``"(a-b-c)"`` or a bare ``"a"`` to an array of its tokens; null and blank text give one blank token."""
    text = F.coalesce(text, F.lit(""))
    inner = F.when(text.startswith("("), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.split(inner, "-")


def parse_code_list(text: Column) -> Column:
    """Text to ``array<int>``; tokens that are no number are left out, so an empty list has no codes."""
    return F.filter(F.transform(code_tokens(text), lambda t: t.try_cast("int")), lambda c: c.isNotNull())


def parse_until_error(text: Column) -> tuple[Column, Column]:
    """Codes before the first token that is no number, and whether the whole text parsed."""
    codes = F.transform(code_tokens(text), lambda t: t.try_cast("int"))
    bad = F.array_position(F.transform(codes, lambda c: c.isNull()), True)
    return F.when(bad == 0, codes).otherwise(F.slice(codes, F.lit(1), bad.cast("int") - 1)), bad == 0


def hex_code(code: Column) -> Column:
    """Lower-case hex with at least four digits (wider codes stay whole)."""
    return F.format_string("%04x", code)


def pad_code(code: Column) -> Column:
    """Decimal with at least two digits (wider codes stay whole)."""
    return F.format_string("%02d", code)


def in_ranges(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Membership in a vocabulary given as inclusive ranges: a few compares instead of a long list."""
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | ((code == low) if low == high else code.between(low, high))
    return hit
