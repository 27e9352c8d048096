"""Identifier shapes and validity as Column expressions. ``\\d`` is Unicode-aware where printed digits may be Indic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksum

#: The shapes below are fixed values: what a printed identifier looks like.
#: Holder types in the fourth place of a PAN.
PAN_HOLDERS = list("ABCFGHLJPTK")
LICENCE = "[A-Z]{2}[0-9]{2}[0-9]{11}"
PAN, EPIC = "[A-Z]{5}[0-9]{4}[A-Z]", "[A-Z]{3}[0-9]{7}"


def compact(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    out = F.regexp_extract(c, pattern, group)
    return F.when(out != "", out)


def pan(c: Column) -> Column:
    return pan_in(compact(c))


def pan_in(compact_text: Column) -> Column:
    return _found(compact_text, PAN)


def pan_valid(c: Column) -> Column:
    return holder_ok(pan(c))


def holder_ok(found: Column) -> Column:
    return F.coalesce(F.substring(found, 4, 1).isin(PAN_HOLDERS), F.lit(False))


def epic(c: Column) -> Column:
    return epic_in(compact(c))


def epic_in(compact_text: Column) -> Column:
    return _found(compact_text, EPIC)


def licence(c: Column) -> Column:
    return licence_in(compact(c))


def licence_in(compact_text: Column) -> Column:
    return _found(compact_text, LICENCE)


def job_card(c: Column) -> Column:
    text = F.regexp_replace(F.translate(F.upper(c), "–—", "--"), r"\s+", "")
    return F.when(text.rlike(r"^[A-Z]{2}-\d{1,10}([-/]\d{1,10}){2,7}$"), text)


def aadhaar(c: Column) -> Column:
    """First number of twelve digits, in groups of four."""
    digits = F.regexp_replace(_found(c, r"(?U)\b\d{4}\s?\d{4}\s?\d{4}\b"), r"(?U)\s", "")
    return F.when(digits.isNotNull(), F.concat_ws(" ", *[F.substring(digits, k, 4) for k in (1, 5, 9)]))


def aadhaar_valid(c: Column) -> Column:
    return aadhaar_ok(aadhaar(c))


def aadhaar_ok(found: Column) -> Column:
    """Validity of a number as ``aadhaar`` gives it: its first digit and its check digit."""
    return F.coalesce(~F.substring(found, 1, 1).isin("0", "1") & checksum.verhoeff_ok_of(F.replace(found, F.lit(" "), F.lit("")), 12), F.lit(False))


def aadhaar_last4(c: Column) -> Column:
    """Last four digits of a masked number."""
    return _found(c, r"([Xx*]{4}[\s-]?){2}(\d{4})\b", 2)


def virtual_id(c: Column) -> Column:
    return _found(c, r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b")


def old_passport(c: Column) -> Column:
    return _found(c, r"[A-Z]\d{7}")


def pincode(c: Column) -> Column:
    return _found(c, r"\b\d{6}\b")
