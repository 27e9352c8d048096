"""Printed and machine-readable dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINTED = r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\b"


def mrz_date(c: Column, pivot: int = 30) -> Column:
    """YYMMDD to an ISO string, years from ``pivot`` in the last century; no calendar check."""
    yy, mm, dd = (F.substring(c, k, 2).try_cast("int") for k in (1, 3, 5))
    year = F.when(yy >= pivot, yy + 1900).otherwise(yy + 2000)
    good = c.rlike("^[0-9]{6}$") & mm.between(1, 12) & dd.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", year, mm, dd))


def printed(c: Column) -> Column:
    """First date-like token of a text, as printed."""
    out = F.regexp_extract(c, PRINTED, 1)
    return F.when(out != "", out)


def printed_whole(c: Column) -> Column:
    """First date-like token with a year of four digits, as printed."""
    out = F.regexp_extract(c, r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})\b", 1)
    return F.when(out != "", out)


def parse_printed(c: Column) -> Column:
    """Printed day-month-year (years of two digits turn at 69), ISO, or with a month's name; null when invalid."""
    text = F.regexp_replace(F.trim(c), "[/.]", "-")
    short = F.regexp_extract(text, r"^(\d{1,2}-\d{1,2})-(\d{2})$", 2).try_cast("int")
    widened = F.concat(F.regexp_extract(text, r"^(\d{1,2}-\d{1,2})-(\d{2})$", 1), F.lit("-"), (F.when(short >= 69, short + 1900).otherwise(short + 2000)).cast("string"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(text, "d-M-yyyy")),
        F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), F.try_to_date(widened, "d-M-yyyy")),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")),
        F.when(text.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(text, "d MMM yyyy")),
        F.when(text.rlike(r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), F.try_to_date(text, "d MMMM yyyy")),
    )


def visual(c: Column) -> Column:
    """A printed date as ISO, day-month-year of four digits, with a month's name, or eight digits; null otherwise."""
    text = F.initcap(F.lower(F.regexp_replace(F.trim(c), "[/.]", "-")))
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")),
        F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(text, "d-M-yyyy")),
        F.when(text.rlike(r"^\d{1,2} [a-zA-Z]{3} \d{4}$"), F.try_to_date(text, "d MMM yyyy")),
        F.when(text.rlike(r"^\d{1,2} [a-zA-Z]{4,} \d{4}$"), F.try_to_date(text, "d MMMM yyyy")),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
    )


#: A day-month-year, a year-month-day, or a day with a month's name.
LETTER_DATE = r"(?i)\b(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}|\d{1,2}\s+(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEP(?:TEMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)\s+\d{4})\b"


def letter_date(c: Column) -> Column:
    """First date of a letter's text, as printed."""
    out = F.regexp_extract(c, LETTER_DATE, 1)
    return F.when(out != "", out)


def past(c: Column, as_of: Column) -> Column:
    return F.coalesce(parse_printed(c) < as_of, F.lit(False))


def not_future(c: Column, as_of: Column) -> Column:
    return F.coalesce(parse_printed(c) <= as_of, F.lit(False))
