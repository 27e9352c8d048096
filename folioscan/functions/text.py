"""Text normalisation and MRZ line clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters read for digits in the numeric places of an MRZ line, and the places (from 1, length).
DIGIT_FROM, DIGIT_TO = "OoDdQqILlZzAaSsGgBb", "0000001112244556688"
DIGIT_PLACES = ((10, 1), (14, 7), (22, 7), (43, 2))


def squeeze(c: Column) -> Column:
    """All white space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_label(c: Column) -> Column:
    """Upper case, & to AND, everything but A-Z and 0-9 to one blank."""
    return F.trim(F.regexp_replace(F.replace(F.upper(c), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))


def norm_text(c: Column) -> Column:
    """As norm_label, without the rule for &."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def casefold(c: Column) -> Column:
    """Full case folding on the JVM: letters that differ in case only, or by a special upper case (ß and SS), become equal.

    Lower, upper, lower again covers all full mappings; a final sigma becomes a plain one, and a dotless i, whose upper case is
    another letter's, stays what it is. Cherokee folds to small letters here, to capitals in the standard.
    """
    kept = lambda x: F.substring(x, 1, 1 << 30)  # noqa: E731 - the whole text; the optimiser drops a case change right under another
    part = lambda x: F.replace(F.lower(kept(F.upper(kept(F.lower(x))))), F.lit("ς"), F.lit("σ"))
    return F.when(c.contains("ı"), F.array_join(F.transform(F.split(c, "ı"), part), "ı")).otherwise(part(c))


def dedup_key(c: Column) -> Column:
    return casefold(squeeze(c))


def clean_mrz(c: Column) -> Column:
    return F.translate(F.upper(c), "«‹> ", "<<<")


def pad44(c: Column) -> Column:
    return F.rpad(c, 44, "<")


def digit_fix(line: Column) -> Column:
    """Digits instead of look-alike letters at the numeric places of line 2."""
    parts, at = [], 1
    for start, length in DIGIT_PLACES:
        if start > at:
            parts.append(F.substring(line, at, start - at))
        parts.append(F.translate(F.substring(line, start, length), DIGIT_FROM, DIGIT_TO))
        at = start + length
    return F.concat(*parts)


def clean_name(c: Column) -> Column:
    return F.trim(F.translate(c, "<", " "))


def clean_colon(c: Column) -> Column:
    """A value without the colons that lead it; null when nothing is left."""
    out = F.trim(F.regexp_replace(F.trim(c), "^:+", ""))
    return F.when(out != "", out)


def after_colon(c: Column) -> Column:
    """Text after the last colon, without blanks, colons, commas and dashes at its ends; null when empty."""
    out = F.regexp_replace(F.element_at(F.split(c, ":"), -1), r"^[ :,\-]+|[ :,\-]+$", "")
    return F.when(out != "", out)


def letters_share(c: Column, letter_class: str) -> Column:
    """Share of a text's letters in a class; 0 without letters."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(letters, f"[^{letter_class}]", "")).cast("double"), F.length(letters)), F.lit(0.0))
