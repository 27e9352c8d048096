"""Machine-readable zone of passports: candidate lines, the two lowest, fields, check digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import checksum, dates
from folioscan.functions import text as T


def mrz_lines(regions: DataFrame) -> DataFrame:
    """doc_id, line1, line2: the two lowest candidate lines, the upper first; documents with fewer are left out."""
    rows = regions.withColumn("line", T.clean_mrz(F.col("text"))).filter(F.col("line").rlike("^[A-Z0-9<]{40,44}$"))
    ordered = F.array_sort(F.collect_list(F.struct("bottom", "seq", "line")))
    pair = rows.groupBy("doc_id").agg(ordered.alias("l")).filter(F.size("l") >= 2)
    pick = lambda back: F.element_at("l", -back)["line"]
    return pair.select("doc_id", T.pad44(pick(2)).alias("line1"), T.digit_fix(T.pad44(pick(1))).alias("line2"))


def parse_mrz(regions: DataFrame, pivot: int = 30) -> DataFrame:
    """One row per document with a zone: ten fields, the check digits' verdicts, errors."""
    two = F.col("line2")
    part = lambda start, length: F.substring(two, start, length)
    blank = lambda c: F.translate(c, "<", "")
    name = F.substring("line1", 6, 39)
    cut = F.instr(name, "<<")
    surname = F.when(cut > 0, F.substring(name, F.lit(1), cut - 1)).otherwise(name)
    given = F.when(cut > 0, F.substring(name, cut + 2, F.length(name))).otherwise(F.lit(""))
    number_ok = checksum.check_digit_ok(part(1, 9), part(10, 1))
    birth_ok = checksum.check_digit_ok(part(14, 6), part(20, 1))
    expiry_ok = checksum.check_digit_ok(part(22, 6), part(28, 1))
    composite_ok = checksum.check_digit_ok(F.concat(part(1, 10), part(14, 7), part(22, 22)), part(44, 1))
    personal = blank(part(29, 14))
    errors = F.array_compact(F.array(*[F.when(~ok, name) for ok, name in ((number_ok, "PASSPORT_NUMBER_CHECKSUM_FAILED"), (birth_ok, "DOB_CHECKSUM_FAILED"), (expiry_ok, "EXPIRY_CHECKSUM_FAILED"), (composite_ok, "OVERALL_CHECKSUM_FAILED"))]))
    sex = part(21, 1)
    kind = blank(F.substring("line1", 1, 2))
    return mrz_lines(regions).select(
        "doc_id",
        F.when(kind == "", "P").otherwise(kind).alias("document_code"),
        blank(F.substring("line1", 3, 3)).alias("country"),
        T.clean_name(surname).alias("surname"),
        T.clean_name(given).alias("given_names"),
        blank(part(1, 9)).alias("passport_number"),
        blank(part(11, 3)).alias("nationality"),
        dates.mrz_date(part(14, 6), pivot).alias("date_of_birth"),
        F.when(sex.isin("M", "F"), sex).when(sex.isin("<", "X"), "X").alias("sex"),
        dates.mrz_date(part(22, 6), pivot).alias("expiry_date"),
        F.when(personal != "", personal).alias("personal_number"),
        number_ok.alias("number_ok"),
        birth_ok.alias("birth_ok"),
        expiry_ok.alias("expiry_ok"),
        (composite_ok & number_ok & birth_ok & expiry_ok).alias("overall_ok"),
        F.array_join(errors, ",").alias("errors"),
    )
