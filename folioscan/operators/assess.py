"""Completeness, identifier validity, date rules, confidence and routing of extracted records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import dates
from folioscan.functions import identifiers as I
from folioscan.operators import classify, extract
from folioscan.operators import regions as R
from folioscan.plans import dims
from folioscan.sources.staging import staged

IDENTIFIER = {"pan": "pan_number", "aadhaar": "aadhaar_number", "driving_licence": "dl_number", "voter_id": "epic_number", "nrega_job_card": "job_card_number"}


def identifier_ok(doc_type: Column, value: Column) -> Column:
    """True, false, or null where no offline check exists."""
    return (
        F.when(doc_type == "pan", I.pan_valid(value))
        .when(doc_type == "aadhaar", I.aadhaar_valid(value))
        .when(doc_type == "driving_licence", F.coalesce(I.compact(value).rlike("^[A-Z]{2}[0-9]{2}[0-9]{11}$"), F.lit(False)))
        .when(doc_type == "voter_id", F.coalesce(I.compact(value).rlike("^[A-Z]{3}[0-9]{7}$"), F.lit(False)))
        .when(doc_type == "nrega_job_card", I.job_card(value).isNotNull())
    )


def kyc_confidence(completeness: Column, identifier: Column, mean: Column, least: Column, missing: Column, semantic: Column) -> Column:
    """Half completeness, three tenths identifier (null counts 0.6), two tenths recognition; capped by faults."""
    raw = 0.5 * completeness + 0.3 * F.when(identifier.isNull(), 0.6).when(identifier, 1.0).otherwise(0.0) + 0.2 * mean
    caps = [F.when(~identifier, 0.39), F.when(missing > 0, 0.69), F.when(least < R.TRUSTED, 0.49)]
    capped = F.least(raw, F.lit(1.0), *[F.coalesce(c, F.lit(1.0)) for c in caps])
    return F.when(semantic > 0, F.least(F.bround(capped, 3), F.lit(0.49))).otherwise(F.bround(capped, 3))


#: Fields that are dates; ``semantic_errors`` takes each parsed as a column day_<field>.
DATES = ["date_of_birth", "issue_date", "validity_date", "registration_date", "validity_from", "validity_to"]


def semantic_errors(v, doc_type: Column, as_of: Column) -> Column:
    """Names of the broken rules on dates, ages and codes, by type; ``v`` gives a field's value or parsed day."""
    born, issue, valid, registered, begins, ends = (v(f"day_{c}") for c in DATES)
    has = lambda c: v(c).isNotNull()
    licence, card, letter = (doc_type == t for t in ("driving_licence", "nrega_job_card", "npr_letter"))
    year, years = v("year_of_birth").try_cast("int"), v("age").try_cast("int")
    past = F.coalesce(born < as_of, F.lit(False))
    before = lambda a, b: F.coalesce(a >= b, F.lit(False))
    rules = [
        ((doc_type == "pan") & ~past, "INVALID_DATE_OF_BIRTH"),
        (doc_type.isin("aadhaar", "voter_id") & has("date_of_birth") & ~past, "INVALID_DATE_OF_BIRTH"),
        ((doc_type == "aadhaar") & ~has("date_of_birth") & has("year_of_birth") & ~F.coalesce(year.between(1900, F.year(as_of)), F.lit(False)), "INVALID_YEAR_OF_BIRTH"),
        ((doc_type == "voter_id") & ~has("date_of_birth") & has("age") & ~F.coalesce(years.between(18, 130), F.lit(False)), "INVALID_AGE"),
        (licence & born.isNull(), "INVALID_DATE_OF_BIRTH"),
        (licence & (issue.isNull() | (issue > as_of)), "INVALID_ISSUE_DATE"),
        (licence & valid.isNull(), "INVALID_VALIDITY_DATE"),
        (licence & (before(born, issue) | before(issue, valid)), "INVALID_DL_DATE_CHRONOLOGY"),
        (card & has("registration_date") & (registered.isNull() | (registered > as_of)), "INVALID_REGISTRATION_DATE"),
        (card & has("validity_from") & begins.isNull(), "INVALID_VALIDITY_FROM"),
        (card & has("validity_to") & ends.isNull(), "INVALID_VALIDITY_TO"),
        (card & before(begins, ends), "INVALID_NREGA_VALIDITY_CHRONOLOGY"),
        (letter & has("issue_date") & ~F.coalesce(issue <= as_of, F.lit(False)), "INVALID_ISSUE_DATE"),
        (letter & has("pincode") & ~v("pincode").rlike(r"(?U)^[\p{Nd}&&[^0]]\p{Nd}{5}$"), "INVALID_PINCODE"),
    ]
    return F.concat_ws(",", *[F.when(c, n) for c, n in rules])  # a type has no name twice


def assess(extracted: DataFrame, regions: DataFrame, classes: DataFrame, as_of: str) -> DataFrame:
    """doc_id, document_type, complete, confidence, identifier_valid, missing, errors, warnings of every typed document.

    ``extracted`` may lack fields; a requirement is met by any of its fields. identifier_valid is null where no offline
    check exists: letters, and masked numbers.
    """
    asked = {f for of in (*dims.REQUIRED.values(), dims.AADHAAR_BACK) for fs in of.values() for f in fs} | {*DATES, "age", "year_of_birth"}
    names = sorted(asked & set(extracted.columns))
    wide = extracted.select("doc_id", *names, *[F.lit(None).cast("string").alias(n) for n in sorted(asked - set(names))])
    docs = classes.filter("document_type != 'unknown' and document_type != 'passport'").select("doc_id", "document_type")
    rows = docs.join(wide, "doc_id", "left").join(R.geometry_confidence(regions), "doc_id", "left")
    kind, semantic = F.col("document_type"), F.col("semantic")
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    any_of = lambda cs: reduce(lambda a, b: a | b, map(given, cs))
    back = (kind == "aadhaar") & any_of(["address", "pincode"]) & ~any_of(dims.AADHAAR_FRONT)
    needs = dims.REQUIRED | {"aadhaar_back": dims.AADHAAR_BACK}
    side = F.when(back, "aadhaar_back").otherwise(kind)
    lacking = lambda of: F.concat_ws(",", *[F.when(~any_of(cs), n) for n, cs in of.items()])
    identifier = F.coalesce(*[F.when(kind == t, F.col(c)) for t, c in IDENTIFIER.items()])
    masked = (kind == "aadhaar") & ~given("aadhaar_number") & given("masked_last4")
    ok = F.when((kind != "npr_letter") & ~F.col("masked"), F.coalesce(identifier_ok(kind, F.col("identifier")), F.lit(False)))
    step = lambda rows, **made: R.apart(rows, "document_type", [c for c in rows.columns if c not in made], **made)
    rows = step(rows, **{f"day_{c}": dates.parse_printed(F.col(c)) for c in DATES}, side=side, masked=masked, identifier=identifier)
    rows = step(rows, identifier_valid=ok, missing=F.coalesce(*[F.when(F.col("side") == t, lacking(of)) for t, of in needs.items()]), asked=F.coalesce(*[F.when(F.col("side") == t, len(of)) for t, of in needs.items()]))
    rows = step(rows, semantic=semantic_errors(F.col, kind, F.lit(as_of).cast("date")))
    mean, least = F.coalesce("mean_confidence", F.lit(0.0)), F.coalesce("min_confidence", F.lit(0.0))
    n_missing, n_semantic = F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ","))), (semantic != "").cast("int")
    rows = step(rows, mean=mean, least=least, n_missing=n_missing, n_semantic=n_semantic)
    least, n_missing, n_semantic = F.col("least"), F.col("n_missing"), F.col("n_semantic")
    whole = (F.col("asked") - n_missing) / F.col("asked")
    own = [F.when(~F.col("identifier_valid"), "INVALID_OR_MISSING_DOCUMENT_IDENTIFIER"), F.when(n_missing > 0, "MISSING_REQUIRED_FIELDS"), F.when(least < R.TRUSTED, "LOW_OCR_CONFIDENCE")]
    warning = F.when(F.col("masked"), "MASKED_AADHAAR_CHECKSUM_UNAVAILABLE").when((kind == "nrega_job_card") & F.col("identifier_valid"), "IDENTIFIER_FORMAT_ONLY_NOT_AUTHENTICITY").when(kind == "npr_letter", "IDENTIFIER_NOT_OFFLINE_VERIFIABLE").otherwise("")
    return rows.select(
        "doc_id",
        "document_type",
        ((n_missing == 0) & F.coalesce("identifier_valid", F.lit(True)) & (least >= R.TRUSTED) & (n_semantic == 0)).alias("complete"),
        kyc_confidence(whole, F.col("identifier_valid"), F.col("mean"), least, n_missing, n_semantic).alias("confidence"),
        "identifier_valid",
        "missing",
        F.concat_ws(",", *own, F.when(semantic != "", semantic)).alias("errors"),
        warning.alias("warnings"),
    )


def extracted(regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, records of each document's own type, and the sound regions that they are read from.

    The regions are read once: documents are classified and staged with their regions. What is dealt after that is one row a document, for all
    readers alike; no join or aggregate moves a region again.
    """
    docs = staged(classify.classify_documents(R.dealt(regions), with_regions=True), "documents")
    classes = R.dealt(docs.drop("regions"))
    typed = R.dealt(docs.select("doc_id", "document_type", "regions").filter("doc_id is not null and document_type is not null"))
    sound = R.trusted(typed.select("doc_id", "document_type", F.inline("regions")))
    return classes, extract.extract_all(sound), sound


def assess_extraction(regions: DataFrame, as_of: str = "2024-06-01") -> DataFrame:
    """``assess`` of every typed document, classified and read by its own type."""
    classes, records, sound = extracted(regions)
    return assess(records, sound, classes, as_of)


def verdicts(classes: DataFrame, judged: DataFrame) -> DataFrame:
    """Every document's class and what was judged, with status and final confidence; documents that no one reads are unsupported."""
    out = classes.withColumnRenamed("confidence", "class_confidence").join(judged.drop("document_type"), "doc_id", "left")
    status = F.when(F.col("document_type").isin("unknown", "passport"), "unsupported_page").when(F.col("complete"), "success").otherwise("failure")
    mixed = F.bround(0.4 * F.col("class_confidence") + 0.6 * F.col("confidence"), 3)
    final = F.when(status == "unsupported_page", F.col("class_confidence")).when(F.col("complete"), mixed).otherwise(F.least(mixed, F.lit(0.69)))
    return out.withColumns({"status": status, "confidence": F.bround(final, 3)})


def scan_results(regions: DataFrame, as_of: str = "2024-06-01") -> DataFrame:
    """doc_id, document_type, status, confidence, errors of every document: classify, extract by route, assess."""
    classes, records, sound = extracted(regions)
    out = verdicts(classes, assess(records, sound, classes, as_of))
    return out.select("doc_id", "document_type", "status", "confidence", F.when(F.col("status") == "unsupported_page", "UNSUPPORTED_DOCUMENT").otherwise(F.col("errors")).alias("errors"))
