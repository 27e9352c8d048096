"""One routed result for documents of any kind: told apart, read by their own type's rules, judged, in one row each.

1. Page types and document types are decided from all regions; each document gets one route.
2. Regions are staged by route, so that each type's reading sees its own documents' rows only, once.
3. Each type's whole record is one struct column of the result, null for documents of other types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators import assess, cards, classify, extract, job_card, mrz, npr, passport
from folioscan.operators import regions as R
from folioscan.plans import dims
from folioscan.sources.staging import staged

#: Readings by type: regions of documents of that type -> one row a document.
READERS = {
    "pan": extract.extract_pan,
    "aadhaar": cards.extract_aadhaar_cards,
    "driving_licence": cards.extract_licences,
    "voter_id": cards.extract_voter_cards,
    "nrega_job_card": job_card.extract_job_cards,
    "npr_letter": npr.extract_npr_fields,
}
PASSPORT, BACK = "passport", "passport_back"
#: What judging asks for under another name than a record has it.
JUDGED = {
    "aadhaar": {"masked_last4": lambda r: F.when(r["aadhaar_masked"], r["aadhaar_last4"])},
    "nrega_job_card": {"member_name": lambda r: F.get(r["members"], F.lit(0))["name"]},
}


def routes(regions: DataFrame) -> DataFrame:
    """doc_id, route, page_type, page_confidence, non_biodata, document_type, class_confidence, reasons: one row a document.

    A passport's lower part tells biodata from back pages; all other documents go by their evidence, and
    types without a reader are unknown.
    """
    pages = classify.classify_pages(R.targeted(regions))
    order = F.when(F.col("page_type") == "biodata", 2).when(F.col("page_type") == "non_biodata", 1).otherwise(0)
    best = F.max_by(F.struct("page_type", F.col("confidence").alias("page_confidence"), "non_biodata"), F.struct(order, F.col("confidence"), -F.col("page_no")))
    kinds = pages.groupBy("doc_id").agg(best.alias("k")).select("doc_id", "k.*")
    classes = classify.classify_documents(regions).select("doc_id", "document_type", F.col("confidence").alias("class_confidence"), "reasons")
    route = F.when(F.col("page_type") == "biodata", PASSPORT).when(F.col("page_type") == "non_biodata", BACK).when(F.col("document_type").isin(*READERS), F.col("document_type")).otherwise("unknown")
    return classes.join(kinds, "doc_id", "left").withColumn("route", route)


def records(regions: DataFrame, codes: DataFrame) -> dict[str, DataFrame]:
    """By type: doc_id and the whole record of its documents. ``regions`` has the column route and is staged by it."""
    of = lambda t: regions.filter(F.col("route") == t).drop("route")
    out = {t: read(R.trusted(of(t))) for t, read in READERS.items()}
    out[PASSPORT] = passport.read_passports(of(PASSPORT), codes)
    out[BACK] = passport.extract_back_page(of(BACK))
    return out


def _judged(found: dict[str, DataFrame], sound: DataFrame, routed: DataFrame, as_of: str) -> DataFrame:
    """doc_id, confidence, complete, errors, warnings of cards and letters, all types in one frame."""
    asked = {f for of in (*dims.REQUIRED.values(), dims.AADHAAR_BACK) for fs in of.values() for f in fs} | {*assess.DATES, *assess.IDENTIFIER.values(), "age", "year_of_birth"}
    wide = None
    for t in READERS:
        rows, own = found[t], JUDGED.get(t, {})
        names = {c: F.col(c) for c in rows.columns if c in asked} | {c: value(rows) for c, value in own.items()}
        rows = rows.select("doc_id", *[c.cast("string").alias(n) for n, c in names.items()])
        wide = rows if wide is None else wide.unionByName(rows, allowMissingColumns=True)
    classes = routed.filter(F.col("route").isin(*READERS)).select("doc_id", "document_type")
    return assess.assess(wide, sound, classes, as_of)


def route_documents(regions: DataFrame, as_of: str, codes: DataFrame) -> DataFrame:
    """One row a document: doc_id, document_type, page_type, status, confidence, low_confidence, unsupported_reason, identifier_valid,
    missing_required_fields, errors, warnings, mrz_raw, mrz_valid, and a struct of every type's whole record.

    A document of several pages is one document; a document without any evidence is unknown and unsupported. The source is read
    once; the routes' aggregates read a few columns each of the staged rows, dealt by document.
    """
    regions = staged(R.dealt(regions), "regions")
    routed = staged(routes(R.dealt(regions)), "routes")
    parted = staged(regions.join(routed.select("doc_id", "route"), "doc_id"), "routed-regions", by="route")
    found = {t: staged(rows, f"record-{t}") for t, rows in records(parted, codes).items()}
    judged = _judged(found, R.trusted(parted.filter(F.col("route").isin(*READERS)).drop("route")), routed, as_of)
    rows = routed.join(judged.drop("document_type"), "doc_id", "left")
    for t, record in found.items():
        rows = rows.join(record.select("doc_id", F.struct(*[c for c in record.columns if c != "doc_id"]).alias(t)), "doc_id", "left")
    zones = mrz.mrz_lines(parted.filter(F.col("route") == PASSPORT).drop("route"))
    rows = rows.join(zones.select("doc_id", F.array("line1", "line2").alias("mrz_raw")), "doc_id", "left")
    return rows.select("doc_id", *_verdict(), *found)


def route_cards(regions: DataFrame, as_of: str) -> DataFrame:
    """As ``route_documents``, of cards and letters by the shorter records of ``extract``: passports are not read, their blocks are null."""
    classes, records, sound = assess.extracted(regions)
    records = R.dealt(staged(records, "records"))  # read twice
    rows = assess.verdicts(classes, assess.assess(records, sound, classes, as_of))
    kind, card = F.col("document_type"), F.col("status") != "unsupported_page"
    block = lambda t, fields: F.when(kind == t, F.struct(*[F.col(f) for f in fields()])).alias(t)
    rows = rows.join(records.select("doc_id", *[block(t, fields) for t, fields in extract.FIELDS.items()]), "doc_id", "left")
    none = lambda kind: F.lit(None).cast(kind)
    low = (F.col("confidence") >= 0.3) & (F.col("confidence") < 0.7) & card
    return rows.select(
        "doc_id", "document_type", F.when(card, kind).otherwise("unknown").alias("page_type"), "status", "confidence", F.coalesce(low, F.lit(False)).alias("low_confidence"),
        F.when(~card, "UNSUPPORTED_DOCUMENT").alias("unsupported_reason"), "identifier_valid", listed(F.col("missing")).alias("missing_required_fields"), "errors", F.concat_ws(",", "reasons", F.when(F.col("warnings") != "", F.col("warnings"))).alias("warnings"),
        none("array<string>").alias("mrz_raw"), F.lit(False).alias("mrz_valid"), *extract.FIELDS, none(f"struct<{','.join(f'{f}:string' for f in passport.FIELDS)}>").alias(PASSPORT), none("struct<address:string>").alias(BACK),
    )


def listed(c: Column) -> Column:
    """Names between commas as a list."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda e: e != "")


def _verdict() -> list[Column]:
    """Status and confidence of each route, from the joined row."""
    route, p, none = F.col("route"), F.col(PASSPORT), F.array().cast("array<string>")
    passport_, back, card = route == PASSPORT, route == BACK, route.isin(*READERS)
    final = passport.overall_confidence(p["confidence"], F.col("page_confidence"))
    read = lambda f: F.coalesce(p[f] != "", F.lit(False))
    good = p["overall_ok"] & read("passport_number") & read("surname") & (final >= 0.7)
    mixed = F.bround(0.4 * F.col("class_confidence") + 0.6 * F.col("confidence"), 3)
    confidence = F.when(passport_, final).when(back, F.col("page_confidence")).when(card, F.when(F.col("complete"), mixed).otherwise(F.least(mixed, F.lit(0.69)))).otherwise(F.col("class_confidence"))
    status = F.when(passport_, F.when(good, "success").otherwise("failure")).when(back, "success").when(card, F.when(F.col("complete"), "success").otherwise("failure")).otherwise("unsupported_page")
    errors = F.when(passport_, F.when(good | (F.size(p["errors"]) > 0), p["errors"]).otherwise(F.array(F.lit("LOW_CONFIDENCE_EXTRACTION")))).when(card, listed(F.col("errors"))).otherwise(none)
    zone = F.when(p["mrz_errors"] != "", F.split(p["mrz_errors"], ",")).when(~p["has_mrz"], F.array(F.lit("MRZ_NOT_DETECTED"))).otherwise(none)
    hints = F.array(F.concat(F.lit("NON_BIODATA_HINTS_"), F.col("non_biodata").cast("string")))
    warnings = F.when(passport_, F.concat(zone, p["warnings"])).when(back, hints).otherwise(F.concat(listed(F.col("reasons")), F.when(card, listed(F.col("warnings"))).otherwise(none)))
    page = F.when(passport_, "passport_biodata").when(back, "passport_non_biodata").when(card, F.col("document_type")).otherwise("unknown")
    confidence = F.bround(confidence, 3)
    low = (confidence >= 0.3) & (confidence < 0.7) & (passport_ | card)
    return [
        F.when(passport_ | back, "passport").otherwise(F.col("document_type")).alias("document_type"),
        page.alias("page_type"),
        status.alias("status"),
        confidence.alias("confidence"),
        F.coalesce(low, F.lit(False)).alias("low_confidence"),
        F.when(status == "unsupported_page", "UNSUPPORTED_DOCUMENT").alias("unsupported_reason"),
        F.when(card, F.col("identifier_valid")).alias("identifier_valid"),
        F.when(card, listed(F.col("missing"))).otherwise(none).alias("missing_required_fields"),
        F.array_join(errors, ",").alias("errors"),
        F.array_join(warnings, ",").alias("warnings"),
        F.when(passport_ & p["has_mrz"], F.col("mrz_raw")).alias("mrz_raw"),
        F.coalesce(F.when(passport_, p["overall_ok"]), F.lit(False)).alias("mrz_valid"),
    ]


def result_objects(routed: DataFrame) -> DataFrame:
    """doc_id and the 22 keys of a published result, in their order; null blocks are kept, probe text is never given.

    The time a document took belongs to a request, not to a table: processing_ms is taken from ``routed`` if it is there.
    """
    p = F.col(PASSPORT)
    took = F.col("processing_ms") if "processing_ms" in routed.columns else F.lit(0)
    block = lambda t: F.col(t)
    fields = F.when(passport.meaningful(lambda c: p[c]), F.struct(*[p[f].alias(f) for f in passport.FIELDS]))
    return routed.select(
        "doc_id", "status", "document_type", "page_type", "confidence", fields.alias("fields"), block(BACK).alias("back_page_fields"), block("pan").alias("pan_fields"), block("aadhaar").alias("aadhaar_fields"),
        block("driving_licence").alias("driving_licence_fields"), block("voter_id").alias("voter_id_fields"), block("nrega_job_card").alias("nrega_job_card_fields"), block("npr_letter").alias("npr_letter_fields"), "mrz_raw", "mrz_valid", "low_confidence",
        "unsupported_reason", "identifier_valid", "missing_required_fields", F.array().cast("array<string>").alias("probe_text"), listed(F.col("errors")).alias("errors"), listed(F.col("warnings")).alias("warnings"), took.cast("long").alias("processing_ms"),
    )


def scan_log(routed: DataFrame) -> DataFrame:
    """What a log may have of each document: doc_id, status, page_type, confidence, processing_ms, errors; no field, no text."""
    took = F.col("processing_ms") if "processing_ms" in routed.columns else F.lit(0)
    return routed.select("doc_id", "status", "page_type", "confidence", took.cast("long").alias("processing_ms"), "errors")
