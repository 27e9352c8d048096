"""Documents of every kind through one routed result; expectations follow the printed rules."""

import json

from pyspark.sql import functions as F

from folioscan.operators import cards, classify, job_card, npr, routing
from folioscan.sources import ingest
from test_engine import LINE1, LINE2, PAN, page
from test_job_card import CARD
from test_passport import biodata, codes

LETTER = [("NATIONAL POPULATION REGISTER", 40, 20, 400, 42), ("Name: SITA DEVI", 40, 80, 300, 102), ("Address: 14 LAKE VIEW", 40, 120, 300, 142), ("KOCHI 682001", 40, 146, 300, 166), ("Date: 12/03/2011", 40, 300, 300, 322)]
AADHAAR = [("Government of India", 40, 0, 300, 20), ("Unique Identification Authority of India", 40, 22, 300, 38), ("MALEK HUSSAIN", 40, 40, 300, 60), ("Year of Birth: 1985", 40, 70, 300, 90), ("पुरुष / MALE", 40, 100, 200, 120), ("9998 8877 7669", 40, 140, 300, 160)]
LICENCE = [("DRIVING LICENCE", 40, 0, 300, 20), ("DL No.", 40, 30, 120, 50), ("KL0720110012345", 140, 30, 300, 50), ("Name", 40, 60, 120, 80), ("ASHA MENON", 140, 60, 300, 80), ("DOB: 09/03/1986", 40, 120, 250, 140), ("Date of Issue", 40, 150, 160, 170), ("10/10/2011", 180, 150, 280, 170), ("Validity NT", 40, 180, 160, 200), ("09/10/2031", 180, 180, 280, 200), ("Blood Group", 40, 210, 160, 230), ("B+VE", 180, 210, 240, 230)]
BACK = [("Name of Father", 40, 300, 220, 325), ("RAVI SOMAN", 40, 330, 220, 350), ("Address", 40, 400, 220, 425), ("FILE NO", 40, 500, 220, 525)]


def pages(spark):
    out = None
    for k, rows in enumerate((biodata(), PAN, BACK, CARD, LETTER, AADHAAR, LICENCE, [("total 100", 0, 0, 10, 10)]), 1):
        one = page(spark, rows, k)
        out = one if out is None else out.union(one)
    return out


def test_whole_records_ride_in_one_row(spark):
    regions = pages(spark)
    got = {r.doc_id: r for r in routing.route_documents(regions, "2024-06-01", codes(spark)).collect()}
    assert [got[k].document_type for k in range(1, 9)] == ["passport", "pan", "passport", "nrega_job_card", "npr_letter", "aadhaar", "driving_licence", "unknown"]
    assert [got[k].page_type for k in (1, 3, 8)] == ["passport_biodata", "passport_non_biodata", "unknown"]
    held = {1: "passport", 2: "pan", 3: "passport_back", 4: "nrega_job_card", 5: "npr_letter", 6: "aadhaar", 7: "driving_licence"}
    for k, row in got.items():
        assert [t for t in (*routing.READERS, "passport", "passport_back") if row[t] is not None] == [held[k] for _ in range(k in held)]
    assert got[1].passport.surname == "ERIKSSON" and got[3].passport_back.father_name == "RAVI SOMAN" and got[2].status == "success"
    assert [m.name for m in got[4].nrega_job_card.members] == ["SITA BAI", "RAVI", "LEELA"] and got[4].nrega_job_card.village == "RAMPUR"
    assert (got[8].status, got[8].unsupported_reason, got[8].errors, got[8].warnings) == ("unsupported_page", "UNSUPPORTED_DOCUMENT", "", "NO_DOCUMENT_HINTS")
    log = routing.scan_log(spark.createDataFrame([(1, "success", "pan", 0.9, "A", "secret")], "doc_id long, status string, page_type string, confidence double, errors string, name string"))
    assert log.columns == ["doc_id", "status", "page_type", "confidence", "processing_ms", "errors"]
    assert got[1].mrz_raw == [LINE1, LINE2] and got[1].mrz_valid and got[2].mrz_raw is None and got[2].identifier_valid and got[2].warnings
    for k, t, read in ((4, "nrega_job_card", job_card.extract_job_cards), (5, "npr_letter", npr.extract_npr_fields), (6, "aadhaar", cards.extract_aadhaar_cards), (7, "driving_licence", cards.extract_licences)):
        alone = read(regions.filter(F.col("doc_id") == k)).drop("doc_id").first()
        assert got[k][t].asDict(True) == alone.asDict(True), t


KEYS = "status documentType pageType confidence fields backPageFields panFields aadhaarFields drivingLicenceFields voterIdFields nregaJobCardFields nprLetterFields mrzRaw mrzValid lowConfidence unsupportedReason identifierValid missingRequiredFields probeText errors warnings processingMs".split()


def test_published_results(spark):
    """All 22 keys in order, nested records in camel case, null blocks present."""
    two = page(spark, CARD, 4).union(page(spark, biodata(), 1))
    rows = {r.doc_id: json.loads(r.json) for r in ingest.to_json(routing.result_objects(routing.route_documents(two, "2024-06-01", codes(spark))), with_id=False).collect()}
    assert [list(r) for r in rows.values()] == [KEYS, KEYS]
    assert rows[1]["fields"]["passportNumber"] == "L898902C3" and rows[1]["nregaJobCardFields"] is None and rows[1]["mrzRaw"] == [LINE1, LINE2]
    card = rows[4]["nregaJobCardFields"]
    assert card["jobCardNumber"] == "RJ-27-001-002-0008147/00" and card["members"][0] == {"serial": "1", "name": "SITA BAI", "relation": "GOPAL", "gender": "FEMALE", "age": 39} and rows[4]["probeText"] == [] and rows[4]["warnings"] and isinstance(rows[4]["errors"], list)


def test_blank_passports_have_no_fields(spark):
    blank = page(spark, [("Surname", 40, 300, 220, 325), ("Date of Birth", 40, 400, 220, 425)], 1)
    row = routing.result_objects(routing.route_documents(blank, "2024-06-01", codes(spark))).first()
    assert (row.page_type, row.status, row.fields, row.mrz_raw) == ("passport_biodata", "failure", None, None)


def test_source_is_read_once(spark):
    regions = pages(spark)
    read = spark.sparkContext.accumulator(0)
    counted = regions.rdd.map(lambda r: (read.add(1), r)[1]).toDF(regions.schema)
    routing.route_documents(counted, "2024-06-01", codes(spark)).count()
    assert read.value == regions.count()


def test_no_documents(spark):
    assert routing.route_documents(page(spark, PAN).limit(0), "2024-06-01", codes(spark)).collect() == []


def test_titles_over_regions_and_in_hindi(spark):
    kind = lambda *texts: classify.classify_documents(page(spark, [(t, 40, 30 * k, 300, 30 * k + 20) for k, t in enumerate(texts)])).first()
    assert kind("NATIONAL POPULATION", "REGISTER").document_type == "npr_letter"
    assert kind("राष्ट्रीय जनसंख्या", "रजिस्टर").reasons == "NPR_EXPLICIT_TITLE"
    two = kind("Mahatma Gandhi", "National Rural Employment", "Guarantee Act")
    assert (two.document_type, two.reasons, two.confidence) == ("nrega_job_card", "NREGA_EXPLICIT_TITLE", 0.98)
    assert kind("राष्ट्रीय ग्रामीण", "रोजगार गारंटी").reasons == "NREGA_EXPLICIT_TITLE"
    assert kind("जॉब कार्ड", "ग्राम पंचायत").reasons == "NREGA_JOB_CARD_CONTEXT"
    assert kind("INTERNATIONAL POPULATION REGISTERS").document_type == kind("जॉब कार्ड").document_type == "unknown"
