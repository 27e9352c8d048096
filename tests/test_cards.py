"""Aadhaar cards, licences and assessments on small hand-made pages; expectations follow the printed rules."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import assess, cards, classify, extract, extras, layout
from folioscan.operators import regions as R
from test_engine import SCHEMA, column, page


def test_vocabularies(spark):
    assert column(spark, ["O+VE", "ab -ve", "B POSITIVE", "Blood Group: O+", "BIHAR", "A NEG"], extras.blood_group) == ["O+", "AB-", "B+", None, None, "A-"]
    assert column(spark, ["LMV-NT, MCWG", "LMV LMV-TR", "ROAD  ROLLER", "X-LMV", "HTV"], extras.vehicle_classes) == ["MCWG, LMV-NT", "LMV-TR", "ROAD ROLLER", "", ""]
    assert column(spark, ["MALEK HUSSAIN", "RAVI KUMAR", "MALE", "S/O RAVI", "R2D2", "राम कुमार", "DATE"], extras.name_like) == [True, True, False, False, False, False, False]
    assert column(spark, ["Age as on 1.1.2024 : 34", "34", "AGE 150", "born 1990"], extract.age) == ["34", "34", None, None]


def test_licence(spark):
    rows = [
        ("DRIVING LICENCE", 40, 0, 300, 20), ("DL No.", 40, 30, 120, 50), ("KL07", 140, 30, 200, 50), ("2011", 210, 31, 260, 51), ("0012345", 270, 30, 360, 50), ("Name", 40, 60, 120, 80), ("ASHA MENON", 140, 60, 300, 80),
        ("S/D/W of", 40, 90, 120, 110), ("KIRAN MENON", 140, 90, 300, 110), ("DOB: 09/03/1986", 40, 120, 250, 140), ("Date of Issue", 40, 150, 160, 170), ("10/10/2011", 180, 150, 280, 170),
        ("Validity NT", 40, 180, 160, 200), ("09/10/2031", 180, 180, 280, 200), ("Validity TR", 340, 180, 440, 200), ("08/10/2016", 460, 180, 560, 200), ("Blood Group", 40, 210, 160, 230), ("B+VE", 180, 210, 240, 230),
        ("COV", 340, 210, 400, 230), ("LMV, MCWG", 420, 210, 560, 230), ("Address", 40, 240, 120, 260), ("5 BEACH ROAD", 140, 240, 300, 260), ("KOCHI", 60, 270, 200, 290), ("KOCHI", 60, 295, 200, 315), ("Signature", 60, 320, 200, 340), ("AFTER", 60, 345, 200, 365),
    ]
    r = cards.extract_licences(page(spark, rows)).first()
    assert (r.dl_number, r.name, r.relation_name, r.date_of_birth, r.issue_date) == ("KL0720110012345", "ASHA MENON", "KIRAN MENON", "09/03/1986", "10/10/2011")
    assert (r.validity_date, r.validity_date_transport, r.blood_group, r.class_of_vehicle) == ("09/10/2031", "08/10/2016", "B+", "MCWG, LMV")
    assert r.address == "5 BEACH ROAD, KOCHI"


def test_aadhaar_front_and_back(spark):
    front = page(spark, [("Government of India", 40, 0, 300, 20), ("MALEK HUSSAIN", 40, 40, 300, 60), ("Year of Birth: 1985", 40, 70, 300, 90), ("पुरुष / MALE", 40, 100, 200, 120), ("XXXX XXXX 7669", 40, 140, 300, 160)], 1)
    back = page(spark, [("Address:", 40, 0, 120, 20), ("S/O RAVI, 5 HILL ROAD", 40, 25, 300, 45), ("राम नगर", 40, 50, 300, 70), ("KOCHI 682001", 40, 75, 300, 95), ("9998 8877 7669", 40, 110, 300, 130), ("VID: 9148 6541 8231 2156", 40, 140, 300, 160)], 2)
    alone = page(spark, [("ASHA RANI", 40, 0, 300, 20), ("महिला", 40, 30, 300, 50)], 3)
    got = {r.doc_id: r for r in cards.extract_aadhaar_cards(front.union(back).union(alone)).collect()}
    assert (got[1].name, got[1].year_of_birth, got[1].date_of_birth, got[1].gender) == ("MALEK HUSSAIN", "1985", None, "MALE")
    assert (got[1].aadhaar_number, got[1].aadhaar_masked, got[1].aadhaar_last4) == (None, True, "7669")
    assert (got[2].aadhaar_number, got[2].checksum_valid, got[2].aadhaar_masked, got[2].vid) == ("9998 8877 7669", True, False, "9148 6541 8231 2156")
    assert (got[2].pincode, got[2].name) == ("682001", None) and got[2].address.startswith("S/O RAVI, 5 HILL ROAD, KOCHI 682001")
    assert (got[3].name, got[3].gender) == ("ASHA RANI", "FEMALE")


def judged(spark, doc_type, fields):
    cols = ", ".join(f"{k} string" for k in fields)
    made = spark.createDataFrame([(1, *fields.values())], f"doc_id long, {cols}")
    classes = spark.createDataFrame([(1, doc_type)], "doc_id long, document_type string")
    return assess.assess(made, page(spark, [("x", 0, 0, 1, 1)], 1, 0.9), classes, "2024-06-01").first()


@pytest.mark.parametrize(
    "doc_type, fields, complete, errors, warnings",
    [
        ("aadhaar", {"aadhaar_number": None, "masked_last4": "7669", "name": "A", "date_of_birth": None, "year_of_birth": "1985", "gender": "MALE"}, True, "", "MASKED_AADHAAR_CHECKSUM_UNAVAILABLE"),
        ("aadhaar", {"aadhaar_number": "9998 8877 7669", "address": "5 HILL ROAD", "pincode": "682001"}, True, "", ""),
        ("aadhaar", {"aadhaar_number": "9998 8877 7669", "name": "A", "year_of_birth": "1850", "gender": "MALE"}, False, "INVALID_YEAR_OF_BIRTH", ""),
        ("voter_id", {"epic_number": "ABC1234567", "name": "A", "age": "34"}, True, "", ""),
        ("voter_id", {"epic_number": "ABC1234567", "name": "A", "age": "12"}, False, "INVALID_AGE", ""),
        ("nrega_job_card", {"job_card_number": "RJ-27-001-002-0008147/00", "member_name": "A", "district": "D"}, True, "", "IDENTIFIER_FORMAT_ONLY_NOT_AUTHENTICITY"),
        ("nrega_job_card", {"job_card_number": "RJ-27-001-002-0008147/00", "head_of_household": "A", "village": "V", "validity_from": "01/04/2025", "validity_to": "01/04/2020"}, False, "INVALID_NREGA_VALIDITY_CHRONOLOGY", "IDENTIFIER_FORMAT_ONLY_NOT_AUTHENTICITY"),
        ("npr_letter", {"name": "A", "address": "B", "pincode": "012345"}, False, "INVALID_PINCODE", "IDENTIFIER_NOT_OFFLINE_VERIFIABLE"),
        ("driving_licence", {"dl_number": "KL0720110012345", "name": "A", "date_of_birth": "01/01/1990", "issue_date": "01/01/2030", "validity_date": None}, False, "MISSING_REQUIRED_FIELDS,INVALID_ISSUE_DATE,INVALID_VALIDITY_DATE", ""),
    ],
)
def test_assessment(spark, doc_type, fields, complete, errors, warnings):
    row = judged(spark, doc_type, fields)
    assert (row.complete, row.errors, row.warnings) == (complete, errors, warnings)
    assert (row.identifier_valid is None) == (doc_type == "npr_letter" or fields.get("masked_last4") is not None)


def test_best_label_over_pages_wins(spark):
    rows = [(1, 0, 0, "Name", 40, 90, 120, 115, 0.9), (1, 0, 1, "ANNA RIGHT", 140, 90, 300, 115, 0.9), (1, 1, 0, "the name of it", 40, 90, 220, 115, 0.9), (1, 1, 1, "ZZZ WRONG", 240, 90, 400, 115, 0.9)]
    assert extract.extract_pan(spark.createDataFrame(rows, SCHEMA)).first().name == "ANNA RIGHT"


def test_ampersand_counts_in_labels_only(spark):
    kind = lambda t: classify.classify_documents(page(spark, [(t, 0, 0, 100, 20)])).first().document_type
    assert kind("INCOME & TAX") == kind("INCOME TAX") == "pan"


def test_registered_extractor_is_used(spark, monkeypatch):
    monkeypatch.setitem(extract.FIELDS, "pan", extract.FIELDS["pan"])
    extract.register_extractor("pan", lambda: {"pan_number": F.lit("own")})
    assert extract.extract_pan(page(spark, [("x", 0, 0, 1, 1)])).first().pan_number == "own"


def test_labels_start_at_first_words_only(spark):
    rows = page(spark, [("THE DATE OF BIRTH HERE", 0, 0, 10, 10), ("BIRTHPLACE", 0, 20, 10, 30), ("UPDATE", 0, 40, 10, 50)])
    assert {r.gram for r in R.grams(rows, ["DATE OF BIRTH", "BIRTH", "DATE"]).collect()} >= {"DATE OF BIRTH", "BIRTH", "DATE"}
    assert {r.seq for r in layout.label_match(rows, [("t", "f", "BIRTH", 0)]).select("label_seq").withColumnRenamed("label_seq", "seq").collect()} == {0}
    assert [r.label_like for r in R.label_like(rows).orderBy("seq").collect()] == [True, False, False]
