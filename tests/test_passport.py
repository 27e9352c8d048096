"""Passport, back page and letter rules on small hand-made pages; expectations follow the published rules, not another job."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscan.functions import dates, likeness
from folioscan.operators import npr, passport, routing
from folioscan.plans import dims
from test_engine import LINE1, LINE2, page


def codes(spark):
    return spark.createDataFrame([("UTO",), ("IND",)], "code string")


def biodata(surname="ERIKSSON", born="12/08/1974", ends="15 Apr 2012"):
    return [("Surname", 40, 20, 220, 45), (surname, 40, 48, 220, 75), ("Date of Birth", 40, 100, 220, 125), (born, 40, 128, 220, 150), ("Date of Expiry", 300, 100, 480, 125), (ends, 300, 128, 480, 150), ("Place of Birth", 40, 180, 220, 205), ("ZENITH", 40, 208, 220, 230), (LINE1, 10, 400, 600, 430), (LINE2, 10, 440, 600, 470)]


@pytest.mark.parametrize(
    "a, b, want",
    [("ANNA MARIA", "MARIA ANNA", 100.0), ("ERIKSSON", "ERIKSON", 100 * 14 / 15), ("ABC", "XYZ", 0.0), ("", "", 100.0), ("SMITH", "", 0.0), ("AB" * 50, "BA" * 50, 99.0)],
)
def test_token_sort_ratio(spark, a, b, want):
    assert abs(likeness.token_sort_ratio.func(pd.Series([a]), pd.Series([b]))[0] - want) < 1e-9


def test_common_length_against_the_table_form():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert likeness.common_length(a, b) == rows[-1][-1]


def test_visual_dates(spark):
    texts = ["1974-08-12", "12/08/1974", "12.08.1974", "12 Aug 1974", "12 AUGUST 1974", "19740812", "12/08/74", "31/02/2000", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", dates.visual(F.col("t")).alias("d")).orderBy("k").collect()
    assert [str(r.d) if r.d else None for r in rows] == ["1974-08-12"] * 6 + [None] * 3


def test_validation_of_a_whole_page(spark):
    row = passport.validate_passport(page(spark, biodata()), codes(spark)).first()
    assert (row.confidence, list(row.errors), list(row.warnings)) == (0.985, [], [])
    assert (row.full_name, row.place_of_birth, row.country) == ("ANNA MARIA ERIKSSON", "ZENITH", "UTO")


def test_validation_warnings(spark):
    row = passport.validate_passport(page(spark, biodata("ERICSEN", "13/08/1974", "1 Jan 2030")), codes(spark).filter("code = 'IND'")).first()
    assert list(row.warnings) == ["NAME_PARTIAL_MATCH", "DOB_MISMATCH", "EXPIRY_DATE_MISMATCH", "UNKNOWN_COUNTRY_CODE_UTO"]
    assert row.confidence == round(0.4 + 0.3 * (0.5 / 3) + 0.3 * 0.95, 3)
    row = passport.validate_passport(page(spark, biodata("QQQ")[:2] + biodata()[-2:]), codes(spark)).first()
    assert list(row.warnings) == ["NAME_MISMATCH"] and row.confidence == round(0.4 + 0.3 * 0.95, 3)
    row = passport.validate_passport(page(spark, biodata()[:4]), codes(spark)).first()
    assert (list(row.errors), row.confidence, row.surname) == (["MRZ_NOT_DETECTED"], round(0.15 + 0.3 * 0.95, 3), None)
    late = LINE2[:13] + "741231" + LINE2[19:21] + "700101" + LINE2[27:]
    row = passport.validate_passport(page(spark, [(LINE1, 10, 400, 600, 430), (late, 10, 440, 600, 470)]), codes(spark)).first()
    assert list(row.errors) == ["EXPIRY_BEFORE_DOB"] or row.date_of_birth is None


def test_routing_of_documents(spark):
    from test_engine import PAN

    back = [("Name of Father", 40, 300, 220, 325), ("A", 40, 330, 220, 350), ("Address", 40, 400, 220, 425), ("FILE NO", 40, 500, 220, 525)]
    pages = page(spark, biodata(), 1).union(page(spark, PAN, 2)).union(page(spark, back, 3)).union(page(spark, [("total 100", 0, 0, 10, 10)], 4)).union(page(spark, [("Surname", 40, 300, 220, 325), ("ROY", 40, 330, 220, 350), ("Date of Birth", 40, 400, 220, 425)], 5))
    got = {r.doc_id: r for r in routing.route_documents(pages, "2024-06-01", codes(spark)).collect()}
    assert (got[1].page_type, got[1].status, got[1].low_confidence) == ("passport_biodata", "success", False)
    assert (got[2].document_type, got[2].status) == ("pan", "success")
    assert (got[3].page_type, got[3].status, got[3].warnings) == ("passport_non_biodata", "success", "NON_BIODATA_HINTS_3")
    assert got[4].status == "unsupported_page"
    assert (got[5].page_type, got[5].status, got[5].errors) == ("passport_biodata", "failure", "MRZ_NOT_DETECTED")


def test_full_page_only_when_needed_and_better(spark):
    high = [(LINE1, 10, 40, 600, 70), (LINE2, 10, 80, 600, 110), ("Surname", 40, 500, 200, 520), ("bottom", 40, 900, 200, 920)]
    row = passport.read_passports(page(spark, high), codes(spark)).first()
    assert row.has_mrz and row.overall_ok  # the crop has no zone, the whole page has


def test_back_page(spark):
    rows = [
        ("Name of Father / Legal Guardian", 40, 20, 300, 42), ("RAVI SOMAN", 40, 50, 300, 72), ("Name of Mother", 40, 90, 300, 112), ("LATA SOMAN", 40, 120, 300, 142),
        ("पता / Address", 40, 160, 300, 182), ("14 LAKE VIEW", 40, 190, 300, 212), ("झील के पास", 40, 214, 300, 236), ("KOCHI - 682001 KL", 40, 240, 300, 262), ("FAR COLUMN", 400, 240, 600, 262),
        ("File No.", 400, 300, 600, 322), ("BELOW THE STOP", 40, 302, 300, 324), ("KL1234567890", 400, 330, 600, 352),
        ("Old Passport No. with Date and Place of Issue", 40, 380, 500, 402), ("K1234567", 40, 410, 150, 432), ("12/03/2011", 260, 410, 380, 432), ("KOCHI", 480, 410, 600, 432),
    ]
    row = passport.extract_back_page(page(spark, rows)).first()
    assert (row.father_name, row.mother_name, row.spouse_name, row.file_number) == ("RAVI SOMAN", "LATA SOMAN", None, "KL1234567890")
    assert (row.address, row.pincode, row.city, row.state) == ("14 LAKE VIEW, KOCHI - 682001 KL", "682001", "KOCHI", "Kerala")
    assert (row.old_passport_number, row.old_passport_date_of_issue, row.old_passport_place_of_issue) == ("K1234567", "12/03/2011", "KOCHI")
    empty = passport.extract_back_page(page(spark, [("nothing here", 0, 0, 10, 10)])).first()
    assert set(empty.asDict().values()) == {1, None}


@pytest.mark.parametrize(
    "lines, city, state",
    [
        (["A STREET", "NEW MAHAVIR NAGAR,DELHI", "PIN:110018,INDIA"], "NEW MAHAVIR NAGAR", "Delhi"),
        (["A STREET", "MYSURU 570001 KA"], "MYSURU", "Karnataka"),
        (["A STREET", "HUBLI", "KARNATAKA - 580020"], "HUBLI", "Karnataka"),
        (["A STREET", "PUNE - 411001"], "PUNE", None),
        (["A STREET"], None, None),
    ],
)
def test_state_and_city(spark, lines, city, state):
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    row = df.select(*[c.alias(n) for n, c in passport.parsed_address(F.col("lines")).items()]).first()
    assert (row.city, row.state) == (city, state)


def test_gap_ends_a_rows_scan_only(spark):
    label = spark.createDataFrame([(1, 0, 40, 0, 0, 20)], "doc_id long, page_no int, row_left int, label_seq int, label_top int, label_bottom int")
    rows = page(spark, [("Address", 40, 0, 100, 20), ("first line", 40, 24, 200, 40), ("too far", 40, 100, 200, 120), ("x", 40, 104, 100, 120)])
    assert passport.address_lines(rows, label).first().lines == ["first line"]


def test_letter_labels_and_block(spark):
    rows = [
        ("NATIONAL POPULATION", 40, 0, 400, 20), ("REGISTER", 40, 22, 400, 42), ("Ref. No.: NPR/12/7", 40, 60, 300, 80), ("NPR name and address letter", 40, 90, 400, 110),
        ("निवासी का नाम", 40, 130, 200, 150), ("MEENA KURUP", 240, 130, 400, 150), ("Address: 5 HILL ROAD", 40, 170, 300, 190), ("WARD 3", 40, 195, 300, 215), ("WARD 3", 40, 220, 300, 240), ("KOTTAYAM 686001", 40, 245, 300, 265),
        ("Date of Issue - 5 March 2015", 40, 290, 300, 310), ("not part of it", 40, 315, 300, 335), ("Yours faithfully", 40, 400, 300, 420),
    ]
    row = npr.extract_npr_fields(page(spark, rows)).first()
    assert (row.reference_number, row.name, row.issue_date) == ("NPR/12/7", "MEENA KURUP", "5 March 2015")
    assert (row.address, row.pincode) == ("5 HILL ROAD, WARD 3, KOTTAYAM 686001", "686001")
    assert npr.extract_npr_fields(page(spark, [("NPR MEDIA SERVICES", 0, 0, 10, 10), ("Name: X", 0, 20, 10, 30)])).count() == 0
    assert npr.npr_letters(page(spark, [("NPR", 0, 0, 10, 10), ("महापंजीयक", 0, 20, 10, 30)])).count() == 1


def test_states_and_countries(spark):
    assert dims.STATES["OR"] == dims.STATES["OD"]
    listed = {r.code for r in dims.country_dim(spark).collect()}
    assert {"IND", "USA", "D<<", "UNO"} <= listed and "UTO" not in listed
