"""Whole voters' cards on small hand-made pages; expectations follow the printed rules."""

import pytest

from folioscan.operators import cards
from test_engine import column, page

TOP = [("ELECTION COMMISSION OF INDIA", 40, 0, 400, 20), ("ABC1234567", 40, 30, 200, 50), ("Elector's Name", 40, 60, 180, 80), ("ASHA MENON", 200, 60, 360, 80)]


def read(spark, *rows):
    return cards.extract_voter_cards(page(spark, TOP + [(t, x, y, x + 140, y + 20) for t, x, y in rows])).first()


@pytest.mark.parametrize("text, want", [("FEMALE", "FEMALE"), ("Male / पुरुष", "MALE"), ("others", "TRANSGENDER"), ("महिला", "FEMALE"), ("अन्य", "TRANSGENDER"), (" f ", "FEMALE"), ("T.", "TRANSGENDER"), ("M1", "MALE"), ("FM", None), ("", None)])
def test_gender_ladder(spark, text, want):
    assert column(spark, [text], cards.voter_gender) == [want]


def test_mother_and_hindi_gender(spark):
    r = read(spark, ("Mother's Name", 40, 100), ("LATA MENON", 200, 100), ("लिंग", 40, 140), ("महिला", 200, 140), ("Date of Birth", 40, 180), ("09/03/1986", 200, 180))
    assert (r.epic_number, r.name, r.relation_name, r.relation_type) == ("ABC1234567", "ASHA MENON", "LATA MENON", "mother")
    assert (r.gender, r.date_of_birth, r.age) == ("FEMALE", "09/03/1986", None)


def test_father_goes_first_and_labels_hold_their_word(spark):
    r = read(spark, ("Mother's Name", 40, 100), ("LATA MENON", 200, 100), ("Father's Name", 40, 140), ("RAVI MENON", 200, 140), ("Sex", 40, 180), ("M", 200, 180))
    assert (r.relation_name, r.relation_type, r.gender) == ("RAVI MENON", "father", "MALE")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("Age", 40, 100), ("34", 200, 100)], "34"),
        ([("Age as on 1.1.2024 : 34", 40, 100)], "34"),
        ([("his AGE was", 40, 100), ("in 2024", 40, 500), ("41 years", 400, 560)], "41"),
        ([("Age", 40, 100), ("150", 200, 100)], None),
        ([("VILLAGE 34", 40, 100)], None),
    ],
)
def test_age(spark, rows, want):
    assert read(spark, *rows).age == want
