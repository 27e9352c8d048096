"""Job cards on small hand-made pages; expectations follow the printed rules, not another job."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import multiscript as M
from folioscan.operators import job_card
from test_engine import column, page


def test_normal_form():
    assert M.normal("Father’s  Name & ＡＢ") == "fathers name and ab"
    assert M.normal("महिला, नहीं!") == "महिला नहीं"
    assert M.as_label("J0B CARD N0 1") == "job card no i"


def test_vocabularies(spark):
    assert column(spark, ["F", "पुरुष", "third gender", "Male person", None], M.gender) == ["FEMALE", "MALE", "TRANSGENDER", None, None]
    assert column(spark, ["Scheduled Caste", "अन्य पिछड़ा वर्ग", "gen", "Hill tribe", " "], M.category) == ["SC", "OBC", "OTHER", "Hill tribe", None]
    assert column(spark, ["Yes", "नहीं", "no, not", "maybe"], M.yes_no) == [True, False, False, None]


def test_full_width_card_numbers(spark):
    assert column(spark, ["ＲＪ－２７－００１－００２－０００８１４７／００", "KL−1-2-3"], job_card.card_number) == ["RJ-27-001-002-0008147/00", None]


def test_card_numbers(spark):
    texts = ["No. RJ-27-OO1-002-0008147/00 here", "RJ-27-123", "KL – 1S - 2 - 3 / 4", "AB-1-2-3 CD-1-2-3-4", "x"]
    assert column(spark, texts, job_card.card_number) == ["RJ-27-001-002-0008147/00", None, "KL-15-2-3/4", "CD-1-2-3-4", None]


@pytest.mark.parametrize(
    "text, group, score",
    [("Village", "village", 1.007), ("Village: RAMPUR", "village", 1.007), ("the gram panchayat office", "gram_panchayat", 1.004), ("Grarn Panchayat", "gram_panchayat", 0.999), ("Vilage", "village", 12 / 13), ("ग्राम पंचायत", "gram_panchayat", 1.012), ("RAMPUR", None, None)],
)
def test_label_scores(spark, text, group, score):
    from folioscan.plans import job_card as L

    got = {r.group: r.score for r in job_card.label_scores(page(spark, [(text, 0, 0, 10, 10)]), L.FIELDS).collect()}
    if group is None:
        assert got == {}
    else:
        assert max(got, key=got.get) == group and abs(got[group] - score) < 0.02


CARD = [
    ("MGNREGA JOB CARD", 40, 0, 300, 20), ("Job Card No.", 40, 40, 200, 60), ("RJ-27-001-002-0008147/00", 220, 40, 500, 60), ("Name of Head of Household: SITA BAI", 40, 70, 400, 90), ("Vilage", 40, 100, 120, 120), ("RAMPUR", 40, 130, 200, 150),
    ("Gram Panchayat", 40, 262, 180, 282), ("KHERA", 220, 262, 320, 282), ("Whether BPL - Yes", 40, 170, 300, 190), ("Category SC", 40, 200, 300, 220), ("Validity Period", 40, 230, 200, 250), ("01/04/2020 to 31/03/2025", 220, 230, 500, 250),
    ("Sl No", 40, 300, 80, 320), ("Name", 120, 302, 200, 322), ("Father/Husband Name", 260, 300, 420, 320), ("Sex", 460, 300, 500, 320), ("Age", 540, 300, 580, 320),
    ("1", 45, 340, 60, 360), ("SITA", 120, 342, 180, 362), ("BAI", 185, 350, 220, 370), ("GOPAL", 270, 341, 330, 361), ("F", 465, 340, 480, 360), ("39", 545, 342, 570, 362),
    ("2", 45, 380, 60, 400), ("RAVI", 120, 380, 180, 400), ("GOPAL", 270, 380, 330, 400), ("पुरुष", 465, 380, 480, 400), ("17", 545, 380, 570, 400),
    ("3", 45, 420, 60, 440), ("NO AGE OR SEX", 120, 420, 200, 440), ("Family ID", 40, 500, 140, 520), ("4 | LEELA | F | 64", 40, 560, 400, 580), ("1 | Sita Bai | F | 39", 40, 600, 400, 620),
]


def test_whole_card(spark):
    row = job_card.extract_job_cards(page(spark, CARD)).first()
    assert (row.job_card_number, row.head_of_household, row.village, row.gram_panchayat) == ("RJ-27-001-002-0008147/00", "SITA BAI", "RAMPUR", "KHERA")
    assert (row.bpl_status, row.category, row.validity_from, row.validity_to) == (True, "SC", "01/04/2020", "31/03/2025")
    assert [(m.serial, m.name, m.relation, m.gender, m.age) for m in row.members] == [("1", "SITA BAI", "GOPAL", "FEMALE", 39), ("2", "RAVI", "GOPAL", "MALE", None), ("4", "LEELA", None, "FEMALE", 64)]


def test_page_without_anything(spark):
    row = job_card.extract_job_cards(page(spark, [("hello", 0, 0, 10, 10)])).first()
    assert {v for k, v in row.asDict().items() if k not in ("doc_id", "members")} == {None} and row.members == []


def test_index_finds_what_all_pairs_find(spark):
    """Planted texts with errors, in several scripts, against the likeness of every text and label."""
    import difflib
    import random
    import re

    from folioscan.plans import job_card as L

    rng = random.Random(4)
    labels = L.FIELDS | L.ENDS | L.HEADERS
    aliases = [(g, M.as_label(a)) for g, names in labels.items() for a in names]
    texts = {"", "x", "no", "Village: RAMPUR", "the gram panchayat office", "Name - SITA", "aaaa aaaa", "12 / 4"}
    for _, a in aliases:
        for _ in range(3):
            w = list(a)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "e", " ", "क"])
            texts.add("".join(w) + rng.choice(["", ": value", " - x", " more"]))
    want = {}
    for text in texts:
        whole, head = M.as_label(text), M.as_label(re.split(job_card.DELIMITERS, text, maxsplit=1)[0])
        for g, a in aliases:
            n, m = len(a), len(head)
            if not whole:
                continue
            score = 1 + min(n, 100) / 1000 if a in (whole, head) else 0.99 + min(n, 100) / 1000 if f" {a} " in f" {whole} " else 0
            if not score and n >= 5 and 0.65 * n <= m <= 1.45 * n:
                score = difflib.SequenceMatcher(None, head, a).ratio()
            if score >= job_card.NEAR:
                want[text, g] = max(want.get((text, g), 0), score)
    got = {(r.text, r.group): r.score for r in job_card.text_scores(spark.createDataFrame([(t,) for t in texts], "text string"), labels).collect()}
    assert got.keys() == want.keys() and len(got) > 300
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_repeated_texts_are_scored_once(spark):
    from folioscan.plans import job_card as L

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.when(F.col("id") % 3 == 0, "Village").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    scored = job_card.label_scores(rows, L.FIELDS).filter("group = 'village'")
    assert scored.count() == 1000 and scored.agg(F.min("score"), F.max("score")).first() == (1.007, 1.007)
