"""What a query does for each row: one search for labels, patterns compiled once, forms of a text made once."""

from pyspark.sql import functions as F

from folioscan.operators import assess, cards, extras, job_card, layout, npr
from folioscan.plans import dims
from folioscan.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_searched_once(spark):
    regions = X.regions(spark, SF)
    searches = lambda df: plan(df).count("Generate posexplode(words")
    assert searches(layout.label_match(regions)) == 1
    assert searches(layout.row_left(layout.label_match(regions), regions)) == 1
    assert searches(layout.value_below(layout.label_match(regions), regions)) == 1


def test_label_score_makes_each_form_once(spark):
    english, hindi = dims.NPR_LABELS["name"]
    scored = spark.createDataFrame([("Name: A",)], "text string").select(npr.label_score(F.col("text"), english, hindi).alias("s"))
    assert plan(scored).count("regexp_replace(") == 2
    assert scored.first().s > 30_000


def test_letters_are_scored_without_lambda(spark):
    assert "lambda" not in plan(npr.best_labels(X.regions(spark, SF)))
    english, hindi = ([x for pair in dims.NPR_LABELS.values() for x in pair[k]] for k in (0, 1))
    texts = [(t,) for t in ("Name: A", "the name", "Name", "Ref. No. 7", "reference", "पता", "पता: x", "पत्र संख्या - 4", "NAMES", "x: Name", "", None)]
    head = F.split("text", "[:：]", 2)[0]
    told = spark.createDataFrame(texts, "text string").select(npr.field_label(F.col("text")).alias("a"), (npr.label_score(head, english, hindi) > 0).alias("b"))
    assert [r.a for r in told.collect()] == [r.b for r in told.collect()] == [True, False, True, True, False, True, True, True, False, False, False, False]
    assert "lambda" not in plan(told.select("a"))


def test_leading_words_of_a_label_are_told_without_lambda(spark):
    labels = {"name": ["Name", "Name of Head"], "block": ["Block"]}
    rows = [("name of head anil", "name"), ("name of heads", "name"), ("names", "name"), ("block name", "name"), ("block", "block"), ("", "block")]
    told = spark.createDataFrame(rows, "whole string, field string").select(job_card.leading_words(F.col("whole"), F.col("field"), labels).alias("n"))
    assert [r.n for r in told.collect()] == [3, 1, 0, 0, 1, 0]
    assert "lambda" not in plan(told)


def test_split_licence_drops_most_rows_by_one_search(spark):
    rows = spark.createDataFrame([(1, 0, 0, "MH12", 10, 20, 60, 40, 0.9), (1, 0, 1, "2011", 70, 20, 120, 40, 0.9), (1, 0, 2, "0012345", 130, 20, 200, 40, 0.9)], "doc_id long, page_no int, seq int, text string, left int, top int, right int, bottom int, confidence double")
    found = extras.split_licence(rows)
    assert [tuple(r) for r in found.collect()] == [(1, "MH1220110012345")]
    assert "RLIKE(" in plan(found)


def test_vehicle_tokens_are_tried_only_where_one_pattern_finds_any(spark):
    texts = [("LMV, MCWG",), ("LMV-NT",), ("XLMV",), (None,), ("nothing",)]
    found = spark.createDataFrame(texts, "text string").select(extras.vehicle_tokens(F.col("text")).alias("t"))
    assert [r.t for r in found.collect()] == [["MCWG", "LMV"], ["LMV-NT"], [], [], []]
    assert "RLIKE(" in plan(found)


def test_names_are_told_without_lambda(spark):
    told = spark.createDataFrame([("RAVI KUMAR",), ("GOVT. OF INDIA",), ("FEMALES ONLY",), ("R2D2",), ("  ",)], "text string").select(extras.name_like(F.col("text")).alias("n"))
    assert [r.n for r in told.collect()] == [True, False, True, False, False]
    assert "lambda" not in plan(told)


def test_labels_of_a_card_are_gathered_not_picked_field_by_field(spark):
    regions = X.regions(spark, SF)
    aadhaar, voter = plan(cards.extract_aadhaar_cards(regions)), plan(cards.extract_voter_cards(regions))
    assert "max_by(struct(page_no" not in aadhaar + voter


def test_a_region_that_labels_many_fields_meets_its_page_once(spark):
    assert "collect_list(struct(doc_type" in plan(layout.label_values(X.regions(spark, SF)))


def test_assessment_deals_regions_by_document_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for job in (assess.assess_extraction, assess.scan_results):
            done = job(X.regions(spark, SF))._jdf.queryExecution().executedPlan().toString()
            moves = [line for line in done.split("\n") if "Exchange hashpartitioning(" in line]
            assert moves and not [m for m in moves if "page_no" in m or "ENSURE_REQUIREMENTS" in m]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
