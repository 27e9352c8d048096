"""Classification reads a document's regions once: one aggregate, no join, and the same evidence as region by region."""

from pyspark.sql import functions as F

from folioscan.functions import identifiers as I
from folioscan.operators import assess, classify
from folioscan.plans import fixtures as X

SCHEMA = "doc_id long, page_no int, seq int, text string, left int, top int, right int, bottom int, confidence double"
ZONE = "P<INDRAO<<SUNITA<<<<<<<<<<<<<<<<<<<<<<<<<<<<"


def pages(spark, *texts):
    return spark.createDataFrame([(doc, page, seq, text, 0, bottom - 20, 100, bottom, 0.9) for doc, page, seq, text, bottom in texts], SCHEMA)


def test_classes_need_one_aggregate_and_no_join(spark):
    plan = classify.classify_documents(X.regions(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    plan = classify.evidence_counts(X.regions(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_keywords_lie_in_one_region_and_titles_may_cross(spark):
    rows = pages(spark, (1, 0, 0, "Income-Tax  Department", 40), (1, 0, 1, "INCOME", 80), (1, 0, 2, "tax", 120), (2, 0, 0, "NATIONAL", 40), (2, 0, 1, "हिन्दी", 60), (2, 0, 2, "POPULATION REGISTER", 80), (3, 0, 0, None, 40), (4, 0, 0, "IDENTITY CARDS | JOB CARD", 40))
    assert {tuple(r) for r in classify.evidence_counts(rows).collect()} == {(1, "pan", "keyword", 1), (4, "nrega_job_card", "card", 1)}
    assert {r.doc_id: r.document_type for r in classify.classify_documents(rows).collect()} == {1: "pan", 2: "npr_letter", 3: "unknown", 4: "unknown"}


def test_zone_needs_two_lines_low_on_one_page(spark):
    rows = pages(
        spark,
        (1, 0, 0, ZONE, 400), (1, 0, 1, ZONE, 450), (1, 0, 2, "x", 600),
        (2, 0, 0, ZONE, 100), (2, 0, 1, ZONE, 450), (2, 0, 2, "x", 600),
        (3, 0, 0, ZONE, 450), (3, 1, 0, ZONE, 450),
        (4, 0, 0, ZONE, 100), (4, 0, 1, ZONE, 140), (4, 0, 2, "", 600),
    )
    assert {tuple(r) for r in classify.document_scores(rows).select("doc_id", "doc_type", "score", "reasons").collect()} == {(1, "passport", 4, "MRZ_DETECTED")}


def test_number_of_twelve_digits_is_judged_without_lambda(spark):
    texts = ["9998 8877 7669", "9998 8877 7660", "0998 8877 7669", "९९९८ ८८७७ ७६६९", "none", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(I.aadhaar_valid(F.col("t")).alias("ok"))
    assert [r.ok for r in found.collect()] == [True, False, False, False, False, False]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_results_read_classes_that_are_staged(spark):
    plan = assess.scan_results(X.regions(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "scores" not in plan and "class_confidence" in plan
