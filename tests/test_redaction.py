"""Reports show no values: the plan of each report, and planted leaks of several shapes."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import evaluate
from folioscan.sources import redaction


def tables(spark):
    """Samples and results with the columns that the evaluation reads, values in ``fields``."""
    slices = ", ".join(f"{d} string" for d in evaluate.DIMENSIONS)
    samples = spark.createDataFrame([], f"sample_id long, document_type string, accepted boolean, fields map<string,string>, {slices}")
    return samples, spark.createDataFrame([], "sample_id long, document_type string, accepted boolean, fields map<string,string>")


def test_reports_show_no_values(spark):
    samples, results = tables(spark)
    observed = evaluate.observations(samples, results)
    measured = evaluate.metrics(observed)
    checks = evaluate.checks(measured)
    for report in (observed, measured, evaluate.sliced_metrics(observed), evaluate.field_metrics(samples, results), checks, evaluate.gate(checks), evaluate.sorted_report(measured, checks)):
        assert redaction.assert_redacted(report, ["fields"]) is report
    assert redaction.shown(observed)["document_type"] == {"document_type"}


LEAKS = {
    "plain": lambda r: r.select("sample_id", F.col("fields")["name"].alias("note")),
    "hidden in text": lambda r: r.select(F.concat(F.lit("see "), F.upper(F.element_at("fields", "name"))).alias("note")),
    "hashed": lambda r: r.select(F.sha2(F.col("fields")["number"], 256).alias("note")),
    "exploded": lambda r: r.select("sample_id", F.explode("fields").alias("k", "v")).groupBy("k").agg(F.max("v").alias("note")),
    "as json": lambda r: r.select(F.to_json(F.struct("sample_id", "fields")).alias("note")),
    "in one branch": lambda r: r.select(F.when(F.col("accepted"), F.lit("fine")).otherwise(F.array_join(F.map_values("fields"), ",")).alias("note")),
    "by a union": lambda r: r.select(F.lit("x").alias("note")).union(r.select(F.col("fields")["name"])),
    "after a join": lambda r: r.select("sample_id").join(r.select("sample_id", F.col("fields")["name"].alias("note")), "sample_id"),
}


@pytest.mark.parametrize("kind", LEAKS)
def test_planted_leaks_are_found(spark, kind):
    with pytest.raises(redaction.LeakError, match="note"):
        redaction.assert_redacted(LEAKS[kind](tables(spark)[1]), ["fields"])


def test_decisions_and_counts_are_no_leaks(spark):
    rows = tables(spark)[1]
    fine = rows.select("document_type", F.when(F.col("fields")["name"] == "X", "same").otherwise("other").alias("verdict"), F.size("fields").alias("n"), F.col("fields")["name"].isNotNull().alias("present"))
    counted = fine.filter("present").groupBy("document_type", "verdict").agg(F.count("*").alias("n"))
    for report in (fine, counted):
        assert redaction.assert_redacted(report, ["fields"]) is report
