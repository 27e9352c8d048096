"""Published expectations on small tables, plan shape, and SQL twins at the smallest scale."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscan.functions import checksum, dates
from folioscan.functions import identifiers as I
from folioscan.functions import text as T
from folioscan.operators import assess, classify, evaluate, extract, layout, mrz, routing
from folioscan.operators import regions as R
from folioscan.plans import fixtures, registry
from folioscan.sources import ingest
from folioscan.streaming import jobs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, page_no int, seq int, text string, left int, top int, right int, bottom int, confidence double"


def page(spark, rows, doc_id=1, confidence=0.95):
    return spark.createDataFrame([(doc_id, 0, k, t, *box, confidence) for k, (t, *box) in enumerate(rows)], SCHEMA)


def column(spark, values, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v"))).collect()]




def column_of(texts, left=25, top=12, step=47):
    """Texts one under the other, each box as wide as its text."""
    return [(t, left, top + step * k, left + 11 * len(t), top + step * k + 26) for k, t in enumerate(texts)]


def rows_of(pairs, left=25, value=310, top=15, step=66):
    """A label and its value on each row."""
    return [cell for k, (a, b) in enumerate(pairs) for cell in ((a, left, top + step * k, left + 11 * len(a), top + step * k + 24), (b, value, top + step * k + 1, value + 11 * len(b), top + step * k + 25))]


PAN = column_of(["INCOME TAX DEPARTMENT", "GOVT. OF INDIA", "Name", "TARUN KULKARNI", "Father's Name", "SURESH KULKARNI", "Date of Birth", "27/11/1979", "Permanent Account Number", "BKLPT4821M"])
LINE1 = "P<UTOERIKSSON<<ANNA<MARIA".ljust(44, "<")
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def zone(spark, line1=LINE1, line2=LINE2):
    return page(spark, [(line1, 10, 400, 600, 430), (line2, 10, 440, 600, 470)])


def test_check_digits(spark):
    assert column(spark, ["L898902C3", "", "<<<"], checksum.icao_digit) == [6, 0, 0]
    assert column(spark, ["2363", "2364", "999888777669", "999888777696", "12A4", ""], checksum.verhoeff_ok) == [True, False, True, False, False, False]


def test_identifiers(spark):
    assert column(spark, ["PAN: BKLPT4821M ", "BKL4821M"], I.pan) == ["BKLPT4821M", None]
    assert column(spark, ["BKLPT4821M", "BKLDT4821Z"], I.pan_valid) == [True, False]
    assert column(spark, ["9998 8877 7669", "9998 8877 7660", "0998 8877 7669"], I.aadhaar_valid) == [True, False, False]
    assert column(spark, ["MH12 2011 0012345"], I.licence) == ["MH1220110012345"]
    assert column(spark, ["RJ-27-001-002-0008147/00", "RJ-27-123"], I.job_card) == ["RJ-27-001-002-0008147/00", None]
    assert column(spark, ["XXXX XXXX 1234", "1234"], I.aadhaar_last4) == ["1234", None]
    assert column(spark, ["९९९८ ८८७७ ७६६९"], lambda c: I.aadhaar(c).isNotNull()) == [True]


def test_dates(spark):
    assert column(spark, ["900315", "290601", "300601", "901301", "900132"], dates.mrz_date) == ["1990-03-15", "2029-06-01", "1930-06-01", None, None]
    parsed = column(spark, ["15/08/1985", "15-08-85", "15.08.45", "1985-08-15", "5 March 1990", "31/02/2000", "x", None], dates.parse_printed)
    assert [str(d) if d else None for d in parsed] == ["1985-08-15", "1985-08-15", "2045-08-15", "1985-08-15", "1990-03-05", None, None, None]


def test_text(spark):
    assert column(spark, ["Father's  Name & Co.\n"], T.norm_label) == ["FATHER S NAME AND CO"]
    assert column(spark, [": TARUN", ":"], T.clean_colon) == ["TARUN", None]
    assert column(spark, ["Name : A B -"], T.after_colon) == ["A B"]
    assert column(spark, ["a>b c"], T.clean_mrz) == ["A<BC"]


def test_machine_readable_zone(spark):
    row = mrz.parse_mrz(zone(spark)).first()
    assert (row.surname, row.given_names, row.country, row.passport_number, row.sex) == ("ERIKSSON", "ANNA MARIA", "UTO", "L898902C3", "F")
    assert row.overall_ok and row.errors == ""
    fixed = mrz.parse_mrz(zone(spark, line2=LINE2[:14] + "4" + LINE2[15:17] + "I" + LINE2[18:])).first()
    assert fixed.date_of_birth == row.date_of_birth
    assert mrz.parse_mrz(zone(spark, LINE1.replace("<", ">"), LINE2.replace("<", ">"))).first().overall_ok
    bad = mrz.parse_mrz(zone(spark, line2=LINE2[:9] + "5" + LINE2[10:19] + "9" + LINE2[20:])).first()
    assert not bad.number_ok and not bad.birth_ok and not bad.overall_ok
    assert mrz.parse_mrz(page(spark, [(LINE1, 10, 400, 600, 430)])).count() == 0


def test_pan_card_value_below_and_right(spark):
    row = extract.extract_pan(page(spark, PAN)).first()
    assert (row.pan_number, row.name, row.father_name, row.date_of_birth) == ("BKLPT4821M", "TARUN KULKARNI", "SURESH KULKARNI", "27/11/1979")
    right = rows_of([("Name", "MEGHA PILLAI"), ("Father's Name", "SASI PILLAI"), ("DOB", "06/02/1995")]) + [("CDMPR7306K", 25, 330, 245, 356)]
    row = extract.extract_pan(page(spark, right)).first()
    assert (row.pan_number, row.name, row.father_name, row.date_of_birth) == ("CDMPR7306K", "MEGHA PILLAI", "SASI PILLAI", "06/02/1995")


def test_classification(spark):
    kind = lambda *texts: classify.classify_documents(page(spark, [(t, 0, 30 * k, 100, 30 * k + 20) for k, t in enumerate(texts)])).first()
    nested = kind("12 ELECTION COMMISSION ROAD")
    assert (nested.document_type, nested.reasons, nested.confidence) == ("voter_id", "VOTER_KEYWORDS_1", 0.74)
    assert kind("MAHATMA GANDHI NATIONAL RURAL EMPLOYMENT GUARANTEE ACT", "9998 8877 7669").document_type == "nrega_job_card"
    assert kind("EMPLOYEE JOB CARD").document_type == "unknown"
    assert kind("NPR MEDIA SERVICES").document_type == "unknown"
    assert kind("just a receipt", "total 100").document_type == "unknown"


def test_routing(spark):
    done = assess.scan_results(page(spark, PAN)).first()
    assert (done.document_type, done.status, done.errors) == ("pan", "success", "")
    bad = assess.scan_results(page(spark, PAN[:-1] + [("BKLDT4821M", *PAN[-1][1:])])).first()
    assert bad.status == "failure" and "INVALID_OR_MISSING_DOCUMENT_IDENTIFIER" in bad.errors
    assert assess.scan_results(page(spark, [("total 100", 0, 0, 10, 10)])).first().status == "unsupported_page"


def test_readings_of_one_box(spark):
    rows = spark.createDataFrame([(1, 0, k, t, 0, 0, 10, 10, c) for k, (t, c) in enumerate([("A b", 0.1), ("a  B", 0.9), ("other", 0.2)])], SCHEMA)
    kept = {(r.seq, r.text) for r in R.dedup_regions(rows).collect()}
    assert kept == {(0, "a  B"), (2, "other")}
    row = R.geometry_confidence(rows).first()
    assert (row.mean_confidence, row.min_confidence) == (0.9, 0.9)


def test_partitions_do_not_matter(spark):
    regions = fixtures.regions(spark, SF).filter("doc_id < 300")
    one = {tuple(r) for r in layout.label_values(regions.coalesce(1)).collect()}
    assert one == {tuple(r) for r in layout.label_values(regions.repartition(7)).collect()}


def test_plans_have_no_cartesian_join(spark):
    regions = spark.read.schema(SCHEMA).parquet(_saved(spark))
    for job in (layout.label_values(regions), classify.classify_documents(regions), assess.scan_results(regions)):
        plan = job._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _saved(spark):
    path = f"/tmp/spark-regions-{os.getpid()}"
    fixtures.regions(spark, SF).write.mode("overwrite").parquet(path)
    return path


def test_trusted_filter_reaches_the_scan(spark):
    plan = R.trusted(spark.read.parquet(_saved(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(confidence,0.5)" in plan


def test_evaluation_gate(spark):
    observed = evaluate.observations(fixtures.samples(spark, SF), fixtures.results(spark, SF))
    row = evaluate.gate(evaluate.checks(evaluate.metrics(observed))).first()
    assert not row.passed and row.failed > 0
    same = fixtures.samples(spark, SF).select("sample_id", "document_type", "accepted", "fields")
    assert evaluate.gate(evaluate.checks(evaluate.metrics(evaluate.observations(fixtures.samples(spark, SF), same)))).first().passed


def test_json_keeps_null_keys(spark):
    row = ingest.to_json(spark.sql("SELECT 1L AS doc_id, CAST(NULL AS STRING) AS document_type")).first()
    assert row.json == '{"docId":1,"documentType":null}'


def test_stream_gives_the_batch_result(spark, tmp_path):
    log = fixtures.scan_log(spark, SF)
    log.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    query = jobs.stream_quality(stream).writeStream.format("memory").queryName("quality").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("quality").collect()} == {tuple(r) for r in jobs.stream_quality(log).collect()}


def test_stream_scan(spark, tmp_path):
    regions = fixtures.regions(spark, SF).filter("doc_id < 60")
    regions.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(regions.schema).parquet(str(tmp_path / "in"))
    jobs.stream_scan(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in assess.scan_results(regions).collect()}


def test_documents_over_many_batches_are_scanned_whole(spark, tmp_path):
    regions = fixtures.regions(spark, SF).filter("doc_id < 40")
    docs = regions.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "seq", "text", "left", "top", "right", "bottom", "confidence")).alias("regions"))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_scan(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    assert {tuple(r) for r in got.drop("batch").collect()} == {tuple(r) for r in assess.scan_results(regions).collect()}


def test_resubmissions_and_pages(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 10:00:00"), (1, 0, "2024-01-01 10:00:05"), (2, 0, "2024-01-01 10:01:00"), (1, 1, "2024-01-01 10:02:00"), (2, 3, "2024-01-01 12:00:00")]
    scans = spark.createDataFrame(rows, "doc_id long, page_no int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    scans.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(scans.schema).parquet(str(tmp_path / "in"))
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(jobs.stream_dedup(source()), "first_scans", "append")
    assert sorted(r.doc_id for r in spark.table("first_scans").collect()) == [1, 2]
    run(jobs.stream_pages(source()), "whole_documents", "complete")
    assert sorted((r.doc_id, r.pages) for r in spark.table("whole_documents").collect()) == [(1, [0, 0, 1]), (2, [0]), (2, [3])]


@pytest.mark.parametrize("name", ["dedup_regions", "label_match", "classify_documents", "parse_mrz", "printed_dates", "sliced_metrics", "threshold_checks", "check_manifest"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("orders", "customer", "documents", "part", "events", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    fold = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else v
    got = sorted(repr(tuple(fold(r[c]) for c in columns)) for r in frame.collect())
    found = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted(repr(tuple(map(fold, r))) for r in found)


def test_results_of_cards_are_whole_objects(spark):
    row = json.loads(registry.queries()["results_to_json"](spark, SF).filter("doc_id = 6").first().json)
    assert len(row) == 22 and row["fields"] is None and row["probeText"] == [] and row["documentType"] == "pan"
    assert row["panFields"]["panNumber"] and set(row["panFields"]) == {"panNumber", "name", "fatherName", "dateOfBirth"} and row["aadhaarFields"] is None
    unread = json.loads(ingest.to_json(routing.result_objects(routing.route_cards(page(spark, [("total 100", 0, 0, 10, 10)]), "2024-06-01")), with_id=False).first().json)
    assert (unread["status"], unread["unsupportedReason"], unread["warnings"], unread["panFields"]) == ("unsupported_page", "UNSUPPORTED_DOCUMENT", ["NO_DOCUMENT_HINTS"], None)
