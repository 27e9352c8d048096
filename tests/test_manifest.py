"""Manifests, thresholds, assets and rates on small hand-made files."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from folioscan.operators import evaluate, extras
from folioscan.plans import fixtures
from folioscan.sources import ingest, manifest as M

SF = "/root/testdata/sf0.001"


def sample(doc_type, k):
    return {"id": f"{doc_type}-{k}", "asset": f"{doc_type}/{k}.png", "documentType": doc_type, "designFamily": "d1", "yearBand": "2010s", "issuer": {"name": "office", "state": "KL"}, "languages": ["en", "ml"], "scripts": ["latin"], "side": "front",
            "capture": {"type": "phone_photo", "quality": {q: v[0] for q, v in M.QUALITY.items()}}, "expected": {"accepted": True, "fields": {"name": "A", "number": None}, "requiredFields": ["name"]}}


def whole():
    slices = {"side": ["front"], "language": ["ml"], "quality.blur": ["none"]}
    return {"schemaVersion": M.VERSION, "datasetVersion": "1", "requiredDocumentTypes": M.TYPES, "samples": [sample(t, 0) for t in M.TYPES], "requiredSlices": slices, "requiredDocumentSlices": {t: slices for t in M.TYPES},
            "thresholds": {"overall": {r: 0.5 for r in M.RULES}, "perDocument": {"*": {"minExactFieldAccuracy": 0.9}}, "perSlice": {"dimensions": ["side"], "minimumSamples": 2, "rules": {}}}}


def violations(spark, tmp_path, body):
    path = tmp_path / "m.json"
    path.write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    return {(r.scope, r.violation) for r in M.manifest_violations(M.read_manifest(spark, str(path))).collect()}


def test_a_sound_manifest(spark, tmp_path):
    assert violations(spark, tmp_path, whole()) == set()


def test_every_fault_is_a_row(spark, tmp_path):
    m = copy.deepcopy(whole())
    s = m["samples"]
    s[0]["asset"], s[1]["asset"], s[2]["side"], s[3]["languages"] = "/abs.png", "a/../b.png", "top", []
    s[0]["capture"]["quality"]["blur"], s[1]["capture"]["type"] = "very", "film"
    s[2]["expected"]["requiredFields"] = ["name", "name", "other"]
    s[3]["expected"]["requiredFields"] = ["number"]
    s[4]["expected"]["classificationTarget"] = "unknown"
    s[5]["expected"]["accepted"] = False
    s.append(copy.deepcopy(s[0]))
    m["thresholds"]["overall"].pop(M.RULES[0])
    m["thresholds"]["overall"]["minLuck"], m["thresholds"]["perDocument"]["visa"] = 0.1, {"minExactFieldAccuracy": 1.5}
    m["thresholds"]["perSlice"] = {"dimensions": ["mood"], "minimumSamples": 0, "rules": {}}
    m["requiredSlices"]["state"] = ["TN"]
    m["datasetVersion"] = " "
    got = violations(spark, tmp_path, m)
    assert got >= {
        ("pan-0", "UNSAFE_ASSET"), ("aadhaar-0", "UNSAFE_ASSET"), ("driving_licence-0", "BAD_SIDE"), ("voter_id-0", "BAD_LANGUAGES"), ("pan-0", "BAD_QUALITY_BLUR"), ("aadhaar-0", "BAD_CAPTURE_TYPE"), ("pan-0", "DUPLICATE_SAMPLE_ID"),
        ("driving_licence-0", "REPEATED_REQUIRED_FIELD"), ("driving_licence-0", "REQUIRED_FIELD_NOT_EXPECTED"), ("voter_id-0", "NULL_REQUIRED_FIELD"), ("nrega_job_card-0", "ACCEPTED_OF_ANOTHER_TYPE"), ("npr_letter", "NO_ACCEPTED_SAMPLE"),
        ("manifest", "OVERALL_RULES_INCOMPLETE"), ("overall.minLuck", "UNKNOWN_RULE"), ("visa.minExactFieldAccuracy", "LIMIT_OUT_OF_RANGE"), ("visa", "UNKNOWN_THRESHOLD_TYPE"), ("manifest", "UNKNOWN_SLICE_DIMENSION"), ("manifest", "BAD_MINIMUM_SAMPLES"),
        ("*.state.TN", "SLICE_NOT_COVERED"), ("npr_letter.side.front", "SLICE_NOT_COVERED"), ("manifest", "BLANK_DATASET_VERSION"),
    }
    assert ("manifest", "BAD_JSON") in violations(spark, tmp_path, "{ no json")


def test_thresholds_are_replaced_whole(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(whole()))
    (tmp_path / "t.json").write_text(json.dumps({"thresholds": {"overall": {"maxRuntimeErrorRate": 0.1}}}))
    one = M.read_manifest(spark, str(tmp_path / "m.json"))
    both = M.with_thresholds(one, M.read_manifest(spark, str(tmp_path / "t.json")))
    assert [(r.scope, r.rule, r.limit) for r in M.thresholds_of(both).collect()] == [("overall", "maxRuntimeErrorRate", 0.1)]


def test_assets(spark, tmp_path):
    (tmp_path / "pan").mkdir()
    (tmp_path / "pan" / "0.png").write_bytes(b"\x89PNG")
    (tmp_path / "pan" / "1.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "pan" / "2.HEIC").write_bytes(b"x")
    catalog = M.asset_catalog(spark, str(tmp_path))
    assert sorted(r.kind for r in catalog.collect()) == ["heic", "image", "pdf"]
    samples = spark.createDataFrame([("a", "pan/0.png"), ("b", "pan/9.png")], "id string, asset string")
    assert [r.id for r in M.missing_assets(samples, catalog, str(tmp_path)).collect()] == ["b"]


def test_legacy_manifest_and_rates(spark, tmp_path):
    fields = "status:string,document_type:string,page_type:string,fields:map<string,string>,mrz_raw:array<string>"
    body = {"a": {"status": "success", "page_type": "passport_biodata", "fields": {"surname": "ROY", "sex": "F"}, "mrz_raw": ["x", "y"]}, "b": {"status": "success", "page_type": "passport_non_biodata"}, "c": {"status": "failure", "page_type": "unknown"}}
    (tmp_path / "l.json").write_text(json.dumps(body, indent=1))
    expected = M.read_legacy_manifest(spark, str(tmp_path / "l.json"), fields)
    rows = [("a", "success", "passport", "passport_biodata", {"surname": "ROY", "sex": "M"}, ["x", "y"], 0.9, 400), ("b", "failure", "passport", "unknown", None, None, 0.2, 100), ("c", "failure", "unknown", "unknown", None, None, 0.1, 100), ("d", "success", "x", "y", None, None, 0.1, 1)]
    actual = spark.createDataFrame(rows, "name string, status string, document_type string, page_type string, fields map<string,string>, mrz_raw array<string>, confidence double, processing_ms int")
    r = extras.scan_benchmark(expected, actual).first()
    assert (r.status_rate, r.field_rate, r.mrz_rate, r.non_biodata_rate, r.biodata_median_ms) == (0.666667, 0.5, 1.0, 0.0, 400.0)
    assert (r.mean_confidence, r.mean_ms, r.mrz_rate_ok, r.field_rate_ok) == (0.4, 200.0, True, False)
    none = extras.scan_benchmark(expected.filter("name = 'c'"), actual).first()
    assert (none.field_rate, none.mrz_rate, none.non_biodata_rate, none.biodata_median_ms) == (1.0, 1.0, 1.0, 0.0)


def test_slices_have_fifteen_dimensions(spark):
    observed = evaluate.observations(fixtures.samples(spark, SF), fixtures.results(spark, SF))
    rows = evaluate.sliced_metrics(observed).filter("document_type = '*'").collect()
    assert len({r.dimension for r in rows}) == 15
    by = {}
    for r in rows:
        by.setdefault(r.dimension, 0)
        by[r.dimension] += r.samples
    assert {n for d, n in by.items() if d not in evaluate.MULTIPLE} == {1500} and by["language"] > 1500


def test_report_is_sorted_and_holds_no_values(spark):
    observed = evaluate.observations(fixtures.samples(spark, SF), fixtures.results(spark, SF))
    measured = evaluate.metrics(observed)
    rows = evaluate.sorted_report(measured, evaluate.checks(measured)).collect()
    assert [(r.section, r.name) for r in rows] == sorted((r.section, r.name) for r in rows)
    for r in rows:
        keys = list(json.loads(r.body))
        assert keys == sorted(keys)
        assert not any(n in r.body for n in fixtures.NAMES)


@pytest.mark.parametrize("block, want", [('{"pan": {"a": "1"}, "x": 2}', {"a": "1"}), ('{"pan": [1]}', None), ('{"other": {}}', None), ("no json", None)])
def test_result_block(spark, block, want):
    row = M.result_fields(spark.createDataFrame([("pan", block)], "document_type string, blocks string")).first()
    assert row.fields == want


def test_json_leaves(spark):
    rows = spark.createDataFrame([("1",), ('{"a": [null, true]}',), ("{a", ), (None,)], "t string").select(M.json_compatible(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in rows] == [True, True, False, None]


def test_whole_result_as_json(spark, tmp_path):
    ingest.write_report({"summary": spark.range(2), "checks": spark.range(1)}, str(tmp_path / "deep" / "report"))
    assert spark.read.json(str(tmp_path / "deep" / "report" / "summary")).count() == 2


def test_report_sections_have_sorted_keys_at_any_depth(spark, tmp_path):
    rows = spark.sql("SELECT 2 AS z, named_struct('y', 1, 'b', array(named_struct('d', CAST(NULL AS INT), 'c', 'x'))) AS a, map('q', 1, 'p', 2) AS m UNION ALL SELECT 3, NULL, NULL")
    ingest.write_report({"documents": rows, "checks": spark.range(1)}, str(tmp_path / "r"))
    ingest.write_report({"documents": rows.filter("z = 2")}, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r" / "documents")).collect()]
    assert lines == ['{"a":{"b":[{"c":"x","d":null}],"y":1},"m":{"p":2,"q":1},"z":2}']
    assert [r.section for r in ingest.report_rows({"documents": rows, "checks": spark.range(1)}).collect()] == ["documents", "documents", "checks"]


def test_heads_are_read_no_further(spark, tmp_path, monkeypatch):
    """A few bytes of a file of any size; files that can't be opened have none."""
    big = tmp_path / "big.bin"
    with open(big, "wb") as file:
        file.write(b"%PDF-1.7")
        file.truncate(1 << 33)  # sparse
    (tmp_path / "empty.dat").write_bytes(b"")
    rows = spark.createDataFrame([(f"file:{big}", 1 << 33), (f"file:{tmp_path}/empty.dat", 0), (f"file:{tmp_path}/none", 1)], "path string, length long")
    heads = [None if r.head is None else bytes(r.head) for r in M.file_heads(rows).collect()]
    assert heads == [b"%PDF-1.7", b"", None]
    plan = M.asset_catalog(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and "content" not in plan


def test_gate_takes_in_slices_coverage_and_runtime_errors(spark):
    """A failing row of each kind fails the gate by itself."""
    m = spark.createDataFrame([("pan", 1.0, 0, 30), ("*", 1.0, 0, 30)], "document_type string, acceptance_rate double, runtime_errors long, samples long")
    sliced = spark.createDataFrame([("*", "side", "front", 30), ("pan", "side", "front", 3)], "document_type string, dimension string, value string, samples long")
    lacking = spark.createDataFrame([("side", "back")], "dimension string, value string")
    rules = [("*", "acceptance_rate", "min", 0.9)]
    judge = lambda m, s, c: evaluate.gate(evaluate.all_checks(m, s, c, rules)).first()
    assert judge(m, sliced, lacking.limit(0)).passed
    few = sliced.withColumn("samples", F.col("samples") - 11)
    broken = m.withColumn("runtime_errors", F.lit(2))
    assert [judge(*x).failed for x in ((m, few, lacking.limit(0)), (m, sliced, lacking), (broken, sliced, lacking.limit(0)), (broken, few, lacking))] == [1, 1, 1, 3]
