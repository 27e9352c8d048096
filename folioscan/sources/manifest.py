"""Benchmark manifests and their assets: reading, thresholds, the older map form, and every violation as a row.

Checks are filters and anti joins over sample rows, so a manifest of any length is judged in parallel; where a plain
reader would stop at the first fault, all faults come out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["pan", "aadhaar", "driving_licence", "voter_id", "nrega_job_card", "npr_letter"]
#: Fixed values of a sample.
SIDES = ["front", "back", "both", "single_page", "multi_page"]
CAPTURES = ["flatbed_scan", "phone_photo", "screenshot", "native_pdf", "photocopy", "other"]
QUALITY = {"resolution": ["low", "medium", "high", "native_pdf"], "blur": ["none", "mild", "severe"], "glare": ["none", "mild", "severe"], "rotation": ["upright", "minor_skew", "quarter_turn", "upside_down"], "crop": ["full", "tight", "partial"], "perspective": ["flat", "mild", "severe"], "compression": ["none", "mild", "severe"]}
RULES = ["minClassificationAccuracy", "minExpectedAcceptanceRate", "minExactFieldAccuracy", "minNormalizedFieldAccuracy", "minCompleteRecordAccuracy", "minNormalizedCompleteRecordAccuracy", "maxFalseSuccessRate", "maxRuntimeErrorRate"]
DIMENSIONS = ["designFamily", "yearBand", "issuer", "state", "language", "script", "side", "captureType", *[f"quality.{q}" for q in QUALITY]]
VERSION = 1

SAMPLE = (
    "id string, asset string, documentType string, designFamily string, yearBand string, issuer struct<name:string,state:string>, languages array<string>, scripts array<string>, side string, "
    f"capture struct<type:string,quality:struct<{','.join(f'{q}:string' for q in QUALITY)}>>, expected struct<accepted:boolean,fields:map<string,string>,requiredFields:array<string>,classificationTarget:string>"
)
SLICES = "map<string,array<string>>"
LIMITS = "map<string,double>"
MANIFEST = f"schemaVersion int, datasetVersion string, requiredDocumentTypes array<string>, samples array<struct<{SAMPLE.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>, requiredSlices {SLICES}, requiredDocumentSlices map<string,{SLICES}>, thresholds struct<overall:{LIMITS},perDocument:map<string,{LIMITS}>,perSlice:struct<dimensions:array<string>,minimumSamples:int,rules:{LIMITS}>>, _corrupt_record string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file, typed; text that is no JSON is in _corrupt_record."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def samples_of(manifest: DataFrame) -> DataFrame:
    """One row per sample."""
    return manifest.select(F.explode("samples").alias("s")).select("s.*")


def thresholds_of(manifest: DataFrame) -> DataFrame:
    """scope (overall, a type, ``*``, or slice), rule, limit."""
    own = manifest.select(F.lit("overall").alias("scope"), F.explode("thresholds.overall").alias("rule", "limit"))
    typed = manifest.select(F.explode("thresholds.perDocument").alias("scope", "of")).select("scope", F.explode("of").alias("rule", "limit"))
    sliced = manifest.select(F.lit("slice").alias("scope"), F.explode("thresholds.perSlice.rules").alias("rule", "limit"))
    return own.unionByName(typed).unionByName(sliced)


def with_thresholds(manifest: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The manifest with all its thresholds replaced by those of a one-row file; ``thresholds`` has the column thresholds."""
    one = thresholds.limit(1).select(F.lit(1).alias("_one"), "thresholds")
    return manifest.drop("thresholds").withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def read_legacy_manifest(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """name and the expected record of each entry of a {file: expected} object; ``expected``: its schema."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{expected}>>")).alias("name", "e")).select("name", "e.*")


#: Bytes of a file that are read to tell its kind.
HEAD = 8


def file_heads(files: DataFrame, count: int = HEAD) -> DataFrame:
    """path, length and head (the first ``count`` bytes; null where a file can't be opened) of files named by ``path``.

    Each file is opened through Arrow's file systems by its own address and read no further, whatever its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [_head(p, count) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.binary())], ["path", "length", "head"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, head binary")


def _head(path: str, count: int) -> bytes | None:
    try:
        system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        with system.open_input_stream(place, buffer_size=0) as file:
            return file.read(count)
    except (OSError, pa.ArrowException):
        return None


def asset_catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind of all files under a folder: by name's end, or, for names that don't tell, by the first bytes.

    The listing reads no content; only files whose names don't tell are opened, for HEAD bytes each.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.lower("path")
    by_name = F.when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.hei[cf]$"), "heic")
    known = rows.filter(by_name.isNotNull()).select("path", "length", by_name.alias("kind"))
    heads = file_heads(rows.filter(by_name.isNull()))
    return known.unionByName(heads.select("path", "length", F.when(F.substring("head", 1, 5) == F.lit(b"%PDF-"), "pdf").otherwise("image").alias("kind")))


def missing_assets(samples: DataFrame, catalog: DataFrame, root: str) -> DataFrame:
    """id, asset of samples whose file isn't in the catalogue."""
    have = catalog.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("_path")).distinct()
    wanted = samples.select("id", "asset", F.concat(F.lit(root.rstrip("/") + "/"), "asset").alias("_path"))
    return wanted.join(have, "_path", "left_anti").select("id", "asset")


def slice_pairs() -> Column:
    """(dimension, value) of a sample in all fifteen dimensions."""
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    each = lambda d, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: pair(d, v))
    one = {"designFamily": "designFamily", "yearBand": "yearBand", "issuer": "issuer.name", "state": "issuer.state", "side": "side", "captureType": "capture.type"} | {f"quality.{q}": f"capture.quality.{q}" for q in QUALITY}
    return F.concat(F.array(*[pair(d, F.col(c)) for d, c in one.items()]), each("language", "languages"), each("script", "scripts"))


def sample_violations(samples: DataFrame) -> DataFrame:
    """id, violation of every fault of a sample."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad_list = lambda c: F.coalesce((F.size(c) < 1) | F.exists(c, blank), F.lit(True))
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(allowed), F.lit(False))
    fields, asked = F.coalesce("expected.fields", F.create_map().cast("map<string,string>")), F.coalesce("expected.requiredFields", F.array().cast("array<string>"))
    accepted, target = F.coalesce("expected.accepted", F.lit(False)), F.coalesce("expected.classificationTarget", "documentType")
    rules = {
        "BLANK_ID": blank(F.col("id")),
        "BLANK_ASSET": blank(F.col("asset")),
        "UNSAFE_ASSET": F.col("asset").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"),
        "UNSUPPORTED_TYPE": outside("documentType", TYPES),
        "BLANK_DESIGN_FAMILY": blank(F.col("designFamily")),
        "BLANK_YEAR_BAND": blank(F.col("yearBand")),
        "BLANK_ISSUER_NAME": blank(F.col("issuer.name")),
        "BLANK_ISSUER_STATE": blank(F.col("issuer.state")),
        "BAD_LANGUAGES": bad_list(F.col("languages")),
        "BAD_SCRIPTS": bad_list(F.col("scripts")),
        "BAD_SIDE": outside("side", SIDES),
        "BAD_CAPTURE_TYPE": outside("capture.type", CAPTURES),
        **{f"BAD_QUALITY_{q.upper()}": outside(f"capture.quality.{q}", allowed) for q, allowed in QUALITY.items()},
        "NO_ACCEPTED_FLAG": F.col("expected.accepted").isNull(),
        "NO_FIELDS_OBJECT": F.col("expected.fields").isNull(),
        "BLANK_FIELD_NAME": F.exists(F.map_keys(fields), blank),
        "NO_REQUIRED_LIST": F.col("expected.requiredFields").isNull(),
        "REPEATED_REQUIRED_FIELD": F.size(F.array_distinct(asked)) < F.size(asked),
        "REQUIRED_FIELD_NOT_EXPECTED": F.size(F.array_except(asked, F.map_keys(fields))) > 0,
        "NO_EXPECTED_FIELDS": accepted & ((F.size(fields) == 0) | (F.size(asked) == 0)),
        "NULL_REQUIRED_FIELD": accepted & F.exists(asked, lambda k: F.array_contains(F.map_keys(fields), k) & F.try_element_at(fields, k).isNull()),
        "UNSUPPORTED_TARGET": ~F.coalesce(target.isin([*TYPES, "unknown"]), F.lit(False)),
        "ACCEPTED_OF_ANOTHER_TYPE": accepted & ~target.eqNullSafe(F.col("documentType")),
    }
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    repeated = samples.filter("id is not null").groupBy("id").count().filter("count > 1").select("id", F.lit("DUPLICATE_SAMPLE_ID").alias("violation"))
    return samples.select("id", F.explode(listed).alias("violation")).unionByName(repeated)


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """scope, violation of every fault: of samples by id, of the head, of coverage by what is missing, of thresholds by rule."""
    samples = samples_of(manifest)
    types = F.array(*map(F.lit, TYPES))
    slice_of, own = F.col("thresholds.perSlice"), F.coalesce("requiredDocumentTypes", F.array().cast("array<string>"))
    head = {
        "BAD_JSON": F.col("_corrupt_record").isNotNull(),
        "BAD_SCHEMA_VERSION": ~F.col("schemaVersion").eqNullSafe(F.lit(VERSION)),
        "BLANK_DATASET_VERSION": F.coalesce(F.trim("datasetVersion"), F.lit("")) == "",
        "REPEATED_DOCUMENT_TYPE": F.size(F.array_distinct(own)) < F.size(own),
        "DOCUMENT_TYPES_INCOMPLETE": (F.size(F.array_except(own, types)) > 0) | (F.size(F.array_except(types, own)) > 0),
        "NO_SAMPLES": F.coalesce(F.size("samples"), F.lit(0)) < 1,
        "NO_REQUIRED_SLICES": F.col("requiredSlices").isNull(),
        "DOCUMENT_SLICES_INCOMPLETE": F.col("requiredDocumentSlices").isNull() | (F.size(F.array_except(own, F.map_keys("requiredDocumentSlices"))) > 0) | (F.size(F.array_except(F.map_keys("requiredDocumentSlices"), own)) > 0),
        "OVERALL_RULES_INCOMPLETE": F.col("thresholds.overall").isNull() | (F.size(F.array_except(F.array(*map(F.lit, RULES)), F.map_keys("thresholds.overall"))) > 0),
        "NO_SLICE_DIMENSIONS": slice_of.isNotNull() & F.coalesce(F.size(slice_of["dimensions"]) < 1, F.lit(True)),
        "UNKNOWN_SLICE_DIMENSION": F.size(F.array_except(slice_of["dimensions"], F.array(*map(F.lit, DIMENSIONS)))) > 0,
        "BAD_MINIMUM_SAMPLES": slice_of.isNotNull() & F.coalesce(slice_of["minimumSamples"] < 1, F.lit(True)),
    }
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in head.items()]))
    out = manifest.select(F.lit("manifest").alias("scope"), F.explode(listed).alias("violation"))
    out = out.unionByName(sample_violations(samples).select(F.col("id").alias("scope"), "violation"))
    limits = thresholds_of(manifest)
    out = out.unionByName(limits.filter(~F.col("rule").isin(RULES)).select(F.concat_ws(".", "scope", "rule").alias("scope"), F.lit("UNKNOWN_RULE").alias("violation")))
    out = out.unionByName(limits.filter("limit is null or limit < 0 or limit > 1").select(F.concat_ws(".", "scope", "rule").alias("scope"), F.lit("LIMIT_OUT_OF_RANGE").alias("violation")))
    out = out.unionByName(limits.filter(~F.col("scope").isin([*TYPES, "*", "overall", "slice"])).select("scope", F.lit("UNKNOWN_THRESHOLD_TYPE").alias("violation")).distinct())
    good = samples.filter("expected.accepted")
    asked = manifest.select(F.explode("requiredDocumentTypes").alias("type"))
    out = out.unionByName(asked.join(good.select(F.col("documentType").alias("type")).distinct(), "type", "left_anti").select(F.col("type").alias("scope"), F.lit("NO_ACCEPTED_SAMPLE").alias("violation")))
    seen = good.select(F.col("documentType").alias("type"), F.explode(slice_pairs()).alias("p")).select("type", "p.*").distinct()
    every = manifest.select(F.lit("*").alias("type"), F.explode("requiredSlices").alias("dimension", "values"))
    typed = manifest.select(F.explode("requiredDocumentSlices").alias("type", "of")).select("type", F.explode("of").alias("dimension", "values"))
    wanted = every.unionByName(typed)
    unknown = wanted.filter(~F.col("dimension").isin(DIMENSIONS)).select(F.concat_ws(".", "type", "dimension").alias("scope"), F.lit("UNKNOWN_DIMENSION").alias("violation"))
    wanted = wanted.select("type", "dimension", F.explode("values").alias("value"))
    have = seen.unionByName(seen.select(F.lit("*").alias("type"), "dimension", "value").distinct())
    lacking = wanted.join(have, ["type", "dimension", "value"], "left_anti").select(F.concat_ws(".", "type", "dimension", "value").alias("scope"), F.lit("SLICE_NOT_COVERED").alias("violation"))
    return out.unionByName(unknown).unionByName(lacking)


def result_fields(results: DataFrame) -> DataFrame:
    """Adds fields: the block of a result's own type as a map; null where the type has none or the block is no object.

    ``results`` has document_type and a JSON text ``blocks`` of {type: {field: value}}.
    """
    block = F.try_element_at(F.from_json("blocks", "map<string,string>"), "document_type")
    return results.withColumn("fields", F.from_json(F.when(block.startswith("{"), block), "map<string,string>"))


def json_compatible(c: Column) -> Column:
    """The text is JSON of any shape; null where the text is."""
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())
