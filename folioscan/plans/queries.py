"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import checksum, dates
from folioscan.functions import identifiers as I
from folioscan.functions import text as T
from folioscan.operators import assess, cards, classify, evaluate, extract, extras, job_card, layout, mrz, npr, passport, routing
from folioscan.operators import regions as R
from folioscan.plans import dims
from folioscan.plans import fixtures as X
from folioscan.sources import ingest, manifest
from folioscan.sources.staging import staged
from folioscan.streaming import jobs

QUERIES = {}
#: Documents are judged as of this day, so that results can be repeated.
AS_OF = "2024-06-01"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def on(source, name: str, fn) -> None:
    """Registers ``fn`` over a derived table."""
    QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))


@query
def read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(spark, sf_dir)
    box = F.array(*[F.array(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"))])
    cells = F.array_sort(F.collect_list(F.struct("seq", box.alias("box"), F.concat(F.lit(" "), "text", F.lit("\t")).alias("txt"), "confidence")))
    raw = rows.groupBy("doc_id", "page_no").agg(cells.alias("c")).select("doc_id", "page_no", F.col("c.box").alias("boxes"), F.col("c.txt").alias("txts"), F.col("c.confidence").alias("scores"))
    return ingest.read_regions(raw)


on(X.lines, "trusted_regions", R.trusted)
on(X.lines, "targeted_crop", R.targeted)
on(X.lines, "offset_regions", lambda r: R.offset(r, 5, -3))
on(X.lines, "non_latin_page", R.non_latin_pages)
on(X.lines, "letter_shares", R.letter_shares)
on(X.lines, "joined_text", R.joined_text)
on(X.lines, "probe_text", R.probe_text)
on(X.lines, "row_band", R.row_bands)
on(X.regions, "dedup_regions", R.dedup_regions)
on(X.regions, "union_passes", lambda r: R.union_passes([r, r.withColumn("confidence", F.col("confidence") - 0.1)]))
on(X.regions, "geometry_confidence", R.geometry_confidence)
on(X.regions, "ocr_confidence", R.ocr_confidence)
on(X.regions, "reading_order", R.reading_order)
on(X.regions, "label_like", lambda r: R.label_like(r).select("doc_id", "seq", "label_like"))
on(X.regions, "label_match", lambda r: layout.label_match(r).drop("label_confidence"))
on(X.regions, "label_row_left", lambda r: layout.row_left(layout.label_match(r), r).select("doc_id", "label_seq", "row_left"))
on(X.regions, "value_below", lambda r: layout.value_below(layout.label_match(r), r).select("doc_id", "label_seq", "below"))
on(X.regions, "value_right", lambda r: layout.value_right(layout.label_match(r), r).select("doc_id", "label_seq", "right"))
on(X.regions, "label_value", lambda r: layout.label_values(r).select("doc_id", "doc_type", "field", "label_seq", "value"))
on(X.regions, "keyword_evidence", classify.keyword_matches)
on(X.regions, "evidence_count", classify.evidence_counts)
on(X.regions, "doc_score", lambda r: classify.document_scores(r).select("doc_id", "doc_type", "score"))
on(X.regions, "classify_documents", lambda r: classify.classify_documents(r).select("doc_id", "document_type", "confidence"))
on(X.passports, "classify_pages", classify.classify_pages)
on(X.passports, "mrz_like_page", R.mrz_pages)
on(X.passports, "mrz_lines", mrz.mrz_lines)
on(X.passports, "parse_mrz", mrz.parse_mrz)
on(X.regions, "extract_pan", extract.extract_pan)
on(X.regions, "extract_voter_id", extract.extract_voter_id)
on(X.regions, "extract_driving_licence", extract.extract_driving_licence)
on(X.regions, "extract_aadhaar", extract.extract_aadhaar)
on(X.regions, "extract_npr_letter", extract.extract_npr_letter)
on(X.regions, "extract_nrega", extract.extract_nrega)
on(X.regions, "scan_results", lambda r: assess.scan_results(r, AS_OF))
on(X.passports, "validate_passport", lambda r: passport.validate_passport(r, dims.country_dim(r.sparkSession)).drop("errors", "warnings"))
on(X.passports, "passport_fields", lambda r: passport.passport_fields(r, dims.country_dim(r.sparkSession)))
on(X.passports, "read_passports", lambda r: passport.read_passports(r, dims.country_dim(r.sparkSession)).select("doc_id", "confidence", "passport_number", "overall_ok"))
on(X.back_pages, "extract_back_page", passport.extract_back_page)
on(X.regions, "extract_licences", cards.extract_licences)
on(X.regions, "extract_aadhaar_cards", cards.extract_aadhaar_cards)
on(X.regions, "extract_voter_cards", cards.extract_voter_cards)


@query
def extract_job_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classified as job cards, read as such."""
    regions = X.regions(spark, sf_dir)
    cards_ = classify.classify_documents(regions).filter("document_type = 'nrega_job_card'").select("doc_id")
    routed = regions.join(cards_, "doc_id", "left_semi")
    return job_card.extract_job_cards(routed).withColumn("members", F.to_json("members"))


on(X.regions, "npr_letters", npr.npr_letters)
on(X.regions, "extract_npr_fields", npr.extract_npr_fields)


def of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of cards, biodata pages and back pages in one table."""
    tables = [X.regions(spark, sf_dir), X.passports(spark, sf_dir), X.back_pages(spark, sf_dir)]
    rows = None
    for k, t in enumerate(tables):
        t = t.withColumn("doc_id", F.col("doc_id") * len(tables) + k)
        rows = t if rows is None else rows.unionByName(t)
    return rows


@query
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all kinds told apart, routed and read whole."""
    return routing.route_documents(of_all_kinds(spark, sf_dir), AS_OF, dims.country_dim(spark))


@query
def published_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of documents of all kinds as JSON with all keys."""
    return ingest.to_json(routing.result_objects(scan_documents(spark, sf_dir)), with_id=False)


on(X.regions, "results_to_json", lambda r: ingest.to_json(routing.result_objects(routing.route_cards(r, AS_OF)), with_id=False))


@query
def assess_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = assess.assess_extraction(X.regions(spark, sf_dir), AS_OF)
    return judged.withColumn("identifier_valid", F.col("identifier_valid").cast("string"))


@query
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return X.regions(spark, sf_dir).select("doc_id", "seq", T.norm_label(text).alias("label"), T.norm_text(text).alias("plain"), T.dedup_key(text).alias("folded"), T.clean_mrz(text).alias("mrz"), T.pad44(text).alias("padded"), T.clean_colon(text).alias("value"), T.after_colon(text).alias("tail"))


@query
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return X.regions(spark, sf_dir).select("doc_id", "seq", I.pan(text).alias("pan"), I.pan_valid(text).alias("pan_ok"), I.epic(text).alias("epic"), I.licence(text).alias("dl"), I.job_card(text).alias("job"), I.aadhaar(text).alias("uid"), I.aadhaar_valid(text).alias("uid_ok"), I.pincode(text).alias("pin"), I.old_passport(text).alias("old"))


@query
def icao_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.substring(I.compact(F.col("text")), 1, 9)
    return X.regions(spark, sf_dir).filter(F.length(text) == 9).select("doc_id", "seq", text.alias("data"), checksum.icao_digit(text).alias("digit"))


@query
def icao_check_digit_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = I.compact(F.col("text"))
    return X.regions(spark, sf_dir).select("doc_id", "seq", text.alias("data"), checksum.icao_digit(text).alias("digit"))


@query
def mrz_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.passports(spark, sf_dir).filter("seq = 4").withColumn("line", T.pad44(T.clean_mrz(F.col("text"))))
    fixed = T.digit_fix(F.col("line"))
    return rows.select("doc_id", fixed.alias("line"), dates.mrz_date(F.substring(fixed, 14, 6)).alias("born"), checksum.check_digit_ok(F.substring(fixed, 1, 9), F.substring(fixed, 10, 1)).alias("number_ok"))


@query
def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dates.printed(F.col("text"))
    rows = X.regions(spark, sf_dir).filter(found.isNotNull())
    as_of = F.lit(AS_OF).cast("date")
    return rows.select("doc_id", "seq", found.alias("printed"), F.date_format(dates.parse_printed(found), "yyyy-MM-dd").alias("parsed"), dates.past(found, as_of).alias("past"), dates.not_future(found, as_of).alias("not_future"))


on(X.assets, "admit_assets", lambda a: ingest.admit_assets(a).select("doc_id", "error"))
on(X.assets, "quality_gate", lambda a: ingest.quality_gate(a).select("doc_id", "quality_error", "warning"))


@query
def decode_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, key = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id")
    image = F.when(key % 7 == 1, "not base64!").when(key % 7 == 2, "").otherwise(F.base64(F.col("url").cast("binary")))
    plain = F.to_json(F.struct(image.alias("image_base64")))
    event = F.when(key % 7 == 0, F.lit('{"other": 1}')).when(key % 2 == 0, plain).otherwise(F.to_json(F.struct(plain.alias("body"))))
    return ingest.decode_payloads(pages.select(key.alias("request_id"), event.alias("event")))


def judged(fn):
    return lambda spark, sf_dir: fn(X.samples(spark, sf_dir), X.results(spark, sf_dir))


QUERIES["expected_vs_actual"] = judged(evaluate.field_outcomes)
QUERIES["observation_flags"] = judged(evaluate.observations)
QUERIES["metrics"] = judged(lambda s, r: evaluate.metrics(evaluate.observations(s, r)))
QUERIES["sliced_metrics"] = judged(lambda s, r: evaluate.sliced_metrics(evaluate.observations(s, r)))
QUERIES["field_metrics"] = judged(evaluate.field_metrics)
QUERIES["threshold_checks"] = judged(lambda s, r: evaluate.checks(evaluate.metrics(evaluate.observations(s, r))))
QUERIES["gate"] = judged(lambda s, r: evaluate.gate(evaluate.checks(evaluate.metrics(evaluate.observations(s, r)))))


@query
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = X.samples(spark, sf_dir)
    required = samples.select(F.lit("capture").alias("dimension"), F.concat("capture", F.when(F.col("sample_id") % 2 == 0, F.lit("")).otherwise(F.lit(" NIGHT"))).alias("value")).distinct()
    return evaluate.missing_coverage(samples, required)


@query
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over thresholds, slices, coverage and runtime errors."""
    samples, results = X.samples(spark, sf_dir), X.results(spark, sf_dir)
    observed = staged(evaluate.observations(samples, results), "observed")
    every = evaluate.all_checks(evaluate.metrics(observed), evaluate.sliced_metrics(observed), coverage_anti(spark, sf_dir))
    return evaluate.gate(every)


@query
def check_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = X.samples(spark, sf_dir)
    faulty = samples.withColumn("fields", F.when(F.col("sample_id") % 13 == 0, F.create_map().cast("map<string,string>")).when(F.col("sample_id") % 17 == 0, F.create_map(F.lit("name"), F.lit(None).cast("string"))).otherwise(F.col("fields")))
    return evaluate.manifest_violations(faulty.union(faulty.filter("sample_id % 101 = 0")))


@query
def sample_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as a manifest has them, some with faults by key."""
    k, s = F.col("sample_id"), X.samples(spark, sf_dir)
    quality = F.struct(*[(F.when(k % (41 + n) == 0, "odd").otherwise(F.lit(v[0]))).alias(q) for n, (q, v) in enumerate(manifest.QUALITY.items())])
    asset = F.when(k % 53 == 0, "../up.png").when(k % 59 == 0, "/abs.png").otherwise(F.concat("document_type", F.lit("/"), k.cast("string"), F.lit(".png")))
    expected = F.struct("accepted", "fields", F.when(k % 61 == 0, F.array(F.lit("name"), F.lit("name"))).when(k % 67 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("name"))).alias("requiredFields"), F.when(k % 71 == 0, "unknown").otherwise(F.col("document_type")).alias("classificationTarget"))
    rows = s.select(k.cast("string").alias("id"), asset.alias("asset"), F.col("document_type").alias("documentType"), F.col("design_family").alias("designFamily"), F.col("year_band").alias("yearBand"), F.struct(F.col("issuer").alias("name"), F.col("state").alias("state")).alias("issuer"), F.split("language", ",").alias("languages"), F.split("script", ",").alias("scripts"), "side", F.struct(F.lit("phone_photo").alias("type"), quality.alias("quality")).alias("capture"), expected.alias("expected"))
    return manifest.sample_violations(rows.unionAll(rows.filter(F.col("id").cast("long") % 101 == 0)))


QUERIES["sorted_report"] = judged(lambda s, r: (lambda m: evaluate.sorted_report(m, evaluate.checks(m)))(evaluate.metrics(evaluate.observations(s, r))))
on(X.scan_log, "latency_report", evaluate.latency_report)
#: Window starts as times without zone, as the log has them.
plain_start = lambda df: df.withColumn("start", F.col("start").cast("timestamp_ntz"))
on(X.scan_log, "stream_quality", lambda s: plain_start(jobs.stream_quality(s, "10 minutes")))
on(X.scan_log, "stream_quality_sliding", lambda s: plain_start(jobs.stream_quality(s, "1 hour", "30 minutes")))
on(X.scan_log, "stream_sessions", lambda s: plain_start(jobs.stream_sessions(s)))


@query
def plausible_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets, k = X.assets(spark, sf_dir), F.col("doc_id")
    point = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    wide, high = F.col("width") - k % 7 * 60, F.col("height") - k % 11 * 30
    quad = F.array(point(F.lit(0), F.lit(0)), point(wide, F.lit(0)), point(F.when(k % 13 == 0, F.lit(5)).otherwise(wide), F.when(k % 13 == 0, F.lit(5)).otherwise(high)), point(F.lit(0), high))
    rows = assets.withColumns({"quad": quad, "warped_area": F.col("width") * F.col("height") * (k % 10) / 10})
    return extras.plausible_quad(rows).select("doc_id", "plausible", "boundary_warning")


@query
def printed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    blood = F.element_at(F.array(*map(F.lit, ["Blood Group: O+VE", "B -ve", "AB POSITIVE", "BLOOD GROUP", "A NEG"])), (k % 5 + 1).cast("int"))
    cov = F.element_at(F.array(*map(F.lit, ["LMV-NT, MCWG", "COV: LMV", "MC / TRANS", "none"])), (k % 4 + 1).cast("int"))
    return orders.select(k.alias("doc_id"), extras.blood_group(blood).alias("blood"), extras.vehicle_classes(cov).alias("vehicles"))


on(X.regions, "name_like", lambda r: r.select("doc_id", "seq", extras.name_like(F.col("text")).alias("name_like")))


@query
def split_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = X.regions(spark, sf_dir).filter("text like 'DL No.%'")
    halves = F.array(F.struct(F.lit(0).alias("n"), F.substring("text", 8, 5).alias("t")), F.struct(F.lit(1).alias("n"), F.substring("text", 13, 30).alias("t")))
    rows = whole.select("doc_id", "page_no", "top", "bottom", "confidence", F.explode(halves).alias("h"))
    return extras.split_licence(rows.select("doc_id", "page_no", F.col("h.n").alias("seq"), F.col("h.t").alias("text"), (40 + 200 * F.col("h.n")).alias("left"), "top", (F.col("bottom") - F.when(F.col("doc_id") % 5 == 0, 22 * F.col("h.n")).otherwise(0)).alias("bottom"), "confidence"))


@query
def compact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    text = F.concat((k % 4).cast("string"), F.lit(" | PERSON "), F.when(k % 2 == 0, "A").otherwise("B"), F.lit(" | "), F.when(k % 3 == 0, "F").when(k % 3 == 1, "MALE").otherwise("-"), F.lit(" | "), (k % 90 + 10).cast("string"))
    lines = orders.select(F.floor(k / 8).alias("doc_id"), (k % 8).cast("int").alias("seq"), text.alias("text"))
    return extras.unique_members(extras.compact_members(lines))


@query
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    flags = lambda m: [(k % p == m).alias(n) for n, p in (("has_mrz", 2), ("overall_ok", 3), ("has_number", 5), ("has_surname", 7), ("has_birth", 11))]
    one = orders.select(k.alias("doc_id"), F.lit("targeted").alias("pass"), ((k % 100).cast("double") / 100).alias("confidence"), *flags(0))
    two = orders.select(k.alias("doc_id"), F.lit("full").alias("pass"), ((k * 7 % 100).cast("double") / 100).alias("confidence"), *flags(1))
    return extras.best_candidate(one.union(two))


@query
def country_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.upper(F.substring("n_name", 1, 3)).alias("code")).distinct()
    zones = mrz.parse_mrz(X.passports(spark, sf_dir)).withColumn("country", F.when(F.col("doc_id") % 3 == 0, "UTO").otherwise(F.col("country")))
    return extras.country_check(zones, codes)


@query
def passport_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.passports(spark, sf_dir)
    return extras.passport_confidence(mrz.parse_mrz(pages), pages)


QUERIES["legacy_benchmark"] = judged(lambda s, r: extras.legacy_benchmark(evaluate.observations(s, r)))


@query
def scan_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rates and their gates: samples' fronts as biodata pages, their backs as back pages, latencies from the log of events."""
    wanted, got, log = X.samples(spark, sf_dir), X.results(spark, sf_dir), X.scan_log(spark, sf_dir)
    page = F.when(F.col("side") == "front", "passport_biodata").when(F.col("side") == "back", "passport_non_biodata").otherwise(F.col("document_type"))
    status = lambda: F.when(F.col("accepted"), "success").otherwise("failure").alias("status")
    name, front = F.col("sample_id").cast("string").alias("name"), F.col("side") == "front"
    expected = wanted.select(name, status(), "document_type", page.alias("page_type"), "fields", F.when(front, F.upper(F.col("fields")["number"])).alias("mrz_raw"))
    read = got.join(wanted.select("sample_id", "side"), "sample_id").join(log.select(F.col("doc_id").alias("sample_id"), "processing_ms"), "sample_id")
    zone = F.when(front, F.when(F.col("fields")["name"].isNull(), "UNREAD").otherwise(F.upper(F.col("fields")["number"])))
    actual = read.select(name, status(), "document_type", page.alias("page_type"), "fields", zone.alias("mrz_raw"), (F.col("processing_ms") % 100 / 100).alias("confidence"), "processing_ms")
    return extras.scan_benchmark(expected, actual)
