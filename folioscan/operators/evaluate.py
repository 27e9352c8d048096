"""Scores of result tables against expected records: observations, metrics by slice, thresholds, gate, coverage.

Overall and per-document metrics aggregate one row per sample; sliced metrics explode booleans only, never field maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T
from folioscan.sources.staging import looked_up, staged

#: Dimensions with one value a sample, and those with several (a text, values between commas).
SINGLE = ("design_family", "year_band", "issuer", "state", "side", "capture", "resolution", "blur", "glare", "rotation", "crop", "perspective", "compression")
MULTIPLE = ("language", "script")
DIMENSIONS = SINGLE + MULTIPLE
COUNTERS = ("samples", "classified", "expected_accepted", "actual_accepted", "accepted_right", "expected_rejected", "false_success", "false_rejection", "runtime_errors", "complete_exact", "complete_normalized")
#: Fields of a sample that were expected, and of those exact and normalised matches.
FIELD_COUNTS = ("field_expected", "field_exact", "field_normalized")


#: Fewest samples of a slice.
SLICE_MINIMUM = 20


def normalize_value(c: Column) -> Column:
    """Case folded, letters and digits only."""
    return F.regexp_replace(T.casefold(c), r"[^\p{L}\p{N}]", "")


def field_outcomes(samples: DataFrame, results: DataFrame) -> DataFrame:
    """sample_id, document_type, field, present, exact, normalized: expected against actual, wrong types give no actual."""
    wanted = samples.select("sample_id", "document_type", F.explode("fields").alias("field", "expected"))
    got = results.select("sample_id", F.col("document_type").alias("actual_type"), F.col("fields").alias("actual"))
    both = wanted.join(got, "sample_id", "left")
    actual = F.when(F.col("actual_type") == F.col("document_type"), F.try_element_at("actual", "field"))
    same = F.col("expected").eqNullSafe(actual)
    return both.select("sample_id", "document_type", "field", actual.isNotNull().alias("present"), same.alias("exact"), normalize_value(F.col("expected")).eqNullSafe(normalize_value(actual)).alias("normalized"))


def observations(samples: DataFrame, results: DataFrame) -> DataFrame:
    """One row of flags per sample; a sample without result is a runtime error and of unknown type."""
    fields = field_outcomes(samples, results).groupBy("sample_id").agg(F.bool_and("exact").alias("all_exact"), F.bool_and("normalized").alias("all_normalized"), F.count("*").alias("field_expected"), F.count_if("exact").alias("field_exact"), F.count_if("normalized").alias("field_normalized"))
    rows = samples.join(results.select("sample_id", F.col("document_type").alias("actual_type"), F.col("accepted").alias("actual_accepted")), "sample_id", "left").join(fields, "sample_id", "left")
    right = F.coalesce(F.col("actual_type") == F.col("document_type"), F.lit(False))
    took = F.coalesce("actual_accepted", F.lit(False))
    whole = F.col("accepted") & took & right
    return rows.select("sample_id", "document_type", *DIMENSIONS, right.alias("classified"), F.col("accepted").alias("expected_accepted"), took.alias("actual_accepted"), (took & F.col("accepted")).alias("accepted_right"), (~F.col("accepted")).alias("expected_rejected"), (took & ~F.col("accepted")).alias("false_success"), (F.col("accepted") & ~took).alias("false_rejection"), F.col("actual_type").isNull().alias("runtime_errors"), (whole & F.coalesce("all_exact", F.lit(True))).alias("complete_exact"), (whole & F.coalesce("all_normalized", F.lit(True))).alias("complete_normalized"), *[F.coalesce(c, F.lit(0)).alias(c) for c in FIELD_COUNTS])


def _counters() -> list[Column]:
    return [F.count("*").alias("samples"), *[F.count_if(F.col(c)).alias(c) for c in COUNTERS[1:]], *[F.sum(c).alias(c) for c in FIELD_COUNTS]]


def ratios(counted: DataFrame) -> DataFrame:
    """Adds ratios, six digits, null on a zero denominator."""
    of = lambda a, b: F.bround(F.try_divide(a.cast("double"), b), 6)
    c = F.col
    return counted.withColumns({
        "classification_accuracy": of(c("classified"), c("samples")),
        "actual_acceptance_rate": of(c("actual_accepted"), c("samples")),
        "acceptance_rate": of(c("accepted_right"), c("expected_accepted")),
        "false_rejection_rate": of(c("false_rejection"), c("expected_accepted")),
        "false_success_rate": of(c("false_success"), c("expected_rejected")),
        "runtime_error_rate": of(c("runtime_errors"), c("samples")),
        "exact_field_accuracy": of(c("field_exact"), c("field_expected")),
        "normalized_field_accuracy": of(c("field_normalized"), c("field_expected")),
        "complete_accuracy": of(c("complete_exact"), c("expected_accepted")),
        "normalized_complete_accuracy": of(c("complete_normalized"), c("expected_accepted")),
    })


def metrics(observed: DataFrame) -> DataFrame:
    """Overall and per document type: one pass with grouping sets over un-exploded rows."""
    rolled = observed.rollup("document_type").agg(*_counters())
    return ratios(rolled.withColumn("document_type", F.coalesce("document_type", F.lit("*"))))


def slice_values() -> Column:
    """(dimension, value) pairs of a sample; a dimension with several values gives a pair for each."""
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    each = lambda d: F.transform(F.split(F.col(d), ","), lambda v: pair(d, v))
    several = [each(d) for d in MULTIPLE]
    return F.concat(F.array(*[pair(d, F.col(d).cast("string")) for d in SINGLE]), *several)


def sliced_metrics(observed: DataFrame) -> DataFrame:
    """Per (dimension, value), over all types (``*``) and by type."""
    counts = [*COUNTERS[1:], *FIELD_COUNTS]
    long = observed.select("document_type", *counts, F.explode(slice_values()).alias("p")).select("document_type", "p.dimension", "p.value", *counts)
    every = long.groupBy("dimension", "value").agg(*_counters()).withColumn("document_type", F.lit("*"))
    return ratios(every.unionByName(long.groupBy("document_type", "dimension", "value").agg(*_counters())))


def field_metrics(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Counts per document type and field."""
    out = field_outcomes(samples, results).groupBy("document_type", "field")
    return out.agg(F.count("*").alias("expected"), *[F.count_if(F.col(c)).alias(c) for c in ("present", "exact", "normalized")])


#: (scope, metric, direction, limit); ``*`` holds for every document type that has no limit of its own.
THRESHOLDS = (("*", "classification_accuracy", "min", 0.98), ("pan", "classification_accuracy", "min", 0.9), ("*", "acceptance_rate", "min", 0.95), ("*", "false_success_rate", "max", 0.01), ("*", "runtime_error_rate", "max", 0.0), ("*", "complete_accuracy", "min", 0.9))


def checks(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """document_type, metric, actual, threshold, passed; a type's own rule overrides the general one, null fails."""
    spark = measured.sparkSession
    names = sorted({t[1] for t in thresholds})
    long = measured.filter("document_type != '*'").select("document_type", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("actual")) for n in names])).alias("m")).select("document_type", "m.*")
    rules = spark.createDataFrame(list(thresholds), "scope string, metric string, direction string, threshold double")
    met = long.join(F.broadcast(rules), "metric").filter((F.col("scope") == "*") | (F.col("scope") == F.col("document_type")))
    best = met.groupBy("document_type", "metric").agg(F.max_by(F.struct("actual", "direction", "threshold"), (F.col("scope") != "*").cast("int")).alias("b"))
    passed = F.when(F.col("b.direction") == "min", F.col("b.actual") >= F.col("b.threshold")).otherwise(F.col("b.actual") <= F.col("b.threshold"))
    return best.select("document_type", "metric", F.col("b.actual").alias("actual"), F.col("b.threshold").alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))


def gate(checked: DataFrame) -> DataFrame:
    """One row: all checks passed, and how many failed."""
    return checked.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def all_checks(measured: DataFrame, sliced: DataFrame, lacking: DataFrame, thresholds=THRESHOLDS, minimum: int = SLICE_MINIMUM) -> DataFrame:
    """scope, rule, actual, threshold, passed of everything that a release must pass: each type's thresholds, enough samples in every
    slice, required coverage that is missing, and no runtime error at all, whatever the thresholds leave out.

    ``measured``: metrics; ``sliced``: metrics by slice; ``lacking``: what ``missing_coverage`` found.
    """
    own = checks(measured, thresholds).select(F.col("document_type").alias("scope"), F.col("metric").alias("rule"), "actual", "threshold", "passed")
    row = lambda scope, rule, actual, least, passed: [scope.alias("scope"), F.lit(rule).alias("rule"), actual.cast("double").alias("actual"), F.lit(float(least)).alias("threshold"), passed.alias("passed")]
    enough = sliced.filter("document_type = '*'").select(*row(F.concat_ws(".", "dimension", "value"), "minimumSamples", F.col("samples"), minimum, F.col("samples") >= minimum))
    covered = lacking.select(*row(F.concat_ws(".", "dimension", "value"), "coverage", F.lit(0), 1, F.lit(False)))
    broken = measured.filter("document_type = '*' and runtime_errors > 0").select(*row(F.lit("overall"), "noRuntimeErrors", F.col("runtime_errors"), 0, F.lit(False)))
    return own.unionByName(enough).unionByName(covered).unionByName(broken)


def missing_coverage(samples: DataFrame, required: DataFrame) -> DataFrame:
    """Required (dimension, value) pairs without an accepted sample."""
    seen = samples.filter("accepted").select(F.explode(slice_values()).alias("p")).select("p.dimension", "p.value").distinct()
    return required.join(seen, ["dimension", "value"], "left_anti")


def manifest_violations(samples: DataFrame) -> DataFrame:
    """sample_id, violation: repeated ids, accepted samples without fields, required values that are null."""
    repeated = samples.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1").select("sample_id", F.lit("DUPLICATE_SAMPLE_ID").alias("violation"))
    empty = samples.filter(F.col("accepted") & (F.size("fields") == 0)).select("sample_id", F.lit("NO_EXPECTED_FIELDS").alias("violation"))
    nulls = samples.filter(F.col("accepted") & F.exists(F.map_values("fields"), lambda x: x.isNull())).select("sample_id", F.lit("NULL_REQUIRED_FIELD").alias("violation"))
    return repeated.unionByName(empty).unionByName(nulls)


def exact_median(rows: DataFrame, key: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """key, n, median of the values that are not null, exact, with buffers that don't grow with a key's rows.

    First pass: a mergeable sketch gives two values between which the middle ranks must lie (its rank error is 1 / ``accuracy``), and
    the number of rows. Second pass: rows below them are counted, those between counted by value, and the middle ranks read off
    the running counts. Keys that hold many rows are looked up by broadcast, so their rows stay spread.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).filter("v is not null")
    named = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit("")))  # null keys, too
    slack = 4 / accuracy
    bounds = named.groupBy("name").agg(F.percentile_approx("v", [max(0.0, 0.5 - slack), min(1.0, 0.5 + slack)], accuracy).alias("b"), F.count("*").alias("n"))
    bounds = staged(bounds.select("name", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "n", F.col("n").alias("rows")), "median-bounds")
    total = bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = looked_up(named, bounds, "name", "rows", total, F.xxhash64("v"))
    place = F.when(F.col("v") < F.col("low"), F.lit(None)).otherwise(F.col("v"))
    counts = met.filter("v <= high").groupBy("name", "k", "n", place.alias("v")).agg(F.count("*").alias("c"))
    run = Window.partitionBy("name").orderBy(F.asc_nulls_first("v"))
    upto = F.sum("c").over(run)
    ranks = counts.withColumns({"from": upto - F.col("c"), "to": upto})
    has = lambda rank: (F.col("from") <= rank) & (rank < F.col("to"))
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = ranks.groupBy("name", "k", "n").agg(F.max(F.when(has(lower), F.col("v"))).alias("a"), F.max(F.when(has(upper), F.col("v"))).alias("b"))
    held = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the sketch missed the median; raise accuracy")).cast("double")).otherwise((F.col("a").cast("double") + F.col("b").cast("double")) / 2)
    return middle.select(F.col("k").alias(key), "n", held.alias("median"))


def latency_report(log: DataFrame) -> DataFrame:
    """Scans, share of successes, median and mean latency by status."""
    mean = log.groupBy("status").agg(F.count("*").alias("scans"), F.bround(F.avg("processing_ms"), 4).alias("mean_ms"))
    middle = exact_median(log, "status", "processing_ms").select(F.col("status").alias("_status"), F.col("median").alias("median_ms"))
    return mean.join(middle, F.col("status").eqNullSafe(F.col("_status")), "left").drop("_status")


def sorted_report(measured: DataFrame, checked: DataFrame) -> DataFrame:
    """One JSON object a row, keys and rows in order: section, name, body. Ordered only here, at the sink."""
    body = lambda df: F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("body")
    rows = measured.select(F.lit("summary").alias("section"), F.col("document_type").alias("name"), body(measured))
    rows = rows.unionByName(checked.select(F.lit("checks").alias("section"), F.concat_ws(".", "document_type", "metric").alias("name"), body(checked)))
    return rows.orderBy("section", "name")
