"""Page geometry guards, printed vocabularies, split identifiers, member rows, candidate choice, legacy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import identifiers as I
from folioscan.functions import text as T
from folioscan.operators.evaluate import exact_median

#: Vehicle class tokens of a licence, in the order that decides which of two overlapping ones counts.
VEHICLES = ["MCWOG", "MCWG", "MCEX50CC", "MGV", "HGMV", "HMV", "HPMV", "LMV-NT", "LMV-TR", "LMV", "TRANS", "TRACTOR", "ERIG", "ROAD ROLLER", "MC", "FVG", "PSV", "3WT", "3WNT", "INVCRG"]
#: Words that no name on an identity card holds.
NOT_NAMES = (
    "GOVERNMENT GOVT INDIA BHARAT AADHAAR AADHAR UNIQUE IDENTIFICATION AUTHORITY UIDAI MALE FEMALE TRANSGENDER DOB YEAR BIRTH YOB ADDRESS MOBILE VID ENROLLMENT "
    "ENROLMENT GENDER DATE NUMBER CARD DOWNLOAD ISSUE ISSUED HELP EMAIL WWW PHONE MERA VALID"
).split()


def convex(points: Column) -> Column:
    """All turns of a closed outline of four (x, y) structs go one way."""
    at = lambda k: F.element_at(points, k % 4 + 1)
    turns = [(at(k + 1)["x"] - at(k)["x"]) * (at(k + 2)["y"] - at(k + 1)["y"]) - (at(k + 1)["y"] - at(k)["y"]) * (at(k + 2)["x"] - at(k + 1)["x"]) for k in range(4)]
    up, down = turns[0] > 0, turns[0] < 0
    for t in turns[1:]:
        up, down = up & (t > 0), down & (t < 0)
    return up | down


def plausible_quad(assets: DataFrame) -> DataFrame:
    """Adds plausible and warnings of a detected outline: convex, large enough, of a card's proportions, not shrunk by warping."""
    xs, ys = F.transform("quad", lambda p: p["x"]), F.transform("quad", lambda p: p["y"])
    bw, bh = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    at = lambda k: F.element_at(F.col("quad"), k % 4 + 1)
    area = F.abs(sum((at(k)["x"] * at(k + 1)["y"] - at(k + 1)["x"] * at(k)["y"] for k in range(4)), F.lit(0))) / 2
    whole = F.col("width") * F.col("height")
    fits = (bw > 0) & (bh > 0) & convex(F.col("quad")) & (area >= 0.30 * whole) & F.try_divide(bw, bh).between(0.5, 3.0)
    good = F.coalesce(fits, F.lit(False))
    warning = F.when(~good, "NO_DOCUMENT_BOUNDARY_DETECTED").when(F.col("warped_area") < 0.5 * whole, "PERSPECTIVE_CORRECTION_DISCARDED")
    return assets.withColumns({"plausible": good, "boundary_warning": warning})


def blood_group(c: Column) -> Column:
    """Letters and sign of a printed blood group, as AB+; null when there is none, or in a label's own words."""
    pattern = r"\b(AB|A|B|O)\s*(\+\s*VE|-\s*VE|\+|-|POSITIVE|NEGATIVE|POS|NEG)(?![A-Z])"
    letters, sign = F.regexp_extract(F.upper(c), pattern, 1), F.regexp_extract(F.upper(c), pattern, 2)
    return F.when((letters != "") & ~F.upper(c).rlike(r"BLOOD|GROUP|\bBG\b"), F.concat(letters, F.when(sign.rlike(r"^(\+|POS)"), "+").otherwise("-")))


def vehicle_tokens(c: Column) -> Column:
    """Distinct class tokens in fixed order; a token inside one already found is left out."""
    text = F.regexp_replace(F.upper(c), r"\s+", " ")

    def add(kept: Column, token: Column) -> Column:
        hit = F.regexp_like(text, F.concat(F.lit("(?<![A-Z0-9-])"), token, F.lit("(?![A-Z0-9])")))
        return F.when(hit & ~F.contains(F.array_join(kept, "|"), token), F.array_append(kept, token)).otherwise(kept)

    none = F.array().cast("array<string>")
    # tokens are tried one by one, each by a pattern of its own, only where one constant pattern finds any
    some = text.rlike(f"(?<![A-Z0-9-])(?:{'|'.join(VEHICLES)})(?![A-Z0-9])")
    return F.when(some, F.aggregate(F.array(*map(F.lit, VEHICLES)), none, add)).otherwise(none)


def vehicle_classes(c: Column) -> Column:
    return F.array_join(vehicle_tokens(c), ", ")


def name_like(c: Column) -> Column:
    """A person's printed name: letters, no digit, mostly Latin, none of its words a card's own, no care-of prefix."""
    words = F.regexp_replace(F.upper(F.trim(c)), "[^A-Z]+", " ")
    latin = ~c.rlike(r"[^\x00-\x7F]") | ((T.letters_share(c, r"ऀ-ॿ") <= 0.5) & (T.letters_share(c, r"\x{80}-\x{10FFFF}") <= 0.5))
    own = f"(?:^| )(?:{'|'.join(NOT_NAMES)})(?: |$)"
    return (F.length(F.trim(c)) >= 3) & ~c.rlike(r"(?U)\d") & latin & ~c.rlike(r"\b[SCDWscdw]\s*/\s*[Oo]\b") & words.rlike("[A-Z]") & ~words.rlike(own)


def split_licence(regions: DataFrame) -> DataFrame:
    """Licence numbers whole or split over up to four neighbours on a row; the first in reading order."""
    row = Window.partitionBy("doc_id", "page_no").orderBy(F.bround(F.col("top") / 20), "left", "seq")
    rows = regions
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_n{k}", F.lead(F.struct("top", "bottom", "text"), k).over(row))
    height = F.greatest(F.col("bottom") - F.col("top"), F.lit(1))
    pieces = [F.col("text")]
    for k in (1, 2, 3):
        near = F.col(f"_n{k}")
        same = F.coalesce(F.least(near["bottom"], F.col("bottom")) - F.greatest(near["top"], F.col("top")) >= 0.4 * height, F.lit(False))
        pieces.append(F.when(same, near["text"]).otherwise(""))
    # what the first pieces hold, all of them hold: most rows are dropped by one search
    rows = rows.filter(I.compact(F.concat(*[F.coalesce(p, F.lit("")) for p in pieces])).rlike(I.LICENCE))
    found = F.coalesce(*[I.licence(F.concat(*pieces[: k + 1])) for k in range(4)])
    rows = rows.withColumn("_found", found).filter("_found is not null")
    return rows.groupBy("doc_id").agg(F.min_by("_found", F.struct("page_no", F.bround(F.col("top") / 20), "left", "seq")).alias("dl_number"))


def compact_members(lines: DataFrame) -> DataFrame:
    """doc_id, seq, serial, name, gender, age of rows such as ``1 | NAME | F | 39``; at least three parts, a name and an age or gender."""
    parts = F.transform(F.split("text", r"\s*[|│\t]\s*|\s{2,}"), lambda p: F.trim(p))
    rows = lines.withColumn("p", F.filter(parts, lambda p: p != "")).filter(F.size("p") >= 3)
    sex = F.element_at(F.concat(F.filter("p", lambda p: F.upper(p).isin("M", "F", "MALE", "FEMALE")), F.array(F.lit(None).cast("string"))), 1)
    numbers = F.filter(F.transform("p", lambda p: p.try_cast("int")), lambda n: n.isNotNull())
    serial = F.get("p", F.lit(0)).try_cast("int")
    ages = F.filter(F.when(serial.isNotNull(), F.slice(numbers, 2, 10)).otherwise(numbers), lambda n: n.between(18, 100))
    name = F.element_at(F.concat(F.filter("p", lambda p: p.rlike("[A-Za-z]{2}") & ~F.upper(p).isin("MALE", "FEMALE")), F.array(F.lit(None).cast("string"))), 1)
    out = rows.select("doc_id", "seq", serial.alias("serial"), name.alias("name"), F.when(F.upper(sex).startswith("F"), "FEMALE").when(sex.isNotNull(), "MALE").alias("gender"), F.get(ages, F.lit(0)).alias("age"))
    return out.filter("name is not null and (age is not null or gender is not null)")


def unique_members(members: DataFrame) -> DataFrame:
    """The first row of each (serial, folded name) of a document."""
    key = Window.partitionBy("doc_id", "serial", T.norm_text(F.col("name"))).orderBy("seq")
    return members.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per document the pass with the higher score; the full page replaces the crop only when strictly better."""
    bonus = lambda c, points: F.when(F.col(c), points).otherwise(0.0)
    score = F.bround(F.col("confidence") + bonus("has_mrz", 0.15) + bonus("overall_ok", 0.2) + bonus("has_number", 0.1) + bonus("has_surname", 0.1) + bonus("has_birth", 0.05), 6)
    best = candidates.withColumn("score", score).groupBy("doc_id").agg(F.max_by(F.struct("pass", "score"), F.struct("score", (F.col("pass") == "targeted").cast("int"))).alias("b"))
    return best.select("doc_id", F.col("b.pass").alias("pass"), F.col("b.score").alias("score"))


def country_check(zones: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, warning of zones whose country is not listed; the list is a dimension."""
    unknown = zones.join(F.broadcast(codes), zones.country == codes.code, "left_anti")
    return unknown.select("doc_id", F.concat(F.lit("UNKNOWN_COUNTRY_CODE_"), "country").alias("warning"))


def passport_confidence(zones: DataFrame, regions: DataFrame) -> DataFrame:
    """Four tenths zone, three tenths cross match (0.5 where nothing compares), three tenths recognition."""
    passed = sum((F.col(c).cast("int") for c in ("number_ok", "birth_ok", "expiry_ok")), F.lit(0))
    zone = F.when(F.col("overall_ok"), 1.0).otherwise(0.7 * passed / 3)
    mean = regions.groupBy("doc_id").agg(F.avg("confidence").alias("ocr"))
    return mean.join(zones, "doc_id", "left").select("doc_id", F.bround(F.least(F.lit(1.0), 0.4 * F.coalesce(zone, F.lit(0.0)) + 0.3 * 0.5 + 0.3 * F.col("ocr")), 3).alias("confidence"))


def legacy_benchmark(observed: DataFrame) -> DataFrame:
    """Rates of matching status and of exact records over all samples, with their gates."""
    share = lambda c: F.bround(F.avg(c.cast("double")), 6)
    status = F.col("expected_accepted") == F.col("actual_accepted")
    return observed.agg(share(status).alias("status_match"), share(F.col("complete_exact")).alias("field_exact")).select("status_match", "field_exact", (F.col("status_match") >= 0.95).alias("status_gate"), (F.col("field_exact") >= 0.97).alias("field_gate"))


def scan_benchmark(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row of rates over all samples: status (with document and page type), fields, zone and back pages exact, median latency of
    biodata pages, mean confidence and latency, and each rate's gate. Only fields and zones that are expected count; 1 without any.

    expected: name, status, document_type, page_type, fields (map), mrz_raw; actual: the same and confidence, processing_ms.
    """
    got = actual.select("name", *[F.col(c).alias(f"a_{c}") for c in ("status", "document_type", "page_type", "fields", "mrz_raw", "confidence", "processing_ms")])
    rows = expected.join(got, "name")
    status = (F.col("a_status") == F.col("status")) & (F.col("a_document_type") == F.coalesce("document_type", "a_document_type")) & F.col("a_page_type").eqNullSafe(F.col("page_type"))
    names = F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,string>")))
    exact = F.size(F.filter(names, lambda k: F.try_element_at("fields", k).eqNullSafe(F.try_element_at("a_fields", k))))
    biodata = (F.col("status") == "success") & (F.col("page_type") == "passport_biodata")
    back = F.when(F.col("page_type") == "passport_non_biodata", ((F.col("a_status") == "success") & (F.col("a_page_type") == "passport_non_biodata")).cast("int"))
    zone = F.when(F.col("mrz_raw").isNotNull(), F.col("mrz_raw").eqNullSafe(F.col("a_mrz_raw")).cast("int"))
    share = lambda a, b: F.bround(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0)), 6)
    out = rows.agg(
        F.bround(F.avg(F.coalesce(status, F.lit(False)).cast("double")), 6).alias("status_rate"), share(F.sum(exact), F.sum(F.size(names))).alias("field_rate"), share(F.sum(zone), F.count(zone)).alias("mrz_rate"), share(F.sum(back), F.count(back)).alias("non_biodata_rate"),
        F.bround(F.avg("a_confidence"), 6).alias("mean_confidence"), F.bround(F.avg("a_processing_ms"), 6).alias("mean_ms"), F.sum("a_processing_ms").alias("total_ms"),
    )
    middle = exact_median(rows.select(F.lit("biodata").alias("kind"), F.when(biodata, F.col("a_processing_ms")).alias("ms")), "kind", "ms")
    middle = middle.agg(F.coalesce(F.max("median"), F.lit(0.0)).alias("biodata_median_ms"), F.lit(1).alias("_one"))
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one").drop("_one")  # one row each
    gates = {"status_rate": 0.95, "field_rate": 0.97, "mrz_rate": 0.99, "non_biodata_rate": 0.95}
    return out.select("*", *[(F.col(c) >= least).alias(f"{c}_ok") for c, least in gates.items()], (F.col("biodata_median_ms") <= 5000).alias("biodata_median_ok"))
