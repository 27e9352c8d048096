"""Passports: biodata page checked against its zone, and the back page.

Every step is an aggregate or a join on doc_id; labels are few, so geometry joins carry few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import dates, likeness
from folioscan.functions import text as T
from folioscan.operators import layout, mrz
from folioscan.operators import regions as R
from folioscan.plans import dims

#: Words of neighbouring labels in the row under the old passport's label.
ROW_LABELS = ["FILE", "ADDRESS", "FATHER", "MOTHER", "SPOUSE", "GUARDIAN"]
FIELDS = ["surname", "given_names", "full_name", "passport_number", "nationality", "date_of_birth", "sex", "expiry_date", "country", "issue_date", "place_of_birth"]


def seen(regions: DataFrame, labels: dict) -> DataFrame:
    """doc_id and, by field, a struct p_<field> of the best label's place, row_left and the text below it."""
    found = layout.best_values(regions, dims.rows_of(labels))
    return found.select("doc_id", *[F.col(f"{t}__{f}").alias(f"p_{f}") for t, f in labels])


def listed(*pairs: tuple[Column, Column | str]) -> Column:
    """Texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in pairs]))


def validate_passport(regions: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, confidence, errors, warnings of every document, with the fields and the zone's verdicts.

    Four tenths zone (seven tenths of its passed digits where the whole fails), three tenths cross match with printed
    fields (a half where nothing compares), three tenths recognition. ``codes``: known countries, a dimension.
    """
    zones = mrz.parse_mrz(regions).withColumnRenamed("errors", "mrz_errors").withColumn("has_mrz", F.lit(True))
    known = codes.select(F.upper("code").alias("_code"), F.lit(True).alias("known")).distinct()
    rows = regions.groupBy("doc_id").agg(F.avg("confidence").alias("ocr"))
    rows = rows.join(zones, "doc_id", "left").join(seen(regions, dims.PASSPORT_LABELS), "doc_id", "left").join(F.broadcast(known), F.upper("country") == F.col("_code"), "left")
    has, below = F.coalesce("has_mrz", F.lit(False)), lambda f: F.col(f"p_{f}.below")
    rows = rows.withColumn("name_ratio", likeness.token_sort_ratio(F.when(has & (F.col("surname") != ""), F.upper("surname")), F.upper(below("surname"))))
    name = F.when(F.col("name_ratio") >= 85, 1.0).when(F.col("name_ratio") >= 60, 0.5).when(F.col("name_ratio").isNotNull(), 0.0)

    def dated(printed: str, zone: str) -> Column:
        compared = has & F.col(zone).isNotNull() & below(printed).isNotNull()
        return F.when(compared, F.coalesce(F.date_format(dates.visual(below(printed)), "yyyy-MM-dd") == F.col(zone), F.lit(False)).cast("double"))

    born, ends = dated("date_of_birth", "date_of_birth"), dated("expiry_date", "expiry_date")
    total = lambda *cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    cross = F.coalesce(F.try_divide(total(name, born, ends), total(*[c.isNotNull().cast("double") for c in (name, born, ends)])), F.lit(0.5))
    passed = sum((F.col(c).cast("int") for c in ("number_ok", "birth_ok", "expiry_ok")), F.lit(0))
    zone = F.when(~has, 0.0).when(F.col("overall_ok"), 1.0).otherwise(passed / 3 * 0.7)
    raw = zone * 0.4 + cross * 0.3 + F.coalesce("ocr", F.lit(0.0)) * 0.3
    days = [F.try_to_date(F.col(c), "yyyy-MM-dd") for c in ("date_of_birth", "expiry_date")]
    unknown = has & (F.col("country") != "") & F.col("known").isNull()
    full = F.when((F.col("surname") != "") & (F.col("given_names") != ""), F.concat_ws(" ", "given_names", "surname")).when(F.col("surname") != "", F.col("surname"))
    return rows.select(
        "doc_id",
        F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3).alias("confidence"),
        listed((~has, "MRZ_NOT_DETECTED"), (has & F.coalesce(days[1] <= days[0], F.lit(False)), "EXPIRY_BEFORE_DOB")).alias("errors"),
        listed((name == 0.5, "NAME_PARTIAL_MATCH"), (name == 0.0, "NAME_MISMATCH"), (born == 0.0, "DOB_MISMATCH"), (ends == 0.0, "EXPIRY_DATE_MISMATCH"), (unknown, F.concat(F.lit("UNKNOWN_COUNTRY_CODE_"), F.upper("country")))).alias("warnings"),
        "surname", "given_names", full.alias("full_name"), "passport_number", "nationality", "date_of_birth", "sex", "expiry_date", "country",
        below("issue_date").alias("issue_date"), below("place_of_birth").alias("place_of_birth"),
        has.alias("has_mrz"), F.coalesce("overall_ok", F.lit(False)).alias("overall_ok"), F.coalesce("mrz_errors", F.lit("")).alias("mrz_errors"),
    )


def passport_fields(regions: DataFrame, codes: DataFrame) -> DataFrame:
    """Eleven fields of every document: the zone's, and two printed ones."""
    return validate_passport(regions, codes).select("doc_id", *FIELDS)


def needs_full_page(judged: DataFrame) -> Column:
    """The crop's reading is not enough: no zone, a failed digit, no number or no surname at all."""
    return ~F.col("has_mrz") | ~F.col("overall_ok") | F.col("passport_number").isNull() | F.col("surname").isNull()


def meaningful(of=F.col) -> Column:
    """Some field was read; ``of`` gives a field's value."""
    return F.coalesce(*[of(c) for c in ("surname", "given_names", "passport_number", "nationality", "date_of_birth", "expiry_date")]).isNotNull()


def candidate_score() -> Column:
    held = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    bonus = lambda c, points: F.when(c, points).otherwise(0.0)
    return F.bround(F.col("confidence") + bonus(F.col("has_mrz"), 0.15) + bonus(F.col("overall_ok"), 0.2) + bonus(held("passport_number"), 0.1) + bonus(held("surname"), 0.1) + bonus(F.col("date_of_birth").isNotNull(), 0.05), 6)


def read_passports(regions: DataFrame, codes: DataFrame) -> DataFrame:
    """``validate_passport`` of the lower part, or of the whole page where that part is not enough and the whole scores higher."""
    crop = validate_passport(R.targeted(regions), codes)
    whole = validate_passport(regions, codes).select("doc_id", F.struct("*", candidate_score().alias("points")).alias("w"))
    both = crop.withColumn("need", needs_full_page(crop)).withColumn("c", F.struct(*crop.columns, candidate_score().alias("points"))).select("doc_id", "need", "c").join(whole, "doc_id")
    return both.select(F.when(F.col("need") & (F.col("w.points") > F.col("c.points")), F.col("w")).otherwise(F.col("c")).alias("b")).select("b.*").drop("points")


def overall_confidence(validation: Column, page: Column) -> Column:
    """Validation and page type, 85 to 15."""
    return F.bround(F.least(F.greatest(validation * 0.85 + page * 0.15, F.lit(0.0)), F.lit(1.0)), 3)


def mostly_non_latin(c: Column) -> Column:
    """Over half of the letters are beyond ASCII; false without letters."""
    return T.letters_share(c, r"\x{80}-\x{10FFFF}") > 0.5


def address_lines(regions: DataFrame, labels: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, lines: texts under the address label in its column, row by row, up to the next section.

    ``labels``: doc_id, page_no, row_left and the label's place. Rows of 12 pixels; a row that holds another section's label ends the
    block; a gap of over 50 pixels ends its row's scan only. The fold sees at most the band of 300 pixels.
    """
    bare = F.trim(F.regexp_replace(F.upper("text"), "[^A-Z0-9 ]", ""))
    stops = [x for f in ("file_number", "old_passport") for x in dims.BACK_LABELS["back", f]]
    stop = F.lit(False)
    for word in stops:
        stop = stop | bare.contains(word)
    band = labels.join(regions, ["doc_id", "page_no"]).filter((F.col("seq") != F.col("label_seq")) & (F.col("top") >= F.col("label_bottom") - 10) & (F.col("top") - F.col("label_bottom") <= 300))
    band = band.withColumns({"row": F.floor(F.col("top") / 12).cast("int"), "stop": stop})
    near = F.abs(F.col("left") - F.col("row_left")) < 250
    one = F.struct("row", "seq", "top", "bottom", F.trim("text").alias("text"), ((F.length(F.trim("text")) >= 2) & ~mostly_non_latin(F.trim("text"))).alias("fit"))
    met = band.groupBy("doc_id").agg(F.min(F.when(F.col("stop"), F.col("row"))).alias("end"), F.array_sort(F.collect_list(F.when(near, one))).alias("cells"), F.min("label_bottom").alias("below"))
    cells = F.filter("cells", lambda c: F.col("end").isNull() | (c["row"] < F.col("end")))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.col("below").cast("int").alias("prev"), F.lit(-1).alias("shut"))

    def step(acc: Column, c: Column) -> Column:
        over = (F.size(acc["lines"]) >= most) | (c["row"] == acc["shut"])
        gap = (c["top"] - acc["prev"] > 50) & (F.size(acc["lines"]) > 0)
        keep = F.struct(F.array_append(acc["lines"], c["text"]).alias("lines"), c["bottom"].cast("int").alias("prev"), acc["shut"].alias("shut"))
        shut = F.struct(acc["lines"].alias("lines"), acc["prev"].alias("prev"), c["row"].alias("shut"))
        return F.when(over, acc).when(gap, shut).when(c["fit"], keep).otherwise(acc)

    return met.select("doc_id", F.aggregate(cells, start, step)["lines"].alias("lines")).filter(F.size("lines") > 0)


def parsed_address(lines: Column) -> dict[str, Column]:
    """address, pincode, city, state of an address's lines.

    First the parts between separators: the first that is a state, and the nearest before it that is none. Then lines
    from the last up: city with pincode and state's code, a state alone or with pincode, city with pincode.
    """
    table = {n.upper(): n for n in dims.STATES.values()}
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    codes = F.create_map(*[F.lit(x) for kv in dims.STATES.items() for x in kv])
    name = lambda c: F.try_element_at(names, F.upper(c))
    code = lambda c: F.try_element_at(codes, F.upper(c))
    whole = F.array_join(lines, ", ")
    parts = F.transform(F.split(whole, r"[,;|/]"), lambda t: F.trim(F.regexp_replace(F.trim(t), r"(?i)^PIN[\s:]*", "")))
    parts = F.filter(parts, lambda t: (t != "") & ~t.rlike(r"^\d{4,6}$"))
    states = F.transform(parts, lambda t: F.coalesce(name(t), code(t)))
    at = F.coalesce(F.array_position(F.transform(states, lambda s: s.isNotNull()), True), F.lit(0)).cast("int")
    state = F.when(at > 0, F.try_element_at(states, at))
    before = F.filter(F.when(at > 1, F.slice(parts, F.lit(1), at - 1)).otherwise(F.array().cast("array<string>")), lambda t: (F.upper(t) != "INDIA") & name(t).isNull() & code(t).isNull())
    city = F.try_element_at(before, F.lit(-1))

    def step(acc: Column, k: Column) -> Column:
        line, prev = F.trim(F.get(lines, k)), F.when(k > 0, F.trim(F.get(lines, k - 1)))
        held = lambda c, s: F.struct(F.coalesce(acc["city"], c).alias("city"), F.coalesce(acc["state"], s).alias("state"))
        coded = (r"^([A-Za-z\s.]+?)[\s-]+\d{6}\s+([A-Z]{2,3})$", F.lit(None).cast("string"))
        with_code = code(F.regexp_extract(line, coded[0], 2))
        named = F.trim(F.regexp_extract(line, r"^([A-Za-z\s]+?)[\s-]*\d{6}$", 1))
        lone = F.trim(F.regexp_extract(line, r"^([A-Za-z\s.]+?)[\s-]+\d{6}$", 1))
        return (
            F.when(with_code.isNotNull(), held(F.trim(F.regexp_extract(line, coded[0], 1)), with_code))
            .when(name(line).isNotNull(), held(prev, line))
            .when(name(named).isNotNull(), held(prev, named))
            .when(lone != "", held(lone, F.lit(None).cast("string")))
            .otherwise(acc)
        )

    start = F.struct(city.alias("city"), state.alias("state"))
    last = F.size(lines) - 1
    folded = F.when(city.isNull() | state.isNull(), F.aggregate(F.sequence(last, F.lit(0)), start, step)).otherwise(start)
    pin = F.regexp_extract(whole, r"\b(\d{6})\b", 1)
    return {"address": whole, "pincode": F.when(pin != "", pin), "city": folded["city"], "state": F.coalesce(name(folded["state"]), folded["state"])}


def old_passport_row(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, number, issued, place of the row under the old passport's label, told apart by shape, from left to right."""
    text, order = F.trim("text"), F.struct("left", "seq")
    words = F.split(F.trim(F.regexp_replace(F.upper(text), "[^A-Z]+", " ")), " ")
    fits = (F.col("seq") != F.col("label_seq")) & (F.col("top") >= F.floor((F.col("label_top") + F.col("label_bottom")) / 2)) & (F.col("top") <= F.col("label_bottom") + 60)
    row = labels.join(regions, ["doc_id", "page_no"]).filter(fits & (F.length(text) >= 2) & ~mostly_non_latin(text) & ~F.arrays_overlap(words, F.lit(ROW_LABELS)))
    number, day = F.upper(text).rlike(r"^[A-Z]\d{7}$"), text.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$")
    first = lambda value, when: F.min_by(value, F.when(when, order))
    return row.groupBy("doc_id").agg(first(F.upper(text), number).alias("number"), first(text, day & ~number).alias("issued"), first(text, ~text.rlike(r"(?U)\d")).alias("place"))


def extract_back_page(regions: DataFrame) -> DataFrame:
    """Eleven fields of every document's back page; null where a label or value is missing."""
    found = seen(regions, dims.BACK_LABELS)
    place = lambda f: found.filter(f"p_{f} is not null").select("doc_id", f"p_{f}.page_no", f"p_{f}.row_left", *[f"p_{f}.label_{c}" for c in ("seq", "top", "bottom")])
    rows = regions.select("doc_id").distinct().join(found, "doc_id", "left").join(address_lines(regions, place("address")), "doc_id", "left").join(old_passport_row(regions, place("old_passport")), "doc_id", "left")
    below = lambda f: F.col(f"p_{f}.below")
    old = F.col("p_old_passport")
    shaped = F.regexp_extract(F.upper(below("old_passport")), r"[A-Z]\d{7}", 0)
    number = F.when(old.isNotNull(), F.coalesce("number", F.when(shaped != "", shaped), below("old_passport")))
    apart = lambda f: old.isNotNull() & (F.col(f"p_{f}.label_seq") != old["label_seq"]) & (F.col(f"p_{f}.label_top") > old["label_bottom"] - 30)
    issued, place_of = (F.when(old.isNotNull(), F.coalesce(c, F.when(apart(f), below(f)))) for c, f in (("issued", "old_issue_date"), ("place", "old_issue_place")))
    address = parsed_address(F.col("lines"))
    return rows.select("doc_id", *[below(f).alias(f) for f in ("father_name", "mother_name", "spouse_name")], *[F.when(F.col("lines").isNotNull(), c).alias(n) for n, c in address.items()], below("file_number").alias("file_number"), number.alias("old_passport_number"), issued.alias("old_passport_date_of_issue"), place_of.alias("old_passport_place_of_issue"))
