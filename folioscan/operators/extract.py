"""Typed fields of cards: labelled values joined with identifiers found in the text, one wide row per document.

``facts`` makes everything that any type needs in one aggregate over the regions and one over the labelled values;
an extractor is a projection of it, so a job over mixed types pays for the joins once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import dates
from folioscan.functions import identifiers as I
from folioscan.functions import text as T
from folioscan.operators import extras, layout
from folioscan.operators import regions as R
from folioscan.plans import dims

VID = r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b"


def _year(text: Column, day: Column) -> Column:
    """A year of the last century or this one; null beside a whole date."""
    year = F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1)
    return F.when(day.isNull() & (year != ""), year)


def age(text: Column) -> Column:
    """First number from 1 to 120 of one to three digits, dates and years left out."""
    bare = F.regexp_replace(F.regexp_replace(text, dates.PRINTED, " "), r"\b(19|20)\d{2}\b", " ")
    return F.get(F.filter(F.regexp_extract_all(bare, F.lit(r"\b(\d{1,3})\b"), F.lit(1)), lambda n: n.cast("int").between(1, 120)), F.lit(0))


def _sought() -> dict[str, dict[str, Column]]:
    """By type: what its regions are searched for, over a region's text and what ``_found`` makes of it; null where it isn't there."""
    text, flat, word, bare = F.col("text"), F.col("flat"), F.col("word"), F.col("bare")
    sex = F.when(word.rlike(r"\bFEMALE\b"), "FEMALE").when(word.rlike(r"\bMALE\b"), "MALE").when(word.rlike(r"\bTRANSGENDER\b"), "TRANSGENDER")
    inline = lambda name: F.when((F.col("head") == name) & (F.col("tail") != ""), F.col("tail"))
    return {
        "pan": {"any_pan": I.pan_in(flat), "any_date": dates.printed(text)},
        "aadhaar": {"aadhaar_number": I.aadhaar(bare), "masked_last4": I.aadhaar_last4(bare), "vid": I.virtual_id(text), "any_sex": sex, "any_pin": I.pincode(bare)},
        "driving_licence": {"dl_number": I.licence_in(flat)},
        "voter_id": {"epic_number": I.epic_in(flat), "any_age": F.when(word.rlike(r"\bAGE\b"), age(text))},
        "nrega_job_card": {"any_card": I.job_card(text)},
        "npr_letter": {"npr_name": inline("NAME"), "npr_address": inline("ADDRESS"), "npr_date": inline("DATE")},
    }


def _found(regions: DataFrame, types: list[str]) -> DataFrame:
    """First identifiers, dates and inline values of each document of its type (column document_type), one aggregate for all of ``types``.

    A document has one type, so the types share the places of what they search for, and a region is searched for its own type's only.
    """
    kind, text, order = F.col("document_type"), F.col("text"), ["page_no", "seq"]
    sought = {t: s for t, s in _sought().items() if t in types}
    of = lambda *ts: kind.isin(*ts)
    split = F.split(text, "[:：]", 2)
    kept = ["doc_id", "document_type", *order, "top", "left", "bottom", "text"]
    rows = R.step(regions, kept, word=F.upper(text), flat=F.when(of("pan", "driving_licence", "voter_id"), I.compact(text)), bare=F.when(of("aadhaar"), F.regexp_replace(text, VID, " ")), split=F.when(of("npr_letter"), split))
    rows = R.step(rows, [*kept, "word", "flat", "bare"], head=F.upper(F.trim(F.col("split")[0])), tail=F.trim(F.get("split", F.lit(1))))
    places = range(max(map(len, sought.values()), default=0))
    at = lambda s, k: list(s.values())[k] if k < len(s) else None
    made = {f"_{k}": F.coalesce(*[F.when(kind == t, at(s, k)) for t, s in sought.items() if at(s, k) is not None]) for k in places}
    rows = R.step(rows, [*kept, "word"], **made)
    first = F.when(kind == "pan", ~I.holder_ok(F.col("_0"))).otherwise(F.lit(False)) if "pan" in types else F.lit(False)
    one = lambda k: F.when(F.col(f"_{k}").isNotNull(), F.struct((first if k == 0 else F.lit(False)).alias("c"), *order, F.col(f"_{k}").alias("value")))
    facts = [F.min(one(k)).alias(f"_{k}") for k in places]
    if "aadhaar" in types:
        labelled, whole = F.col("word").rlike("DOB|YOB|BIRTH") | text.contains("जन्म"), F.col("_day").isNotNull()
        born = F.when(labelled & whole, 1).when(labelled, 2).when(whole, 3)
        rows = R.step(rows, rows.columns, _day=F.when(kind == "aadhaar", dates.printed_whole(text)), _name=F.when(kind == "aadhaar", extras.name_like(text)))
        rows = R.step(rows, rows.columns, _born=F.when((kind == "aadhaar") & born.isNotNull(), F.struct(born.alias("c"), *order, "top", "left", F.col("_day").alias("date"), _year(text, F.col("_day")).alias("year"))))
        facts += [F.min("_born").alias("dob"), F.collect_list(F.when(F.col("_name"), F.struct("page_no", "bottom", "left", "seq", "text"))).alias("names")]
    if "npr_letter" in types:
        facts.append(F.bool_or((kind == "npr_letter") & F.coalesce(T.norm_text(text).contains("NATIONAL POPULATION REGISTER"), F.lit(False))).alias("npr_title"))
    found = rows.groupBy("doc_id").agg(F.any_value("document_type").alias("document_type"), *facts)
    named = {n: F.when(kind == t, F.col(f"_{k}.value")) for t, s in sought.items() for k, n in enumerate(s)}
    rest = [c for c in ("dob", "npr_title") if c in found.columns]
    return found.select("doc_id", "document_type", *[c.alias(n) for n, c in named.items()], *rest, *([_above().alias("above")] if "aadhaar" in types else []))


def _above() -> Column:
    """The name-like text nearest above the birth date."""
    d = F.col("dob")
    near = F.filter("names", lambda r: (r["page_no"] == d["page_no"]) & (r["bottom"] <= d["top"] + 5))
    return F.array_min(F.transform(near, lambda r: F.struct((d["top"] - r["bottom"]).alias("dy"), F.abs(r["left"] - d["left"]).alias("dx"), r["seq"].alias("seq"), r["text"].alias("text"))))["text"]


def facts(regions: DataFrame, types: list[str]) -> DataFrame:
    """Everything that an extractor projects of documents of ``types``; one row per document.

    ``regions`` have a column document_type: labels and identifiers of a document's own type are searched.
    """
    found = _found(regions, types)
    rows = [r for r in dims.label_rows() if r[0] in types]
    return found.join(layout.best_values(regions, rows), "doc_id", "left") if rows else found


def _relation(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.upper(c), "[^A-Z]", "").rlike("FATHER|HUSBAND|MOTHER"), F.lit(False))


def pan_fields() -> dict[str, Column]:
    """Number labelled and valid, else the first valid, else the first shaped; a name that is the father's is dropped."""
    of = lambda f, c="value": F.col(f"pan__{f}")[c]
    name, father = T.clean_colon(of("name")), T.clean_colon(of("father_name"))
    same = F.coalesce((name == father) & (of("name", "label_seq") == of("father_name", "label_seq")), F.lit(False))
    number = F.when(I.pan_valid(of("pan_number")), I.pan(of("pan_number"))).otherwise(F.col("any_pan"))
    return {"pan_number": number, "name": F.when(~same, name), "father_name": father, "date_of_birth": F.coalesce(dates.printed(of("date_of_birth")), F.col("any_date"))}


def voter_id_fields() -> dict[str, Column]:
    of = lambda f, c="value": F.col(f"voter_id__{f}")[c]
    clean = lambda f: T.after_colon(F.trim(of(f)))
    father, husband = (F.when(_relation(of(f, "label_text")), clean(f)) for f in ("father", "husband"))
    holder = F.when(~_relation(of("name", "label_text")) & ~_relation(of("name")), clean("name"))
    sex = F.upper(of("gender"))
    gender = F.when(sex.contains("FEMALE"), "FEMALE").when(sex.contains("MALE"), "MALE").when(sex.rlike("TRANSGENDER|OTHER"), "TRANSGENDER").when(sex == "F", "FEMALE").when(sex == "M", "MALE")
    kind = F.when(father.isNotNull(), "father").when(husband.isNotNull(), "husband")
    return {"epic_number": F.col("epic_number"), "name": holder, "relation_name": F.coalesce(father, husband), "relation_type": kind, "date_of_birth": dates.printed(of("date_of_birth")), "age": F.when(dates.printed(of("date_of_birth")).isNull(), F.col("any_age")), "gender": gender}


def driving_licence_fields() -> dict[str, Column]:
    """A date may stand in its label's own text."""
    of = lambda f, c="value": F.col(f"driving_licence__{f}")[c]
    date = lambda f: F.coalesce(dates.printed(of(f, "label_text")), dates.printed(of(f)))
    return {"dl_number": F.col("dl_number"), "name": T.clean_colon(of("name"))} | {f: date(f) for f in ("date_of_birth", "issue_date", "validity_date")}


def aadhaar_fields() -> dict[str, Column]:
    return {"aadhaar_number": F.col("aadhaar_number"), "masked_last4": F.when(F.col("aadhaar_number").isNull(), F.col("masked_last4")), "name": F.col("above"), "date_of_birth": F.col("dob.date"), "year_of_birth": F.col("dob.year"), "gender": F.col("any_sex"), "address": F.col("aadhaar__address")["value"], "pincode": F.col("any_pin"), "vid": F.col("vid")}


def npr_letter_fields() -> dict[str, Column]:
    pin = F.regexp_extract("npr_address", r"\b([1-9]\d{5})\b", 1)
    return {"name": F.col("npr_name"), "address": F.col("npr_address"), "issue_date": dates.printed(F.col("npr_date")), "pincode": F.when(pin != "", pin)}


def nrega_fields() -> dict[str, Column]:
    of = lambda f: F.col(f"nrega_job_card__{f}")["value"]
    return {"job_card_number": F.coalesce(I.job_card(of("job_card_number")), F.col("any_card")), "head_of_household": of("head_of_household")} | {f: of(f) for f in ("village", "gram_panchayat", "district")}


#: Fields of each type over ``facts``; ``register_extractor`` replaces or adds one.
FIELDS = {"pan": pan_fields, "aadhaar": aadhaar_fields, "driving_licence": driving_licence_fields, "voter_id": voter_id_fields, "nrega_job_card": nrega_fields, "npr_letter": npr_letter_fields}


def register_extractor(doc_type: str, fields) -> None:
    """fields: () -> columns by name, over ``facts``."""
    FIELDS[doc_type] = fields


def _project(regions: DataFrame, doc_type: str) -> DataFrame:
    fields = FIELDS[doc_type]()
    return facts(regions.withColumn("document_type", F.lit(doc_type)), [doc_type]).select("doc_id", *[c.alias(n) for n, c in fields.items()])


def extract_pan(regions: DataFrame) -> DataFrame:
    return _project(regions, "pan")


def extract_voter_id(regions: DataFrame) -> DataFrame:
    return _project(regions, "voter_id")


def extract_driving_licence(regions: DataFrame) -> DataFrame:
    return _project(regions, "driving_licence")


def extract_aadhaar(regions: DataFrame) -> DataFrame:
    return _project(regions, "aadhaar")


def extract_nrega(regions: DataFrame) -> DataFrame:
    return _project(regions, "nrega_job_card")


def extract_npr_letter(regions: DataFrame) -> DataFrame:
    """Only documents that bear the register's title."""
    rows = facts(regions.withColumn("document_type", F.lit("npr_letter")), ["npr_letter"])
    return rows.filter("npr_title").select("doc_id", *[c.alias(n) for n, c in npr_letter_fields().items()])


def extract_all(regions: DataFrame) -> DataFrame:
    """doc_id and one column per field name of any type, filled by each document's own type (column document_type of ``regions``)."""
    rows = facts(regions, list(FIELDS))
    own = {t: fields() for t, fields in FIELDS.items()}
    names = list(dict.fromkeys(n for fields in own.values() for n in fields))
    pick = lambda n: F.coalesce(*[F.when(F.col("document_type") == t, fields[n].cast("string")) for t, fields in own.items() if n in fields])
    return R.apart(rows, "document_type", ["doc_id", "document_type"], **{n: pick(n) for n in names})
