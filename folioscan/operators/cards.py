"""Whole records of Aadhaar cards and driving licences: address blocks, relations, vocabularies, validity by kind.

Labels of one card kind are searched at a time; blocks are bands under a label, ended by the next label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import dates
from folioscan.functions import identifiers as I
from folioscan.functions import text as T
from folioscan.operators import extract, extras, layout
from folioscan.plans import dims

#: Labels of a licence besides those of ``dims.LABELS``.
LICENCE = {
    ("dl", "name"): ["NAME", "HOLDER S NAME", "HOLDERS NAME", "HOLDER NAME"],
    ("dl", "relation"): ["SON DAUGHTER WIFE OF", "S D W OF", "S O", "D O", "W O", "C O", "SON OF", "DAUGHTER OF", "WIFE OF", "FATHER", "GUARDIAN"],
    ("dl", "date_of_birth"): ["DATE OF BIRTH", "DOB", "BIRTH"],
    ("dl", "issue_date"): ["DATE OF ISSUE", "ISSUE DATE", "DOI", "ISSUE"],
    ("dl", "validity"): ["VALID TILL", "VALID UPTO", "VALID UNTIL", "VALIDITY", "DATE OF EXPIRY", "EXPIRY"],
    ("dl", "validity_nt"): ["VALIDITY NT", "VALID TILL NT", "NON TRANSPORT", "NT"],
    ("dl", "validity_tr"): ["VALIDITY TR", "VALID TILL TR", "TRANSPORT", "TR"],
    ("dl", "blood"): ["BLOOD GROUP", "BG", "BLOOD"],
    ("dl", "vehicles"): ["CLASS OF VEHICLE", "CLASS OF VEHICLES", "COV", "CL OF VEH", "AUTHORISATION TO DRIVE", "AUTHORIZATION TO DRIVE"],
    ("dl", "present"): ["PRESENT ADDRESS", "CURRENT ADDRESS", "TEMPORARY ADDRESS", "TEMP ADDRESS"],
    ("dl", "permanent"): ["PERMANENT ADDRESS", "PERM ADDRESS"],
    ("dl", "address"): ["ADDRESS", "ADD", "ADDR"],
}
#: Words that begin another field of a licence.
OTHER_FIELDS = ["DL NO", "LICENCE NO", "LICENSE NO", "NAME", "DATE OF BIRTH", "DOB", "DATE OF ISSUE", "VALID", "VALIDITY", "BLOOD GROUP", "CLASS OF VEHICLE", "COV", "SIGNATURE", "ISSUING AUTHORITY", "AUTHORITY"]
#: Genders in Hindi.
GENDERS_HINDI = {"पुरुष": "MALE", "महिला": "FEMALE", "स्त्री": "FEMALE", "किन्नर": "TRANSGENDER", "ट्रांसजेंडर": "TRANSGENDER"}


def known_label(c: Column) -> Column:
    """The text is a licence's label and nothing else."""
    return T.norm_text(c).isin(sorted({x for names in LICENCE.values() for x in names}))


def other_label(c: Column) -> Column:
    """The text begins another field."""
    return T.norm_text(c).rlike(f"(^| )({'|'.join(OTHER_FIELDS)})( |$)")


def person(c: Column) -> Column:
    """A name's value: two Latin letters at least, no label."""
    return F.when((F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 2) & ~known_label(c), F.trim(c))


def licence_addresses(regions: DataFrame, found: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, address: the block of the present address, else the permanent, else any: the text beside the label, then lines below
    it up to the next field; each line once."""
    kinds = ["present", "permanent", "address"]
    one = lambda k: F.when(F.col(f"dl__{k}").isNotNull(), F.struct(F.lit(kinds.index(k)).alias("kind"), *[F.col(f"dl__{k}.{c}").alias(c) for c in ("page_no", "label_seq", "label_top", "label_left", "label_bottom", "right", "right_seq", "right_left")]))
    labels = found.select("doc_id", F.explode(F.array_compact(F.array(*map(one, kinds)))).alias("k")).select("doc_id", "k.*")
    drop = F.col("top") - F.col("label_bottom")
    near = (drop > -5) & (drop <= 220) & (F.abs(F.col("left") - F.col("label_left")) <= 320) & (F.length(F.trim("text")) >= 2) & (F.col("seq") != F.col("label_seq")) & ~F.coalesce(F.col("seq") == F.col("right_seq"), F.lit(False))
    cell = F.struct("top", "left", "seq", F.trim("text").alias("text"))
    band = labels.join(regions.select("doc_id", "page_no", "seq", "top", "left", "text"), ["doc_id", "page_no"]).filter(near)
    band = band.groupBy("doc_id", "kind").agg(F.min(F.when(other_label(F.col("text")), F.col("top"))).alias("stop"), F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = labels.join(band, ["doc_id", "kind"], "left")
    none = F.array().cast("array<struct<top:int,left:int,seq:int,text:string>>")
    beside = F.when(F.col("right").isNotNull() & ~other_label(F.col("right")), F.array(F.struct(F.col("label_top").cast("int").alias("top"), F.col("right_left").cast("int").alias("left"), F.col("right_seq").cast("int").alias("seq"), F.trim("right").alias("text")))).otherwise(none)
    below = F.coalesce(F.filter("cells", lambda c: F.col("stop").isNull() | (c["top"] < F.col("stop"))), none)
    lines = F.slice(F.array_distinct(F.transform(F.array_sort(F.concat(beside, below)), lambda c: c["text"])), 1, most)
    whole = F.when(F.size(lines) > 0, F.array_join(lines, ", "))
    return rows.withColumn("block", whole).groupBy("doc_id").agg(F.min_by("block", F.when(F.col("block").isNotNull(), F.col("kind"))).alias("address"))


def extract_licences(regions: DataFrame) -> DataFrame:
    """Eleven fields of every document: number (also split over neighbours), name, relation, dates, validity for private and
    transport use, blood group, vehicle classes, address."""
    found = layout.best_values(regions, dims.rows_of(LICENCE))
    of = lambda f: F.col(f"dl__{f}")
    day = lambda f: F.coalesce(dates.printed(of(f)["label_text"]), dates.printed(of(f)["value"]))
    tokens = extras.vehicle_tokens(F.col("text"))
    everywhere = regions.select("doc_id", "page_no", "seq", tokens.alias("t")).filter(F.size("t") > 0).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "seq", "t"))), lambda r: r["t"]))).alias("all_tokens"))
    rows = regions.select("doc_id").distinct().join(found, "doc_id", "left").join(everywhere, "doc_id", "left").join(extras.split_licence(regions), "doc_id", "left").join(licence_addresses(regions, found), "doc_id", "left")
    generic = F.when(~F.coalesce((of("validity")["label_seq"] == of("validity_tr")["label_seq"]) & (of("validity")["page_no"] == of("validity_tr")["page_no"]), F.lit(False)), day("validity"))
    beside = extras.vehicle_tokens(of("vehicles")["value"])
    vehicles = F.when(F.size(beside) > 0, beside).otherwise(F.col("all_tokens"))
    blood = F.coalesce(*[extras.blood_group(of("blood")[c]) for c in ("right", "below", "label_text")])
    return rows.select(
        "doc_id", "dl_number", person(of("name")["value"]).alias("name"), person(of("relation")["value"]).alias("relation_name"), day("date_of_birth").alias("date_of_birth"), day("issue_date").alias("issue_date"),
        F.coalesce(day("validity_nt"), generic, day("validity_tr")).alias("validity_date"), day("validity_tr").alias("validity_date_transport"), blood.alias("blood_group"), F.when(F.size(vehicles) > 0, F.array_join(vehicles, ", ")).alias("class_of_vehicle"), "address",
    )


def aadhaar_addresses(regions: DataFrame, found: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, address: up to six lines on the label's row or within 300 pixels below it, Hindi lines and bare numbers left out;
    without any, the label's value."""
    label = F.col("aadhaar__address")
    labels = found.filter(label.isNotNull()).select("doc_id", *[label[c].alias(c) for c in ("page_no", "label_seq", "label_top", "label_bottom", "value")])
    text = F.trim("text")
    row = (F.col("bottom") > F.col("label_top")) & (F.col("top") < F.col("label_bottom"))
    below = (F.col("top") >= F.col("label_bottom") - 10) & (F.col("top") - F.col("label_bottom") <= 300)
    number = ~text.rlike(r"\p{L}") & (F.length(F.regexp_replace(text, r"\P{Nd}", "")) >= 8)
    fits = (F.col("seq") != F.col("label_seq")) & (row | below) & (T.letters_share(text, r"ऀ-ॿ") <= 0.5) & ~number & (F.length(text) >= 2)
    lines = labels.join(regions.select("doc_id", "page_no", "seq", "top", "bottom", "text"), ["doc_id", "page_no"]).filter(fits)
    lines = lines.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("top", "seq", text.alias("text")))), 1, most).alias("lines"))
    return labels.join(lines, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("lines", lambda x: x["text"]), ", "), "value").alias("address"))


def extract_aadhaar_cards(regions: DataFrame) -> DataFrame:
    """Eleven fields of every document. A virtual id is taken out before the number is sought; a masked number gives its last four
    digits only; the name stands above the birth date, on a front side without one it is the topmost."""
    text, word = F.col("text"), F.col("word")
    latin = F.concat(F.lit(" "), F.regexp_replace(word, "[^A-Z]", " "), F.lit(" "))
    sex = F.coalesce(*[F.when(latin.contains(f" {g} "), g) for g in ("MALE", "FEMALE", "TRANSGENDER")], *[F.when(text.contains(h), g) for h, g in GENDERS_HINDI.items()])
    sex = F.when(word.contains("MALE") | word.contains("TRANSGENDER") | word.rlike(r"[^\x00-\x7F]"), sex)
    rows = regions.withColumns({"word": F.upper("text"), "whole": F.when(text.rlike("[0-9]"), dates.printed_whole(text)), "like": extras.name_like(text)})
    labelled, whole = word.rlike("DOB|YOB|BIRTH") | text.contains("जन्म"), F.col("whole")
    rows = rows.withColumns({"born": F.when(labelled & whole.isNotNull(), 1).when(labelled, 2).when(whole.isNotNull(), 3), "sex": sex})
    year, born = F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1), F.col("born")
    # few rows hold a fact; what an aggregate gathers is made before it, where code is compiled
    cell = F.struct("page_no", "seq", F.when(F.trim("text") != "", text).alias("text"), F.when(born.isNotNull(), F.struct(born.alias("rank"), "page_no", "seq", "top", "left", whole.alias("day"), F.when(year != "", year).alias("year"))).alias("birth"), "sex", F.when(F.col("like"), F.struct("page_no", "top", "seq", F.trim("text").alias("text"), "left", "bottom")).alias("like"))
    cells = lambda f: F.array_compact(F.col("cells")[f])
    facts = rows.select("doc_id", cell.alias("cell")).groupBy("doc_id").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    facts = facts.select("doc_id", F.array_join("cells.text", " ").alias("joined"), F.get(cells("sex"), F.lit(0)).alias("gender"), F.array_min("cells.birth").alias("b"), cells("like").alias("names")).withColumn("topmost", F.array_min("names")["text"])
    above = F.transform(F.filter("names", lambda n: (n["page_no"] == F.col("b.page_no")) & (n["bottom"] <= F.col("b.top") + 5)), lambda n: F.struct((F.col("b.top") - n["bottom"]).alias("dy"), F.abs(n["left"] - F.col("b.left")).alias("dx"), n["seq"].alias("seq"), n["text"].alias("text")))
    facts = facts.withColumn("above", F.array_min(above)["text"]).drop("names")
    found = layout.best_values(regions, [r for r in dims.label_rows() if r[:2] == ("aadhaar", "address")])
    rows = facts.join(found, "doc_id", "left").join(aadhaar_addresses(regions, found), "doc_id", "left")
    vid_like = r"\b\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b"
    vid = F.regexp_replace(F.regexp_extract("joined", vid_like, 0), r"\D", "")
    bare = F.regexp_replace("joined", vid_like, " ")
    rows = rows.withColumns({"bare": bare, "vid": F.when(vid != "", F.concat_ws(" ", *[F.substring(vid, k, 4) for k in (1, 5, 9, 13)]))})
    number, tail = I.aadhaar(F.col("bare")), I.aadhaar_last4(F.col("bare"))
    front = (F.col("b").isNotNull() | F.col("gender").isNotNull()) & F.col("aadhaar__address").isNull()
    pin = F.regexp_extract("address", r"\b(\d{6})\b", 1)
    return rows.select(
        "doc_id", number.alias("aadhaar_number"), F.coalesce("above", F.when(front, F.col("topmost"))).alias("name"), F.col("b.day").alias("date_of_birth"), F.when(F.col("b.day").isNull(), F.col("b.year")).alias("year_of_birth"), "gender", "address",
        F.when(pin != "", pin).alias("pincode"), I.aadhaar_valid(F.col("bare")).alias("checksum_valid"), (number.isNull() & tail.isNotNull()).alias("aadhaar_masked"), F.coalesce(F.substring(number, -4, 4), tail).alias("aadhaar_last4"), "vid",
    )


#: Labels of a voter's card.
VOTER = {
    ("voter", "name"): ["ELECTOR S NAME", "ELECTORS NAME", "ELECTOR NAME", "NAME OF ELECTOR", "NAME"],
    ("voter", "father"): ["FATHER S NAME", "FATHERS NAME", "FATHER NAME", "NAME OF FATHER", "FATHER"],
    ("voter", "husband"): ["HUSBAND S NAME", "HUSBANDS NAME", "HUSBAND NAME", "NAME OF HUSBAND", "HUSBAND"],
    ("voter", "mother"): ["MOTHER S NAME", "MOTHERS NAME", "MOTHER NAME", "NAME OF MOTHER", "MOTHER"],
    ("voter", "gender"): ["SEX", "GENDER"],
    ("voter", "date_of_birth"): ["DATE OF BIRTH", "DOB"],
    ("voter", "age"): ["AGE AS ON", "AGE"],
}
RELATIONS = ["father", "husband", "mother"]
#: Genders in Hindi on a voter's card, in the order in which they are looked for.
VOTER_HINDI = {"FEMALE": "महिला", "MALE": "पुरुष", "TRANSGENDER": "अन्य"}


def letters_of(c: Column) -> Column:
    """A to Z of a text in capitals, nothing else."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def voter_gender(c: Column) -> Column:
    """Gender by a word within the text, else by a Hindi word, else by a lone letter."""
    word = F.upper(c)
    named = F.when(word.contains("FEMALE"), "FEMALE").when(word.contains("MALE"), "MALE").when(word.contains("TRANSGENDER") | word.contains("OTHER"), "TRANSGENDER")
    hindi = F.coalesce(*[F.when(c.contains(h), g) for g, h in VOTER_HINDI.items()])
    lone = F.coalesce(*[F.when(letters_of(c) == g[0], g) for g in VOTER_HINDI])
    return F.coalesce(named, hindi, lone)


def extract_voter_cards(regions: DataFrame) -> DataFrame:
    """Seven fields of every document: number, name, relation by name and kind, birth date, age where that is missing, gender.

    A relation's label must hold its own word, and father goes before husband before mother. Age stands beside or under its label, in the
    label's own text, in any text with the word AGE, or behind that word in the document's joined text. Gender is its label's value,
    else the first text that is a gender by itself or holds its Hindi word.
    """
    text = F.trim("text")
    number = I.epic_in(I.compact(F.col("text")))
    aged = extract.age(F.col("text"))
    lone = reduce(lambda a, b: a | b, [text.contains(h) for h in VOTER_HINDI.values()]) | letters_of(text).isin(*VOTER_HINDI, *[g[0] for g in VOTER_HINDI])
    made = regions.withColumns({"gender": F.when(lone, voter_gender(text)), "number": number, "aged": F.when(F.col("text").rlike(r"(?i)\bAGE\b"), aged)})
    made = made.select("doc_id", F.struct("page_no", "seq", F.when(text != "", F.col("text")).alias("text"), "number", "aged", "gender").alias("cell"))
    facts = made.groupBy("doc_id").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    first = lambda f: F.get(F.array_compact(F.col("cells")[f]), F.lit(0))
    facts = facts.select("doc_id", first("number").alias("epic_number"), first("aged").alias("any_age"), first("gender").alias("any_gender"), F.array_join("cells.text", " ").alias("joined"))
    rows = facts.join(layout.best_values(regions, dims.rows_of(VOTER)), "doc_id", "left")
    of = lambda f: F.col(f"voter__{f}")
    near = lambda f: F.coalesce(of(f)["right"], of(f)["below"])
    relation_label = lambda c: F.coalesce(letters_of(c).rlike("FATHER|HUSBAND|MOTHER"), F.lit(False))
    related = {f: F.when(letters_of(of(f)["label_text"]).contains(f.upper()), T.after_colon(F.trim(near(f)))) for f in RELATIONS}
    name = F.when(~relation_label(of("name")["label_text"]) & ~relation_label(near("name")), T.after_colon(F.trim(near("name"))))
    born = F.coalesce(dates.printed(of("date_of_birth")["value"]), dates.printed(near("date_of_birth")))
    labelled = F.when(letters_of(of("age")["label_text"]).contains("AGE"), F.coalesce(extract.age(near("age")), extract.age(of("age")["label_text"])))
    tail = F.regexp_extract("joined", r"(?is)\bAGE\b.*", 0)
    return rows.select(
        "doc_id",
        "epic_number",
        name.alias("name"),
        F.coalesce(*related.values()).alias("relation_name"),
        F.coalesce(*[F.when(c.isNotNull(), f) for f, c in related.items()]).alias("relation_type"),
        born.alias("date_of_birth"),
        F.when(born.isNull(), F.coalesce(labelled, "any_age", extract.age(tail))).alias("age"),
        F.coalesce(voter_gender(of("gender")["value"]), voter_gender(near("gender")), "any_gender").alias("gender"),
    )
