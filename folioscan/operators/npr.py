"""Population-register letters: bilingual labels with inline, right or lower values, and an address block.

Labels are few and letters are first told from other documents, so label scores are plain expressions over a letter's regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import dates
from folioscan.functions import text as T
from folioscan.operators import layout
from folioscan.operators import regions as R
from folioscan.plans import dims
from folioscan.sources.staging import staged

#: Signs stripped from a value's ends.
ENDS = " \t:;,–—-"


def npr_letters(regions: DataFrame) -> DataFrame:
    """doc_id of documents with the register's title in their joined text, or its acronym and an issuer."""
    ordered = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page_no", "seq", "text"))))
    joined = regions.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("joined"))
    plain, raw = T.norm_label(F.col("joined")), F.col("joined")
    title = plain.contains("NATIONAL POPULATION REGISTER") | raw.contains(dims.NPR_TITLE_HINDI)
    issuer = plain.contains("REGISTRAR GENERAL") | plain.contains("CENSUS COMMISSIONER")
    for phrase in dims.NPR_ISSUERS_HINDI:
        issuer = issuer | raw.contains(phrase)
    return joined.filter(title | (plain.rlike(r"\bNPR\b") & issuer)).select("doc_id")


def forms(text: Column) -> dict[str, Column]:
    """What labels are compared with, of a text."""
    prefix = F.split(text, "[:：]", 2)[0]
    signs = F.lit(" :.-/")
    return {"raw": text, "whole": T.norm_label(text), "head": T.norm_label(prefix), "bare": F.btrim(text, signs), "bare_head": F.btrim(prefix, signs)}


def score_of(form, english: list[str], hindi: list[str]) -> Column:
    """``label_score`` of a text whose forms are made; ``form`` gives one by its name."""
    raw, whole, head, bare, bare_head = map(form, ("raw", "whole", "head", "bare", "bare_head"))
    found = []
    for label in english:
        hit = F.when((head == label) & (whole != label), 30_000 + len(label)).when(whole == label, 20_000 + len(label))
        found.append(hit if label in dims.NPR_GENERIC else hit.when(F.concat(F.lit(" "), whole, F.lit(" ")).contains(f" {label} "), 10_000 + len(label)))
    for label in hindi:
        hit = F.when((bare_head == label) & (bare != label), 30_000 + len(label)).when(bare == label, 20_000 + len(label))
        found.append(hit if label in dims.NPR_GENERIC else hit.when(raw.contains(label), 10_000 + len(label)))
    return F.greatest(F.lit(0), *[F.coalesce(f, F.lit(0)) for f in found])


def label_score(text: Column, english: list[str], hindi: list[str]) -> Column:
    """0 without label; a label before a colon beats one alone, that beats one contained; longer labels beat shorter ones.

    What all labels are compared with is made once for a text: it is bound by a lambda, not repeated for each label.
    """
    made = F.struct(*[c.alias(n) for n, c in forms(text).items()])
    return F.get(F.transform(F.array(made), lambda form: score_of(lambda n: form[n], english, hindi)), F.lit(0))


def field_label(text: Column) -> Column:
    """The text before a colon is any label: one of the longer ones within it, or a generic one alone. One pattern a script, no lambda."""
    prefix = F.split(text, "[:：]", 2)[0]
    listed = lambda k, generic: [x for pair in dims.NPR_LABELS.values() for x in pair[k] if (x in dims.NPR_GENERIC) == generic]
    english = T.norm_label(prefix).rlike(f"(?:^| )(?:{'|'.join(listed(0, False))})(?: |$)|^(?:{'|'.join(listed(0, True))})$")
    hindi = prefix.rlike("|".join(listed(1, False))) | F.btrim(prefix, F.lit(" :.-/")).isin(*listed(1, True))
    return F.coalesce(english | hindi, F.lit(False))


def address_footer(text: Column) -> Column:
    return T.norm_label(text).rlike("|".join(dims.NPR_FOOTERS))


def squeezed(text: Column) -> Column:
    """White space to single blanks, no signs at the ends; null when empty."""
    out = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(ENDS))
    return F.when(out != "", out)


def clean(text: Column) -> Column:
    """A value; null where it is a label itself."""
    out = squeezed(text)
    return F.when(~field_label(out), out)


def best_labels(regions: DataFrame) -> DataFrame:
    """doc_id, page_no, field, inline, and the best label's place.

    A region's forms are made in one step and scored in the next, all compiled; only regions with a label are looked into for a value
    behind a colon or a spaced dash.
    """
    place = ["seq", "left", "top", "right", "bottom"]
    kept, text = ["doc_id", "page_no", "text", "confidence", *place], F.col("text")
    rows = R.step(regions, kept, **forms(text))
    rows = R.step(rows, kept, **{f"score_{f}": score_of(F.col, e, h) for f, (e, h) in dims.NPR_LABELS.items()})
    rows = rows.filter(F.greatest(*[F.col(f"score_{f}") for f in dims.NPR_LABELS]) > 0)
    kept += [f"score_{f}" for f in dims.NPR_LABELS]
    by_colon, by_dash = F.split(text, "[:：]", 2), F.split(text, r"\s+[–—-]\s+", 2)
    rows = R.step(rows, kept, pieces=F.when(F.size(by_colon) == 2, by_colon).when(F.size(by_dash) == 2, by_dash))
    rows = R.step(rows, kept, **forms(F.col("pieces")[0]), rest=squeezed(F.col("pieces")[1]))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"score_{f}").alias("score"), F.when(score_of(F.col, e, h) > 0, F.col("rest")).alias("inline")) for f, (e, h) in dims.NPR_LABELS.items()])
    rows = rows.select("doc_id", "page_no", "confidence", *place, F.explode(cells).alias("c")).select("doc_id", "page_no", "confidence", *place, "c.*").filter("score > 0")
    one = F.struct("page_no", "inline", *[F.col(c).alias(f"label_{c}") for c in place])
    return rows.groupBy("doc_id", "field").agg(F.max_by(one, F.struct("score", "confidence", -F.col("page_no"), -F.col("seq"))).alias("b")).select("doc_id", "field", "b.*")


def labelled(regions: DataFrame) -> DataFrame:
    """``best_labels`` with the values beside and below them."""
    return layout.values_at(best_labels(regions).withColumn("doc_type", F.lit("npr_letter")), regions)


def address_blocks(labels: DataFrame, regions: DataFrame, most: int = 7) -> DataFrame:
    """doc_id, address: the inline text, the one to the right, then lines of the column below up to a label or footer."""
    own = labels.filter("field = 'address'")
    below = F.col("top") - F.col("label_bottom")
    ends = field_label(F.col("text")) | address_footer(F.col("text"))
    band = own.join(regions, layout.PAGE).filter((F.col("seq") != F.col("label_seq")) & (below >= -4))
    beside = F.when(~field_label(F.col("right")), clean(F.col("right")))
    near = (below <= 320) & (F.abs(F.col("left") - F.col("label_left")) <= 260) & ~F.coalesce(F.col("seq") == F.col("right_seq"), F.lit(False))
    cell = F.struct("top", "left", "seq", clean(F.col("text")).alias("text"))
    met = band.groupBy("doc_id").agg(F.min(F.when(ends, F.col("top"))).alias("stop"), F.array_sort(F.collect_list(F.when(near, cell))).alias("cells"))
    lines = F.transform(F.filter("cells", lambda c: (F.col("stop").isNull() | (c["top"] < F.col("stop"))) & c["text"].isNotNull()), lambda c: c["text"])
    rows = own.select("doc_id", F.array_compact(F.array(F.col("inline"), beside)).alias("first")).join(met.select("doc_id", lines.alias("lines")), "doc_id", "left")
    whole = F.slice(F.array_distinct(F.concat("first", F.coalesce("lines", F.array().cast("array<string>")))), 1, most)
    return rows.select("doc_id", F.when(F.size(whole) > 0, F.array_join(whole, ", ")).alias("address"))


def extract_npr_fields(regions: DataFrame) -> DataFrame:
    """doc_id, reference_number, name, address, pincode, issue_date of documents with the register's evidence."""
    regions = staged(regions.join(npr_letters(regions), "doc_id", "left_semi"), "npr-regions")  # read by every step
    letters = regions.select("doc_id").distinct()
    labels = staged(labelled(regions), "npr-labels")
    value = F.when(F.col("inline").isNotNull(), clean(F.col("inline"))).otherwise(clean(F.coalesce("right", "below")))
    wide = labels.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, value)).alias(f"v_{f}") for f in dims.NPR_LABELS if f != "address"])
    rows = letters.join(wide, "doc_id", "left").join(address_blocks(labels, regions), "doc_id", "left")
    pin = lambda c: F.when(F.regexp_extract(c, r"\b([1-9]\d{5})\b", 1) != "", F.regexp_extract(c, r"\b([1-9]\d{5})\b", 1))
    name, reference = F.col("v_name"), F.col("v_reference_number")
    return rows.select("doc_id", F.when((F.length(reference) <= 80) & reference.rlike(r"[\p{L}\p{N}]"), reference).alias("reference_number"), F.when((F.length(name) <= 160) & name.rlike(r"\p{L}"), name).alias("name"), "address", F.coalesce(pin(F.col("address")), pin(F.col("v_pincode"))).alias("pincode"), dates.letter_date(F.col("v_issue_date")).alias("issue_date"))
