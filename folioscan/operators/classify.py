"""Page and document types from keyword and identifier evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import identifiers as I
from folioscan.functions import text as T
from folioscan.operators import regions as R
from folioscan.plans import dims


def keyword_matches(regions: DataFrame) -> DataFrame:
    """doc_id, doc_type, evidence, keyword: distinct keywords of each document, matched region by region."""
    spark = regions.sparkSession
    found = R.grams(regions, [r[2] for r in dims.keyword_rows()], T.norm_text)
    return found.join(F.broadcast(dims.keyword_dim(spark)), F.col("gram") == F.col("keyword")).select("doc_id", "doc_type", "evidence", "keyword").distinct()


def without_nested(matches: DataFrame) -> DataFrame:
    """Drops a keyword that lies inside another matched keyword of its list."""
    nested = F.broadcast(dims.nesting_dim(matches.sparkSession))
    covered = matches.join(nested, (matches.keyword == nested.long) & (matches.doc_type == nested.doc_type) & (matches.evidence == nested.evidence)).select(matches.doc_id, matches.doc_type, matches.evidence, F.col("short").alias("keyword"))
    return matches.join(covered, ["doc_id", "doc_type", "evidence", "keyword"], "left_anti")


def _kept(held: Column, doc_type: str, evidence: str) -> Column:
    """How many keywords of a list ``held`` has between blanks; one inside another held one is left out."""
    has = lambda k: held.contains(f" {k} ")
    longer = lambda k: [b for t, e, a, b in dims.nesting_rows() if (t, e, a) == (doc_type, evidence, k)]
    return reduce(lambda a, b: a + b, [reduce(lambda a, b: a & ~has(b), longer(k), has(k)).cast("int") for k in dims.KEYWORDS[doc_type, evidence]])


def _held(plain: Column) -> Column:
    """Normalised texts as one, a bar between: a phrase between blanks lies within one of them."""
    return F.concat(F.lit("| "), F.array_join(plain, " | "), F.lit(" |"))


def _plain(norm: Column) -> Column:
    return F.when(norm != "", norm)


def evidence_counts(regions: DataFrame) -> DataFrame:
    """doc_id, doc_type, evidence, n: keywords of each document, nested ones left out. Keywords are few, so each document's texts are gathered
    once and searched for all of them."""
    docs = regions.select("doc_id", _plain(T.norm_text(F.col("text"))).alias("plain")).groupBy("doc_id").agg(F.collect_list("plain").alias("plain")).select("doc_id", _held(F.col("plain")).alias("held"))
    lists = F.array(*[F.struct(F.lit(t).alias("doc_type"), F.lit(e).alias("evidence"), _kept(F.col("held"), t, e).cast("long").alias("n")) for t, e in dims.KEYWORDS])
    return docs.select("doc_id", F.explode(lists).alias("c")).select("doc_id", "c.*").filter("n > 0")


def across(joined: Column, phrases: list[str]) -> Column:
    """How many phrases a document's joined text holds at word boundaries, over the borders of its regions, too. None of ``phrases`` lies in
    another. Only texts with a phrase's first word are normalised."""
    firsts = sorted({p.split(" ")[0] for p in phrases})
    padded = F.concat(F.lit(" "), T.norm_text(joined), F.lit(" "))
    counted = F.aggregate(F.array(padded), F.lit(0), lambda n, t: n + reduce(lambda a, b: a + b, [t.contains(f" {p} ").cast("int") for p in phrases]))
    return F.when(F.upper(joined).rlike("|".join(firsts)), counted).otherwise(F.lit(0))


def _facts(regions: DataFrame, carried: list[str]) -> DataFrame:
    """One row a document: shapes of numbers, joined text, normalised texts (``held``: apart, ``joint``: over their borders), zone, from one
    aggregate over the regions. ``carried``: [], or ["regions"], an array of the document's regions as they are."""
    whole = F.struct(*[c for c in regions.columns if c != "doc_id"]).alias("regions")
    text, flat = F.col("text"), F.col("flat")
    rows = regions.withColumns({"norm": T.norm_text(text), "line": R.mrz_line(text)}).withColumn("flat", F.replace("norm", F.lit(" "), F.lit("")))
    # an aggregate evaluates what it gathers without compiled code, so that is made before it
    cell = F.struct("page_no", "seq", F.when(F.trim("text") != "", text).alias("text"), _plain(F.col("norm")).alias("plain"), "bottom", "line")
    shaped = flat.rlike("[A-Z]{2}[0-9]{4}")  # any of the three shapes has it
    shapes = {"pan": I.PAN, "dl": I.LICENCE, "epic": I.EPIC}
    rows = rows.select("doc_id", "line", cell.alias("cell"), *[whole for _ in carried], *[(shaped & flat.rlike(p)).alias(n) for n, p in shapes.items()])
    rows = rows.groupBy("doc_id").agg(*[F.bool_or(n).alias(n) for n in shapes], F.count_if("line").alias("lines"), F.collect_list("cell").alias("cells"), *[F.collect_list(c).alias(c) for c in carried]).withColumn("cells", F.sort_array("cells"))
    own, cells = ["doc_id", *carried, *shapes], F.col("cells")
    on = lambda p: F.filter(cells, lambda c: c["page_no"] == p)
    zone = lambda c: F.coalesce(c["line"], F.lit(False)) & (c["bottom"] >= F.array_max(on(c["page_no"])["bottom"]) * 0.6)
    zones = F.filter(cells, zone)["page_no"]
    mrz = F.coalesce(F.when(F.col("lines") >= 2, F.size(zones) > F.size(F.array_distinct(zones))), F.lit(False))
    rows = R.step(rows, own, joined=F.array_join(cells["text"], " "), held=_held(cells["plain"]), mrz=mrz)
    return R.step(rows, [*own, "joined", "held", "mrz"], uid=I.aadhaar(F.col("joined")), joint=F.replace(F.col("held"), F.lit(" | "), F.lit(" ")))


def _scored(regions: DataFrame, carried: list[str]) -> DataFrame:
    """doc_id, what is carried, scores: doc_type, score, reasons of every type in order, null without evidence. All documents are in it; nothing is joined."""
    rows, kept = _facts(regions, carried), ["doc_id", *carried, "pan", "dl", "epic", "mrz", "uid"]
    joined = F.col("joined")
    hindi = lambda *words: F.coalesce(reduce(lambda a, b: a | b, [joined.contains(w) for w in words]), F.lit(False))
    over = lambda t: _kept(F.col("joint"), t, "title")
    rows = R.step(rows, [*kept, "joined", "joint"], uid_ok=I.aadhaar_ok(F.col("uid")), **{f"{t}__{e}": _kept(F.col("held"), t, e) for t, e in dims.KEYWORDS})
    rows = R.step(
        rows,
        [*kept, "uid_ok", *[f"{t}__{e}" for t, e in dims.KEYWORDS]],
        title=F.greatest("nrega_job_card__title", over("nrega_job_card")),
        title_hindi=hindi(*dims.NREGA_TITLES_HINDI),
        rural_hindi=hindi(dims.NREGA_CARD_HINDI) & hindi(*dims.NREGA_CONTEXT_HINDI),
        npr=(F.col("npr_letter__title") > 0) | (over("npr_letter") > 0) | hindi(dims.NPR_TITLE_HINDI),
    )
    n = lambda t, e="keyword": F.col(f"{t}__{e}")
    title, npr = F.col("title"), F.col("npr")
    titled = (title > 0) | F.col("title_hindi")
    card, context, acronym = (n("nrega_job_card", e) for e in ("card", "context", "acronym"))
    rural = ((acronym > 0) & ((card > 0) | (context > 0))) | ((card > 0) & (context > 0)) | F.col("rural_hindi")
    npr_weak = (n("npr_letter", "acronym") > 0) & (n("npr_letter", "issuer") > 0)
    words = lambda t, prefix: (n(t) > 0, 2 * n(t), F.concat(F.lit(f"{prefix}_KEYWORDS_"), n(t).cast("string")))
    evidence = {
        "pan": [words("pan", "PAN"), (F.col("pan"), 3, "PAN_FORMAT")],
        "aadhaar": [words("aadhaar", "AADHAAR"), (F.col("uid").isNotNull(), 3, "AADHAAR_NUMBER"), (F.col("uid_ok"), 2, "AADHAAR_CHECKSUM_VALID")],
        "driving_licence": [words("driving_licence", "DL"), (F.col("dl"), 3, "DL_FORMAT")],
        "voter_id": [words("voter_id", "VOTER"), (F.col("epic"), 3, "EPIC_FORMAT")],
        "nrega_job_card": [(titled, 9 + F.least(title, F.lit(2)), "NREGA_EXPLICIT_TITLE"), (~titled & rural, 8, "NREGA_JOB_CARD_CONTEXT")],
        "npr_letter": [(npr, 9, "NPR_EXPLICIT_TITLE"), (~npr & npr_weak, 8, "NPR_ISSUER_CONTEXT")],
        "passport": [words("passport", "PASSPORT"), (F.col("mrz"), 4, "MRZ_DETECTED")],
    }

    def judged(k: int, t: str) -> Column:
        total, why = F.lit(0), []
        for holds, score, reason in evidence[t]:
            total = total + F.when(holds, score if not isinstance(score, int) else F.lit(score)).otherwise(0)
            why.append(F.when(holds, reason if not isinstance(reason, str) else F.lit(reason)))
        return F.when(total > 0, F.struct(total.cast("int").alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("doc_type"), F.concat_ws(",", *why).alias("reasons")))

    return R.step(rows, ["doc_id", *carried], scores=F.array(*[judged(k, t) for k, t in enumerate(dims.TYPES)]))


def document_scores(regions: DataFrame) -> DataFrame:
    """doc_id, doc_type, score, reasons of every type with evidence; one aggregate on doc_id, no joins."""
    return _scored(regions, []).select("doc_id", F.explode("scores").alias("s")).filter("s is not null").select("doc_id", "s.doc_type", "s.score", "s.reasons")


def classify_documents(regions: DataFrame, with_regions: bool = False) -> DataFrame:
    """doc_id, document_type, confidence, reasons; documents without evidence are unknown. ``with_regions`` adds an array of the document's regions."""
    carried = ["regions"] if with_regions else []
    docs = R.step(_scored(regions, carried), ["doc_id", *carried], b=F.array_max("scores"))
    known = F.col("b.score") >= 2
    return docs.select("doc_id", *carried, F.when(known, F.col("b.doc_type")).otherwise("unknown").alias("document_type"), F.when(F.col("b").isNull(), F.lit(0.2)).when(~known, F.lit(0.3)).otherwise(F.bround(F.least(0.5 + 0.12 * F.col("b.score"), F.lit(0.98)), 3)).alias("confidence"), F.when(F.col("b").isNull(), "NO_DOCUMENT_HINTS").when(~known, "WEAK_DOCUMENT_HINTS").otherwise(F.col("b.reasons")).alias("reasons"))


def classify_pages(regions: DataFrame) -> DataFrame:
    """doc_id, page_no, page_type, confidence and hint counts of passport pages."""
    spark = regions.sparkSession
    found = R.grams(regions, [r[1] for r in dims.hint_rows()], T.norm_text).join(F.broadcast(dims.hint_dim(spark)), F.col("gram") == F.col("hint"))
    hints = found.groupBy("doc_id", "page_no").agg(F.count_distinct(F.when(F.col("kind") == "biodata", F.col("hint"))).alias("biodata"), F.count_distinct(F.when(F.col("kind") == "non_biodata", F.col("hint"))).alias("non_biodata"))
    pages = R.mrz_pages(regions).join(hints, ["doc_id", "page_no"], "left").fillna(0, ["biodata", "non_biodata"])
    b, n, m = F.col("biodata"), F.col("non_biodata"), F.col("has_mrz")
    kind = F.when(m | (b >= 2), "biodata").when(n >= 2, "non_biodata").when((b + n) > 0, "weak").otherwise("unknown")
    confidence = F.when(kind == "biodata", F.least(0.55 + 0.12 * F.least(b, F.lit(3)) + F.when(m, 0.18).otherwise(0.0), F.lit(0.99))).when(kind == "non_biodata", F.least(0.62 + 0.1 * F.least(n, F.lit(3)), F.lit(0.98))).when(kind == "weak", F.lit(0.45)).otherwise(F.lit(0.2))
    return pages.select("doc_id", "page_no", "biodata", "non_biodata", "has_mrz", kind.alias("page_type"), F.bround(confidence, 3).alias("confidence"))
